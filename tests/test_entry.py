import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_every_oracle_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_works_without_the_optional_parts(tmp_path):
    shutil.copytree(ROOT / "quiverlog", tmp_path / "quiverlog", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'edge_two_hop' in q and 'pipeline' not in q and not any(x.startswith('op1') for x in q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) >= 50


def test_nothing_else_imports_the_optional_parts():
    for path in (ROOT / "quiverlog").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
