"""What the operators share: the folder for intermediate tables, and names that cannot clash."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_scopes: list[list[str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only where the session names none and all runs on one machine (tests) a temporary folder is made and removed at exit.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "root" not in _own:
        _own["root"] = tempfile.mkdtemp(prefix="quiverlog-")
        atexit.register(shutil.rmtree, _own["root"], True)
    return f"file://{_own['root']}"


def fresh_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_root(spark)}/quiverlog/{tag}-{uuid.uuid4().hex}"
    for made in _scopes[-1:]:
        made.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables made inside are removed at the end: what is read afterwards must have been written to a path made outside."""
    made: list[str] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.remove(made)
        for path in made:
            drop_path(spark, path)


def stored(df: DataFrame, tag: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    return written(df, fresh_path(spark, tag), compression)


def written(df: DataFrame, path: str, compression: str = "zstd") -> DataFrame:
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a finished intermediate table through Hadoop's file system, wherever it is."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def modest_batches(spark: SparkSession) -> None:
    """Rows of one Arrow batch: Spark's 10,000 whole texts at once are too many for a worker's memory; a value set by the user stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "512")


def own_name(df: DataFrame, name: str) -> str:
    """A column name that no column of ``df`` has, upper or lower case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_{uuid.uuid4().hex[:6]}"
    return name


def partitions_for(df: DataFrame, rows: int, per_partition: int) -> int:
    """As many partitions as the session deals, more where each would hold over ``per_partition`` rows."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_partition))


def documents_of(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_bytes(column) -> "F.Column":
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def text_keys(text: F.Column) -> list[F.Column]:
    """key_a and key_b, two 64-bit hashes that stand for a text; null is the empty text.

    The number comes first: hashed behind the text it would only mix the text's one 64-bit hash once more, in both alike.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(F.lit(1), text).alias("key_a"), F.xxhash64(F.lit(2), text).alias("key_b")]
