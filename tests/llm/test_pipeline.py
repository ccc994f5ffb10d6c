"""The pipeline's stages, each on what the one before kept, against brute force."""

from collections import Counter

import numpy as np
import public_tokenizers

import corpus_pipeline
from quiverlog.llm import quality_net
from quiverlog.llm.encoding import load_tokenizer
from tests.llm.helpers import documents, prose, words
from tests.llm.test_archive_and_tokens import check_packing
from tests.llm.test_duplicates import brute_classes, edited
from tests.llm.test_text_operators import brute_contamination


def corpus():
    bad = lambda i: "|".join(x.upper() for x in words(i, 60))
    texts = [(i, prose(i, 80) if i % 4 else bad(i)) for i in range(160)]
    base, passage, item = prose(900, 200), prose(901, 70), prose(902, 30)
    texts += [(200 + k, edited(base, k % 3, k)) for k in range(6)] + [(210, base), (211, base)]
    texts += [(220 + k, f"{prose(910 + k, 90)} {passage} {prose(930 + k, 90)}") for k in range(4)]
    texts += [(240, f"{prose(940, 40)} {item} {prose(941, 40)}"), (241, prose(942, 900) + " " + " ".join(item.split()[:13])), (250, None), (251, "")]
    return texts, [(1, item), (2, prose(903, 20))]


def cut_repeats(rows):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i : i + 200] for i in range(len(b) - 199))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        out.append((d, t if not gone.any() else np.frombuffer(b, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")))
    return out


def test_stages_equal_brute_force(spark, tmp_path):
    texts, items = corpus()
    docs = documents(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(160)], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality_classifier", "near_duplicates", "repeated_strings", "decontamination", "packing"]

    rows = spark.read.parquet(f"{tmp_path}/documents.parquet")
    expected = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r["doc_id"], r["text"]) for r in rows.collect()]
        result = stage(spark, rows, str(tmp_path))
        if k < 4:
            assert result.columns == docs.columns, name
            result.write.parquet(f"{tmp_path}/stage{k}")
            rows = spark.read.parquet(f"{tmp_path}/stage{k}")
            found = sorted(((r["doc_id"], r["text"]) for r in rows.collect()))
        if k == 0:
            good = {r["doc_id"] for r in quality_net.quality_scores(docs, labels).filter("predicted = 1").collect()}
            expected = [x for x in before if x[0] in good]
            assert sum(i % 4 == 0 for i in good if i < 160) <= 2 and {i for i in range(160) if i % 4} <= good | {0}
        elif k == 1:
            kept = {c for _, c in brute_classes(before)}
            expected = [x for x in before if x[0] in kept]
            assert {200, 220, 240} <= kept and not {210, 211} & kept
        elif k == 2:
            expected = cut_repeats(before)
            assert dict(expected)[220] != dict(before)[220]
        elif k == 3:
            expected = [x for x in before if not brute_contamination([x], items)[0][5]]
            assert 240 not in dict(expected) and 241 in dict(expected)
        if k < 4:
            assert sorted(expected, key=repr) == sorted(found, key=repr), name
    packed = result.collect()
    tokenizer = load_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    tokens = {d: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in expected}
    assert {d: sum(r["length"] for r in packed if r["doc_id"] == d) for d in tokens} == tokens
    check_packing(packed, 2048)
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "ids_crc32").collect())) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in packed)
