"""Empty tables, extra columns whose names clash with the operators' own, and texts of several MB."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quiverlog.llm import decontaminate, packing, sharding, token_counts, token_output, warc
from tests.llm.helpers import documents, odd_texts, prose

CLASHING = ["key_a", "key_b", "words", "size", "start", "shard", "rank", "range_no", "payload", "digest", "row", "length", "hashes"]


def benchmark(spark):
    return spark.createDataFrame([("i1", prose(99, 40)), ("i2", "same text here"), (None, "a"), ("i3", None)], "item_id string, text string")


OPERATORS = {
    "op1": lambda d: warc.archive_round_trip(d.withColumnsRenamed({"doc_id": "page_id", "text": "html", "lang": "url"})),
    "op2": lambda d: decontaminate.contamination(d, benchmark(d.sparkSession)),
    "op4": lambda d: token_output.token_round_trip(d),
    "op5": lambda d: token_counts.count_pieces(d),
    "op6": lambda d: sharding.shard_by_bytes(d),
    "op10": lambda d: packing.pack_documents(d).drop("sequence_id", "offset"),
}


def rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_and_clashing(spark, name):
    run = OPERATORS[name]
    assert rows(run(documents(spark, []))) == []
    docs = documents(spark, odd_texts())
    plain = rows(run(docs))
    assert plain and rows(run(docs.withColumns({c: F.lit(k) for k, c in enumerate(CLASHING)}))) == plain


@pytest.mark.parametrize("name", OPERATORS)
def test_a_text_of_megabytes(spark, name):
    found = OPERATORS[name](documents(spark, [(1, prose(1, 300_000)), (2, "x" * 3_000_000), (3, " \n" * 1_000_000)]))
    assert {r[0] for r in found.select("page_id" if name == "op1" else "doc_id").collect()} == {1, 2, 3}


def test_pipeline_of_nothing(spark, tmp_path):
    documents(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    benchmark(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
