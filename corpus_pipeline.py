"""The training-data pipeline: whole documents in, packed sequences out.

Each stage takes (spark, docs, sf_dir), works on every row that the stage before it kept, and returns the documents that stay
with their columns; the last returns the places of their token pieces. Between stages the rows are written as Parquet.

In every stage a null text counts as the empty one and stays null, rows that repeat are judged alike, texts of any length are read whole, an
empty table gives an empty table, and further columns, whatever their names, pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quiverlog.llm.common import drop_path, fresh_path, scratch, written
from quiverlog.llm.decontaminate import remove_contaminated
from quiverlog.llm.packing import pack_documents
from quiverlog.llm.probminhash import keep_one_of_each
from quiverlog.llm.quality_net import keep_good
from quiverlog.llm.suffix_dedup import remove_repeated


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled rows outside the held-out fold, predicts to be good.

    Rows with equal texts stay or go together; without any label every score is 0.5, so none stays.
    """
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the smallest doc_id; of rows that repeat id and text one; all empty texts are one class."""
    return keep_one_of_each(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their strings of 200 bytes that begin anywhere else too; a text may become empty, no row goes."""
    return remove_repeated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark's windows don't contaminate; a text without words is clean, an empty benchmark contaminates none."""
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all token pieces in sequences of 2048; an empty text is one piece, the end id."""
    return pack_documents(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]

#: SQL has no network, signatures, byte strings or tokenizer; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's intermediate tables go when its result is written, and its input when the next result is."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path = fresh_path(spark, f"stage{k}")
        with scratch(spark):
            rows = written(stage(spark, rows, sf_dir), path)
        if before:
            drop_path(spark, before)
        before = path
    return STAGES[-1][1](spark, rows, sf_dir)
