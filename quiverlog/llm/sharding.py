"""Byte-balanced contiguous shards from global prefix sums, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiverlog.llm.common import own_name, partitions_for, stored

#: Ranges whose totals are broadcast; 40 bytes each, so the broadcast stays under 40 MB.
MOST_RANGES = 1_000_000


def shard_by_bytes(docs: DataFrame, n_shards: int = 24, overhead: int = 8, rows_per_range: int = 250_000, carry: bool = False) -> DataFrame:
    """Cut ``docs`` (doc_id, text), in doc_id order, into contiguous shards of nearly equal bytes.

    The rows are dealt into ranges of doc_id and written once, without their texts; a total per range gives
    each range its global byte offset, a running sum inside the range gives each row its own, and the row whose middle
    byte lies in the k-th of ``n_shards`` equal targets goes to shard k. Shards differ by the size of a document at most.

    Returns doc_id, size, text_crc32, law (``bytes``), shard, slot (place in the shard, gapless from 0), grown_shard (null).
    A null text has no bytes, crc 0. Null ids come first. Rows with one id are ordered by checksum and size; equal
    rows are interchangeable and each gets its own slot. An empty table gives no rows; other columns are ignored, or with ``carry`` the
    whole row comes along in a struct ``row``.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(F.col("doc_id"), (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []))
    more = ["row"] if carry else []
    ranges = partitions_for(docs, docs.count(), rows_per_range)
    if ranges > MOST_RANGES:
        raise ValueError(f"{ranges} ranges; raise rows_per_range so that at most {MOST_RANGES} are needed")
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    dealt = stored(slim.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("range_no", F.spark_partition_id()), "shards")

    totals = dealt.groupBy("range_no").agg(F.sum("size").alias("range_bytes"), F.count(F.lit(1)).alias("range_rows"))
    before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "range_no",
        F.coalesce(F.sum("range_bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("range_rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("range_bytes").over(Window.partitionBy()).alias("all_bytes"),
    )
    inside = Window.partitionBy("range_no").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.join(F.broadcast(offsets), "range_no").select(
        "doc_id",
        "size",
        "text_crc32",
        (F.col("bytes_before") + F.sum("size").over(inside) - F.col("size")).alias("start"),
        (F.col("rows_before") + F.row_number().over(inside.orderBy(*order)) - 1).alias("row_no"),
        "all_bytes",
        *more,
    )
    placed = placed.withColumn("shard", F.expr(f"int((2 * start + size) * {n_shards} div (2 * all_bytes))"))
    firsts = placed.groupBy("shard").agg(F.min("row_no").alias("first_row"))
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row_no") - F.col("first_row")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        *more,
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 24, overhead: int = 8) -> None:
    """Write every row of ``docs`` once, with all its columns, to one folder ``shard=k`` for each shard (``shard_by_bytes``).

    A shard is many files, cut by ranges of its slots and sorted by them. Null and repeated ids and repeated rows keep their
    number, since rows are carried and never joined back; an empty table writes no shard; where ``docs`` has a column ``shard`` or
    ``slot``, the shard's own gets another name.
    """
    shard, slot = own_name(docs, "shard"), own_name(docs, "slot")
    rows = shard_by_bytes(docs, n_shards, overhead, carry=True).select(F.col("shard").alias(shard), F.col("slot").alias(slot), "row.*")
    rows.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
