"""Bulk-synchronous best-fit packing of tokenized documents into sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiverlog.llm.common import modest_batches, partitions_for, stored
from quiverlog.llm.encoding import encoder_of

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
RESULT = PIECES + ", sequence_id long, offset long"
_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def cut_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Token pieces of ``docs`` (doc_id, text): the ids with the end id; only what is longer than ``capacity`` is cut."""
    path = tokenizer or default_tokenizer()
    modest_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path, keep_spaces=False)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids, texts, rows = batch.column(0).to_pylist(), batch.column(1), []
            for i, doc_id in enumerate(ids):
                data = encoder.encode(texts[i].as_py() or "") + end
                for k in range(0, len(data), 4 * capacity):
                    part = data[k : k + 4 * capacity]
                    rows.append((doc_id, k // (4 * capacity), k // 4, len(part) // 4, zlib.crc32(part)))
            columns = zip(*rows) if rows else [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=_NAMES[:5])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(run, PIECES)


def match_rounds(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Rounds of best fit over classes of equal pieces and equal gaps.

    A class of pieces is (length, ranks from-to), a class of gaps (size, sequence numbers from-to); there are at most
    ``capacity`` lengths and sizes, whatever the corpus holds. One round is a sweep from the largest size down: a piece's
    successor, the smallest free gap that holds it, is the one last passed. Where many pieces want the same gaps, ranks
    decide: the lowest rank takes the lowest sequence number, the rest go to the next larger gaps. Each gap takes
    one piece a round, then shrinks. When no piece fits any gap, as many sequences as the rest needs at least are opened with the
    longest pieces. Returns rows (length, first rank, how many, first sequence, offset) and the number of sequences.
    """
    left = {n: [0, c] for n, c in sorted(counts.items(), reverse=True) if c}
    gaps: list[tuple[int, int, int]] = []
    placed: list[tuple[int, int, int, int, int]] = []
    opened = 0
    while left:
        fits = []
        stack: list[list[int]] = []
        waiting = sorted(gaps)
        changed: list[tuple[int, int, int]] = []
        for length in list(left):
            while waiting and waiting[-1][0] >= length:
                stack.append(list(waiting.pop()))
            rank, n = left[length]
            while n and stack:
                size, first, many = stack[-1]
                k = min(n, many)
                fits.append((length, rank, k, first, capacity - size))
                if size > length:
                    changed.append((size - length, first, k))
                rank, n = rank + k, n - k
                if k == many:
                    stack.pop()
                else:
                    stack[-1] = [size, first + k, many - k]
            left[length] = [rank, n]
        left = {a: b for a, b in left.items() if b[1]}
        gaps = changed + [tuple(x) for x in stack] + waiting
        placed += fits
        if left and not fits:
            need = max(-(-sum(a * b[1] for a, b in left.items()) // capacity), sum(b[1] for a, b in left.items() if 2 * a > capacity))
            for length in list(left):
                rank, n = left[length]
                k = min(n, need)
                placed.append((length, rank, k, opened, 0))
                if length < capacity:
                    gaps.append((capacity - length, opened, k))
                opened, need, left[length] = opened + k, need - k, [rank + k, n - k]
                if not need:
                    break
            left = {a: b for a, b in left.items() if b[1]}
    return np.array(sorted(placed), np.int64).reshape(-1, 5), opened


def best_fit(pieces: DataFrame, capacity: int = CAPACITY, rows_per_range: int = 250_000) -> DataFrame:
    """Give every row of ``pieces`` (doc_id, piece, start, length, ids_crc32) its sequence_id and offset.

    Pieces are range-sorted by length and ranked within their length across ranges (a hot length spans several ranges:
    ranks inside a range plus the totals of the ranges before). Lengths are matched to gaps in rounds (``match_rounds``),
    and each piece finds its place by its rank. Only class totals, at most ``capacity`` rows, reach the driver.
    """
    kept = stored(pieces, "pieces")
    order = [F.col("length").desc(), F.col("doc_id").asc_nulls_first(), F.col("piece"), F.col("ids_crc32")]
    ranges = partitions_for(pieces, kept.count(), rows_per_range)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, last, n = TaskContext.get().partitionId(), -1, 0
        for batch in batches:
            lengths = batch.column(3).to_numpy()
            if not len(lengths):
                continue
            starts = np.flatnonzero(np.r_[True, lengths[1:] != lengths[:-1]])
            run = np.arange(len(lengths)) - np.repeat(starts, np.diff(np.r_[starts, len(lengths)]))
            first = lengths == lengths[0]
            run[: int(first.sum())] += n if lengths[0] == last else 0
            last, n = int(lengths[-1]), int(run[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(run), number), pa.int32()), pa.array(run, pa.int64())], names=[*_NAMES[:5], "range_no", "rank"])

    ranked = stored(kept.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(rank, PIECES + ", range_no int, rank long"), "ranked")
    totals = ranked.groupBy("length", "range_no").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    # sorted ranges share only their edge lengths: at most `capacity` + `ranges` rows
    offsets = totals.select("length", "range_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank_before"))
    counts = {r["length"]: r["n"] for r in ranked.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan, _ = match_rounds(counts, capacity)
    keys = plan[:, 0] << 44 | plan[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(5).to_numpy()
            row = plan[np.searchsorted(keys, batch.column(3).to_numpy() << 44 | at, side="right") - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(row[:, 3] + at - row[:, 1]), pa.array(row[:, 4])], names=_NAMES)

    joined = ranked.join(F.broadcast(offsets), ["length", "range_no"])
    return joined.select(*_NAMES[:5], (F.col("rank") + F.col("rank_before")).alias("rank")).mapInArrow(place, RESULT)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pack ``docs`` (doc_id, text) into sequences of at most ``capacity`` tokens: one row for each piece.

    Null and empty texts are the end id alone. Repeated rows are packed once each; an empty table gives no rows;
    other columns are ignored.
    """
    return best_fit(cut_pieces(docs, tokenizer, capacity), capacity)
