"""Token ids in Arrow files of fixed-size lists: equal-length sequences and masks that are read without copying."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quiverlog.llm.common import fresh_path, modest_batches, partitions_for
from quiverlog.llm.encoding import encoder_of, load_tokenizer

SEQUENCE = 1024
SEQUENCES_PER_BATCH = 256
INDEX = "doc_id long, file_no int, file_start long, n_tokens long"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def file_name(number: int) -> str:
    return f"tokens-{number:06d}.arrow"


class TokenWriter:
    """Appends ids to an Arrow file of record batches (``ids``, ``mask``); a file that is not closed is never seen."""

    def __init__(self, uri: str, name: str, kind: type = np.uint16, length: int = SEQUENCE, per_batch: int = SEQUENCES_PER_BATCH):
        self.fs, folder = pa.fs.FileSystem.from_uri(uri)
        self.fs.create_dir(folder, recursive=True)
        self.final, self.draft = f"{folder}/{name}", f"{folder}/.{name}-{uuid.uuid4().hex}"
        self.kind, self.length, self.per_batch = np.dtype(kind), length, per_batch
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(self.kind), length)), ("mask", pa.list_(pa.bool_(), length))])
        self.stream = self.fs.open_output_stream(self.draft)
        self.file = pa.ipc.new_file(self.stream, self.schema)
        self.held: list[np.ndarray] = []
        self.n_held = 0

    def append(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.kind))
        self.n_held += len(ids)
        if self.n_held >= self.length * self.per_batch:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, self.kind)
        size = self.length * self.per_batch
        while len(ids) >= size or (last and len(ids)):
            part, ids = ids[:size], ids[size:]
            rows = -(-len(part) // self.length)
            mask = np.zeros(rows * self.length, bool)
            mask[: len(part)] = True
            full = np.zeros(rows * self.length, self.kind)
            full[: len(part)] = part
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (full, mask)]
            self.file.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.held, self.n_held = ([ids], len(ids)) if len(ids) else ([], 0)

    def close(self) -> None:
        self._flush(True)
        self.file.close()
        self.stream.close()
        self.fs.move(self.draft, self.final)


class TokenFile:
    """Random access to a token file. On a local or mounted store the file is mapped and views share its memory."""

    def __init__(self, uri: str, name: str):
        fs, folder = pa.fs.FileSystem.from_uri(uri)
        path = f"{folder}/{name}"
        self.source = pa.memory_map(path) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size
        self.per_batch = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1

    def __len__(self) -> int:
        n = self.file.num_record_batches
        return (n - 1) * self.per_batch + self.file.get_batch(n - 1).num_rows if n else 0

    def _values(self, batch: int, column: int) -> np.ndarray:
        return self.file.get_batch(batch).column(column).values.to_numpy(zero_copy_only=column == 0)

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a view) and mask of sequence k."""
        batch, row = divmod(k, self.per_batch)
        part = slice(row * self.length, (row + 1) * self.length)
        return self._values(batch, 0)[part], self._values(batch, 1)[part]

    def ids(self, start: int, n: int) -> np.ndarray:
        size, parts = self.length * self.per_batch, []
        while n:
            batch, at = divmod(start, size)
            part = self._values(batch, 0)[at : at + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint16)


def write_tokens(docs: DataFrame, uri: str, tokenizer: str | None = None, end_id: int = 0, rows_per_file: int = 50_000) -> DataFrame:
    """Encode ``docs`` (doc_id, text), write one token file for each range of doc_id under ``uri`` and return their index.

    The index (doc_id, file_no, file_start, n_tokens) is written as Parquet beside the files. Files follow each other in
    ascending doc_id order, null ids first, rows with one id by a hash of their text. A retried task replaces its file whole.
    """
    path = tokenizer or default_tokenizer()
    modest_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    dealt = slim.repartitionByRange(partitions_for(docs, docs.count(), rows_per_file), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path, keep_spaces=True)
        small = load_tokenizer(path).get_vocab_size() <= 1 << 16
        number = TaskContext.get().partitionId()
        end = np.array([end_id], "<u4")
        writer, at = None, 0
        for batch in batches:
            texts, starts, sizes = batch.column(1), [], []
            for i in range(batch.num_rows):
                ids = np.concatenate([np.frombuffer(encoder.encode(texts[i].as_py()), "<u4"), end])
                writer = writer or TokenWriter(uri, file_name(number), np.uint16 if small else np.uint32)
                writer.append(ids)
                starts.append(at)
                sizes.append(len(ids))
                at += len(ids)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([number] * n, pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], names=["doc_id", "file_no", "file_start", "n_tokens"])
        if writer:
            writer.close()

    dealt.mapInArrow(run, INDEX).write.parquet(f"{uri}/index")
    return docs.sparkSession.read.schema(INDEX).parquet(f"{uri}/index")


def read_tokens(spark: SparkSession, uri: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document, from the files under ``uri``."""
    index = spark.read.schema(INDEX).parquet(f"{uri}/index")
    files = index.groupBy("file_no").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each file; their number is set by the writer, so the broadcast is bounded
    offsets = files.select("file_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ids_before"))
    placed = index.join(F.broadcast(offsets), "file_no").select("doc_id", "file_no", "file_start", "n_tokens", (F.col("ids_before") + F.col("file_start")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, file = None, None
        for batch in batches:
            _, numbers, starts, sizes, _ = (c.to_pylist() for c in batch.columns)
            sums = []
            for f, a, n in zip(numbers, starts, sizes):
                if f != number:
                    number, file = f, TokenFile(uri, file_name(f))
                sums.append(zlib.crc32(file.ids(a, n).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), batch.column(3), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(run, RESULT)


def token_round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write the token files of ``docs`` in the shared folder and return what reading them back gives.

    One row for each row of ``docs``; null and empty texts are the end id alone; an empty table gives no rows and no files;
    other columns are ignored.
    """
    uri = fresh_path(docs.sparkSession, "tokens")
    write_tokens(docs, uri, tokenizer)
    return read_tokens(docs.sparkSession, uri)
