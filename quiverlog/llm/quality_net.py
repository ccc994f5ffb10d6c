"""Quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiverlog.llm.common import modest_batches, own_name

DIMS = 6
FILTERS = 32
STEP = 4
#: A filter sees four steps, 16 bytes, and moves one step: its windows overlap.
SPAN = 4
WIDTH = SPAN * STEP
#: A chunk is two blocks, 512 bytes, and begins at every block.
BLOCK = 256
SLAB = 1 << 20
THRESHOLD = 0.7
#: Bound of the training sample: labelled rows (those with the smallest hashes of their id), and the longest text taken.
SAMPLE_ROWS = 2000
SAMPLE_BYTES = 1 << 16
EPOCHS = 12
RESULT = "doc_id long, held_out boolean, score double, predicted int"


@dataclass
class Net:
    table: np.ndarray  # (256, DIMS): what each byte stands for
    filters: np.ndarray  # (WIDTH * DIMS, FILTERS)
    bias: np.ndarray
    most: np.ndarray  # weights of a filter's maximum over the document
    mean: np.ndarray  # weights of the mean of its chunks' maxima
    level: np.ndarray  # (1,)

    def parts(self) -> list[np.ndarray]:
        return [self.table, self.filters, self.bias, self.most, self.mean, self.level]


def new_net(seed: int = 11) -> Net:
    rng = np.random.default_rng(seed)
    f = np.float32
    return Net(rng.normal(0, 0.5, (256, DIMS)).astype(f), rng.normal(0, (WIDTH * DIMS) ** -0.5, (WIDTH * DIMS, FILTERS)).astype(f), np.zeros(FILTERS, f), rng.normal(0, 0.1, FILTERS).astype(f), rng.normal(0, 0.1, FILTERS).astype(f), np.ones(1, f))


def activations(net: Net, data: np.ndarray) -> np.ndarray:
    """Of every filter at every step; ``data`` is padded to whole steps, plus ``SPAN`` - 1 more."""
    size = STEP * DIMS
    steps = np.take(net.table, data, axis=0).reshape(-1, size)
    n = len(steps) - SPAN + 1
    out = steps[:n] @ net.filters[:size]
    for k in range(1, SPAN):
        out += steps[k : k + n] @ net.filters[k * size : (k + 1) * size]
    out += net.bias
    return np.maximum(out, 0, out=out)


def layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts one after the other, each padded to whole blocks so that no filter looks into the next; first block and length of each."""
    sizes = np.array([len(t) for t in texts], np.int64)
    blocks = -(-(sizes + WIDTH - STEP) // BLOCK)
    first = np.r_[0, np.cumsum(blocks)]
    data = np.zeros(int(first[-1]) * BLOCK + WIDTH - STEP, np.uint8)
    for t, b in zip(texts, first):
        data[b * BLOCK : b * BLOCK + len(t)] = np.frombuffer(t, np.uint8)
    return data, first, sizes


def live_steps(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether each step begins inside its text; steps in the padding count for nothing."""
    per = BLOCK // STEP
    n = np.diff(first) * per
    at = np.arange(int(first[-1]) * per) - np.repeat(first[:-1] * per, n)
    return at * STEP < np.repeat(sizes, n)


def block_maxima(net: Net, data: np.ndarray, live: np.ndarray) -> np.ndarray:
    per, out = BLOCK // STEP, []
    for k in range(0, len(live), SLAB // STEP):
        part = live[k : k + SLAB // STEP]
        act = activations(net, data[k * STEP : (k + len(part)) * STEP + WIDTH - STEP])
        act[~part] = 0
        out.append(act.reshape(-1, per, FILTERS).max(1))
    return np.concatenate(out)


def pooled(maxima: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the maximum over its chunks, and the mean of their maxima."""
    after = np.r_[maxima[1:], maxima[-1:]]
    last = first[1:] - 1
    after[last] = maxima[last]
    chunks = np.maximum(maxima, after)
    alone = np.diff(first) == 1
    sums = np.add.reduceat(chunks, first[:-1], axis=0)
    n = np.diff(first)
    sums[~alone] -= chunks[last[~alone]]  # the last block begins no chunk of its own
    return np.maximum.reduceat(maxima, first[:-1], axis=0), sums / np.maximum(1, np.where(alone, 1, n - 1))[:, None].astype(np.float32)


def scores(net: Net, texts: list[bytes]) -> np.ndarray:
    if not texts:
        return np.empty(0)
    data, first, sizes = layout(texts)
    most, mean = pooled(block_maxima(net, data, live_steps(first, sizes)), first)
    return 1 / (1 + np.exp(-np.clip((most @ net.most + mean @ net.mean + net.level[0]).astype(np.float64), -30, 30)))


def _gradients(net: Net, texts: list[bytes], labels: np.ndarray) -> list[np.ndarray]:
    data, first, sizes = layout(texts)
    live = live_steps(first, sizes)
    per = BLOCK // STEP
    act = activations(net, data)
    act[~live] = 0
    act = act.reshape(-1, per, FILTERS)
    where = act.argmax(1)
    maxima = np.take_along_axis(act, where[:, None], 1)[:, 0]
    most, mean = pooled(maxima, first)
    p = 1 / (1 + np.exp(-np.clip(most @ net.most + mean @ net.mean + net.level[0], -30, 30)))
    d = ((p - labels) / len(texts)).astype(np.float32)
    # what each block's maximum adds to the document's maximum and to the mean of its chunks
    n = np.diff(first)
    owner = np.repeat(np.arange(len(texts)), n)
    back = (maxima == most[owner]) * net.most
    after = np.r_[maxima[1:], maxima[-1:]]
    chunk = np.ones(len(owner), bool)
    chunk[first[1:] - 1] = n == 1
    mine = (maxima >= after) | (n == 1)[owner][:, None]
    share = chunk[:, None] / np.maximum(1, np.where(n == 1, 1, n - 1))[owner][:, None]
    part = mine * share
    part[1:] += (~mine[:-1]) * share[:-1]
    back = (back + part * net.mean) * d[owner][:, None] * (maxima > 0)
    rows, cols = np.nonzero(back)
    g = back[rows, cols].astype(np.float32)
    at = (rows * per + where[rows, cols]) * STEP
    window = data[at[:, None] + np.arange(WIDTH)]
    seen = net.table[window].reshape(len(at), -1)
    d_filters = np.stack([seen[cols == f].T @ g[cols == f] for f in range(FILTERS)], 1)
    d_table = np.zeros_like(net.table)
    np.add.at(d_table, window.ravel(), (net.filters.T[cols] * g[:, None]).reshape(-1, DIMS))
    return [d_table, d_filters, np.bincount(cols, g, FILTERS).astype(np.float32), most.T @ d, mean.T @ d, d.sum(keepdims=True)]


def train(texts: list[bytes], labels: list[int], epochs: int = EPOCHS, batch: int = 32, rate: float = 0.01, seed: int = 11) -> Net:
    """Fit a network by Adam on cross-entropy; the same rows in the same order give the same network."""
    net, rng = new_net(seed), np.random.default_rng(seed)
    if not texts:
        net.most[:], net.mean[:], net.level[:] = 0, 0, 0
        return net
    y = np.array(labels, np.float32)
    first, second, t = [np.zeros_like(x) for x in net.parts()], [np.zeros_like(x) for x in net.parts()], 0
    rounds = max(epochs, -(-epochs * 600 // len(texts)))  # small samples get as many steps as 600 rows would
    for epoch in range(rounds):
        order = rng.permutation(len(texts))
        for k in range(0, len(order), batch):
            own = order[k : k + batch]
            t += 1
            now = rate * (1 - 0.9 * epoch / rounds) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            for x, g, a, b in zip(net.parts(), _gradients(net, [texts[i] for i in own], y[own]), first, second):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                x -= now * a / (np.sqrt(b) + 1e-8)
    return net


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[list[bytes], list[int]]:
    """At most ``rows`` labelled texts, none held out: first the ids, then their documents, so that little reaches the driver."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    chosen = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("int").alias("quality"), fold.alias("fold"), F.xxhash64(F.col("doc_id").cast("long")).alias("hash"))
    chosen = chosen.filter("label_id is not null and quality in (0, 1) and fold <> 2").groupBy("label_id", "hash").agg(F.min("quality").alias("quality")).orderBy("hash", "label_id").limit(rows)
    ids = chosen.collect()
    if not ids:
        return [], []
    small = docs.sparkSession.createDataFrame([(r["label_id"], r["quality"]) for r in ids], "label_id long, quality int")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = own.join(F.broadcast(small), own["doc_id"] == small["label_id"]).filter(F.octet_length("text") <= SAMPLE_BYTES).select("doc_id", "text", "quality").limit(2 * rows).collect()
    found.sort(key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"], r["text"]))
    return [r["text"].encode("utf-8", "surrogatepass") for r in found], [r["quality"] for r in found]


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Net:
    return train(*training_sample(docs, labels, rows))


def _texts(column: pa.Array) -> list[bytes]:
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def _grouped(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Runs of texts of some two slabs, so that a batch of long texts doesn't need much memory at once."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t) + BLOCK
        if size > 2 * SLAB:
            yield held
            held, size = [], 0
    yield held


def score_batch(net: Net, column: pa.Array) -> np.ndarray:
    return np.concatenate([scores(net, g) for g in _grouped(_texts(column))])


def quality_scores(docs: DataFrame, labels: DataFrame, net: Net | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``docs`` (doc_id, text); the score sees the text's bytes alone.

    The network is fitted on at most ``SAMPLE_ROWS`` rows of ``labels`` (doc_id, quality) whose fold is not 2, each with a
    text of at most ``SAMPLE_BYTES``; without any, every score is 0.5. Every byte of every text is scored. Null and empty texts
    get the score of no bytes; repeated rows get equal scores; a null id is in no fold; other columns are ignored.
    """
    modest_batches(docs.sparkSession)
    model = net or fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            p = score_batch(model, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([i is not None and is_held_out(i) for i in ids], pa.bool_()), pa.array(p, pa.float64()), pa.array((p >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(run, RESULT)


def keep_good(docs: DataFrame, labels: DataFrame, net: Net | None = None) -> DataFrame:
    """The rows of ``docs`` that the classifier predicts to be good, with all their columns as they were."""
    modest_batches(docs.sparkSession)
    model = net or fit(docs, labels)
    name = own_name(docs, "_text")
    place = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = score_batch(model, batch.column(place)) >= THRESHOLD
            yield pa.RecordBatch.from_arrays(batch.columns[:place], schema=pa.schema(list(batch.schema)[:place])).filter(pa.array(good))

    return docs.withColumn(name, F.col("text").cast("string")).mapInArrow(run, docs.schema)
