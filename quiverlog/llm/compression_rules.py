"""Quality rules by zstandard ratios of whole documents and fixed chunks."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from quiverlog.llm.common import modest_batches

LEVEL = 3
CHUNK = 4096
WINDOW = 8
#: A last chunk of fewer bytes belongs to the one before.
LEAST_CHUNK = 1024
#: (bytes, least ratio, greatest ratio) of compressed to plain size; between two lengths the limits lie on a line over the logarithm of the
#: length, beyond the last they stay. Short texts compress worse by nature. From 256 bytes on the least ratios are the lowest 0.5 % of prose
#: labelled good (quantile regression over lengths, rows outside the held-out fold), less 0.01 from 2048 bytes on and 0.02 to 0.06 for shorter
#: texts, which vary more; the greatest lie between prose and base64 of that length. Under 128 bytes prose and base64 overlap.
BANDS = ((0, 0.0, 9.9), (63, 0.0, 9.9), (64, 0.45, 1.10), (128, 0.52, 1.00), (256, 0.53, 0.82), (512, 0.51, 0.75), (1024, 0.485, 0.69), (2048, 0.46, 0.64), (4096, 0.435, 0.61), (8192, 0.41, 0.60), (16384, 0.39, 0.60), (65536, 0.36, 0.60))
#: A document is rejected if chunks with more than this share of its bytes lie outside their band.
CHUNK_SHARE = 0.25

SYMBOLS = b"#*$%&|<>"
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, whole_ratio double, bad_chunk_share double"

_rng = np.random.default_rng(20240607)
_FACTORS = _rng.integers(1, 2**63, WINDOW, dtype=np.uint64) | np.uint64(1)


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of 8 words that the text holds twice or more, the first time included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.uint64, len(words))
    if len(numbers) == len(words):
        return 0
    keys = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        keys += (ids[k : k + n] + np.uint64(1)) * _FACTORS[k]
    order = np.argsort(keys, kind="stable")
    same = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
    if not len(same):
        return 0
    a, b = order[same], order[same + 1]
    equal = np.ones(len(same), bool)
    for k in range(WINDOW):
        equal &= ids[a + k] == ids[b + k]
    if not equal.all():  # two windows with one key: count those windows by their words
        seen: dict[tuple, list[int]] = {}
        for i in np.unique(np.concatenate([a, b])).tolist():
            seen.setdefault(tuple(ids[i : i + WINDOW].tolist()), []).append(i)
        starts = np.array([i for group in seen.values() if len(group) > 1 for i in group], dtype=np.int64)
    else:
        starts = np.unique(np.concatenate([a, b]))
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + WINDOW, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


_LENGTHS, _LEAST, _MOST = np.log2(np.maximum([x[0] for x in BANDS], 1)), [x[1] for x in BANDS], [x[2] for x in BANDS]


def limits(size: int) -> tuple[float, float]:
    """Least and greatest ratio for a text or chunk of so many bytes."""
    at = math.log2(max(size, 1))
    return float(np.interp(at, _LENGTHS, _LEAST)), float(np.interp(at, _LENGTHS, _MOST))


def compression_verdict(data: bytes, packer: zstandard.ZstdCompressor) -> tuple[float, float, bool]:
    """Ratio of the whole text, share of its bytes in chunks outside their band, and whether the text is kept."""
    if not data:
        return 1.0, 0.0, True
    whole = len(packer.compress(data)) / len(data)
    low, high = limits(len(data))
    bad = 0
    if len(data) >= CHUNK + LEAST_CHUNK:
        cuts = list(range(0, len(data), CHUNK)) + [len(data)]
        if cuts[-1] - cuts[-2] < LEAST_CHUNK:
            del cuts[-2]
        for a, b in zip(cuts, cuts[1:]):
            ratio = len(packer.compress(data[a:b])) / (b - a)
            least, most = limits(b - a)
            bad += (b - a) * (not least <= ratio <= most)
    share = bad / len(data)
    return whole, share, low <= whole <= high and share <= CHUNK_SHARE


def measure(text: str | None, packer: zstandard.ZstdCompressor) -> tuple:
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # of bytes: exactly the six ASCII spaces
    n = len(words)
    chars = len(text) - (len(data) - len(data.translate(None, b" \t\n\x0b\x0c\r")))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip()] if n else []
    repeats = repeated_words(words)
    whole, share, good = compression_verdict(data, packer)
    failed = n < 20 or 100 * repeats > 30 * n
    return n, chars, symbols, len(lines) - len(set(lines)), repeats, failed, good and not failed, whole, share


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=LEVEL)
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "whole_ratio", "bad_chunk_share"]
    for batch in batches:
        texts = batch.column(1)
        rows = [measure(texts[i].as_py(), packer) for i in range(batch.num_rows)]
        columns = list(zip(*rows)) if rows else [()] * 9
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)


def compression_rules(docs: DataFrame) -> DataFrame:
    """Base counts, the base verdict and the compression verdict for each row of ``docs`` (doc_id, text).

    ``kept`` is false where the base rule fails (under 20 words, or over 30 % of words in repeated 8-word windows);
    otherwise the zstandard ratio of the whole text and of its 4096-byte chunks must lie inside the band for their length.
    A null or empty text has no words and fails the base rule. Each row is judged by itself: repeated rows and ids give
    repeated results, an empty table gives none, other columns are ignored. No shuffle, one pass.
    """
    modest_batches(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(_score, SCHEMA)
