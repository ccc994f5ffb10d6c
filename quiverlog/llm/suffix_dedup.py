"""Removal of repeated 200-byte strings by blockwise suffix sorting with a difference cover."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiverlog.llm.common import modest_batches, own_name, partitions_for, stored, text_keys
from quiverlog.llm.probminhash import _BASE, _VALUES, _power_tables, mix

LENGTH = 200
#: Bytes of an anchor. Every string of LENGTH bytes holds LENGTH - GRAM + 1 grams; the one of least hash is its anchor.
GRAM = 64
REACH = LENGTH - GRAM + 1
#: Anchors that occur more often split their strings into steps of STEP starts; groups that still hold more contexts are compared string by
#: string, so that no task gathers more contexts of a group than that.
HOT = 512
STEP = 8
#: Suffixes are sorted in blocks of some BLOCK bytes of context, an 8-byte leading word at a time.
BLOCK = 2 << 20
SLAB = 1 << 18
#: A difference cover of 64. Any two residues meet it after one common shift below 64.
PERIOD = 64
COVER = (0, 1, 2, 5, 14, 16, 34, 42, 59)
PARTITION_BYTES = 12 << 20

_U = np.uint64
_PLACE = _U((1 << 24) - 1)


def _least_of_windows(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours: block-wise running minima from both sides."""
    n = len(x) - width + 1
    full = np.full(-(-len(x) // width) * width, ~_U(0))
    full[: len(x)] = x
    rows = full.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Anchors of all LENGTH-byte strings: text number, anchor, first and last start of its strings, and the anchor's hash.

    The anchor depends on a string's bytes alone (its leftmost gram of least hash), so equal strings have equal anchors at
    equal distances. Each start belongs to one anchor.
    """
    parts, group, size = [], [], 0
    for number, text in enumerate(texts):
        for at in range(0, max(0, len(text) - LENGTH + 1), SLAB):
            piece = text[at : at + SLAB + LENGTH - 1]
            if len(piece) < LENGTH:
                continue
            if size + len(piece) > 2 * SLAB:
                parts.append(_anchors(group))
                group, size = [], 0
            group.append((number, at, piece))
            size += len(piece)
    if group:
        parts.append(_anchors(group))
    if not parts:
        none = np.empty(0, np.int64)
        return none, none, none, none, np.empty(0, _U)
    return tuple(np.concatenate(x) for x in zip(*parts))


def _anchors(group: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(b"".join(p for _, _, p in group), np.uint8)
    sizes = np.array([len(p) for _, _, p in group])
    first = np.r_[0, np.cumsum(sizes)[:-1]]
    power, inverse = _power_tables(len(data) + 1)
    sums = np.empty(len(data) + 1, _U)
    sums[0] = 0
    np.cumsum(_VALUES[data] * power[: len(data)], out=sums[1:])
    grams = sums[GRAM:] - sums[:-GRAM]
    grams *= inverse[: len(grams)]
    hashes = mix(grams)
    keys = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=_U)
    least = _least_of_windows(keys, REACH)
    anchor = (least & _PLACE).astype(np.int64)
    owner = np.repeat(np.arange(len(group)), sizes)
    starts = np.concatenate([np.arange(f, f + n - LENGTH + 1) for f, n in zip(first, sizes)])
    anchor = anchor[starts]
    cut = np.r_[True, (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)]
    low, a = starts[cut], anchor[cut]
    high = starts[np.r_[np.flatnonzero(cut)[1:] - 1, len(starts) - 1]]
    own = owner[low]
    shift = np.array([at for _, at, _ in group])[own] - first[own]
    return np.array([n for n, _, _ in group])[own], a + shift, low + shift, high + shift, hashes[a]


def _words(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as one number, in byte order."""
    return np.lib.stride_tricks.sliding_window_view(data, 8)[at].view(">u8").ravel().astype(_U)


def _ranks(keys: np.ndarray) -> np.ndarray:
    order = np.argsort(keys)
    held = keys[order]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(np.r_[0, held[1:] != held[:-1]])
    return out


class CoverRanks:
    """Ranks of the suffixes at cover places of a block, by their first 256 bytes.

    The first PERIOD bytes are ranked a word at a time; a place plus PERIOD is again a cover place, so ranks of twice the
    depth are pairs of ranks.
    """

    def __init__(self, data: np.ndarray):
        places = np.arange(0, len(data) - 8 - 2 * PERIOD, PERIOD)[:, None] + np.array(COVER)
        self.rows = len(places)
        flat = places.ravel()
        rank = _ranks(_words(data, flat))
        for k in range(8, PERIOD, 8):
            rank = _ranks(rank * (len(flat) + 1) + _ranks(_words(data, flat + k)))
        depth = PERIOD
        while depth < LENGTH:
            later = np.zeros(len(flat), np.int64)
            skip = depth // PERIOD * len(COVER)
            later[:-skip] = rank[skip:] + 1
            rank = _ranks(rank * (len(flat) + 2) + later)
            depth *= 2
        self.rank = rank
        residues = np.arange(PERIOD)
        self.column = np.full(PERIOD, -1)
        self.column[list(COVER)] = np.arange(len(COVER))
        #: the shift after which two residues are both in the cover
        self.shift = np.array([[next(k for k in range(PERIOD) if self.column[(a + k) % PERIOD] >= 0 and self.column[(b + k) % PERIOD] >= 0) for b in residues] for a in residues])

    def at(self, places: np.ndarray) -> np.ndarray:
        return self.rank[places // PERIOD * len(COVER) + self.column[places % PERIOD]]

    def before(self, a: int, b: int) -> int:
        """Sign of the order of two suffixes whose first PERIOD bytes are equal."""
        k = self.shift[a % PERIOD, b % PERIOD]
        x, y = (int(self.at(np.array([p + k]))[0]) for p in (a, b))
        return (x > y) - (x < y)


def sorted_bucket(data: np.ndarray, bucket: np.ndarray, ranks: CoverRanks) -> np.ndarray:
    """One bucket of suffixes (equal residue, a range of leading words) in order of their first LENGTH bytes.

    The first PERIOD bytes are compared a word at a time, only where suffixes still tie; longer ties are settled at once by
    the ranks of the cover places that follow at the residue's shift.
    """
    group = np.zeros(len(bucket), np.int64)
    tied = np.arange(len(bucket))
    for k in range(0, PERIOD, 8):
        words = _words(data, bucket[tied] + k)
        order = np.lexsort((words, group[tied]))
        places = tied
        bucket[places] = bucket[places[order]]
        words, old = words[order], group[places][order]
        new = np.r_[True, (words[1:] != words[:-1]) | (old[1:] != old[:-1])]
        group[places] = places[np.maximum.accumulate(np.where(new, np.arange(len(places)), 0))]
        alone = new & np.r_[new[1:], True]
        tied = places[~alone]
        if not len(tied):
            return bucket
    residue = int(bucket[0] % PERIOD)
    follow = ranks.at(bucket[tied] + ranks.shift[residue, residue])
    bucket[tied] = bucket[tied[np.lexsort((follow, group[tied]))]]
    return bucket


def repeated_starts(contexts: list[bytes], heads: list[int]) -> list[np.ndarray]:
    """For each context, which of its LENGTH-byte strings occurs again in the block; ``heads`` are the anchors' places.

    Contexts are laid out with their anchors at multiples of PERIOD. Strings that are equal have the same distance to their anchor,
    hence equal residues, so each residue's suffixes are sorted by themselves, one bucket after the other, and equal strings are neighbours.
    """
    base, at = [], 0
    for c, h in zip(contexts, heads):
        at += -(at + h) % PERIOD
        base.append(at)
        at += len(c)
    data = np.zeros(at + 2 * LENGTH + 2 * PERIOD + 16, np.uint8)
    for b, c in zip(base, contexts):
        data[b : b + len(c)] = np.frombuffer(c, np.uint8)
    ranks = CoverRanks(data)
    n = [len(c) - LENGTH + 1 for c in contexts]
    starts = np.concatenate([np.arange(b, b + m) for b, m in zip(base, n)])
    twice = np.zeros(len(data), bool)
    residues = starts % PERIOD
    order = np.argsort(residues, kind="stable")
    edges = np.searchsorted(residues[order], np.arange(PERIOD + 1))
    for r in range(PERIOD):
        bucket = starts[order[edges[r] : edges[r + 1]]]
        if len(bucket) < 2:
            continue
        bucket = sorted_bucket(data, bucket, ranks)
        same = _equal(data, bucket[:-1], bucket[1:], ranks)
        twice[bucket[:-1][same]] = True
        twice[bucket[1:][same]] = True
    return [np.flatnonzero(twice[b : b + m]) for b, m in zip(base, n)]


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, ranks: CoverRanks) -> np.ndarray:
    """Whether neighbours share LENGTH bytes, compared byte for byte."""
    same = _words(data, a) == _words(data, b)
    for k in [*range(8, LENGTH - 8, 8), LENGTH - 8]:
        left = np.flatnonzero(same)
        if not len(left):
            break
        same[left] = _words(data, a[left] + k) == _words(data, b[left] + k)
    return same


def runs(at: np.ndarray) -> list[int]:
    """Sorted numbers as first, last, first, last, ..."""
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > 1)
    return np.stack([at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]]], 1).ravel().tolist()


def _utf8(value: str | None) -> bytes:
    return (value or "").encode("utf-8", "surrogatepass")


def _small_groups(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, int, list[bytes]]]:
    """Texts of a batch in groups of some two slabs: the batch, the first row and the texts."""
    for batch in batches:
        texts, held, size, first = batch.column(column), [], 0, 0
        for i in range(batch.num_rows):
            held.append(_utf8(texts[i].as_py()))
            size += len(held[-1])
            if size > 2 * SLAB or i == batch.num_rows - 1:
                yield batch, first, held
                held, size, first = [], 0, i + 1


def _list_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each anchor of each text once, with its number of places."""
    for batch, first, texts in _small_groups(batches, 1):
        number, _, _, _, hashes = anchors(texts)
        order = np.lexsort((hashes, number))
        own, found = number[order], hashes[order]
        new = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (found[1:] != found[:-1])]) if len(own) else np.empty(0, np.int64)
        keys = batch.column(0).slice(first, len(texts)).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(found[new].view(np.int64)), pa.array(keys[own[new]]), pa.array(np.diff(np.r_[new, len(own)]).astype(np.int32))], names=["anchor", "key_a", "places"])


_CONTEXTS = "bucket long, context_key binary, context binary, head int, n long, key_a long, key_b long, places array<int>"


def _cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of two kinds: the contexts of repeated anchors (equal ones of a task once, with their number), and where each text has them."""
    held: dict[bytes, list] = {}
    size = 0

    def flush() -> pa.RecordBatch:
        rows = [(bucket, key, context, head, n, None, None, None) for key, (bucket, context, head, n) in held.items()]
        held.clear()
        return _rows(rows)

    for batch, start, texts in _small_groups(batches, 2):
        number, anchor, low, high, hashes = anchors(texts)
        hashes = hashes.view(np.int64)
        bounds = np.searchsorted(number, np.arange(len(texts) + 1))
        out = []
        for i, text in enumerate(texts):
            own = slice(bounds[i], bounds[i + 1])
            cold = np.array(batch.column(3)[start + i].as_py() or [], np.int64)
            hot = np.array(batch.column(4)[start + i].as_py() or [], np.int64)
            h, a, lo, hi = hashes[own], anchor[own], low[own], high[own]
            places: dict[bytes, list[int]] = {}
            is_cold, is_hot = np.isin(h, cold), np.isin(h, hot)
            picked = [(b, x, y, z) for b, x, y, z in zip(h[is_cold].tolist(), a[is_cold].tolist(), lo[is_cold].tolist(), hi[is_cold].tolist())]
            for b, x, y, z in zip(h[is_hot].tolist(), a[is_hot].tolist(), lo[is_hot].tolist(), hi[is_hot].tolist()):
                for step in range((x - z) // STEP, (x - y) // STEP + 1):
                    core = text[x - STEP * step : x - STEP * step - STEP + 1 + LENGTH]  # in every string that begins in this step
                    bucket = int.from_bytes(hashlib.blake2b(core, digest_size=8, key=(b & (1 << 64) - 1).to_bytes(8, "big") + bytes([step])).digest(), "big", signed=True)
                    picked.append((bucket, x, max(y, x - STEP * step - STEP + 1), min(z, x - STEP * step)))
            for bucket, x, y, z in picked:
                context = text[y : z + LENGTH]
                key = hashlib.blake2b(context, digest_size=16, key=(bucket & (1 << 64) - 1).to_bytes(8, "big")).digest()
                places.setdefault(key, []).append(y)
                if key in held:
                    held[key][3] += 1
                else:
                    held[key] = [bucket, context, x - y, 1]
                    size += len(context)
            a1, a2 = batch.column(0)[start + i].as_py(), batch.column(1)[start + i].as_py()
            out += [(None, key, None, None, None, a1, a2, at) for key, at in places.items()]
        yield _rows(out)
        if size > 8 << 20:
            yield flush()
            size = 0
    yield flush()


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
    columns = list(zip(*rows)) if rows else [()] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in _CONTEXTS.split(", ")])


def _sort_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in bucket order; a block is a run of whole buckets. Gives each context with repeated strings its runs of starts."""

    def found(block: list[dict]) -> pa.RecordBatch:
        keys, spans, contexts, heads, owners = [], [], [], [], []
        for group in block:
            for key, (context, head, n) in group.items():
                if n > 1:
                    keys.append(key)
                    spans.append([0, len(context) - LENGTH])
                if len(group) > 1:
                    contexts.append(context)
                    heads.append(head)
                    owners.append(key if n == 1 else None)
        for key, at in zip(owners, repeated_starts(contexts, heads) if contexts else []):
            if key is not None and len(at):
                keys.append(key)
                spans.append(runs(at))
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(spans, pa.list_(pa.int32()))], names=["context_key", "spans"])

    block, group, last, size = [], {}, None, 0
    for batch in batches:
        for bucket, key, context, head, n in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if bucket != last:
                if size > BLOCK:
                    yield found(block)
                    block, size = [], 0
                group, last = {}, bucket
                block.append(group)
            if key in group:
                group[key][2] += n
            else:
                group[key] = [context, head, n]
                size += len(context)
    yield found(block)


def _single_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every string of each context: the context's key and count, the string's place in it and its own key."""
    names = ["context_key", "place", "string_key", "n"]
    for batch in batches:
        rows = []
        for bucket, key, context, n in zip(*(batch.column(k).to_pylist() for k in range(4))):
            salt = (bucket & (1 << 64) - 1).to_bytes(8, "big")
            rows += [(key, k, hashlib.blake2b(context[k : k + LENGTH], digest_size=16, key=salt).digest(), n) for k in range(len(context) - LENGTH + 1)]
        columns = zip(*rows) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int32(), pa.binary(), pa.int64()))], names=names)


def crowded_spans(contexts: DataFrame) -> DataFrame:
    """Repeated strings of contexts whose buckets hold too many of them: context_key, spans.

    A passage in many texts with other surroundings everywhere shares all but the ends of its contexts, so its bucket grows with the
    corpus. Equal contexts become one by partial sums; then each string, of at most STEP in a context, is counted for itself.
    """
    merged = contexts.groupBy("bucket", "context_key").agg(F.first("context").alias("context"), F.sum("n").alias("n"))
    strings = stored(merged.select("bucket", "context_key", "context", "n").mapInArrow(_single_strings, "context_key binary, place int, string_key binary, n long"), "strings")
    twice = strings.groupBy("string_key").agg(F.sum("n").alias("times")).filter("times > 1").select("string_key")
    found = strings.join(twice, "string_key").groupBy("context_key").agg(F.sort_array(F.collect_set("place")).alias("places"))
    return found.select("context_key", F.expr("flatten(transform(places, x -> array(x, x)))").alias("spans"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Texts of ``docs`` (text) with repeated strings: key_a, key_b, spans (arrays of place, then runs of first and last start).

    1. Anchors are counted over all texts; only strings whose anchor repeats can repeat.
    2. A text's repeated anchors are gathered at the text, which cuts a context around each, some 270 bytes.
    3. Contexts meet by anchor and are suffix-sorted block by block; equal contexts were merged in each task before the
       shuffle, anchors above HOT meet by finer keys, and buckets that still hold over HOT contexts are not gathered but
       counted string by string (``crowded_spans``), so no bucket grows with the corpus.
    4. The runs found go back to the places of each context.
    """
    modest_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(*text_keys(F.col("text")), text.alias("text")).filter(F.octet_length("text") >= LENGTH)
    listed = stored(keyed.select("key_a", "text").mapInArrow(_list_anchors, "anchor long, key_a long, places int"), "listed")
    twice = stored(listed.groupBy("anchor").agg(F.sum("places").alias("n")).filter("n > 1"), "anchors")
    wanted = listed.join(twice, "anchor").groupBy("key_a").agg(F.collect_set(F.when(F.col("n") <= HOT, F.col("anchor"))).alias("cold"), F.collect_set(F.when(F.col("n") > HOT, F.col("anchor"))).alias("hot"))
    wanted = stored(wanted, "wanted")
    packed = keyed.mapInArrow(_pack, "key_a long, key_b long, packed binary")
    cut = packed.join(wanted, "key_a").mapInArrow(_unpack_and_cut, _CONTEXTS)
    table = stored(cut, "contexts")
    contexts = table.filter("context is not null").select("bucket", "context_key", "context", "head", "n")
    volume = contexts.agg(F.coalesce(F.sum(F.octet_length("context")), F.lit(0))).first()[0]
    # counted by partial sums; at most one bucket in HOT contexts, written so that its size is known before it is joined
    crowded = stored(contexts.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > HOT).select("bucket"), "crowded")
    sparse = contexts.join(crowded, "bucket", "left_anti").select("bucket", "context_key", "context", "head", "n")
    runs_of = sparse.repartition(partitions_for(docs, volume, PARTITION_BYTES), "bucket").sortWithinPartitions("bucket").mapInArrow(_sort_blocks, "context_key binary, spans array<int>")
    runs_of = stored(runs_of.unionByName(crowded_spans(contexts.join(crowded, "bucket", "left_semi"))), "runs")
    places = table.filter("places is not null").select("context_key", "key_a", "key_b", "places")
    back = places.join(runs_of, "context_key").select("key_a", "key_b", F.explode("places").alias("place"), "spans")
    # an exact copy gives the same places again: they are merged here
    return back.select("key_a", "key_b", F.concat(F.array(F.col("place").cast("int")), "spans").alias("span")).groupBy("key_a", "key_b").agg(F.collect_set("span").alias("spans"))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = batch.column(2)
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array((packer.compress(_utf8(texts[i].as_py())) for i in range(batch.num_rows)), pa.binary())], names=["key_a", "key_b", "packed"])


def _unpack_and_cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def opened() -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()
        for batch in batches:  # key_a, key_b, packed, cold, hot
            size = 256
            for k in range(0, batch.num_rows, size):
                part = batch.slice(k, size)
                texts = pa.array((opener.decompress(x.as_py()).decode("utf-8", "surrogatepass") for x in part.column(2)), pa.large_string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), texts, part.column(3), part.column(4)], names=["key_a", "key_b", "text", "cold", "hot"])

    return _cut_contexts(opened())


def kept_bytes(data: bytes, spans: list[list[int]]) -> tuple[bytes, int, int]:
    """What is left of a text, and how many bytes in how many maximal runs go."""
    edges = np.zeros(len(data) + 1, np.int64)
    for place, *pairs in spans:
        for first, last in zip(pairs[::2], pairs[1::2]):
            edges[place + first] += 1
            edges[place + last + LENGTH] -= 1
    gone = np.cumsum(edges)[:-1] > 0
    n_runs = int((gone & ~np.r_[False, gone[:-1]]).sum())
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), int(gone.sum()), n_runs


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of ``docs`` (doc_id, text).

    Removed is every byte inside a 200-byte string that begins anywhere else too, in any text or the same; strings may overlap
    themselves. Null is the empty text; texts under 200 bytes lose nothing. Rows with equal texts, repeated rows among
    them, are copies of each other. One row for each row; an empty table gives none; other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id"), *text_keys(F.col("text")), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("whole"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                left, n, spans = kept_bytes(_utf8(batch.column(2)[i].as_py()), batch.column(3)[i].as_py())
                rows.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), n, spans, hashlib.sha256(left).hexdigest()))
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["key_a", "key_b", "n_removed", "n_spans", "kept"])

    spans = stored(repeated_spans(docs), "spans")
    # equal texts become one in each task, before they are shuffled
    texts = docs.select(*text_keys(F.col("text")), text.alias("text")).groupBy("key_a", "key_b").agg(F.first("text").alias("text"))
    cut = texts.join(spans, ["key_a", "key_b"]).mapInArrow(run, "key_a long, key_b long, n_removed long, n_spans long, kept string")
    return base.join(cut, ["key_a", "key_b"], "left").select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept", "whole").alias("kept_sha256"))


def remove_repeated(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated strings cut out of ``text`` (bytes of split characters go with them); n_chars follows, other columns stay.

    Rows are never dropped: a text that is all repeated becomes empty.
    """
    spans = stored(repeated_spans(docs), "spans")
    a, b, s = own_name(docs, "_a"), own_name(docs, "_b"), own_name(docs, "_spans")
    one, two = text_keys(docs["text"])
    renamed = spans.select(F.col("key_a").alias(a + "_"), F.col("key_b").alias(b + "_"), F.col("spans").alias(s))
    joined = docs.withColumns({a: one, b: two}).join(renamed, (F.col(a) == F.col(a + "_")) & (F.col(b) == F.col(b + "_")), "left").drop(a, b, a + "_", b + "_")
    place, at = len(docs.columns), docs.columns.index("text")
    count = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            cut = [i for i, x in enumerate(batch.column(place)) if x.is_valid]
            for i in cut:
                texts[i] = kept_bytes(_utf8(texts[i]), batch.column(place)[i].as_py())[0].decode("utf-8", "ignore")
            columns = list(batch.columns[:place])
            columns[at] = pa.array(texts, columns[at].type)
            if count is not None:
                sizes = columns[count].to_pylist()
                for i in cut:
                    sizes[i] = len(texts[i])
                columns[count] = pa.array(sizes, columns[count].type)
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(list(batch.schema)[:place]))

    return joined.mapInArrow(run, docs.schema)
