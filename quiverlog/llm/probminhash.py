"""Near-duplicate classes by ProbMinHash signatures, banding, exact verification and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiverlog.llm.common import modest_batches, own_name, stored, text_keys

SHINGLE = 5
THRESHOLD = 0.8
#: 20 bands of 5 components: a pair at similarity 0.8 shares no band with probability 0.0004.
BANDS, ROWS = 20, 5
SIZE = BANDS * ROWS
#: Groups of at most this many members are compared member by member; larger ones through their leaders, then block by block.
SMALL_GROUP = 12
#: A block of a large group holds some so many members, and some so many bytes of text.
BLOCK, BLOCK_BYTES = 512, 4 << 20
#: Columns of the matrices that bound similarities, and members whose signatures are compared with a block at once.
COLUMNS, STRIPE = 4096, 32
#: Pairs whose signatures agree in fewer components than 0.8 less four standard deviations are not verified.
LEAST_AGREEING = int(SIZE * (THRESHOLD - 4 * (THRESHOLD * (1 - THRESHOLD) / SIZE) ** 0.5))
SEGMENT = 4 << 20
#: Classes of rows that all lack an id have numbers from here on.
NO_ID = 1 << 62
#: Shingles whose signatures are made together, and arrivals drawn at once: some 40 MB of arrays.
TOGETHER, ARRIVALS = 100_000, 400_000

_U = np.uint64
_rng = np.random.default_rng(5)
#: A value for each byte inside a word (first 256) and for each byte that begins one.
_VALUES = _rng.integers(1, 2**64, 512, dtype=_U)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: A-Z lowered; every ASCII character that is no letter or digit is a space.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = [np.cumprod(np.r_[_U(1), np.full(size - 1, _U(x), _U)]) for x in (_BASE, _INVERSE)]
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _segment_shingles(data: bytes) -> np.ndarray:
    """Hashes of all runs of five words; of all words where there are fewer."""
    raw = np.frombuffer(data, np.uint8)
    inside = raw != 32
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    letters = raw[inside].astype(np.int64) + 256 * first[inside]
    if not len(letters):
        return np.empty(0, _U)
    power, inverse = _power_tables(len(letters) + 1)
    sums = np.r_[_U(0), np.cumsum(_VALUES[letters] * power[: len(letters)])]
    starts = np.flatnonzero(letters >= 256)
    ends = np.r_[starts, len(letters)]
    k = min(SHINGLE, len(starts))
    return mix((sums[ends[k:]] - sums[ends[:-k]]) * inverse[ends[:-k]])


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a text, and how often each occurs."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL)
    if len(data) <= SEGMENT:
        found = _segment_shingles(data)
    else:  # long texts in pieces of five words or more that share four
        data, parts, at = data.strip(), [], 0
        stop = SEGMENT
        while True:
            stop = data.find(b" ", stop)
            stop = len(data) if stop < 0 else stop
            tail = data[at:stop].rsplit(None, SHINGLE - 1)
            if stop < len(data) and len(tail) < SHINGLE:  # a blob or a run of blanks: as far again
                stop += stop - at
                continue
            parts.append(_segment_shingles(data[at:stop]))
            if stop == len(data):
                break
            at += len(tail[0])
            stop = at + SEGMENT
        found = np.concatenate(parts)
    return np.unique(found, return_counts=True)


def signatures(docs: list[tuple[np.ndarray, np.ndarray]], size: int = SIZE) -> np.ndarray:
    """ProbMinHash of weighted shingle sets, one row of 32-bit values for each; a set without shingles has zeros.

    Each shingle is a Poisson process of rate proportional to its weight; every arrival goes to a random component, and a component
    keeps the shingle that arrives first, so two sets agree in a component with their probability Jaccard similarity. A shingle's
    arrivals are drawn in growing numbers and end once they come later than every component's first.
    """
    n = len(docs)
    first = np.full(n * size, np.inf)
    winner = np.zeros(n * size, np.uint32)
    if not n:
        return winner.reshape(0, size)
    owner = np.repeat(np.arange(n), [len(x) for x, _ in docs])
    hashes = np.concatenate([x for x, _ in docs])
    rate = np.concatenate([w for _, w in docs]).astype(np.float64)
    name = (mix(hashes ^ _U(0x1234567)) >> _U(32)).astype(np.uint32)
    clock = np.zeros(len(hashes))
    drawn, many = 0, 1
    while len(hashes):
        number = np.arange(drawn, drawn + many, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(0x632BE59BD9B4E019)
        random = mix(hashes[:, None] + number)
        wait = -np.log(((random >> _U(12)).astype(np.float64) + 0.5) * 2.0**-52) / rate[:, None]
        time = clock[:, None] + (np.cumsum(wait, 1) if many > 1 else wait)
        part = ((mix(random) >> _U(32)) * _U(size) >> _U(32)).astype(np.int64)
        place = (owner[:, None] * size + part).ravel()
        at = time.ravel()
        np.minimum.at(first, place, at)
        won = at == first[place]
        winner[place[won]] = np.repeat(name, many)[won]
        clock = time[:, -1]
        live = clock < first.reshape(n, size).max(1)[owner]
        owner, hashes, rate, name, clock = owner[live], hashes[live], rate[live], name[live], clock[live]
        drawn, many = drawn + many, max(1, min(2 * drawn, 256, ARRIVALS // max(1, len(hashes))))
    return winner.reshape(n, size)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard similarity of two weighted shingle sets; 1 for two empty ones."""
    (x, v), (y, w) = a, b
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    keys = np.concatenate([x, y])
    union, inverse = np.unique(keys, return_inverse=True)
    p, q = np.zeros(len(union)), np.zeros(len(union))
    p[inverse[: len(x)]] = v
    q[inverse[len(x) :]] = w
    if p.max() == 1 and q.max() == 1:
        return float((p * q).sum() / len(union))
    with np.errstate(divide="ignore"):
        ratio = q / p
    order = np.argsort(ratio, kind="stable")
    p, q, ratio = p[order], q[order], ratio[order]
    below = np.cumsum(p)
    above = np.cumsum(q[::-1])[::-1]
    both = np.flatnonzero((p > 0) & (q > 0))
    last = np.searchsorted(ratio, ratio[both], side="right")
    rest = np.where(last < len(q), above[np.minimum(last, len(q) - 1)], 0.0)
    return float((p[both] / (below[last - 1] + rest / ratio[both])).sum())


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, held, rows, size = batch.column(4), [], [], 0
        for i in range(batch.num_rows):
            held.append(shingles(texts[i].as_py()))
            size += len(held[-1][0])
            if size > TOGETHER or i == batch.num_rows - 1:
                rows.append(signatures(held))
                held, size = [], 0
        found = np.concatenate(rows) if rows else np.zeros((0, SIZE), np.uint32)
        lists = pa.ListArray.from_arrays(np.arange(0, found.size + 1, SIZE, dtype=np.int32), found.ravel().view(np.int32))
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], lists], names=["doc_id", "key_a", "key_b", "bytes", "sketch"])


def sketch_documents(docs: DataFrame) -> DataFrame:
    """doc_id, text keys, length in bytes and signature of each row of ``docs`` (doc_id, text)."""
    modest_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_keys(F.col("text")), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"), text.alias("text"))
    return slim.mapInArrow(_sketches, "doc_id long, key_a long, key_b long, bytes long, sketch array<int>")


def _grouped_pairs(members: DataFrame, degree: DataFrame) -> DataFrame:
    """Pairs of each group (key, node): all of a small group, the leader with every other of a large one.

    The leader is the member that shares the fullest groups with others (``degree``), so the text that the copies of a group were made
    from leads rather than one of the copies. Large groups are never gathered: their rows are joined with their leader, one row each.
    """
    ranked = members.join(degree, "node")
    heads = ranked.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct(F.col("degree"), (-F.col("node")).alias("minus"))).alias("head")).filter("n > 1")
    heads = heads.select("key", "n", (-F.col("head.minus")).alias("leader"))
    large = members.join(heads.filter(F.col("n") > SMALL_GROUP), "key").filter("node <> leader").select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b"))
    small = members.join(heads.filter(F.col("n") <= SMALL_GROUP).select("key"), "key").groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    firsts = small.select(F.col("nodes"), F.posexplode("nodes").alias("i", "a"))
    pairs = firsts.select("a", F.explode(F.expr("slice(nodes, i + 2, size(nodes))")).alias("b"))
    return large.unionByName(pairs)


def band_groups(nodes: DataFrame) -> DataFrame:
    """Members of the groups of ``nodes`` (node, sketch) that have a band in common: node, band, key and size ``n`` of the group."""
    keys = [F.xxhash64(F.slice("sketch", 1 + ROWS * j, ROWS), F.lit(j)) for j in range(BANDS)]
    members = nodes.select("node", F.posexplode(F.array(*keys)).alias("band", "key"))
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return stored(members.join(sizes, "key").select("node", "band", "key", "n"), "bands")


def candidate_pairs(shared: DataFrame) -> DataFrame:
    """Pairs (a < b) of nodes that meet in a group of ``shared`` (``band_groups``), of large groups those with the leader only.

    What the leaders leave apart is compared in full by ``block_links``, so no pair of a large group is lost, and no step makes more
    rows than the groups have members.
    """
    degree = shared.groupBy("node").agg(F.sum("n").alias("degree"))
    return _grouped_pairs(shared.select("node", "key"), degree).distinct()


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        left, right = batch.column(2), batch.column(3)
        known: dict[int, tuple] = {}
        good = []
        for i in range(batch.num_rows):
            for node, column in ((a[i], left), (b[i], right)):
                if node not in known:
                    if len(known) > 256:
                        known.clear()
                    known[node] = shingles(column[i].as_py())
            good.append(similarity(known[a[i]] if a[i] in known else shingles(left[i].as_py()), known[b[i]]) >= THRESHOLD)
        yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(good, pa.bool_()))


def _bounds(left: list[tuple], right: list[tuple]) -> np.ndarray:
    """Upper bounds of the similarity of each left and each right set; the similarity itself where no shingle repeats.

    Shingles with equal counts add their share of the sum of greater counts, others at most the smaller of their two shares of a text.
    """
    m, n = len(left), len(right)
    keys, counts = np.concatenate([x for x, _ in left + right]), np.concatenate([c for _, c in left + right]).astype(np.float64)
    owner = np.repeat(np.arange(m + n), [len(x) for x, _ in left + right])
    total = np.bincount(owner, counts, m + n)
    # only shingles of both sides count
    names, place = np.unique(keys, return_inverse=True)
    both = np.zeros((2, len(names)), bool)
    both[(owner >= m).astype(np.intp), place] = True
    number = np.cumsum(both.all(0)) - 1
    wanted = both.all(0)[place]
    owner, counts, place = owner[wanted], counts[wanted], number[place[wanted]]
    order = np.argsort(place, kind="stable")
    owner, counts, place = owner[order], counts[order], place[order]
    equal, least, of_left, of_right = (np.zeros((m, n)) for _ in range(4))
    top = int(place[-1]) + 1 if len(place) else 0
    for low in range(0, top, COLUMNS):
        a, b = np.searchsorted(place, [low, low + COLUMNS])
        table = np.zeros((m + n, min(COLUMNS, top - low)))
        table[owner[a:b], place[a:b] - low] = counts[a:b]
        plain = table.max(0) <= 1
        once = table[:m, plain] @ table[m:, plain].T
        equal, least, of_left, of_right = equal + once, least + once, of_left + once, of_right + once
        x, y = table[:m, ~plain], table[m:, ~plain]
        of_left += x @ (y > 0).T.astype(np.float64)
        of_right += (x > 0).astype(np.float64) @ y.T
        before = 0.0
        for value in np.unique(np.r_[x.ravel(), y.ravel()]):
            if value:
                some = (x >= value).any(0) & (y >= value).any(0)
                p, q = x[:, some], y[:, some]
                equal += value * ((p == value).astype(np.float64) @ (q == value).T.astype(np.float64))
                least += (value - before) * ((p >= value).astype(np.float64) @ (q >= value).T.astype(np.float64))
                before = value
    sums = total[:m, None] + total[None, m:]
    with np.errstate(divide="ignore", invalid="ignore"):
        unequal = np.minimum((of_left - equal) / total[:m, None], (of_right - equal) / total[None, m:])
        found = equal / (sums - least) + unequal
    empty = (total[:m, None] == 0) | (total[None, m:] == 0)
    return np.where(empty, ((total[:m, None] == 0) & (total[None, m:] == 0)).astype(np.float64), found)


def _block_links(table: pa.Table) -> pa.Table:
    """Links between classes from two blocks of a large group (or one with itself): signatures, then bounds, then exact similarity.

    A pair counts in the first band that it shares; pairs of one class, also by links found here, are skipped.
    """
    column = lambda name: table[name].to_numpy()
    block, label, node = column("block"), column("label"), column("node")
    low, high, band = (int(column(name)[0]) for name in ("low", "high", "band"))
    sketch = table["sketch"].combine_chunks().flatten().to_numpy().reshape(-1, SIZE)
    one, two = np.flatnonzero(block == low), np.flatnonzero(block == high)
    pairs = []
    for k in range(0, len(one), STRIPE):
        part = one[k : k + STRIPE]
        good = (sketch[part, None, :] == sketch[None, two, :]).sum(2) >= LEAST_AGREEING
        good &= label[part, None] != label[None, two]
        if low == high:
            good &= node[part, None] < node[None, two]
        i, j = np.nonzero(good)
        i, j = part[i], two[j]
        earlier = (sketch[i, : ROWS * band] == sketch[j, : ROWS * band]).reshape(len(i), band, ROWS).all(2).any(1) if band else np.zeros(len(i), bool)
        pairs.append(np.stack([i[~earlier], j[~earlier]]))
    i, j = np.concatenate(pairs, 1) if pairs else np.zeros((2, 0), np.intp)
    links: list[tuple[int, int]] = []
    if len(i):
        rows, columns = np.unique(i), np.unique(j)
        texts = table["text"]
        sets = {int(r): shingles(texts[int(r)].as_py()) for r in np.union1d(rows, columns)}
        bound = _bounds([sets[r] for r in rows.tolist()], [sets[c] for c in columns.tolist()])[np.searchsorted(rows, i), np.searchsorted(columns, j)]
        near = np.flatnonzero(bound >= THRESHOLD - 1e-9)
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while up.get(x, x) != x:
                up[x] = x = up.get(up[x], up[x])
            return x

        near = near[np.argsort(-bound[near], kind="stable")]
        for r, c in zip(i[near].tolist(), j[near].tolist()):
            a, b = top(int(label[r])), top(int(label[c]))
            if a != b and similarity(sets[r], sets[c]) >= THRESHOLD:
                up[a] = b
                links.append((int(label[r]), int(label[c])))
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def large_members(shared: DataFrame, nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """Members of large groups that still hold several ``classes`` (node, label), each once for every two blocks it is compared in.

    The largest class of a group has blocks of its own, which are not compared with each other. How often a member appears depends on
    the group's blocks: no key gathers a group.
    """
    marked = shared.filter(F.col("n") > SMALL_GROUP).select("node", "band", "key").join(nodes, "node").join(classes, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sums = marked.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    groups = sums.groupBy("key").agg(F.count(F.lit(1)).alias("labels"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max(F.struct("n", "label", "bytes")).alias("main")).filter("labels > 1")
    blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("int")
    cuts = groups.select("key", F.col("main.label").alias("main"), blocks(F.col("main.n"), F.col("main.bytes")).alias("own"), blocks(F.col("n") - F.col("main.n"), F.col("bytes") - F.col("main.bytes")).alias("others"))
    dealt = marked.join(cuts, "key")
    salt = F.xxhash64("node", F.lit(7))
    dealt = dealt.withColumn("block", F.when(F.col("label") == F.col("main"), F.pmod(salt, F.col("own"))).otherwise(F.col("own") + F.pmod(salt, F.col("others"))).cast("int"))
    meetings = F.expr("transform(filter(sequence(0, own + others - 1), o -> greatest(o, block) >= own), o -> struct(least(o, block) as low, greatest(o, block) as high))")
    return dealt.select("key", "band", "node", "label", "block", "sketch", "key_a", "key_b", F.explode(meetings).alias("m")).select("*", "m.low", "m.high").drop("m")


def block_links(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) of classes among ``members`` (``large_members``), compared in full by their ``texts`` (key_a, key_b, text)."""
    whole = members.join(texts, ["key_a", "key_b"]).drop("key_a", "key_b")
    return whole.groupBy("key", "low", "high").applyInArrow(_block_links, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """The smallest node that each node of ``links`` (a, b) is connected to: node, label.

    Every round gives a node the smallest label among its neighbours and then that label's own label, so paths shorten by half;
    labels are written to the shared folder each round, and the rounds end when none changes.
    """
    # both directions from one reading: a union of two would verify every pair twice
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(links.select(F.explode(ways).alias("way")).select("way.*"), "links")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("label"), F.lit(True).alias("changed")), "labels")
    while labels.filter("changed").limit(1).count():
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("low"))
        lower = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "low").alias("next"))
        jump = lower.select(F.col("node").alias("at"), F.col("next").alias("beyond"))
        labels = stored(lower.join(jump, lower["next"] == jump["at"]).select("node", F.col("beyond").alias("label"), (F.col("beyond") < F.col("label")).alias("changed")), "labels")
    return labels.select("node", "label")


def _unnamed() -> F.Column:
    """Number of a text that no row with an id has, above all ids below NO_ID."""
    return F.lit(NO_ID) + F.shiftrightunsigned("key_a", 2)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Class of each row of ``docs`` (doc_id, text): doc_id, class_id (the smallest doc_id of the class), key_a, key_b.

    Documents are linked if the probability Jaccard similarity of their weighted five-word shingles (words of letters and digits,
    A-Z lowered) is 0.8 or more; a class is what the links connect. Every pair that shares a band is compared, through its group's
    leader, member by member or block against block, unless it is of one class already. A link is lost only by chance of the
    signatures: no band in common (0.0004 at 0.8), or fewer than ``LEAST_AGREEING`` of 100 components alike (0.00006 at 0.8);
    higher similarities lose less. Equal texts are one node. A text of fewer than five words has
    one shingle, all its words; texts without words are alike. One row for each row, repeated ones too; rows that share an id share
    a class. Rows without an id belong to classes like others; a class in which no row has an id has a number from NO_ID on.
    An empty table gives no rows; other columns are ignored.
    """
    sketched = stored(sketch_documents(docs), "sketches")
    texts = sketched.groupBy("key_a", "key_b").agg(F.min("doc_id").alias("low"), F.first("bytes").alias("bytes"), F.first("sketch").alias("sketch"))
    texts = texts.select("key_a", "key_b", F.coalesce("low", _unnamed()).alias("node"), "bytes", "sketch")
    nodes = stored(texts, "nodes")
    shared = band_groups(nodes)
    pairs = candidate_pairs(shared)
    # signatures first: they are small, and most chance meetings end here
    one = nodes.select(F.col("node").alias("a"), F.col("sketch").alias("sketch_a"), F.col("key_a").alias("a1"), F.col("key_b").alias("a2"))
    two = nodes.select(F.col("node").alias("b"), F.col("sketch").alias("sketch_b"), F.col("key_a").alias("b1"), F.col("key_b").alias("b2"))
    same = F.expr("aggregate(zip_with(sketch_a, sketch_b, (x, y) -> if(x = y, 1, 0)), 0, (n, x) -> n + x)")
    close = stored(pairs.join(one, "a").join(two, "b").filter(same >= LEAST_AGREEING).select("a", "b", "a1", "a2", "b1", "b2"), "pairs")
    # one text of each node that is in a pair or in a large group
    crowded = shared.filter(F.col("n") > SMALL_GROUP).select("node").distinct().join(nodes, "node").select("key_a", "key_b")
    wanted = close.select(F.col("a1").alias("key_a"), F.col("a2").alias("key_b")).unionByName(close.select(F.col("b1").alias("key_a"), F.col("b2").alias("key_b"))).unionByName(crowded).distinct()
    keyed = docs.select(*text_keys(F.col("text")), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # equal texts become one in each task, before they are shuffled; a merge join at every size: the pairs grow with the corpus,
    # and a plan that broadcast them while they are few would not last
    needed = keyed.groupBy("key_a", "key_b").agg(F.first("text").alias("text")).join(wanted.hint("merge"), ["key_a", "key_b"], "left_semi")
    needed = stored(needed, "texts")
    left = needed.select(F.col("key_a").alias("a1"), F.col("key_b").alias("a2"), F.col("text").alias("text_a"))
    right = needed.select(F.col("key_a").alias("b1"), F.col("key_b").alias("b2"), F.col("text").alias("text_b"))
    links = close.join(left, ["a1", "a2"]).join(right, ["b1", "b2"]).select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a long, b long")
    found = components(links)
    # what the leaders of large groups left apart, in full: links of classes, which join them
    beyond = components(block_links(large_members(shared, nodes, found), needed)).select(F.col("node").alias("label"), F.col("label").alias("least"))
    found = found.unionByName(beyond.select(F.col("label").alias("node"), "label").join(found.select("node"), "node", "left_anti"))
    found = found.join(beyond, "label", "left").select("node", F.coalesce("least", "label").alias("label"))
    classes = nodes.select("key_a", "key_b", "node").join(found, "node", "left").select("key_a", "key_b", F.coalesce("label", "node").alias("class_id"))
    return sketched.select("doc_id", "key_a", "key_b").join(classes, ["key_a", "key_b"]).select("doc_id", "class_id", "key_a", "key_b")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one document of each class, that with the smallest id, with all their columns as they were."""
    found = near_duplicates(docs)
    i, a, b = own_name(docs, "_id"), own_name(docs, "_a"), own_name(docs, "_b")
    # the equality becomes a join key beside the text's, so that copies of one text are dealt out by their ids
    chosen = found.filter(F.coalesce("doc_id", _unnamed()) == F.col("class_id")).select(F.col("doc_id").alias(i), F.col("key_a").alias(a), F.col("key_b").alias(b)).distinct()
    one, two = (k for k in text_keys(docs["text"]))
    kept = docs.withColumns({a: one, b: two}).join(chosen.withColumnsRenamed({a: a + "_", b: b + "_"}), F.col(a).eqNullSafe(F.col(a + "_")) & F.col(b).eqNullSafe(F.col(b + "_")) & docs["doc_id"].cast("long").eqNullSafe(chosen[i]), "left_semi")
    return kept.dropDuplicates(["doc_id", a, b]).drop(a, b)
