import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quiverlog.llm import compression_rules, decontaminate, quality_net, sharding, token_counts
from tests.llm.helpers import documents, odd_texts, prose, words


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- decontamination ---

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_contamination(docs, items):
    windows = {}
    for item, text in items:
        w = WORD.findall((text or "").translate(LOWER))
        size = min(13, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    out = []
    for doc, text in docs:
        w = WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
                    found |= windows[tuple(w[i : i + size])]
        ids = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def contamination_case():
    base = words(1, 60)
    items = [(1, " ".join(base[:20])), (12, " ".join(base[:15])), (2, "Kelvin Éa " + " ".join(base[30:50])), (3, "two words"), (4, "Ünique"), (None, "no number item"), (5, None), (6, "..."), (1, " ".join(base[:20]))]
    docs = odd_texts() + [
        (20, prose(5, 30) + "! " + ", ".join(base[:20]).upper() + " " + prose(6, 30)), (21, prose(7, 400) + " " + " ".join(base[2:15]) + " " + prose(8, 400)), (22, " ".join(base[1:13])),
        (23, "TWO... Words two words"), (24, "ünique"), (25, "Ünique éa kelvin"), (26, "no number item"), (21, "another text of one id two words"),
    ]
    return docs, items


def test_contamination_equals_brute_force(spark, monkeypatch):
    docs, items = contamination_case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = lambda: rows(decontaminate.contamination(documents(spark, docs), bench).drop("key_a", "key_b"))
    assert found() == brute_contamination(docs, items)
    monkeypatch.setattr(decontaminate, "GRAMS_PER_BROADCAST", 7)
    assert found() == brute_contamination(docs, items)
    monkeypatch.setattr(decontaminate, "LONG_GRAM", 20)
    monkeypatch.setattr(decontaminate, "ROWS_TO_BROADCAST", 0)
    assert found() == brute_contamination(docs, items)


def test_lines_that_all_items_share(spark):
    line = " ".join(words(70, 16))
    items = [(i, f"{line} {prose(100 + i, 14)}" if i % 3 else line) for i in range(90)] + [(None, line)]
    docs = [(i, f"{prose(300 + i, 9)} {line}") for i in range(40)] + [(50, items[1][1]), (51, items[2][1] + " x " + items[1][1]), (52, prose(52, 30)), (53, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    grams = decontaminate.grams_of(decontaminate.benchmark_windows(bench))
    assert max(len(r["item_list"]) for r in grams.collect()) < 64  # no item ids in what is broadcast
    assert rows(decontaminate.contamination(documents(spark, docs), bench).drop("key_a", "key_b")) == brute_contamination(docs, items)


def test_keepers_without_broadcasts(spark, monkeypatch):
    docs, items = contamination_case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = documents(spark, docs + docs)
    kept = rows(decontaminate.remove_contaminated(table, bench))
    monkeypatch.setattr(decontaminate, "ROWS_TO_BROADCAST", 0)
    assert rows(decontaminate.remove_contaminated(table, bench)) == kept
    none = spark.createDataFrame([], "item_id long, text string")
    assert rows(decontaminate.remove_contaminated(table, none)) == rows(table)
    assert rows(decontaminate.remove_spans(table, none)) == rows(table.select("doc_id", "text"))
    assert rows(decontaminate.remove_spans(documents(spark, []), bench)) == []


def test_contaminated_documents_and_spans_go(spark):
    docs, items = contamination_case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    table = documents(spark, docs).withColumnRenamed("source", "_id")
    kept = decontaminate.remove_contaminated(table, bench)
    assert kept.columns == table.columns
    clean = [(d, t) for (d, t) in docs if not brute_contamination([(d, t)], items)[0][5]]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted(clean, key=repr)
    cut = {(r["doc_id"], r["text"]) for r in decontaminate.remove_spans(documents(spark, docs), bench).collect()}
    assert (23, "") in cut and (24, "ünique") in cut and (None, None) in cut and (10, "a") in cut


def test_contamination_of_empty_tables(spark):
    none, bench = documents(spark, []), spark.createDataFrame([], "item_id long, text string")
    assert rows(decontaminate.contamination(none, bench)) == []
    docs = documents(spark, odd_texts())
    assert {r["n_hit"] for r in decontaminate.contamination(docs, bench).collect()} == {0}
    assert decontaminate.contamination(docs, bench).count() == len(odd_texts())


# --- compression rules ---


def brute_rules(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def test_rules_equal_brute_force(spark):
    base = prose(3, 30)
    texts = odd_texts() + [(30, base + " x " + base), (31, "\n".join([base, base, " ", "", base + " "])), (32, " ".join(["la"] * 40)), (33, prose(4, 200) + " " + " ".join(words(5, 9) * 2))]
    found = compression_rules.compression_rules(documents(spark, texts).withColumnRenamed("lang", "kept")).collect()
    assert sorted(((r[0], *r[1:7]) for r in found), key=repr) == sorted(((i, *brute_rules(t)) for i, t in texts), key=repr)
    assert compression_rules.compression_rules(documents(spark, [])).collect() == []


def test_verdict_rejects_repetition_and_noise():
    import random

    random.seed(1)
    packer = compression_rules.zstandard.ZstdCompressor(level=compression_rules.LEVEL)
    good = lambda t: compression_rules.measure(t, packer)[6]
    assert good(prose(11, 40)) and good(prose(12, 3000))
    noise = " ".join("".join(chr(random.randint(33, 126)) for _ in range(40)) for _ in range(300))
    assert not good(noise)
    varied = " ".join(f"all work and no play makes {k} dull" for k in range(900))
    assert not good(varied)
    assert not good(prose(13, 1200) + " " + noise)  # by its chunks


def brute_verdict(text):
    """Ratio, share of bytes in bad chunks and verdict, chunk by chunk and with lines between limits drawn by hand."""
    import math

    data = (text or "").encode()
    packed = lambda x: len(compression_rules.zstandard.ZstdCompressor(level=3).compress(x)) / len(x)

    def inside(ratio, size):
        for (n, a, b), (m, c, d) in zip(compression_rules.BANDS, compression_rules.BANDS[1:] + ((1 << 60, *compression_rules.BANDS[-1][1:]),)):
            if n <= size < m:
                part = math.log(size / max(n, 1)) / math.log(m / max(n, 1))
                return a + (c - a) * part <= ratio <= b + (d - b) * part

    if not data:
        return 1.0, 0.0, False
    chunks = [data[i : i + 4096] for i in range(0, len(data), 4096)]
    if len(chunks) > 1 and len(chunks[-1]) < 1024:
        last = chunks.pop()
        chunks[-1] += last
    bad = 0 if len(data) < 4096 + 1024 else sum(len(x) for x in chunks if not inside(packed(x), len(x)))
    return packed(data), bad / len(data), inside(packed(data), len(data)) and bad / len(data) <= 0.25


def test_verdicts_equal_brute_force(spark):
    """Ratios, chunk shares and verdicts of prose, symbols, tables, noise and blends of them, of many lengths."""
    import random

    r, texts = random.Random(8), odd_texts()
    for k in range(120):
        size = 2 ** (5 + k % 11) + r.randrange(40)
        kinds = [prose(k, size)[:size], " ".join(w + r.choice(["###", "%%%", "$$$"]) for w in words(k, size))[:size], " | ".join(words(k, size, 3))[:size], "".join(chr(r.randint(33, 126)) for _ in range(size))]
        texts.append((1000 + k, r.choice(kinds) if k % 3 else r.choice(kinds) + "\n" + r.choice(kinds)))
    found = compression_rules.compression_rules(documents(spark, texts)).select("doc_id", "whole_ratio", "bad_chunk_share", "kept").collect()
    expected = []
    for i, t in texts:
        ratio, share, good = brute_verdict(t)
        expected.append((i, round(ratio, 9), round(share, 9), good and not brute_rules(t)[-1]))
    assert sorted(((i, round(a, 9), round(b, 9), k) for i, a, b, k in found), key=repr) == sorted(expected, key=repr)
    kept = [k for *_, k in expected]
    assert 10 < sum(kept) < len(kept) - 40


@pytest.mark.parametrize("size", [256, 400, 511, 512, 1000, 1023, 1024, 1500, 4000, 4095, 6000])
def test_base64_is_rejected_at_every_length(size):
    import base64
    import random

    packer = compression_rules.zstandard.ZstdCompressor(level=compression_rules.LEVEL)
    good = lambda t: compression_rules.measure(t, packer)[6]
    for seed in range(10):
        blob = base64.b64encode(random.Random(seed).randbytes(size)).decode()
        assert not good(" ".join(blob[i : i + 11] for i in range(0, len(blob), 11))[:size])
        assert good(prose(seed, size)[:size])


# --- piece counts ---


def greedy(word, pieces):
    n, at = 0, 0
    while at < len(word):
        stop = next((s for s in range(len(word), at, -1) if word[at:s] in pieces), None)
        if stop is None:
            return -1
        n, at = n + 1, stop
    return n


def test_automaton_equals_greedy_matching():
    import itertools

    pieces = [b"a", b"ab", b"abcd", b"bc", b"b", b"cc", b"dab", b"aaaa"]
    counter = token_counts.PieceCounter(pieces)
    for n in range(7):
        for letters in itertools.product(b"abcd", repeat=n):
            assert counter.count(bytes(letters)) == greedy(bytes(letters), set(pieces)), letters


def test_piece_counts_with_the_public_vocabulary(spark):
    pieces = set(token_counts.read_pieces(token_counts.default_vocabulary()))
    texts = odd_texts()
    expected = []
    for i, t in texts:
        data = (t or "").encode()
        expected.append((i, len(data), len(data.split()), sum(greedy(b" " + w, pieces) for w in data.split())))
    assert rows(token_counts.count_pieces(documents(spark, texts))) == sorted(expected, key=repr)
    assert token_counts.count_pieces(documents(spark, [])).collect() == []


# --- shards ---


def test_shards_equal_one_running_sum(spark):
    texts = [(i, t) for i, t in odd_texts() if i not in (3, None)] + [(100 + k, prose(k, k % 40)) for k in range(300)]
    found = {r["doc_id"]: r for r in sharding.shard_by_bytes(documents(spark, texts), n_shards=7, rows_per_range=40).collect()}
    ordered = sorted(texts)
    sizes = [len((t or "").encode()) + 8 for _, t in ordered]
    total, at, slots = sum(sizes), 0, Counter()
    for (i, t), size in zip(ordered, sizes):
        shard = (2 * at + size) * 7 // (2 * total)
        r = found[i]
        assert (r["size"], r["shard"], r["slot"], r["law"], r["grown_shard"], r["text_crc32"]) == (size, shard, slots[shard], "bytes", None, zlib.crc32((t or "").encode()))
        slots[shard] += 1
        at += size
    assert len(found) == len(texts)


def test_shards_of_ties_and_nothing(spark):
    found = sharding.shard_by_bytes(documents(spark, odd_texts() * 3), n_shards=3).collect()
    assert len(found) == 3 * len(odd_texts())
    for shard in {r["shard"] for r in found}:
        slots = sorted(r["slot"] for r in found if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert sharding.shard_by_bytes(documents(spark, [])).collect() == []


def test_written_shards(spark, tmp_path):
    """Every row once, also with null and repeated ids, repeated rows and a column of the shard's name."""
    texts = odd_texts() * 2 + [(100 + i, prose(i, 20)) for i in range(30)]
    docs = documents(spark, texts).withColumnRenamed("source", "shard")
    sharding.write_shards(docs, str(tmp_path / "s"), n_shards=4)
    found = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(map(tuple, found.select(*docs.columns).collect()), key=repr) == sorted(map(tuple, docs.collect()), key=repr)
    own = next(c for c in found.columns if c.startswith("shard_"))
    assert found.select(own, "slot").distinct().count() == len(texts)


# --- quality ---


def test_network_gradients():
    net = quality_net.new_net(2)
    texts, labels = [prose(1, 60).encode(), prose(2, 200).encode(), b"", b"xyz"], np.array([1, 0, 1, 0], np.float32)
    for x in net.parts():
        x[:] = x.astype(np.float32)

    def loss():
        p = quality_net.scores(net, texts)
        return float(-np.mean(np.where(labels == 1, np.log(p), np.log(1 - p))))

    for x, g in zip(net.parts(), quality_net._gradients(net, texts, labels)):
        flat, place = x.ravel(), int(np.abs(g).ravel().argmax())
        old, step = flat[place], 1e-2
        flat[place] = old + step
        up = loss()
        flat[place] = old - step
        down = loss()
        flat[place] = old
        assert abs((up - down) / (2 * step) - g.ravel()[place]) < 0.05 * abs(g.ravel()[place]) + 2e-4


def quality_case(spark, n=240):
    texts = [(i, prose(i, 40) if i % 3 else "|".join(x.upper() for x in words(i, 40))) for i in range(n)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(n)] + [(None, 1), (4, None)], "doc_id long, quality int")
    return texts, labels


def test_quality_on_held_out_rows(spark):
    texts, labels = quality_case(spark)
    found = quality_net.quality_scores(documents(spark, texts + [(900, None), (901, ""), (None, "x")]), labels).collect()
    assert len(found) == len(texts) + 3 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in found)
    held = [r for r in found if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 and r["doc_id"] < 900]
    assert all(r["held_out"] for r in held)
    assert np.mean([r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held]) > 0.95
    kept = quality_net.keep_good(documents(spark, texts).withColumnRenamed("lang", "_text"), labels)
    assert kept.columns == ["doc_id", "text", "_text", "source", "n_chars"]
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in found if r["predicted"] and r["doc_id"] is not None and r["doc_id"] < 900}


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality_net.quality_scores(documents(spark, odd_texts()), none).collect()} == {0.5}
    assert quality_net.quality_scores(documents(spark, []), none).collect() == []


def brute_score(net, text):
    """The network's score by plain loops: every window of every filter, chunk by chunk."""
    d, f = quality_net.DIMS, quality_net.FILTERS
    span = lambda at: [text[k] if k < len(text) else 0 for k in range(at, at + quality_net.WIDTH)]

    def maxima(begin, end):
        best = [0.0] * f
        for at in range(begin, min(end, len(text)), quality_net.STEP):
            seen = [float(net.table[b, j]) for b in span(at) for j in range(d)]
            for k in range(f):
                best[k] = max(best[k], sum(x * float(w) for x, w in zip(seen, net.filters[:, k])) + float(net.bias[k]))
        return best

    step, blocks = quality_net.BLOCK, -(-(len(text) + quality_net.WIDTH - quality_net.STEP) // quality_net.BLOCK)
    chunks = [maxima(c * step, (c + 2) * step) for c in range(max(1, blocks - 1))]
    z = sum(max(c[k] for c in chunks) * float(net.most[k]) + sum(c[k] for c in chunks) / len(chunks) * float(net.mean[k]) for k in range(f)) + float(net.level[0])
    return 1 / (1 + np.exp(-z))


@pytest.mark.parametrize("size", [0, 3, 16, 250, 256, 300, 512, 700])
def test_scores_equal_brute_force(size):
    net, text = quality_net.new_net(9), prose(size, 300).encode()[:size]
    assert abs(quality_net.scores(net, [b"before", text, b"after"])[1] - brute_score(net, text)) < 1e-5


@pytest.mark.parametrize("size", [0, 1, 244, 245, 250, 255, 256, 257, 600, 5000])
def test_scores_do_not_depend_on_neighbours(size):
    net, text = quality_net.new_net(3), prose(size, 2000).encode()[:size]
    alone = quality_net.scores(net, [text])[0]
    assert abs(quality_net.scores(net, [b"other" * 100, text, b"another", b""])[1] - alone) < 1e-5
