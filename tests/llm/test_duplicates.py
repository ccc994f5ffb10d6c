import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quiverlog.llm import probminhash, suffix_dedup
from tests.llm.helpers import documents, odd_texts, prose, words


# --- repeated strings ---


def brute_repeats(texts):
    seen = Counter()
    for _, t in texts:
        b = (t or "").encode()
        seen.update(b[i : i + 200] for i in range(len(b) - 199))
    out = []
    for d, t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((d, len(b), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def repeat_case():
    random.seed(3)
    noise = lambda n: "".join(random.choice("abcdefgh é") for _ in range(n))
    passages = [noise(random.randint(150, 400)) for _ in range(6)]
    texts = [(k, "".join(random.choice([noise(random.randint(0, 120)), random.choice(passages), "ab" * random.randint(1, 200), "z" * random.randint(1, 300)]) for _ in range(random.randint(0, 8)))) for k in range(50)]
    return texts + [(t, x) for t, x in odd_texts() if len(x or "") < 5000] + [(1000, texts[3][1]), (1001, texts[3][1]), (1001, texts[3][1]), (50, "q" * 199), (51, "w" * 200), (52, "v" * 201)]


@pytest.mark.parametrize(("hot", "block", "slab"), [(512, 2 << 20, 1 << 18), (2, 3000, 700)])
def test_repeats_equal_brute_force(spark, monkeypatch, hot, block, slab):
    for name, value in (("HOT", hot), ("BLOCK", block), ("SLAB", slab)):
        monkeypatch.setattr(suffix_dedup, name, value)
    texts = repeat_case()
    assert sorted((tuple(r) for r in suffix_dedup.repeated_bytes(documents(spark, texts).withColumnRenamed("lang", "spans")).collect()), key=repr) == brute_repeats(texts)


@pytest.mark.parametrize("extra", [0, 1, 4, 9])
def test_no_bucket_grows_with_a_shared_passage(spark, monkeypatch, extra):
    """A passage in many texts, with other bytes around it in each: results as by brute force, with buckets split above 16."""
    monkeypatch.setattr(suffix_dedup, "HOT", 16)
    r = random.Random(extra)
    noise = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    passage = noise(200 + extra)
    texts = [(k, noise(r.randint(0, 90)) + passage + noise(r.randint(0, 90))) for k in range(150)]
    texts += [(500 + k, noise(300)[: 240 + k] + passage[: 199 + k % 3]) for k in range(20)]
    docs = documents(spark, texts)
    assert sorted((tuple(x) for x in suffix_dedup.repeated_bytes(docs).collect()), key=repr) == brute_repeats(texts)
    table = list(suffix_dedup._single_strings([pa.record_batch({"bucket": pa.array([5, -5]), "context_key": pa.array([b"a", b"b"]), "context": pa.array([b"x" * 203, b"y" * 200]), "n": pa.array([1, 2])})]))[0]
    assert table.num_rows == 5 and len(set(table.column(2).to_pylist())) == 2


def test_repeats_of_nothing(spark):
    assert suffix_dedup.repeated_bytes(documents(spark, [])).collect() == []
    assert suffix_dedup.remove_repeated(documents(spark, [])).collect() == []


def test_repeats_are_cut_out_of_documents(spark):
    passage = prose(1, 80)
    texts = [(1, prose(2, 50) + " " + passage + " " + prose(3, 50)), (2, passage), (3, prose(4, 50)), (4, None)]
    docs = documents(spark, texts).withColumnRenamed("source", "_spans")
    found = {r["doc_id"]: r for r in suffix_dedup.remove_repeated(docs).collect()}
    assert suffix_dedup.remove_repeated(docs).columns == docs.columns and len(found) == 4
    assert passage[20:-20] not in found[1]["text"] and found[1]["text"].startswith(prose(2, 50)) and found[1]["text"].endswith(prose(3, 50))
    assert (found[2]["text"], found[2]["n_chars"]) == ("", 0) and found[1]["n_chars"] == len(found[1]["text"])
    assert found[3]["text"] == texts[2][1] and found[4]["text"] is None


def test_anchors_cover_every_string_once():
    texts = [t.encode() for _, t in repeat_case() if t]
    number, anchor, low, high, _ = suffix_dedup.anchors(texts)
    for i, t in enumerate(texts):
        starts = [s for a, b in zip(low[number == i], high[number == i]) for s in range(a, b + 1)]
        assert sorted(starts) == list(range(max(0, len(t) - 199)))
    assert ((anchor >= high) & (anchor + suffix_dedup.GRAM <= low + 200)).all()


def test_buckets_are_sorted_suffixes():
    random.seed(5)
    unit = bytes(random.choice(b"ab") for _ in range(90))
    data = np.frombuffer(unit * 12 + bytes(random.choice(b"abc") for _ in range(900)) + unit * 5 + bytes(800), np.uint8)
    ranks = suffix_dedup.CoverRanks(data)
    raw = data.tobytes()
    for residue in (0, 7, 33):
        bucket = np.arange(residue, len(data) - 760, 64)
        order = suffix_dedup.sorted_bucket(data, bucket.copy(), ranks)
        keys = [raw[p : p + 200] for p in order]
        assert keys == sorted(keys) and sorted(order) == bucket.tolist()
    places = [p for p in range(0, 900, 13)]
    for a in places:
        for b in places:
            if raw[a : a + 64] == raw[b : b + 64]:
                k = ranks.shift[a % 64, b % 64]
                x, y = raw[a + k : a + k + 256], raw[b + k : b + k + 256]
                assert ranks.before(a, b) == (x > y) - (x < y)


# --- near duplicates ---


def edited(text, n, seed):
    r, w = random.Random(seed), text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = "changed" + str(r.randrange(1000))
    return " ".join(w)


def near_case():
    texts = []
    for g in range(6):
        base = prose(100 + g, 150)
        texts += [(1000 * (g + 1) + k, edited(base, k % 4, 7 * g + k)) for k in range(8)]
    hub = prose(500, 300)
    texts += [(9000 + k, edited(hub, 3, k)) for k in range(60)]
    passage = prose(600, 40)
    texts += [(20000 + k, prose(700 + k, 60) + " " + passage + " " + prose(800 + k, 60)) for k in range(40)]
    return texts + odd_texts() + [(30000 + k, "one two three four five six seven eight nine ten " * 4) for k in range(5)] + [(31000, "One, two"), (31001, "one two!"), (31002, "two one")]


def brute_classes(texts):
    sets = {t: probminhash.shingles(t) for t in {t or "" for _, t in texts}}
    keys = sorted(sets)
    up = {t: t for t in keys}

    def top(t):
        while up[t] != t:
            t = up[t]
        return t

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if probminhash.similarity(sets[a], sets[b]) >= 0.8:
                up[top(a)] = top(b)
    low = {}
    for d, t in texts:
        if d is not None:
            low[top(t or "")] = min(d, low.get(top(t or ""), d))
    return {(d, low.get(top(t or ""))) for d, t in texts}


@pytest.mark.parametrize("small", [12, 3])
def test_classes_equal_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(probminhash, "SMALL_GROUP", small)
    texts = near_case()
    found = probminhash.near_duplicates(documents(spark, texts)).collect()
    assert len(found) == len(texts)
    assert {(r["doc_id"], r["class_id"] if r["class_id"] < probminhash.NO_ID else None) for r in found} == brute_classes(texts)


@pytest.mark.parametrize("block", [512, 40])
def test_links_inside_large_groups(spark, monkeypatch, block):
    """Texts that meet in large groups only, most of them unlike every leader."""
    monkeypatch.setattr(probminhash, "BLOCK", block)
    hub = prose(3, 200)
    texts = []
    for k in range(150):
        one = edited(hub, 3, 3000 + k)
        texts += [(2 * k, one), (2 * k + 1, edited(one, 5, 15000 + k))]
    texts.append((1000, hub + " " + " ".join(hub.split()[:8])))
    found = probminhash.near_duplicates(documents(spark, texts)).collect()
    assert {(r["doc_id"], r["class_id"]) for r in found} == brute_classes(texts)


def test_bounds_hold(monkeypatch):
    monkeypatch.setattr(probminhash, "COLUMNS", 30)
    r = np.random.default_rng(2)
    base = r.integers(1, 2**63, 120).astype(np.uint64)
    sets = [(np.empty(0, np.uint64), np.empty(0, np.int64))]
    for k in range(40):
        own = np.unique(np.r_[base[r.random(120) < 0.9], r.integers(1, 2**63, 5).astype(np.uint64)])
        sets.append((own, np.ones(len(own), np.int64) if k % 2 else np.where(r.random(len(own)) < 0.1, r.integers(1, 4, len(own)), 1)))
    bounds = probminhash._bounds(sets[:25], sets)
    exact = np.array([[probminhash.similarity(a, b) for b in sets] for a in sets[:25]])
    assert (bounds >= exact - 1e-12).all() and (bounds - exact).max() < 0.2
    once = np.array([not len(c) or c.max() == 1 for _, c in sets])
    assert np.abs(bounds - exact)[once[:25]][:, once].max() < 1e-12


def test_one_of_each_class_stays(spark):
    docs = documents(spark, near_case()).withColumnRenamed("source", "_a")
    kept = probminhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    classes = {c for _, c in brute_classes(near_case()) if c is not None}
    assert {i for i in ids if i is not None} == classes and max(ids.values()) == 1
    base = prose(1, 100)
    rows = [(None, base), (None, edited(base, 1, 1)), (-5, edited(base, 1, 2)), (None, prose(2, 100)), (None, edited(prose(2, 100), 1, 3)), (None, prose(2, 100))]
    assert [r["doc_id"] for r in probminhash.keep_one_of_each(documents(spark, rows)).orderBy("doc_id").collect()] == [None, -5]


def test_no_documents(spark):
    assert probminhash.near_duplicates(documents(spark, [])).collect() == []
    assert probminhash.keep_one_of_each(documents(spark, [])).collect() == []


def test_signatures_estimate_probability_jaccard():
    r = np.random.default_rng(1)
    errors = []
    for _ in range(60):
        own, shared = r.integers(1, 2**63, 400).astype(np.uint64), r.integers(1, 2**63, int(r.integers(5, 400))).astype(np.uint64)
        a = np.unique(np.r_[own[:100], shared])
        b = np.unique(np.r_[own[200 : 200 + int(r.integers(0, 150))], shared])
        x, y = (a, r.integers(1, 5, len(a))), (b, r.integers(1, 5, len(b)))
        p, q = dict(zip(*(v.tolist() for v in x))), dict(zip(*(v.tolist() for v in y)))
        exact = sum(1 / sum(max(p.get(j, 0) / p[i], q.get(j, 0) / q[i]) for j in p.keys() | q.keys()) for i in p.keys() & q.keys())
        assert abs(exact - probminhash.similarity(x, y)) < 1e-9
        s = probminhash.signatures([x, y], 400)
        errors.append((s[0] == s[1]).mean() - exact)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.04


def test_shingles_of_long_texts_in_pieces(monkeypatch):
    text = " ".join(words(8, 3000))
    whole = probminhash.shingles(text)
    monkeypatch.setattr(probminhash, "SEGMENT", 700)
    pieces = probminhash.shingles(text)
    assert whole[0].tolist() == pieces[0].tolist() and whole[1].tolist() == pieces[1].tolist()
    assert probminhash.shingles("A b, c d e!")[0].tolist() == probminhash.shingles("a B c\nd E")[0].tolist()
    assert len(probminhash.shingles(None)[0]) == 0 and len(probminhash.shingles("...")[0]) == 0


@pytest.mark.parametrize("text", [
    "x" * 2000 + " " + prose(1, 300), " |-" * 700 + prose(2, 300), prose(3, 200) + " " * 3000 + prose(4, 200), "a b c " + "y" * 900 + " " + "z" * 5000 + " d e",
    prose(5, 200) + "-" * 3000, "q" * 3000, " " * 3000, "one two " + " " * 3000 + "three", prose(6, 150) + " " * 900 + "end",
])
def test_shingles_of_blobs_and_blanks_in_pieces(monkeypatch, text):
    whole = probminhash.shingles(text)
    monkeypatch.setattr(probminhash, "SEGMENT", 700)
    pieces = probminhash.shingles(text)
    assert whole[0].tolist() == pieces[0].tolist() and whole[1].tolist() == pieces[1].tolist()


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 103)], "a long, b long")
    found = {r["node"]: r["label"] for r in probminhash.components(links).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}


def test_links_are_made_once(spark, tmp_path):
    """Links come out of verification, the dearest step: no row of theirs is computed a second time."""
    log = str(tmp_path / "seen")

    def noted(batches):
        for batch in batches:
            with open(log, "a") as f:
                f.write("x" * batch.num_rows)
            yield batch

    links = spark.createDataFrame([(i, i + 1) for i in range(0, 20, 2)], "a long, b long").coalesce(1).mapInArrow(noted, "a long, b long")
    assert {(r["node"], r["label"]) for r in probminhash.components(links).collect()} == {(i, i // 2 * 2) for i in range(20)}
    assert len(open(log).read()) == 10


def colliding_texts():
    """Two texts of 16 letters and signs with the same xxhash64: the second word is solved for."""
    full, one, two, four = (1 << 64) - 1, 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x85EBCA77C2B2AE63
    turn = lambda x, n: (x << n | x >> 64 - n) & full
    mixed = lambda x: turn(x * two & full, 31) * one & full
    solved = lambda y: turn(y * pow(one, -1, 1 << 64) & full, 33) * pow(two, -1, 1 << 64) & full
    after = lambda t: (turn((42 + 0x27D4EB2F165667C5 + 16 & full) ^ mixed(int.from_bytes(t, "little")), 27) * one + four) & full
    head, tail = b"abcdefgh", b"ijklmnop"
    target = after(head) ^ mixed(int.from_bytes(tail, "little"))
    for k in range(10**6):
        other = b"%08d" % k
        rest = solved(target ^ after(other)).to_bytes(8, "little")
        if all(0x21 <= c <= 0x7E for c in rest):
            return (head + tail).decode(), (other + rest).decode()


def test_texts_of_equal_hash_stay_apart(spark):
    a, b = colliding_texts()
    docs = documents(spark, [(1, a), (2, b), (3, a)])
    assert docs.filter("doc_id < 3").selectExpr("xxhash64(text) as h").distinct().count() == 1
    assert {r["doc_id"]: r["class_id"] for r in probminhash.near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 1}
    assert {r["doc_id"] for r in probminhash.keep_one_of_each(docs).collect()} == {1, 2}
