import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from quiverlog.llm import packing, token_output, warc
from quiverlog.llm.encoding import WordEncoder, load_tokenizer
from tests.llm.helpers import documents, odd_texts, prose

PAGES = "page_id long, url string, html string"


def test_archive_round_trip(spark, tmp_path):
    pages = [(3, "http://a/", "<p>é</p>"), (1, "http://b/\r\nEvil: x", "<p>é</p>"), (2, None, None), (8, "u", ""), (5, "u", "x\r\n\r\ny"), (5, "u", "x\r\n\r\ny"), (6, "u", "x\r\n\r\ny"), (None, "u", "<p>é</p>"), (None, "v", "alone"), (-4, "w", "z" * 50_000)]
    found = sorted((tuple(r) for r in warc.archive_round_trip(spark.createDataFrame(pages, PAGES)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    expected = []
    for i, _, h in pages:
        data = (h or "").encode()
        head = first.get(h or "")
        again = head is not None and i != head
        expected.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", head if again else None))
    assert found == sorted(expected, key=repr)
    assert warc.archive_round_trip(spark.createDataFrame([], PAGES)).collect() == []


def test_records_are_exact_and_payloads_stored_once(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "same" if i % 2 else f"own {i}") for i in range(20)], PAGES)
    warc.write_archive(pages, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "payloads")).count() == 11
    records = [bytes(r["record"]) for r in warc.read_records(spark, str(tmp_path)).collect()]
    assert len(records) == 20
    for r in records:
        head, _, block = r.partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and r.endswith(b"\r\n\r\n")
        size = int(head.lower().split(b"\r\ncontent-length: ")[1].split(b"\r\n")[0])
        assert len(block) == size + 4
    assert sum(b"WARC-Type: revisit" in r for r in records) == 9


def test_damaged_payloads_are_noticed(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "text")], PAGES)
    warc.write_archive(pages, str(tmp_path / "a"))
    payloads = spark.read.parquet(str(tmp_path / "a/payloads")).selectExpr("digest", "X'28B52FFD200421000074657374' as packed")
    payloads.write.parquet(str(tmp_path / "b/payloads"))
    spark.read.parquet(str(tmp_path / "a/headers")).write.parquet(str(tmp_path / "b/headers"))
    with pytest.raises(Exception, match="digest|decompress"):
        warc.read_archive(spark, str(tmp_path / "b")).collect()


@pytest.mark.parametrize(("file", "spaces"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_words_encode_like_whole_texts(file, spaces):
    path = public_tokenizers.path(file)
    encoder, tokenizer = WordEncoder(path, spaces), load_tokenizer(path)
    r = random.Random(1)
    parts = ["a", "bc", "É", "é", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", chr(0x2003), "1", "22", "'s", "It's", "!", "...", "日本", "<|endoftext|>", "İ", "ß", "\r\n", chr(0x200B), "Σ", "😀", "½", "²", "Ÿ", "—", "µ", "ª", "e" + chr(0x301)]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(800)] + [t or "" for _, t in odd_texts()]
    for t in texts:
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def expected_ids(file, text):
    return np.array([*load_tokenizer(public_tokenizers.path(file)).encode(text or "", add_special_tokens=False).ids, 0], "<u4")


def test_token_files(spark, tmp_path):
    texts = odd_texts() + [(100 + k, prose(k, 300)) for k in range(60)]
    found = [tuple(r) for r in token_output.token_round_trip(documents(spark, texts)).collect()]
    assert len(found) == len(texts)
    assert Counter((d, n, c) for d, _, n, c in found) == Counter((i, len(x), zlib.crc32(x.tobytes())) for i, t in texts for x in [expected_ids("byte_bpe_50k.json", t)])
    at = 0
    by_start = sorted(found, key=lambda x: x[1])
    for _, start, n, _ in by_start:
        assert start == at
        at += n
    ids = [d for d, *_ in by_start]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    assert token_output.token_round_trip(documents(spark, [])).collect() == []


def test_sequences_are_views_with_masks(tmp_path):
    writer = token_output.TokenWriter(f"file://{tmp_path}", "t.arrow", length=8, per_batch=3)
    for k in range(10):
        writer.append(np.arange(k, k + 7))
    writer.close()
    file = token_output.TokenFile(f"file://{tmp_path}", "t.arrow")
    stream = np.concatenate([np.arange(k, k + 7) for k in range(10)])
    assert len(file) == 9
    for k in range(9):
        ids, mask = file.sequence(k)
        assert not ids.flags.owndata and ids[mask].tolist() == stream[8 * k : 8 * k + 8].tolist()
    for start in range(70):
        assert file.ids(start, 70 - start).tolist() == stream[start:].tolist()
    assert [p.name for p in tmp_path.iterdir()] == ["t.arrow"]


def best_fit_decreasing(lengths, capacity):
    import bisect

    gaps, n = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(gaps, x)
        if i == len(gaps):
            n, gap = n + 1, capacity - x
        else:
            gap = gaps.pop(i) - x
        bisect.insort(gaps, gap)
    return n


def check_packing(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("ranges", [250_000, 9])
def test_packing(spark, ranges):
    texts = odd_texts() + [(100 + k, prose(k, 5 + 9 * (k % 50))) for k in range(150)]
    pieces = packing.cut_pieces(documents(spark, texts))
    found = packing.best_fit(pieces, rows_per_range=ranges).collect()
    expected = Counter()
    for i, t in texts:
        ids = expected_ids("word_bpe_49k.json", t)
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            expected[(i, k // 2048, k, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter(tuple(r[:5]) for r in found) == expected
    n = check_packing(found, 2048)
    assert n <= best_fit_decreasing([r["length"] for r in found], 2048) + 1


def test_rounds_place_everything():
    r = np.random.default_rng(4)
    for capacity, draw in ((2048, lambda n: np.minimum(2048, r.lognormal(6, 1, n).astype(int) + 1)), (100, lambda n: r.integers(1, 101, n)), (64, lambda n: np.full(n, 21)), (10, lambda n: np.full(n, 10))):
        lengths = draw(5000)
        counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
        plan, n = packing.match_rounds(counts, capacity)
        used = Counter()
        for length in counts:
            own = plan[plan[:, 0] == length]
            assert own[:, 1].tolist() == [0, *np.cumsum(own[:, 2])[:-1]] and own[:, 2].sum() == counts[length]
        for length, _, many, first, _ in plan.tolist():
            for s in range(first, first + many):
                used[s] += length
        assert max(used.values()) <= capacity and len(used) == n
        assert n <= 1.02 * best_fit_decreasing(lengths.tolist(), capacity) + 1
    assert packing.match_rounds({})[1] == 0


def test_packing_nothing(spark):
    assert packing.pack_documents(documents(spark, [])).collect() == []
