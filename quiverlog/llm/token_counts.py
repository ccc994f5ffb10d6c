"""Greedy word-piece lengths by a linear automaton over the vocabulary's trie."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from quiverlog.llm.common import modest_batches

#: Words whose counts a worker remembers; forgotten all at once when full, so memory stays bounded.
CACHE_WORDS = 300_000
SCHEMA = "doc_id long, n_bytes long, n_words long, n_pieces long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 characters stand for themselves, the others for 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def read_pieces(path: str) -> list[bytes]:
    """The vocabulary of a byte-level tokenizer file as byte strings; a word's first piece begins with a space."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    alphabet = byte_alphabet()
    return [bytes(alphabet[c] for c in piece) for piece in vocabulary if all(c in alphabet for c in piece)]


class PieceCounter:
    """Trie with failure links. ``pops[v]`` pieces are complete when the automaton fails from node v to ``fail[v]``.

    A word is read once from left to right; every failure shortens the pending text, so the time is linear in its length.
    ``count`` is the number of pieces that longest-match-first segmentation gives, -1 where it gets stuck (no piece fits).
    """

    def __init__(self, pieces: list[bytes]):
        self.step: dict[int, int] = {}
        parents, symbols, ends = [0], [0], [False]
        for piece in pieces:
            node = 0
            for byte in piece:
                key = node << 8 | byte
                if key not in self.step:
                    self.step[key] = len(parents)
                    parents.append(node)
                    symbols.append(byte)
                    ends.append(False)
                node = self.step[key]
            if node:
                ends[node] = True
        depth = [0] * len(parents)
        for v in range(1, len(parents)):  # a parent always has the smaller number
            depth[v] = depth[parents[v]] + 1
        self.fail, self.pops = [-1] * len(parents), [0] * len(parents)
        for v in sorted(range(1, len(parents)), key=depth.__getitem__):
            if ends[v]:
                self.fail[v], self.pops[v] = 0, 1
                continue
            at, popped = self.fail[parents[v]], self.pops[parents[v]]
            while at >= 0 and (at << 8 | symbols[v]) not in self.step:
                popped += self.pops[at]
                at = self.fail[at]
            if at >= 0:
                self.fail[v], self.pops[v] = self.step[at << 8 | symbols[v]], popped

    def count(self, word: bytes) -> int:
        step, fail, pops = self.step, self.fail, self.pops
        node = n = 0
        for byte in word:
            while (after := step.get(node << 8 | byte)) is None:
                n += pops[node]
                node = fail[node]
                if node < 0:
                    return -1
            node = after
        while node:
            n += pops[node]
            node = fail[node]
            if node < 0:
                return -1
        return n


@lru_cache(maxsize=2)
def counter_of(path: str) -> PieceCounter:
    return PieceCounter(read_pieces(path))


def count_pieces(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Number of longest-match pieces of each row of ``docs`` (doc_id, text); pieces are never built.

    Words are split at ASCII white space and get a leading space, as the vocabulary marks word starts. A word that no
    piece sequence covers counts as one unknown piece. Null or empty texts have no words. Each row stands for itself:
    repeated rows give repeated results, an empty table gives none, other columns are ignored. No shuffle, one pass.
    """
    path = vocabulary or default_vocabulary()
    modest_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter_of(path).count
        known: dict[bytes, int] = {}
        for batch in batches:
            texts, sizes, words_of, pieces_of = batch.column(1), [], [], []
            for i in range(batch.num_rows):
                data = (texts[i].as_py() or "").encode("utf-8", "surrogatepass")
                words, total = data.split(), 0
                for w in words:
                    n = known.get(w)
                    if n is None:
                        if len(known) >= CACHE_WORDS:
                            known.clear()
                        n = count(b" " + w)
                        known[w] = n = 1 if n < 0 else n
                    total += n
                sizes.append(len(data))
                words_of.append(len(words))
                pieces_of.append(total)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(x, pa.int64()) for x in (sizes, words_of, pieces_of))], names=["doc_id", "n_bytes", "n_words", "n_pieces"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(run, SCHEMA)
