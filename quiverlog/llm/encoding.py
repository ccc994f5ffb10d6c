"""Token ids of whole texts by the tokenizers library, with a bounded memory of words seen before."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

from quiverlog.llm.token_counts import byte_alphabet

#: Unicode White_Space, and the letters and numbers below U+0100, as the tokenizers' patterns mean them.
SPACES = "\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
LOWER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
UPPER = "A-Z\xc0-\xd6\xd8-\xde"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
#: Texts of these characters alone are cut into words here; others are cut at white space, and the library does the rest.
PLAIN = "\x00-\xff" + f"{chr(0x2010)}-{chr(0x2027)}"
#: Words that a worker remembers, some 200 MB; forgotten all at once when full.
CACHE_WORDS = 1_000_000

CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    return tokenizer


class WordEncoder:
    """``encode(text)`` gives the ids as little-endian 32-bit bytes, equal to encoding the whole text at once.

    Ids depend on a word alone, so each distinct word is given to the library's model once. ``keep_spaces`` says which of two
    kinds of tokenizer it is: byte-level, where a space belongs to the word after it, or word-end, which lowers the text
    and drops white space.
    """

    def __init__(self, path: str, keep_spaces: bool):
        self.tokenizer = load_tokenizer(path)
        self.model, self.lower = self.tokenizer.model, not keep_spaces
        self.symbols = {b: c for c, b in byte_alphabet().items()}
        run = f"[^{SPACES}]+"
        self.chunks = re.compile(f"[{SPACES}]*{run}|[{SPACES}]+" if keep_spaces else run).findall
        letters = LOWER + UPPER
        if keep_spaces:
            words = f" ?[{letters}]+| ?[{NUMBERS}]+| ?[^{SPACES}{letters}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
        else:
            words = f"[{LOWER}]+|[{NUMBERS}]|[^{SPACES}{LOWER}{NUMBERS}]+"
        self.words = re.compile(f"{CONTRACTIONS}|{words}").findall
        self.odd = re.compile(f"[^{PLAIN}]").search
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        odd = self.odd(text) is not None
        parts = self.chunks(text) if odd else self.words(text.lower() if self.lower else text)
        known = self.known
        try:
            return b"".join([known[c] for c in parts])
        except KeyError:
            pass
        new = {c for c in parts if c not in known}
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
            new = set(parts)
        if odd:
            each = list(new)
            for k in range(0, len(each), 4096):
                part = each[k : k + 4096]
                for c, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                    known[c] = np.array(e.ids, "<u4").tobytes()
        else:
            tokenize, symbols = self.model.tokenize, self.symbols
            for c in new:
                known[c] = b"".join([t.id.to_bytes(4, "little") for t in tokenize(c.encode().decode("latin-1").translate(symbols))])
        return b"".join([known[c] for c in parts])


@lru_cache(maxsize=2)
def encoder_of(path: str, keep_spaces: bool) -> WordEncoder:
    """One encoder for each worker process, kept from task to task."""
    return WordEncoder(path, keep_spaces)
