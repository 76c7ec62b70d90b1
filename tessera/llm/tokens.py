"""Token ids of whole texts from a public tokenizer, with a bounded memory of chunks seen before.

A tokenizer that lower-cases and drops blanks treats what stands between spaces or newlines on its own, so a text's ids
are the ids of its chunks in order. A worker keeps chunk -> ids in two generations of CACHE_CHUNKS chunks; every miss
goes to the tokenizer. Chunks are looked up with A-Z lower-cased, as the tokenizer's own normaliser has it. Whether a
vocabulary is of that kind is asked of its tokenizer by PROBES; texts of any other go to it whole.
"""

from __future__ import annotations

import sys
from array import array

CACHE_CHUNKS = 450_000
#: Letters below this one (the Latin blocks) are lower-cased alike by Python and the tokenizer's normaliser, but for those
#: that an encoder finds out when it starts.
_LATIN_END = "\u0250"
#: What may follow a word in its chunk as a pre-token of its own.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


#: Texts whose ids differ from their lower-cased chunks' ids wherever case, blanks or neighbours count.
PROBES = [
    "The Quick  Brown FOX", "two  blanks", " leading and trailing ", "one\ntwo\n\nthree", "tab\there", "a,b; c! (d) e's", "x", "", " ", "Stra\u00dfe L\u00c9GENDE ni\u00f1o",
    "numbers 12 1234567 3.14", "the the", "A B C", "caf\u00e9 \U0001f600 \u4e2d\u6587 text",
]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder(dict):
    """encode(text) -> little-endian ids, 2 bytes each for vocabularies below 65,536, else 4.

    A chunk that is one Latin word is one pre-token, so it goes straight to the tokenizer's merge model, normalised, and
    punctuation after a word is a pre-token too; every other chunk takes the whole tokenizer. Chunks in use move on to the young
    generation of the memory, the others leave with the old one.
    """

    def __init__(self, path: str | None = None, most: int = CACHE_CHUNKS):
        import numpy as np
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_path())
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() < 65_536 else "<u4")
        self._code = "H" if self.dtype.itemsize == 2 else "I"
        self.most, self._old = most, {}
        # Latin letters, lower-cased, as the tokenizer's byte-level step spells them; they are stable under its NFC.
        self._spelled = {ord(c): self._bytes_of(c.lower()) for c in map(chr, range(0x80, ord(_LATIN_END))) if c.isalpha()}
        # Whether texts fall into chunks, and whether words may take the short way, is asked of the tokenizer itself.
        self._short, self._long = False, []
        self._chunked = True
        self._chunked = all(self.encode(t) == self._direct(t) for t in PROBES)
        self.clear()
        probe = ["thor", "l\u00e9gende", "stra\u00dfe", "ni\u00f1o"]
        self._short = self._chunked and all(self._word(w) == self._direct(w) for w in probe)
        self._long = [c for c in map(chr, self._spelled) if self._short and self._word(f"a{c}a") != self._direct(f"a{c}a")]

    def _packed(self, ids: list[int]) -> bytes:
        out = array(self._code, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _bytes_of(self, letter: str) -> str:
        pre = self.tokenizer.pre_tokenizer
        return "".join(part for part, _ in pre.pre_tokenize_str(letter)) if pre else letter

    def _word(self, word: str) -> bytes:
        """Ids of a word of Latin letters, A-Z lower-cased already."""
        if not word.isascii():
            word = word.translate(self._spelled)
        return self._packed([x.id for x in self.model.tokenize(word)])

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self._old.get(chunk)
        if ids is None:
            ids = self._new(chunk)
        if len(self) >= self.most:
            self._old = dict(self)
            self.clear()
        self[chunk] = ids
        return ids

    def _new(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if self._short:
            stem = text.rstrip(_MARKS)
            if stem.isalpha() and (stem.isascii() or (max(stem) < _LATIN_END and not any(map(stem.count, self._long)))):
                if len(stem) == len(text):
                    return self._word(text)
                cut = len(text) - len(stem)  # marks are one byte each
                return self[chunk[:-cut]] + self[chunk[-cut:]]
        return self._direct(text)

    def _direct(self, text: str) -> bytes:
        return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str | bytes | None) -> bytes:
        raw = text.encode("utf-8") if isinstance(text, str) else text or b""
        if not self._chunked or b"<|" in raw:  # "<|" may begin a special token, whose spelling is exact
            return self._direct(raw.decode())
        return b"".join(map(self.__getitem__, raw.lower().replace(b"\n", b" ").split(b" ")))


_ENCODERS: dict[tuple[str | None, int], Encoder] = {}


def encoder(path: str | None = None, most: int = CACHE_CHUNKS) -> Encoder:
    """One encoder per worker process, vocabulary and memory of chunks (two generations of `most`)."""
    if (path, most) not in _ENCODERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _ENCODERS[path, most] = Encoder(path, most)
    return _ENCODERS[path, most]
