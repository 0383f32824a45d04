"""Whole-text encoding by a public tokenizer file, with each distinct piece encoded once in a worker's bounded cache.

Both supported files cut a text into pieces before the merges, and no merge crosses a piece. ``Encoder`` cuts at places
that are always such borders (see ``_CUTS``) and asks the tokenizers library for each distinct piece; a text that holds
a special token's string goes to the library whole. The ids equal those of encoding the whole text; tests hold both
against each other.
"""

from __future__ import annotations

import os
import re

import numpy as np

from weftmill.llm.common import TwoGenerations

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_SPACE = "\t-\r \x85\xa0  -     　"
_LETTER = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-įĲ-ſ"
#: A run of Latin letters before white space, plain punctuation or the end is a piece; so is any other run without
#: white space together with the space before it, and white space up to the last one before a word.
_CUTS = {
    "word_bpe_49k.json": re.compile(rf"[{_LETTER}]++(?=[ \n.,;:!?|)]|$)|[^ \n]+"),
    "byte_bpe_50k.json": re.compile(rf" ?[{_LETTER}]++(?=[ \n.,;:!?|)]|\Z)| ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"),
}


def _bytes_as_text() -> dict[int, str]:
    """Byte-level files write each byte as one character: itself where printable, else from U+0100 on, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


_ENCODERS: dict[tuple[str, str], Encoder] = {}


class Encoder:
    """ids of texts as little-endian unsigned 16-bit integers (both vocabularies fit)."""

    bytes_as_text = _bytes_as_text()

    def __init__(self, path: str, entries: int = 250_000):
        from tokenizers import Tokenizer

        self.name = os.path.basename(path)
        self.model = Tokenizer.from_file(path)
        self.cut = _CUTS.get(self.name)
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        if self.model.get_vocab_size() > 1 << 16:
            raise ValueError("the vocabulary needs more than 16 bits")
        self.bare = self.model.model  # merges alone: for runs of letters, which the other steps leave as they are
        self.bare._resize_cache(0)
        self.lower = self.name.startswith("word_")
        self.letters = re.compile(rf" ?[{_LETTER}]+")
        self.cache = TwoGenerations(entries)

    def whole(self, text: str) -> bytes:
        return np.asarray(self.model.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes()

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text (null: empty), without an end id."""
        out: list[bytes | None] = [None] * len(texts)
        cuts: list[list[str] | None] = [None] * len(texts)
        known: dict[str, bytes] = {}
        missing: dict[str, None] = {}
        young, old = self.cache.young, self.cache.old
        for i, t in enumerate(texts):
            t = t or ""
            if self.cut is None or any(s in t for s in self.special):
                out[i] = self.whole(t)
                continue
            cuts[i] = pieces = self.cut.findall(t)
            for p in set(pieces):
                if p not in known and p not in missing:
                    v = young.get(p)
                    if v is None:
                        v = old.get(p)
                        if v is None:
                            missing[p] = None
                            continue
                        self.cache.put(p, v)
                        young, old = self.cache.young, self.cache.old
                    known[p] = v
        if missing:
            tokenize, plain, letters = self.bare.tokenize, self.bytes_as_text, self.letters.fullmatch
            fresh = []
            for p in missing:
                if letters(p):
                    q = (p.lower() if self.lower else p).encode().decode("latin-1").translate(plain)
                    known[p] = v = np.asarray([t.id for t in tokenize(q)], dtype="<u2").tobytes()
                    self.cache.put(p, v)
                else:
                    fresh.append(p)
            for a in range(0, len(fresh), 4096):
                part = fresh[a : a + 4096]
                for p, e in zip(part, self.model.encode_batch_fast(part, add_special_tokens=False), strict=True):
                    known[p] = v = np.asarray(e.ids, dtype="<u2").tobytes()
                    self.cache.put(p, v)
        get = known.__getitem__
        for i, pieces in enumerate(cuts):
            if pieces is not None:
                out[i] = b"".join(map(get, pieces))
        return out


def encoder(name: str, path: str | None = None) -> Encoder:
    """The encoder of a worker process; ``path`` names the file itself, else it is a file of ``public_tokenizers``."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(name)
    if (name, path) not in _ENCODERS:
        _ENCODERS[(name, path)] = Encoder(path)
    return _ENCODERS[(name, path)]
