"""Exact token counts and ids with caches of pre-tokens.

A byte-level BPE without normaliser or post-processor encodes each pre-token by itself, so the
ids of a text are the joined ids of its pre-tokens. The split is done with a compiled pattern for
texts of well-known characters only; any other text, and any text that holds a special token,
goes to the library whole. Other tokenizer files always go to the library whole.
"""

from __future__ import annotations

import json
import os
import re

from tidegraph.llm import caches

#: Fixed values of the pre-token pattern, for characters whose classes all engines agree on.
LETTER = "a-zA-Z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
SPLIT = re.compile(rf" ?[{LETTER}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[0-9]+| ?[^\s0-9{LETTER}]+|\s+(?!\S)|\s+")
UNUSUAL = re.compile("[^\\t\\n\\r\\x20-\\x7e\\u00a1-\\u00ac\\u00ae-\\u00b1\\u00b4-\\u00b8\\u00ba\\u00bb\\u00bf-\\u024f\\u2010-\\u2027\\u2030-\\u203a\\u20ac]")
#: Pre-tokens that a worker keeps beside the broadcast table.
CACHE_ENTRIES = 1 << 19
#: Characters that those pre-tokens have at most, besides one chunk's.
CACHE_CHARS = 1 << 24
CHUNK_CHARS = 4 << 20
#: Pre-tokens that go to the library in one text, a line each.
LINES = 2048

_encoders: dict[tuple, "Encoder"] = {}
caches.register("encoders", _encoders.clear)


def encoder(path: str, width: int = 0) -> "Encoder":
    """The encoder of this worker for a tokenizer file; lives as long as the worker."""
    caches.claim("encoders")
    key = (path, width)
    if key not in _encoders:
        _encoders[key] = Encoder(path, width)
    return _encoders[key]


class Encoder:
    """width 0: values are token counts; 2 or 4: values are the ids' little-endian bytes of that width."""

    def __init__(self, path: str, width: int = 0) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.path, self.width = path, width
        self.cache: dict[str, int | bytes] = {}
        self.held = 0
        self.base: dict[str, int | bytes] = {}
        self.special: list[str] = []
        self.split = False
        self.line_end: list[int] | None = None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.size = model.get_piece_size()
            self.raw = lambda texts: model.encode(texts, num_threads=1)
        else:
            from tokenizers import Tokenizer

            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            own = Tokenizer.from_file(path)
            own.no_truncation()
            own.no_padding()
            self.size = own.get_vocab_size()
            pre = spec.get("pre_tokenizer") or {}
            self.split = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
            self.special = [t["content"] for t in spec.get("added_tokens") or []]
            self.raw = lambda texts: [e.ids for e in own.encode_batch_fast(texts, add_special_tokens=False)]
        if width == 2 and self.size > 1 << 16:
            raise ValueError("the vocabulary does not fit 16-bit ids")

    def _value(self, ids: list[int]):
        if not self.width:
            return len(ids)
        import array

        return array.array("H" if self.width == 2 else "I", ids).tobytes()

    def _lines(self, pieces: list[str]) -> list:
        """Values of pre-tokens. Those without white space inside stand line by line in one text, which the
        pre-tokenizer cuts back into them and the line ends; if it does not, each goes alone."""
        import numpy as np

        if any(p[:1] in "\n\t\r" or p == " " or any(c.isspace() for c in p[1:]) for p in pieces):
            plain = [p for p in pieces if p[:1] not in "\n\t\r" and p != " " and not any(c.isspace() for c in p[1:])]
            odd = [p for p in pieces if p not in set(plain)]
            got = dict(zip(plain, self._lines(plain), strict=True)) if plain else {}
            got.update(zip(odd, map(self._value, self.raw(odd)), strict=True))
            return [got[p] for p in pieces]
        ids = np.array(self.raw(["\n".join(pieces) + "\n"])[0], f"<u{self.width or 4}")
        if self.line_end is None:
            self.line_end = self.raw(["\n"])[0]
        ends = np.flatnonzero(ids == self.line_end[0])
        if len(self.line_end) != 1 or len(ends) != len(pieces):
            return list(map(self._value, self.raw(pieces)))
        starts = np.append(0, ends[:-1] + 1)
        if not self.width:
            return (ends - starts).tolist()
        raw, w = ids.tobytes(), self.width
        return [raw[a:b] for a, b in zip((starts * w).tolist(), (ends * w).tolist(), strict=True)]

    def preload(self, table: dict) -> None:
        """Entries that stay when the cache is cleared."""
        if not self.base and table:
            self.base = dict(table)
            self.cache = dict(table)

    def pieces(self, text: str) -> list[str] | None:
        """Pre-tokens; None if the library must see the whole text."""
        if not self.split or UNUSUAL.search(text) or any(s in text for s in self.special):
            return None
        return SPLIT.findall(text)

    def values(self, texts: list[str]) -> list:
        """Count or bytes of each text."""
        out, start, chars = [], 0, 0
        for i, t in enumerate(texts):
            chars += len(t)
            if chars >= CHUNK_CHARS:
                out += self._chunk(texts[start : i + 1])
                start, chars = i + 1, 0
        return out + (self._chunk(texts[start:]) if start < len(texts) else [])

    def _chunk(self, texts: list[str]) -> list:
        cut = [self.pieces(t) for t in texts]
        if len(self.cache) > CACHE_ENTRIES + len(self.base) or self.held > CACHE_CHARS:
            self.cache, self.held = dict(self.base), 0
        cache = self.cache
        new = list(set().union(*(c for c in cut if c)).difference(cache))
        self.held += sum(map(len, new))
        for at in range(0, len(new), LINES):
            part = new[at : at + LINES]
            cache.update(zip(part, self._lines(part), strict=True))
        whole = iter(map(self._value, self.raw([t for t, c in zip(texts, cut, strict=True) if c is None])))
        get = cache.__getitem__
        if self.width:
            return [next(whole) if c is None else b"".join(map(get, c)) for c in cut]
        return [next(whole) if c is None else sum(map(get, c)) for c in cut]
