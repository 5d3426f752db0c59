"""Token ids of texts by a public tokenizer file, with a cache of pieces.

A byte-level BPE encodes each piece of its pre-tokenizer on its own, so ids of
known pieces are looked up and only new pieces go to the tokenizers library.
Texts beyond the Latin blocks, or with a special token's string, go to it whole.

Defined cases: a null or empty text has no ids.
"""

from __future__ import annotations

import json
import os
import re
import struct

import numpy as np

# The pre-tokenizer's pieces, for texts up to U+024F: its letters, numbers and white space are listed.
_LETTER, _NUMBER, _SPACE = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", r"\t-\r \x85\xa0"
_PIECES = rf" ?[{_LETTER}]++|'(?:[stmd]|re|ve|ll)| ?[{_NUMBER}]++| ?[^{_SPACE}{_LETTER}{_NUMBER}]++|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


def _shown() -> dict[int, str]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


_SHOWN = _shown()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """text -> ids as little-endian unsigned 32-bit integers, as the tokenizers library gives them."""

    #: Pieces in each of the cache's two generations, and characters of a piece that is kept.
    LIMIT, LONGEST = 300_000, 64

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        cached = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        beyond, named = re.compile(r"[^\x00-\u024f]").search, [t["content"] for t in spec.get("added_tokens", [])]
        self._whole = (lambda text: (not text.isascii() and beyond(text)) or any(s in text for s in named)) if cached else lambda text: True
        self._pieces = re.compile(_PIECES).findall
        self._known: dict[str, bytes] = {}
        self._before: dict[str, bytes] = {}

    def _encoded(self, piece: str) -> bytes:
        """By the library's model alone: what its pipeline adds, offsets and words, isn't needed."""
        ids = [t.id for t in self._model.tokenize(piece.encode().decode("latin-1").translate(_SHOWN))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learnt(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids of pieces that aren't known; those of reasonable length are from now on."""
        out = {p: self._before[p] for p in pieces if p in self._before}
        out.update((p, self._encoded(p)) for p in pieces.difference(out))
        if len(self._known) + len(out) > self.LIMIT:
            self._before, self._known = self._known, {}
        self._known.update((p, ids) for p, ids in out.items() if len(p) <= self.LONGEST)
        return out

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self._whole(text):
            return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        pieces = self._pieces(text)
        ids = list(map(self._known.get, pieces))
        if None in ids:
            learnt = self._learnt({p for p, known in zip(pieces, ids) if known is None})
            ids = [learnt[p] if known is None else known for p, known in zip(pieces, ids)]
        return b"".join(ids)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and path."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
