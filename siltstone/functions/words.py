"""The terms of texts a batch at a time: those that retrieval.terms gives, by array operations."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_CODES = 0x110000
_edges: dict[str, np.ndarray] = {}


def edges(spark: SparkSession) -> np.ndarray:
    r"""Where the runs of code points that [\p{L}\p{N}] matches begin and end: by Spark's own expressions, as queries are split by these."""
    session = spark.sparkContext.applicationId
    if session not in _edges:
        codes = spark.range(1, _CODES).where("id < 55296 or id > 57343")  # no surrogates
        char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
        inside = np.zeros(_CODES + 1, bool)
        inside[codes.where(char.rlike(r"[\p{L}\p{N}]")).toArrow().column(0).to_numpy()] = True
        _edges[session] = np.flatnonzero(np.diff(inside, prepend=False))
    return _edges[session]


def letters(at: np.ndarray) -> np.ndarray:
    """For each code point whether a term may hold it, of the edges."""
    flips = np.zeros(_CODES, np.int8)
    flips[at[at < _CODES]] = 1
    return (np.cumsum(flips, dtype=np.int32) & 1).astype(bool)


@cache
def alphanumeric() -> np.ndarray:
    r"""The same of [^\W_] in Python."""
    return np.fromiter((chr(c).isalnum() for c in range(_CODES)), bool, _CODES)


def _found(texts: pa.Array, holds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-case texts (null: empty): their code points, which of these terms hold, where terms begin, and how many terms each text has."""
    texts = texts.fill_null("") if texts.null_count else texts
    ends = np.cumsum(pc.utf8_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    size = np.int32 if pa.types.is_string(texts.type) else np.int64
    at = np.frombuffer(texts.buffers()[1], size)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else [0, 0]
    data = memoryview(texts.buffers()[2] or b"")[at[0] : at[-1]]
    codes = np.frombuffer(str(data, "utf-8").encode("utf-32-le"), np.uint32)
    inside = holds[codes]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = ends[:-1][ends[:-1] < len(codes)]
    first[begins] = inside[begins]
    upto = np.r_[0, np.cumsum(first, dtype=np.int32)]
    return codes, inside, first, np.diff(upto[np.r_[0, ends]])


def count(texts: pa.Array, holds: np.ndarray) -> np.ndarray:
    """How many terms each of some lower-case texts has."""
    return _found(texts, holds)[3]


def split(texts: pa.Array, holds: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms of lower-case texts, in order, and how many each text has (null: none)."""
    codes, inside, first, counts = _found(texts, holds)
    kept = codes[inside]
    width = 1 + (kept >= 0x80).view(np.int8) + (kept >= 0x800) + (kept >= 0x10000)
    offsets = np.r_[0, np.cumsum(width, dtype=np.int64)][np.r_[np.flatnonzero(first[inside]), len(kept)]]
    held = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(kept.tobytes().decode("utf-32-le").encode()))
    return held, counts
