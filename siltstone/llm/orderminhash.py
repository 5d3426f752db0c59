"""Document fingerprints by Order MinHash.

Every k-mer of a text's code points is numbered by its occurrence, so repeats
count. Each of SIGNATURES hash functions, drawn independently, selects the TUPLE
numbered k-mers of least hash; put back in text order, the k-mers are hashed to
one signature. Two texts share a signature if they share those k-mers and their
order, which follows edit distance more closely than sets of k-mers do. Likeness
is the share of equal signatures.

Documents are dealt to partitions by ranges of their ids. A partition compares
neighbours as it streams by, and hands its first and last row to a second step
that compares across partitions; so no partition need be small, and a text is
shuffled once.

Defined cases: a null text counts as empty; an empty text has the fingerprint
of no k-mers, equal to that of any empty text only; a text shorter than a k-mer
is one k-mer. Order is by descending doc_id, null last; rows of one id are in
ascending order of a hash of the text, equal rows in any. A single row is its own
next one; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.runtime import cut

KMER, TUPLE, SIGNATURES = 8, 2, 64
SEED = 20190

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Each signature's hash function is x -> a x + b modulo 2^32, of a mixed 32-bit value x; a is odd.
_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 32, (2, SIGNATURES, 1), dtype=np.uint64).astype(np.uint32)
_FACTOR, _SHIFT = _DRAWN[0] | np.uint32(1), _DRAWN[1]
#: K-mers that are hashed by all functions at a time.
_AT_ONCE = 1 << 13


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _A
    h = (h ^ (h >> np.uint64(29))) * _B
    return h ^ (h >> np.uint64(32))


#: Low bits of a k-mer's hash that make room for its position; fixed, as hashes must not depend on the text's length.
_PLACE = np.uint64(24)


def _numbered(kmers: np.ndarray) -> np.ndarray:
    """Hashes of (k-mer, occurrence number)."""
    n = len(kmers)
    kmers = kmers >> _PLACE
    if n <= 1 << int(_PLACE):
        # Sorting hash and position as one number groups equal k-mers in text order.
        both = np.sort((kmers << _PLACE) | np.arange(n, dtype=np.uint64))
        kmer, at = both >> _PLACE, (both & np.uint64((1 << int(_PLACE)) - 1)).astype(np.int64)
    else:
        at = np.argsort(kmers, kind="stable")
        kmer = kmers[at]
    same = kmer[1:] == kmer[:-1]
    if not same.any():
        return _mix(kmers << _PLACE)
    begun = np.concatenate(([0], np.flatnonzero(~same) + 1))
    number = np.arange(n) - np.repeat(begun, np.diff(np.append(begun, n)))
    out = np.empty(n, np.uint64)
    out[at] = _mix((kmer << _PLACE) + number.astype(np.uint64) * _B)
    return out


def _least(hashes: np.ndarray) -> np.ndarray:
    """Places of the TUPLE least values (all, if fewer) under each function; of equal values the first places."""
    rows = np.arange(SIGNATURES)
    values, places = np.zeros((SIGNATURES, 0), np.uint32), np.zeros((SIGNATURES, 0), np.int64)
    x = hashes.astype(np.uint32)
    for at in range(0, len(x), _AT_ONCE):
        part = x[None, at : at + _AT_ONCE] * _FACTOR + _SHIFT
        found = []
        for _ in range(min(TUPLE, part.shape[1])):
            k = part.argmin(axis=1)
            found.append((part[rows, k], k + at))
            part[rows, k] = np.uint32(0xFFFFFFFF)
        values = np.concatenate([values, *(v[:, None] for v, _ in found)], axis=1)
        places = np.concatenate([places, *(k[:, None] for _, k in found)], axis=1)
        if values.shape[1] > TUPLE:
            order = np.argsort(values, axis=1, kind="stable")[:, :TUPLE]
            values, places = np.take_along_axis(values, order, 1), np.take_along_axis(places, order, 1)
    return places


def kmer_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each k-mer, or of the whole of a shorter text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    if len(points) < KMER:
        whole = np.uint64(0)
        for p in points.tolist():
            whole = _mix(np.array([int(whole) ^ p], np.uint64))[0]
        return np.array([whole], np.uint64)
    h, span = points, 1
    while span < KMER:
        h = _mix(h[:-span] * _A + h[span:] * _B)
        span *= 2
    return h


def fingerprint(text: str | None) -> np.ndarray:
    """SIGNATURES unsigned 16-bit signatures."""
    if not text:
        return np.zeros(SIGNATURES, np.uint16)
    kmers = kmer_hashes(text)
    places = np.sort(_least(_numbered(kmers)), axis=1)
    out = np.full(SIGNATURES, 0x5851F42D4C957F2D, np.uint64)
    for k in range(places.shape[1]):
        out = _mix(out * _A + kmers[places[:, k]])
    return (out >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The last third of text replaced by as much of the next text."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


_JUDGED = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_FIELDS = [(x.split()[0], {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}[x.split()[1]]) for x in _JUDGED.split(", ")]
#: A row of either kind: judged, or the text that begins or ends a partition.
_STREAMED = f"part long, side int, {_JUDGED}, text string"
_STREAM_SCHEMA = pa.schema([("part", pa.int64()), ("side", pa.int32()), *_FIELDS, ("text", pa.string())])
_INNER, _FIRST, _LAST = 0, 1, 2


def _judge(doc: int | None, text: str, own: np.ndarray, follow: str, follow_print: np.ndarray) -> tuple:
    changed = edited(text, follow)
    other = own if changed == text else fingerprint(changed)
    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).digest()
    return doc, len(text), digest, own.astype(">u2").tobytes(), other.astype(">u2").tobytes(), likeness(own, other), likeness(own, follow_print)


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) in order: all but the last judged, and the first and the last text."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    none = (None,) * len(_FIELDS)
    held: tuple | None = None
    for batch in batches:
        out = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py() or ""
            own = held[2] if held and held[1] == text else fingerprint(text)
            if held:
                out.append((part, _INNER, *_judge(*held, text, own), None))
            else:
                out.append((part, _FIRST, *none, text))
            held = (doc, text, own)
        yield _arrow(out, _STREAM_SCHEMA)
    if held:
        yield _arrow([(part, _LAST, held[0], *none[1:], held[1])], _STREAM_SCHEMA)


def _crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, next text), judged."""
    for batch in batches:
        rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
        yield _arrow([_judge(doc, text, fingerprint(text), follow, fingerprint(follow)) for doc, text, follow in rows], pa.schema(_FIELDS))


def compare(docs: DataFrame) -> DataFrame:
    """One row per row of docs: its fingerprint, and how like it are its edited text and the next document."""
    spark = docs.sparkSession
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("digest"))
    # Equal rows are dealt to several partitions too.
    order = [F.col("doc_id").desc_nulls_last(), F.col("digest"), F.col("tie")]
    dealt = narrow.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    streamed = cut(dealt.select("doc_id", "text").mapInArrow(_streamed, _STREAMED))
    parts = [r["part"] for r in streamed.where(F.col("side") == _FIRST).select("part").orderBy("part").collect()]  # a number for each partition
    follows = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part long, next long")
    firsts = streamed.where(F.col("side") == _FIRST).select(F.col("part").alias("next"), F.col("text").alias("follow"))
    lasts = streamed.where(F.col("side") == _LAST).select("part", "doc_id", "text")
    crossed = lasts.join(F.broadcast(follows), "part").join(firsts, "next").select("doc_id", "text", "follow").mapInArrow(_crossed, _JUDGED)
    inner = streamed.where(F.col("side") == _INNER).select(*crossed.columns)
    shown = {c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")}
    return inner.unionByName(crossed).withColumns(shown)
