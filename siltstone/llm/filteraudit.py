"""Audit of how quality filters interact, on a packed bitmap index.

``flags`` asks every text filter of every whole text once; ``with_repeats`` adds
the filter of repeated texts, ``with_labels`` the labels. ``bitmaps`` packs what
results into the index: for each part and block of rows a bitset for each filter
and each label. ``counts`` goes through all sets of filters that can stand before
a filter: AND-NOT leaves the rows that passed them, population counts of what
is left with the filter's bitset are its effects. Counts of the blocks are summed,
and each order of the filters is then a walk through sets, no further pass.

Defined cases: a null text is an empty one; a null part (source) is the empty
string's; a row fails the repeat filter if a row of equal text has a smaller
doc_id, so of rows of one id neither repeats the other, and a null doc_id is
smaller than none and has none smaller; an id of several label rows has a label
if one of them does; a null doc_id has no label; repeated rows count each; an
empty table has no parts and gives no rows. Only doc_id, text and source are
read, so other columns, whatever their names, do not matter. Texts are seen one
at a time and whole; very long ones only take their own size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.leastid import least_ids, sized
from siltstone.runtime import cut

_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_CONTINUATION = bytes(range(0x80, 0xC0))


def short(text: bytes, words: list[bytes]) -> bool:
    return len(words) < 50


def repetitive(text: bytes, words: list[bytes]) -> bool:
    return 100 * len(set(words)) < 65 * len(words)


def shouting(text: bytes, words: list[bytes]) -> bool:
    capitals, chars = (len(text) - len(text.translate(None, kind)) for kind in (_UPPER, bytes(set(range(256)) - set(_CONTINUATION))))
    return 100 * capitals > 5 * chars


def marked(text: bytes, words: list[bytes]) -> bool:
    return len(text.translate(None, b"#$%&*|")) < len(text)


#: Each filter's letter and when a text (in UTF-8, and its words between ASCII white space) fails it.
FILTERS: dict[str, Callable[[bytes, list[bytes]], bool]] = {"A": short, "B": repetitive, "C": shouting, "D": marked}
#: The letter of the filter of repeated texts, after the others.
REPEATS = "E"
LABELS = {"good": "quality", "toxic": "toxic"}
#: Rows of an index block at most, and filters at most: there are n! orders.
BLOCK_ROWS, MOST_FILTERS = 1 << 20, 7


def _flags(batches: Iterator[pa.RecordBatch], tests: list[Callable]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        failed, digests = np.zeros(batch.num_rows, np.int32), []
        for k, scalar in enumerate(batch.column(2)):
            text = scalar.as_py()
            words = text.split()
            failed[k] = sum(1 << j for j, test in enumerate(tests) if test(text, words))
            digests.append(hashlib.blake2b(text, digest_size=16).digest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(failed), pa.array(digests, pa.binary())], ["doc_id", "part", "failed", "digest"])


def flags(docs: DataFrame, filters: dict[str, Callable[[bytes, list[bytes]], bool]] = FILTERS) -> DataFrame:
    """(doc_id, part, failed, digest): bit k of failed is set if the text fails the k-th filter; digest stands for the text."""
    tests = list(filters.values())
    text = F.coalesce("text", F.lit("")).cast("binary")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source"), F.lit("")).alias("part"), text.alias("text"))
    return narrow.mapInArrow(lambda batches: _flags(batches, tests), "doc_id long, part string, failed int, digest binary")


def with_repeats(flagged: DataFrame, bit: int) -> DataFrame:
    """flagged with that bit of failed set where an equal text has a smaller doc_id."""
    least = least_ids(flagged, "digest", "doc_id").withColumnsRenamed({"digest": "of", "least": "first"})
    joined = flagged.join(sized(least), flagged["digest"] == least["of"], "left")
    repeats = F.coalesce((F.col("doc_id") > F.col("first")).cast("int"), F.lit(0))
    return joined.select("doc_id", "part", F.col("failed").bitwiseOR(F.shiftleft(repeats, bit)).alias("failed"))


def with_labels(flagged: DataFrame, labels: DataFrame, bit: int, names: dict[str, str] = LABELS) -> DataFrame:
    """flagged with bits of failed from that one on set for the labels that a document has."""
    own = F.lit(0)
    for k, column in enumerate(names.values()):
        own = own.bitwiseOR(F.shiftleft(F.coalesce((F.col(column) == 1).cast("int"), F.lit(0)), bit + k))
    per = labels.select(F.col("doc_id").cast("long").alias("of"), own.alias("own")).where("own <> 0 and of is not null")
    per = cut(per.groupBy("of").agg(F.bit_or("own").alias("own")))
    joined = flagged.join(sized(per), flagged["doc_id"] == per["of"], "left")
    return joined.select("part", F.col("failed").bitwiseOR(F.coalesce("own", F.lit(0))).alias("bits"))


def _packed(names: list[str], codes: np.ndarray, bits: np.ndarray, planes: int) -> pa.RecordBatch:
    """A row for each part: its rows side by side, padded to whole 64-bit words, a bitset a plane; the first plane marks rows."""
    order = np.argsort(codes, kind="stable")
    sizes = np.bincount(codes, minlength=len(names))
    words = -(-sizes // 64)
    first = np.concatenate(([0], np.cumsum(words)))
    at = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first[:-1] * 64, sizes)
    row = np.zeros(first[-1] * 64, np.uint32)
    row[at] = (bits[order].astype(np.uint32) << 1) | 1
    packed = [np.packbits(row >> k & 1, bitorder="little").tobytes() for k in range(planes + 1)]
    spans = list(zip((8 * first[:-1]).tolist(), (8 * first[1:]).tolist(), strict=True))
    columns = [pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array([[p[a:b] for p in packed] for a, b in spans], pa.list_(pa.binary()))]
    return pa.RecordBatch.from_arrays(columns, ["part", "n", "planes"])


def _bitmaps(batches: Iterator[pa.RecordBatch], planes: int) -> Iterator[pa.RecordBatch]:
    places: dict[str, int] = {}
    codes, bits, held = [], [], 0

    def flush() -> pa.RecordBatch:
        out = _packed(list(places), np.concatenate(codes), np.concatenate(bits), planes)
        places.clear(), codes.clear(), bits.clear()
        return out

    for batch in batches:
        coded = batch.column(0).dictionary_encode()
        own = np.array([places.setdefault(p, len(places)) for p in coded.dictionary.to_pylist()], np.int64)
        codes.append(own[coded.indices.to_numpy(zero_copy_only=False)] if len(own) else np.zeros(0, np.int64))
        bits.append(batch.column(1).to_numpy(zero_copy_only=False))
        held += batch.num_rows
        if held >= BLOCK_ROWS:
            yield flush()
            held = 0
    if held:
        yield flush()


def bitmaps(bits: DataFrame, planes: int) -> DataFrame:
    """(part, bits) -> the index (part, n, planes): rows of a part and block, and their bitsets; planes[0] marks the rows."""
    return bits.mapInArrow(lambda batches: _bitmaps(batches, planes), "part string, n long, planes array<binary>")


_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _counted(batches: Iterator[pa.RecordBatch], filters: int) -> Iterator[pa.RecordBatch]:
    every = (1 << filters) - 1
    pairs = [(s, f) for s in range(1 << filters) for f in range(filters) if not s >> f & 1]
    weights = [factorial(k) * factorial(filters - 1 - k) for k in range(filters)]  # orders that begin with one set of k filters, then a given one
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch.column(2).to_pylist()
        live, *planes = (np.frombuffer(b"".join(row[k] for row in rows), np.uint64) for k in range(len(rows[0])))
        starts = np.cumsum([0] + [len(row[0]) // 8 for row in rows])[:-1]
        fails, good, toxic = planes[:filters], planes[filters], planes[filters + 1]

        def ones(x: np.ndarray, starts: np.ndarray = starts) -> np.ndarray:
            return np.add.reduceat(np.bitwise_count(x), starts, dtype=np.int64)

        out = np.zeros((len(_COUNTS), len(rows), len(pairs)), np.int64)
        sets: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for s in range(1 << filters):
            gone = np.zeros_like(live)
            for f in range(filters):
                if s >> f & 1:
                    gone = gone | fails[f]
            sets[s] = live & ~gone, ones(live & ~gone)
        alone = [ones(sets[every ^ 1 << f][0] & fails[f]) for f in range(filters)]
        failing = [ones(fails[f]) for f in range(filters)]
        shapley = np.zeros((filters, len(rows)), np.int64)
        for k, (s, f) in enumerate(pairs):
            here = sets[s][0] & fails[f]
            removed = ones(here)
            shapley[f] += weights[s.bit_count()] * removed
            out[:6, :, k] = sets[s | 1 << f][1], removed, failing[f] - removed, alone[f], ones(here & good), ones(here & toxic)
        for k, (_, f) in enumerate(pairs):
            out[6, :, k] = shapley[f]
        before, letter = (np.tile(np.array(x, np.int32), len(rows)) for x in zip(*pairs, strict=True))
        parts = batch.column(0).take(pa.array(np.repeat(np.arange(len(rows)), len(pairs))))
        yield pa.RecordBatch.from_arrays([parts, pa.array(before), pa.array(letter), *(pa.array(x.reshape(-1)) for x in out)], ["part", "before", "filter", *_COUNTS])


def counts(index: DataFrame, filters: int) -> DataFrame:
    """(part, before, filter, kept, removed, ...), a row for each part, set of filters (bits) and filter that can come next."""
    schema = "part string, before int, filter int, " + ", ".join(f"{c} long" for c in _COUNTS)
    per = index.mapInArrow(lambda batches: _counted(batches, filters), schema)
    return per.groupBy("part", "before", "filter").agg(*[F.sum(c).alias(c) for c in _COUNTS])


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Callable[[bytes, list[bytes]], bool]] = FILTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for all orders of filters and the repeat filter."""
    letters = [*filters, REPEATS]
    n = len(letters)
    if n > MOST_FILTERS or any(len(x) != 1 for x in letters) or len(set(letters)) < n:
        raise ValueError(f"up to {MOST_FILTERS} filters of one letter each are audited, not {letters}")
    flagged = cut(flags(docs, filters))
    bits = with_labels(with_repeats(flagged, n - 1), labels, n)
    found = counts(bitmaps(bits, n + len(LABELS)), n)
    steps = [("".join(letters[f] for f in order), k + 1, sum(1 << f for f in order[:k]), order[k]) for order in permutations(range(n)) for k in range(n)]
    walk = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, before int, filter int")  # n * n! rows
    return found.join(F.broadcast(walk), ["before", "filter"]).select("part", "filter_order", "step", *_COUNTS)


ORACLE = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part FROM documents
), worded AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM texts
), own AS (
  SELECT doc_id, bool_or(coalesce(quality, 0) = 1)::INT AS good, bool_or(coalesce(toxic, 0) = 1)::INT AS toxic FROM labels GROUP BY doc_id
), failed AS (
  SELECT part, [(len(words) < 50)::INT, (100 * len(list_distinct(words)) < 65 * len(words))::INT,
                (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text))::INT,
                regexp_matches(text, '[#$%&*|]')::INT, coalesce(w.doc_id > first, false)::INT] AS f,
         coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM worded w LEFT JOIN own ON w.doc_id = own.doc_id
), kinds AS (
  SELECT part, f, list_sum(f) AS fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, f
), letter AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 3, 4, 5]) AS k
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.k, b.k, c.k, d.k, e.k] AS ks
  FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5
), steps AS (
  SELECT filter_order, step::INT AS step, ks[step] AS k, ks[1:step - 1] AS before FROM orders, unnest([1, 2, 3, 4, 5]) AS s(step)
), seen AS (
  SELECT part, filter_order, step, k, n, good, toxic, fails, f[k] = 1 AS fails_it, list_sum(list_transform(before, lambda j: f[j])) > 0 AS gone FROM kinds, steps
), summed AS (
  SELECT part, filter_order, step, k,
         coalesce(sum(n) FILTER (NOT coalesce(gone, false) AND NOT fails_it), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (NOT coalesce(gone, false) AND fails_it), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (coalesce(gone, false) AND fails_it), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (fails_it AND fails = 1), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (NOT coalesce(gone, false) AND fails_it), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (NOT coalesce(gone, false) AND fails_it), 0)::BIGINT AS toxic_lost
  FROM seen GROUP BY part, filter_order, step, k
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley FROM summed
"""
