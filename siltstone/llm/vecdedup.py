"""Embedding near-dedup: int8 tile products with rigorous error bounds.

Vectors of one label and length are dealt to tiles as int8 codes, a scale and
the norm of what the codes miss. A tile pair is compared by an exact integer
product of codes; with each vector's own error norm that product bounds the
cosine from both sides. Pairs whose lower bound reaches the threshold are links.
Only pairs possibly above it are recomputed in double precision: their vectors,
and no others, follow the tile pair in a second pass.

Equal vectors of one label form one class first, so a vector that repeats
without limit is one row here. A task returns, per class, how many vectors it
links to, and a spanning forest of the links.

Defined cases: vectors that are null, empty, zero, or hold a null or non-finite
component, and vectors with a null label, link with nothing and stand for
themselves; so do vectors of different lengths. Repeated rows link to each
other. A null vec_id is never kept. Other columns are left out; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.components import Forest, connected_components, least_of
from siltstone.runtime import cut

THRESHOLD = 0.98
#: Vectors in a tile: at least, at most, the tiles a label is to have in between; and the most components in a tile.
TILE_LEAST, TILE_MOST, TILES_AIMED, TILE_COMPONENTS = 1024, 32768, 16, 1 << 23
#: Rounding of sums in double and single precision stays below this.
SLACK = 1e-6
#: Rows of a tile that are multiplied at a time.
_AT_ONCE = 512


class Tile:
    """Unit vectors as int8 codes x scale, with the norm of what the codes miss."""

    def __init__(self, code: np.ndarray, scale: np.ndarray, error: np.ndarray, unit: np.ndarray | None = None):
        self.code, self.scale, self.error, self.unit = code, scale, error, unit

    @classmethod
    def of(cls, raw: np.ndarray) -> Tile:
        # Divided by the largest component first, so that squares neither overflow nor vanish.
        shrunk = raw / np.abs(raw).max(axis=1, keepdims=True)
        unit = shrunk / np.sqrt(np.einsum("ij,ij->i", shrunk, shrunk))[:, None]
        scale = np.abs(unit).max(axis=1) / 127
        code = np.rint(unit / scale[:, None]).astype(np.int8)
        missed = unit - code * scale[:, None]
        return cls(code, scale, np.sqrt(np.einsum("ij,ij->i", missed, missed)), unit)

    def part(self, rows: slice) -> Tile:
        return Tile(self.code[rows], self.scale[rows], self.error[rows], None if self.unit is None else self.unit[rows])


def bounds(a: Tile, b: Tile) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest cosine that each pair of rows can have.

    x = sp + e and y = tq + f give |x.y - st(p.q)| <= |e||y| + |sp||f| <= |e| + (1 + |e|)|f|.
    """
    exact = np.float32 if a.code.shape[1] * 127 * 127 < 1 << 24 else np.float64
    product = a.code.astype(exact) @ b.code.astype(exact).T
    about = product * a.scale[:, None] * b.scale[None, :]
    error = a.error[:, None] + (1 + a.error[:, None]) * b.error[None, :] + SLACK
    return about - error, about + error


def judged(a: Tile, b: Tile, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, sure): index pairs that may reach the threshold, in parts; the sure ones do, whatever the codes miss."""
    for at in range(0, len(a.code), _AT_ONCE):
        least, most = bounds(a.part(slice(at, at + _AT_ONCE)), b)
        i, j = np.nonzero(most >= threshold)
        yield i + at, j, least[i, j] >= threshold


def linked(a: Tile, b: Tile, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of pairs that bounds leave open, those whose cosine in double precision reaches the threshold, in parts."""
    for i, j, sure in judged(a, b, threshold):
        i, j = i[~sure], j[~sure]
        for k in range(0, len(i), 1 << 16):
            p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            reach = np.einsum("ij,ij->i", a.unit[p], b.unit[q]) >= threshold
            yield p[reach], q[reach]


def _matrix(lists: pa.Array) -> np.ndarray:
    """Lists of one length, none null, as rows."""
    return np.asarray(lists.flatten()).astype(np.float64).reshape(len(lists), -1)


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The embedding, the last column, gives way to (code, scale, error)."""
    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        sizes = np.asarray(lists.value_lengths())
        for size in np.unique(sizes):
            rows = pa.array(np.flatnonzero(sizes == size))
            tile = Tile.of(_matrix(lists.take(rows)))
            codes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(int(size)), len(rows), [None, pa.py_buffer(np.ascontiguousarray(tile.code).tobytes())]).cast(pa.binary())
            kept = [c.take(rows) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, codes, pa.array(tile.scale), pa.array(tile.error)], [*batch.schema.names[:-1], "code", "scale", "error"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    """(key, rows) of consecutive rows of one key, the first three columns."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
        at = 0
        while at < len(keys):
            end = at + 1
            while end < len(keys) and keys[end] == keys[at]:
                end += 1
            if held and keys[at] != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = keys[at]
            held.append(batch.slice(at, end - at))
            at = end
    if held:
        yield key, pa.Table.from_batches(held)


_FOUND = pa.schema([("g", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("u", pa.int64()), ("v", pa.int64()), ("links", pa.int64())])
_FOUND_SQL = "g string, a int, b int, u long, v long, links long"
#: In the column links: an edge of a spanning forest, and a row of pairs left open, whose v is its side.
_EDGE, _OPEN = 0, -1


def _found(batches: Iterator[pa.RecordBatch], threshold: float, recompute: bool) -> Iterator[pa.RecordBatch]:
    """Rows (g, a, b, side, cid, n, code, scale, error), or with the embedding in place of the last three, in order of the first four.

    Out: numbers of linked vectors by class, a forest of the links; of the first pass also the rows of open pairs.
    """
    for key, rows in _groups(batches):
        side, cid, n = (rows.column(k).to_numpy() for k in (3, 4, 5))
        if recompute:
            every = Tile.of(_matrix(rows.column(6).combine_chunks()))
        else:
            codes = np.frombuffer(b"".join(rows.column(6).to_pylist()), np.int8).reshape(len(cid), -1)
            every = Tile(codes, rows.column(7).to_numpy(), rows.column(8).to_numpy())
        same = key[1] == key[2]
        split = len(cid) if same else int((side == 0).sum())
        left, right, shift = every.part(slice(0, split)), every if same else every.part(slice(split, None)), 0 if same else split
        degree, forest, open_ = np.zeros(len(cid), np.int64), Forest(len(cid)), np.zeros(len(cid), bool)
        pairs = () if split == 0 or not same and split == len(cid) else linked(left, right, threshold) if recompute else judged(left, right, threshold)
        for i, j, *sure in pairs:
            j = j + shift
            once = i < j if same else np.ones(len(i), bool)
            if sure:
                left_open = once & ~sure[0]
                open_[i[left_open]] = open_[j[left_open]] = True
                once &= sure[0]
            i, j = i[once], j[once]
            degree += np.bincount(i, n[j], len(cid)).astype(np.int64) + np.bincount(j, n[i], len(cid)).astype(np.int64)
            forest.link(i, j)
        child, root = forest.edges()
        touched, asked = np.flatnonzero(degree), np.flatnonzero(open_)
        u, v = np.concatenate([cid[touched], cid[child], cid[asked]]), np.concatenate([cid[touched], cid[root], side[asked]])
        links = np.concatenate([degree[touched], np.full(len(child), _EDGE), np.full(len(asked), _OPEN)])
        yield pa.RecordBatch.from_arrays([pa.array([x] * len(u), f.type) for x, f in zip(key, _FOUND, strict=False)] + [pa.array(u), pa.array(v.astype(np.int64)), pa.array(links)], schema=_FOUND)


def _keyed(vectors: DataFrame) -> DataFrame:
    """vectors with 128 bits of hash of the vector, and whether it can link at all."""
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    valid = F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    return vectors.select("vec_id", "label", "embedding", F.xxhash64("embedding").alias("h0"), F.xxhash64(F.lit(1), "embedding").alias("h1"), F.coalesce(valid, F.lit(False)).alias("valid"))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vectors (vec_id, embedding, label) -> (vec_id, n_links, component_id, kept), one row per row."""
    kind = vectors.schema["embedding"].dataType
    if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)):
        vectors = vectors.withColumn("embedding", F.col("embedding").cast(T.ArrayType(T.DoubleType())))
    keyed = _keyed(vectors.select("vec_id", "embedding", "label"))
    valid = keyed.where("valid")
    per = valid.groupBy("label", "h0", "h1").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("embedding").alias("embedding"))
    classes = cut(per).withColumn("cid", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding"))
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("members"))
    most = F.least(F.lit(TILE_MOST), F.greatest(F.lit(1), F.floor(F.lit(TILE_COMPONENTS) / F.col("dim"))))
    tile_size = F.least(most, F.greatest(F.lit(TILE_LEAST), F.ceil(F.col("members") / TILES_AIMED)))
    sizes = cut(sizes.select("label", "dim", F.ceil(F.col("members") / tile_size).cast("int").alias("tiles")))
    few = F.broadcast(sizes) if sizes.count() <= 10_000 else sizes
    places = classes.join(few, ["label", "dim"]).select("cid", "n", F.concat_ws("/", F.col("label").cast("string"), F.col("dim").cast("string")).alias("g"), "tiles", "embedding")
    coded = places.select("g", "tiles", "cid", "n", "embedding").mapInArrow(_coded, "g string, tiles int, cid long, n long, code binary, scale double, error double")
    tiled = coded.withColumn("tile", F.pmod(F.xxhash64("cid"), F.col("tiles")).cast("int"))
    paired = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    a, b = F.least("tile", "other"), F.greatest("tile", "other")
    rows = paired.select("g", a.alias("a"), b.alias("b"), (F.col("tile") > a).cast("int").alias("side"), "cid", "n", "code", "scale", "error")
    dealt = rows.repartition("g", "a", "b").sortWithinPartitions("g", "a", "b", "side")
    first = cut(dealt.mapInArrow(lambda batches: _found(batches, threshold, False), _FOUND_SQL))
    open_ = first.where(F.col("links") == _OPEN).select("g", "a", "b", F.col("v").cast("int").alias("side"), F.col("u").alias("cid"))
    vectors_of = open_.join(classes.select("cid", "n", "embedding"), "cid").select("g", "a", "b", "side", "cid", "n", "embedding")
    again = vectors_of.repartition("g", "a", "b").sortWithinPartitions("g", "a", "b", "side")
    second = cut(again.mapInArrow(lambda batches: _found(batches, threshold, True), _FOUND_SQL))
    found = first.union(second)
    degrees = found.where("links > 0").groupBy(F.col("u").alias("cid")).agg(F.sum("links").alias("linked"))
    labels = connected_components(found.where(F.col("links") == _EDGE).select("u", "v"))
    lowest = least_of(labels, classes.select(F.col("cid").alias("node"), F.col("least").alias("value"))).withColumnRenamed("node", "cid")
    judged_ = classes.join(degrees, "cid", "left").join(lowest, "cid", "left").select(
        "label", "h0", "h1", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("value", "least").alias("component_id")
    )
    linked_ = valid.select("vec_id", "label", "h0", "h1").join(judged_, ["label", "h0", "h1"]).select("vec_id", "n_links", "component_id")
    alone = keyed.where("not valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked_.unionByName(alone).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


ORACLE = """
WITH RECURSIVE valid AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM valid a JOIN valid b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT vec_id AS u, vec_id AS v FROM embeddings
  UNION
  SELECT r.u, l.v FROM reach r JOIN link l ON r.v = l.u
)
SELECT e.vec_id, (SELECT count(*) FROM link WHERE u = e.vec_id)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN (SELECT u, min(v) AS component_id FROM reach GROUP BY u) c ON c.u = e.vec_id
"""
