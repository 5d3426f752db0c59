"""Exact k nearest vectors by matrix products: queries x vectors a block at a time, the best k of each query kept.

A query set of known, small size is shipped to every task once, and the index is
read once and not shuffled. A larger one is cut into tiles, the index into
shares, and each task holds a tile while it goes through a share. Either way a task
returns k rows a query at most, no pair is ever a row, and no more than a block of
scores is in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import vector
from siltstone.runtime import cut

#: Queries, and bytes of their components, that are shipped to every task; larger sets are cut into tiles of that size.
MOST_QUERIES, MOST_BYTES = 10_000, 32 << 20
#: Scores that a task holds at a time.
BLOCK_SCORES = 1 << 21
#: Places that scores are rounded to; equal ones are in order of their ids.
PLACES = 6
_EXACT = 1 << 16


def matrices(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of a list column: for each length its rows' places and their components in double precision, a row each.

    A row that is null, or has a component that is null or not finite, is in none.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    ends = np.cumsum(np.maximum(sizes, 0))
    out = {}
    for n in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == n)
        rows = flat.reshape(-1, n) if len(at) == len(sizes) else flat[(ends[at] - n)[:, None] + np.arange(n)]
        good = np.isfinite(rows).all(axis=1)
        out[n] = (at, rows) if good.all() else (at[good], rows[good])
    return out


def exact_scores(metric: str, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Rounded score of each query with the row beside it, higher is better (L2 negated), NaN where there is none."""
    if metric == "L2":
        out = -np.sqrt(((queries - rows) ** 2).sum(axis=1))
    else:
        out = (queries * rows).sum(axis=1)
        if metric == "COSINE":
            with np.errstate(invalid="ignore", divide="ignore"):
                out = out / (np.sqrt((queries**2).sum(axis=1)) * np.sqrt((rows**2).sum(axis=1)))
    return np.where(np.isfinite(out), np.round(out, PLACES), np.nan)


def all_scores(metric: str, queries: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, float]:
    """By a matrix product: scores as above, a row for each query, -inf where there is none, and how far they may be off."""
    products, a, b = queries @ rows.T, (queries**2).sum(axis=1), (rows**2).sum(axis=1)
    off = 8 * np.finfo(float).eps * queries.shape[1] * (a.max(initial=0) + b.max(initial=0))
    if metric == "L2":  # a difference of squares loses the digits of near ones
        out, off = -np.sqrt(np.maximum(a[:, None] + b[None, :] - 2 * products, 0)), np.sqrt(off)
    elif metric == "COSINE":
        with np.errstate(invalid="ignore", divide="ignore"):
            out, off = products / (np.sqrt(a)[:, None] * np.sqrt(b)[None, :]), 1e-12
    else:
        out = products
    return np.where(np.isfinite(out), out, -np.inf), off + 10.0**-PLACES


class Best:
    """The k best (score, id) of each query so far; of equal scores those of the least ids."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.query, self.score, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object)
        self.least = np.full(queries, -np.inf)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Some (query, score, id), none of them NaN."""
        if not len(query):
            return
        query, score, ids = np.concatenate([self.query, query]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        _, place = np.unique(ids, return_inverse=True)
        order = np.lexsort((place, -score, query))
        query = query[order]
        first = np.r_[True, query[1:] != query[:-1]]
        nth = np.arange(len(query)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        kept = nth < self.k
        self.query, self.score, self.id = query[kept], score[order][kept], ids[order][kept]
        last = nth[kept] == self.k - 1
        self.least[self.query[last]] = self.score[last]

    def meet(self, metric: str, queries: np.ndarray, places: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> None:
        """Queries (a row each; places are their numbers) against vectors of the same length."""
        step = max(1, BLOCK_SCORES // max(1, len(queries)))
        for at in range(0, len(rows), step):
            block, off = all_scores(metric, queries, rows[at : at + step])
            floor = self.least[places]
            if block.shape[1] > self.k:
                # The k-th best of the block bounds what can be among the best, equal ones after rounding included.
                floor = np.maximum(floor, np.partition(block, -self.k, axis=1)[:, -self.k])
            i, j = np.nonzero((block >= (floor - 2 * off)[:, None]) & (block > -np.inf))
            for part in range(0, len(i), _EXACT):
                x, y = i[part : part + _EXACT], at + j[part : part + _EXACT]
                score = exact_scores(metric, queries[x], rows[y])
                good = ~np.isnan(score)
                self.add(places[x][good], score[good], ids[y][good])


    def see(self, metric: str, queries: Queries, ids: np.ndarray, vectors: pa.Array) -> None:
        """A batch of the index: ids, and a list column."""
        for n, (at, rows) in matrices(vectors).items():
            if n in queries.by_length:
                places, asked = queries.by_length[n]
                self.meet(metric, asked, places, rows, ids[at])


class Queries:
    """A query set as matrices by length, with the number and id of each query."""

    def __init__(self, table: pa.Table):
        self.ids = np.array(table.column(0).to_pylist(), object)
        self.by_length = matrices(table.column(1))


def _ids(column: pa.Array) -> np.ndarray:
    out = np.empty(len(column), object)
    out[:] = column.to_pylist()
    return out


def _result(queries: Queries, best: Best, metric: str, schema: pa.Schema) -> pa.RecordBatch:
    score = (-best.score if metric == "L2" else best.score) + 0.0  # no negative zero
    columns = [queries.ids[best.query].tolist(), best.id.tolist(), score]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _found(batches: Iterator[pa.RecordBatch], queries: Queries, metric: str, k: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Of batches (id, embedding) the best k of each query."""
    best = Best(len(queries.ids), k)
    for batch in batches:
        best.see(metric, queries, _ids(batch.column(0)), batch.column(1))
    yield _result(queries, best, metric, schema)


def _schema(index: DataFrame, queries: DataFrame) -> tuple[str, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = queries.schema["query_id"].dataType, index.schema["id"].dataType
    names = f"query_id {kinds[0].simpleString()}, id {kinds[1].simpleString()}, score double"
    return names, pa.schema([("query_id", to_arrow_type(kinds[0])), ("id", to_arrow_type(kinds[1])), ("score", pa.float64())])


def _tiled(index: DataFrame, queries: DataFrame, tiles: int, k: int, metric: str) -> DataFrame:
    """Each tile of queries meets each share of the index in a task, which holds the tile and goes through the share."""
    names, schema = _schema(index, queries)
    shares = max(1, index.sparkSession.sparkContext.defaultParallelism // tiles)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select(F.pmod(F.monotonically_increasing_id(), F.lit(tiles)).cast("int").alias("tile"), "query_id", F.col("query").cast("array<double>").alias("vector"))
    asked = asked.select("tile", every(shares).alias("share"), F.lit(0).alias("side"), "query_id", F.lit(None).cast(index.schema["id"].dataType).alias("id"), "vector")
    rows = index.select(F.pmod(F.xxhash64("id"), F.lit(shares)).cast("int").alias("share"), "id", F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.select(every(tiles).alias("tile"), "share", F.lit(1).alias("side"), F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), "id", "vector")
    dealt = asked.unionByName(rows).repartition("tile", "share").sortWithinPartitions("tile", "share", "side")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, best, key, waiting = None, None, None, []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in range(3)], axis=1)
            edges = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, len(keys)]
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                part = batch.slice(a, b - a)
                tile, share, side = keys[a].tolist()
                if (tile, share) != key:
                    if best:
                        yield _result(held, best, metric, schema)
                    held, best, key, waiting = None, None, (tile, share), []
                if side == 0:
                    waiting.append(pa.record_batch([part.column(3), part.column(5)], ["query_id", "query"]))
                elif waiting or best:
                    if not best:
                        held = Queries(pa.Table.from_batches(waiting))
                        best, waiting = Best(len(held.ids), k), []
                    best.see(metric, held, _ids(part.column(4)), part.column(5))
        if best:
            yield _result(held, best, metric, schema)

    return dealt.mapInArrow(met, names)


def knn(index: DataFrame, queries: DataFrame, k: int, metric: str = "COSINE") -> DataFrame:
    """(query_id, id, score, rank) of the k nearest in index (id, embedding) for each of queries (query_id, query).

    Vectors without a score (null, of another length, with a component that is null or not
    finite, or zero under cosine) are no hits. Rows of one query_id are ranked together.
    """
    metric = vector.metric(metric)
    rows = index.select("id", "embedding").where(F.col("embedding").isNotNull())
    known = queries.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("query")), F.lit(0)).alias("components")).first()
    tiles = max(-(-known["n"] // MOST_QUERIES), -(-8 * known["components"] // MOST_BYTES))
    if tiles <= 1:
        names, schema = _schema(index, queries)
        shipped = index.sparkSession.sparkContext.broadcast(Queries(queries.select("query_id", F.col("query").cast("array<double>")).toArrow()))
        scored = rows.withColumn("embedding", F.col("embedding").cast("array<double>")).mapInArrow(lambda batches: _found(batches, shipped.value, metric, k, schema), names)
    else:
        scored = _tiled(rows, cut(queries), tiles, k, metric)
    order = F.col("score").asc() if vector.ascending(metric) else F.col("score").desc()
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "id"))).where(F.col("rank") <= k)
