"""A stored inverted-list vector index: every row is in the list of its nearest centroid.

The index is a folder: ``lists`` has the centroids and the settings, ``vectors`` the rows,
a segment for each write, sorted by list so that a search reads few row groups, and
``gone`` the ids that a write replaced or deleted in earlier segments. A row has its
vector, and its code: a byte for each component, the step that the bytes count, and
how far the code is from the vector.

A search picks the lists nearest to each query, goes through their codes alone, and
keeps what the codes' error bounds leave among the k best; those are scored again from
their vectors. So within the lists probed the result is exact.

Lists follow the metric: directions for COSINE, places for L2; for IP each vector gets one
more component that makes all equally long, so that the nearest has the largest
product. Centroids are fitted on a bounded sample; every row is indexed. ``tune`` finds how many
lists to probe by recall against brute force, under the index's metric.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import vector
from siltstone.operators import nearest
from siltstone.operators.generations import Segments, State
from siltstone.operators.retrieval import checked_vectors
from siltstone.runtime import cut

#: Rows that the centroids are fitted on, at most about; picked by a hash of their ids.
FIT_ROWS = 20_000
ROUNDS = 12
#: Queries that recall is measured with.
TUNE_QUERIES, TARGET_RECALL = 200, 0.98
#: Candidates that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Rows of a row group, so that a list is read without its neighbours.
GROUP_BYTES = 8 << 20


@dataclass(frozen=True)
class Lists:
    """Centroids, a row each, for a metric; longest is the length of the longest vector, for IP; probes what tune found."""

    centroids: np.ndarray
    metric: str
    dims: int
    longest: float = 0.0
    probes: int = 0

    def placed(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors of the index where the lists are fitted."""
        if self.metric == "COSINE":
            return _unit(vectors)
        if self.metric == "IP":
            rest = np.sqrt(np.maximum(self.longest**2 - (vectors**2).sum(axis=1), 0))
            return np.concatenate([vectors, rest[:, None]], axis=1)
        return vectors

    def nearest(self, places: np.ndarray, n: int) -> np.ndarray:
        """The n lists nearest to each place, nearest first."""
        away = (self.centroids**2).sum(axis=1)[None, :] - 2 * places @ self.centroids.T
        return np.argsort(away, axis=1, kind="stable")[:, :n].astype(np.int32)

    def asked(self, queries: np.ndarray) -> np.ndarray:
        """Where queries look: like vectors, but under IP the direction alone counts, at the length of all."""
        if self.metric == "IP":
            return np.concatenate([_unit(queries) * self.longest, np.zeros((len(queries), 1))], axis=1)
        return self.placed(queries)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1, norm)


def _picked(index: DataFrame, most: int, n: int) -> DataFrame:
    share = min(1.0, most / max(1, n))
    return index.where(F.pmod(F.xxhash64(F.lit("ann"), "id"), F.lit(1 << 32)) < F.lit(share * (1 << 32)))


def fit(index: DataFrame, lists: int = 64, metric: str = "COSINE") -> Lists:
    """k-means over a sample of index (id, embedding), of directions, places or, for IP, lengthened vectors; deterministic."""
    metric = vector.metric(metric)
    rows = index.where(F.col("embedding").isNotNull())
    seen = rows.agg(F.count("*").alias("n"), F.max(vector.norm(F.col("embedding"))).alias("longest")).first()
    sample = _picked(rows, FIT_ROWS, seen["n"]).orderBy("id").select(F.col("embedding").cast("array<double>")).toArrow()
    by_length = nearest.matrices(sample.column(0)) if sample.num_rows else {}
    if len(by_length) != 1:
        raise ValueError("no vectors to fit lists on" if not by_length else "vectors of several lengths")
    dims, (_, x) = by_length.popitem()
    out = Lists(np.zeros((0, dims)), metric, dims, float(seen["longest"] or 0.0))
    x = out.placed(x)
    lists = min(lists, len(x))
    centers = x[np.linspace(0, len(x) - 1, lists).astype(int)].copy()
    for _ in range(ROUNDS):
        own = replace(out, centroids=centers).nearest(x, 1)[:, 0]
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=lists)
        centers[n > 0] = sums[n > 0] / n[n > 0, None]
        if metric == "COSINE":
            centers = _unit(centers)
    return replace(out, centroids=centers)


def coded(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, steps, errors): rows are within errors (a length) of codes * steps."""
    steps = np.abs(rows).max(axis=1, initial=0) / 127
    steps[steps == 0] = 1
    codes = np.rint(rows / steps[:, None]).astype(np.int8)
    off = rows - codes * steps[:, None]
    return codes, steps, np.sqrt((off**2).sum(axis=1)) * (1 + 1e-9)


_CODED = "list_id int, code binary, step double, error double, length double"


def _assigned(batches: Iterator[pa.RecordBatch], lists: Lists) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        own, steps, errors, lengths, codes = np.full(n, -1, np.int32), np.zeros(n), np.zeros(n), np.zeros(n), [None] * n
        at, rows = nearest.matrices(batch.column(1)).get(lists.dims, ((), np.zeros((0, lists.dims))))
        if len(at):
            own[at] = lists.nearest(lists.placed(rows), 1)[:, 0]
            lengths[at] = np.sqrt((rows**2).sum(axis=1))
            found, steps[at], errors[at] = coded(rows)
            for k, code in zip(at.tolist(), found, strict=True):
                codes[k] = code.tobytes()
        columns = [*batch.columns, pa.array(own), pa.array(codes, pa.binary()), *map(pa.array, (steps, errors, lengths))]
        yield pa.RecordBatch.from_arrays(columns, ["id", "embedding", "list_id", "code", "step", "error", "length"])


def assign(index: DataFrame, lists: Lists) -> DataFrame:
    """index (id, embedding) with list_id and code; a vector that is null, not finite or of another length is in list -1 and never found."""
    narrow = index.select("id", F.col("embedding").cast("array<float>").alias("embedding"))
    return narrow.mapInArrow(lambda batches: _assigned(batches, lists), f"id {index.schema['id'].dataType.simpleString()}, embedding array<float>, {_CODED}")


def _bounds(lists: Lists, queries: np.ndarray, norms: np.ndarray, code: pa.Array, step: np.ndarray, error: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the most that the score of each query with each row of a list may be, -inf where there is none."""
    matrix = np.frombuffer(b"".join(code.to_pylist()), np.int8).reshape(-1, lists.dims).astype(np.float64) * step[:, None]
    middle, off = queries @ matrix.T, norms[:, None] * (error + 1e-9 * length)[None, :]
    if lists.metric == "L2":
        middle, off = 2 * middle - (norms**2)[:, None] - (length**2)[None, :], 2 * off + 1e-9 * (norms**2)[:, None]
    elif lists.metric == "COSINE":
        with np.errstate(invalid="ignore", divide="ignore"):
            scale = norms[:, None] * length[None, :]
            middle, off = middle / scale, off / scale
    good = np.isfinite(middle)
    return np.where(good, middle - off, -np.inf), np.where(good, middle + off, -np.inf)


def _candidates(batches: Iterator[pa.RecordBatch], queries: nearest.Queries, lists: Lists, k: int, probes: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows (id, list_id, code, step, error, length): for each query that probes the list, the ids that may be among its k best, with the least score they may have."""
    places, asked = queries.by_length.get(lists.dims, (np.zeros(0, np.int64), np.zeros((0, lists.dims))))
    probed = lists.nearest(lists.asked(asked), probes) if len(asked) else np.zeros((0, 0), np.int32)
    norms = np.sqrt((asked**2).sum(axis=1))
    who: dict[int, np.ndarray] = {}
    for q, row in enumerate(probed.tolist()):
        for at in row:
            who.setdefault(at, []).append(q)
    who = {at: np.array(qs) for at, qs in who.items()}
    floor = np.full(len(asked), -np.inf)  # what k rows of this task are sure to reach
    for batch in batches:
        own = batch.column(1).to_numpy()
        ids = nearest._ids(batch.column(0))
        code, (step_, error, length) = batch.column(2), (batch.column(c).to_numpy() for c in (3, 4, 5))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for at in np.unique(own).tolist():
            if at not in who:
                continue
            mine, qs = np.flatnonzero(own == at), who[at]
            step = max(4 * k, nearest.BLOCK_SCORES // len(qs))
            for part in range(0, len(mine), step):  # no more than a block of scores is held
                rows = mine[part : part + step]
                low, high = _bounds(lists, asked[qs], norms[qs], code.take(pa.array(rows)), step_[rows], error[rows], length[rows])
                if low.shape[1] >= k:
                    floor[qs] = np.maximum(floor[qs], np.partition(low, -k, axis=1)[:, -k])
                i, j = np.nonzero((high > -np.inf) & (high >= _slack(lists.metric, floor[qs])[:, None]))
                out.append((qs[i], rows[j], low[i, j], high[i, j]))
        if out:
            q, row, low, high = map(np.concatenate, zip(*out, strict=True))
            kept = high >= _slack(lists.metric, floor[q])
            columns = [queries.ids[places[q[kept]]].tolist(), ids[row[kept]].tolist(), own[row[kept]], low[kept], high[kept]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _slack(metric: str, floor: np.ndarray) -> np.ndarray:
    """Scores are rounded before they are ranked, so what is that little below a floor may be level with it."""
    step = 10.0**-nearest.PLACES
    if metric == "L2":  # negated squares
        return -((np.sqrt(np.maximum(-floor, 0)) + step) ** 2)
    return floor - step


def search(indexed: DataFrame, queries: DataFrame, lists: Lists, k: int, probes: int | None = None) -> DataFrame:
    """(query_id, id, score, rank) of the k nearest rows in the probed lists, for queries (query_id, query), by the lists' metric.

    indexed is what assign gives, or StoredIndex.rows. The codes are gone through where they are; of the vectors only those of
    the candidates are read on. Query sets beyond what a task may hold are searched in parts.
    """
    probes = min(len(lists.centroids), probes or lists.probes or 1)
    asked = checked_vectors(queries.select("query_id", F.col("query").cast("array<double>").alias("query")), lists.dims)
    n = asked.count()
    parts = max(1, -(-n // nearest.MOST_QUERIES), -(-8 * n * lists.dims // nearest.MOST_BYTES))
    placed = (cut(asked) if parts > 1 else asked).withColumn("_at", F.pmod(F.monotonically_increasing_id(), F.lit(parts)))
    kinds = nearest._schema(indexed, queries)[1]
    schema = pa.schema([kinds.field(0), kinds.field(1), ("list_id", pa.int32()), ("low", pa.float64()), ("high", pa.float64())])
    names = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {indexed.schema['id'].dataType.simpleString()}, list_id int, low double, high double"
    spark, found = indexed.sparkSession, None
    for part in range(parts):
        table = placed.where(F.col("_at") == part).select("query_id", "query").toArrow()
        held = nearest.Queries(table)
        near = lists.nearest(lists.asked(held.by_length[lists.dims][1]), probes) if table.num_rows else np.zeros((0, 0), np.int32)
        wanted = np.unique(near).tolist()
        shipped = spark.sparkContext.broadcast(held)
        rows = indexed.where(F.col("list_id").isin(wanted) if len(wanted) < len(lists.centroids) else F.col("list_id") >= 0).select("id", "list_id", "code", "step", "error", "length")
        one = rows.mapInArrow(lambda batches, shipped=shipped: _candidates(batches, shipped.value, lists, k, probes, schema), names)
        found = one if found is None else found.unionByName(one)
    # Of all tasks' candidates, those that k others surely beat go.
    found = cut(found)
    best = found.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("low").desc()))).where(F.col("_n") <= k)
    floors = best.groupBy(F.col("query_id").alias("_q")).agg(F.min("low").alias("_floor"), F.count("*").alias("_have")).where(F.col("_have") == k)
    step = 10.0**-nearest.PLACES
    least = -F.pow(F.sqrt(F.greatest(-F.col("_floor"), F.lit(0.0))) + step, 2) if lists.metric == "L2" else F.col("_floor") - step
    joined = found.join(floors, F.col("query_id") == F.col("_q"), "left")
    open_ = cut(joined.where(F.col("_floor").isNull() | (F.col("high") >= least)).select("query_id", "id", "list_id"))
    open_ = F.broadcast(open_) if open_.count() <= BROADCAST_ROWS else open_
    score = F.round(vector.score(lists.metric, F.col("embedding").cast("array<double>"), F.col("query")), nearest.PLACES)
    hits = indexed.where("list_id >= 0").select("id", "list_id", "embedding").join(open_, ["list_id", "id"])
    hits = hits.join(F.broadcast(asked) if parts == 1 else asked, "query_id").select("query_id", "id", score.alias("score")).where("score is not null")
    order = F.col("score").asc() if vector.ascending(lists.metric) else F.col("score").desc()
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "id"))).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of exact hits (query_id, id) that were found."""
    both = exact.join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return both.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0] or 0.0


def tune(index: DataFrame, indexed: DataFrame, lists: Lists, k: int = 10) -> tuple[Lists, float]:
    """(lists with probes, recall): the fewest probes, by doubling, that reach TARGET_RECALL on sampled rows as queries, by the lists' metric."""
    rows = index.where(vector.is_valid(F.col("embedding"), lists.dims))
    queries = cut(_picked(rows, TUNE_QUERIES, rows.count()).select(F.col("id").alias("query_id"), F.col("embedding").alias("query")))
    exact = cut(nearest.knn(index, queries, k, lists.metric))
    probes = 1
    while True:
        got = recall(search(indexed, queries, lists, k, probes), exact)
        if got >= TARGET_RECALL or probes >= len(lists.centroids):
            return replace(lists, probes=probes), got
        probes = min(2 * probes, len(lists.centroids))


@dataclass(frozen=True)
class StoredIndex:
    """An index in a folder of shared storage; every write is one published state. One writer at a time is assumed."""

    root: str

    def _segments(self) -> Segments:
        return Segments(self.root, "id")

    def create(self, index: DataFrame, lists: int = 64, metric: str = "COSINE", k: int = 10) -> float:
        """Fit, assign, write and tune; the recall that was measured."""
        spark, fitted, segments = index.sparkSession, fit(index, lists, metric), self._segments()
        state = segments.next(spark, "vectors")
        self._write(index, fitted, state)
        tuned, got = tune(index, spark.read.parquet(segments.path(f"vectors/segment={state.n}")), fitted, k)
        rows = [(at, c.tolist(), tuned.metric, tuned.dims, tuned.longest, tuned.probes) for at, c in enumerate(tuned.centroids)]  # a row for each list
        spark.createDataFrame(rows, "list_id int, centroid array<double>, metric string, dims int, longest double, probes int").coalesce(1).write.mode("overwrite").parquet(segments.path("lists"))
        segments.publish(spark, state)
        return got

    def lists(self, spark: SparkSession) -> Lists:
        rows = sorted(spark.read.parquet(self._segments().path("lists")).collect(), key=lambda r: r["list_id"])
        return Lists(np.array([r["centroid"] for r in rows]), rows[0]["metric"], rows[0]["dims"], rows[0]["longest"], rows[0]["probes"])

    def _write(self, index: DataFrame, lists: Lists, state: State) -> None:
        # The second key deals a list of many rows to several tasks.
        rows = assign(index, lists).repartitionByRange("list_id", F.xxhash64("id")).sortWithinPartitions("list_id")
        self._segments().put(rows, "vectors", state, **{"parquet.block.size": GROUP_BYTES})

    def rows(self, spark: SparkSession) -> DataFrame:
        """What the index holds: rows that no later write replaced or deleted."""
        return self._segments().read(spark, "vectors")

    def add(self, vectors: DataFrame) -> None:
        """New vectors (id, embedding), each id once, join the index or replace those of the same id; the lists stay as they were fitted."""
        spark, segments = vectors.sparkSession, self._segments()
        vectors, state = cut(vectors.select("id", "embedding")), segments.next(vectors.sparkSession, "vectors")
        self._write(vectors, self.lists(spark), state)
        segments.take(vectors, state)
        segments.publish(spark, state)

    def delete(self, ids: DataFrame) -> None:
        """The ids go; ids that aren't there do no harm."""
        segments, state = self._segments(), self._segments().next(ids.sparkSession, "vectors")
        segments.take(ids, state)
        segments.publish(ids.sparkSession, state)

    def compact(self, spark: SparkSession) -> None:
        """All segments become one and deletions are forgotten, so that reads don't grow with the writes; the old ones go once the new one is published."""
        state = self._segments().next(spark, "vectors")
        self._write(self.rows(spark).select("id", "embedding"), self.lists(spark), state)
        self._segments().rebase(spark, state, "vectors")

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        spark = queries.sparkSession
        return search(self.rows(spark), queries, self.lists(spark), k, probes)
