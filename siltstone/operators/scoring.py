"""Sums of term weights by query and row, the best k of each query kept where the rows are.

A query set of bounded size is shipped to every task: for each term, who asks for it. The
weights of a row's terms are dealt by the row, in order of its id; a task adds them up for a
few rows at a time, and returns k rows a query at most. No pair of query and row leaves a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Weights of (query, row) that are added up at a time.
PAIRS = 1 << 20
#: Places that sums are rounded to; equal ones are in order of their ids.
PLACES = 6


class Asked:
    """Queries by term: those of term t are queries[starts[t] : starts[t + 1]]."""

    def __init__(self, table: pa.Table):
        """table (query_id, a list of distinct terms); a query's number is its row."""
        lists = table.column(1).combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        who = np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
        self.n, self.terms, self.ids = table.num_rows, coded.dictionary.cast(pa.string()), table.column(0)
        self.queries = who[np.argsort(codes, kind="stable")]
        self.starts = np.r_[0, np.cumsum(np.bincount(codes, minlength=len(self.terms)))].astype(np.int64)

    def frames(self, spark) -> tuple[DataFrame, DataFrame]:
        """(term, t) and (query_id, q)."""
        number = lambda n: pa.array(np.arange(n, dtype=np.int32))
        return spark.createDataFrame(pa.table({"term": self.terms, "t": number(len(self.terms))})), spark.createDataFrame(pa.table({"query_id": self.ids, "q": number(self.n)}))


class Best:
    """The k best (score, id) of each query, of rows that come in order of their ids. Scores are whole numbers."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score, self.id = np.full((queries, k), -1, np.int64), np.full((queries, k), None, object)

    def add(self, query: np.ndarray, score: np.ndarray, row: np.ndarray, ids: np.ndarray) -> None:
        """Distinct (query, row); all rows come after those before, so of equal scores the earlier stay."""
        open_ = score > self.score[query, -1]
        query, score, row = query[open_], score[open_], row[open_]
        if not len(query):
            return
        order = np.lexsort((row, -score, query))
        query, score, row = query[order], score[order], row[order]
        first = np.r_[True, query[1:] != query[:-1]]
        nth = np.arange(len(query)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        kept = nth < self.k
        who, at = np.unique(query, return_inverse=True)
        scores, found = np.full((len(who), self.k), -1, np.int64), np.full((len(who), self.k), None, object)
        scores[at[kept], nth[kept]], found[at[kept], nth[kept]] = score[kept], ids[row[kept]]
        scores, found = np.concatenate([self.score[who], scores], axis=1), np.concatenate([self.id[who], found], axis=1)
        best = np.argsort(-scores, axis=1, kind="stable")[:, : self.k]
        self.score[who], self.id[who] = np.take_along_axis(scores, best, axis=1), np.take_along_axis(found, best, axis=1)


def _summed(asked: Asked, best: Best, row: np.ndarray, term: np.ndarray, weight: np.ndarray, ids: np.ndarray) -> None:
    """Weights of whole rows, in order; row says which, from 0."""
    counts = asked.starts[term + 1] - asked.starts[term]
    upto = np.cumsum(counts)
    ends = np.flatnonzero(np.r_[row[1:] != row[:-1], True]) + 1  # where a row's weights end
    at = 0
    while at < len(row):
        before = upto[at - 1] if at else 0
        k = np.searchsorted(upto[ends - 1], before + PAIRS, side="right")
        end = int(ends[max(k - 1, np.searchsorted(ends, at, side="right"))])
        n = counts[at:end]
        total = int(n.sum())
        if total:
            place = np.repeat(asked.starts[term[at:end]] - (np.cumsum(n) - n), n) + np.arange(total)
            query, low = asked.queries[place], row[at]
            key = np.repeat(row[at:end] - low, n) * asked.n + query
            weights, cells = np.repeat(weight[at:end], n), int(row[end - 1] - low + 1) * asked.n
            if cells <= 8 * total:
                sums = np.bincount(key, weights, minlength=cells)[key]
                score = np.rint(sums * 10**PLACES).astype(np.int64)
                open_ = score > best.score[query, -1]
                key, first = np.unique(key[open_], return_index=True)
                score = score[open_][first]
            else:
                key, inverse = np.unique(key, return_inverse=True)
                score = np.rint(np.bincount(inverse, weights) * 10**PLACES).astype(np.int64)
            best.add(key % asked.n, score, low + key // asked.n, ids)
        at = end


def _found(batches: Iterator[pa.RecordBatch], asked: Asked, k: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Of batches (id, t, weight), in order of the id, the best k of each query."""
    best, rest = Best(asked.n, k), None
    for batch in batches:
        held = pa.Table.from_batches([*([rest] if rest is not None else []), batch]).combine_chunks().to_batches()
        if not held:
            continue
        rows = held[0]
        ids = np.empty(rows.num_rows, object)
        ids[:] = rows.column(0).to_pylist()
        new = np.r_[True, ids[1:] != ids[:-1]].astype(bool)
        last = int(np.flatnonzero(new)[-1])  # the last row may go on in the next batch
        _all(rows.slice(0, last), ids[:last], new[:last], asked, best)
        rest = rows.slice(last)
    if rest is not None:
        ids = np.empty(rest.num_rows, object)
        ids[:] = rest.column(0).to_pylist()
        _all(rest, ids, np.arange(len(ids)) == 0, asked, best)
    q, nth = np.nonzero(best.score >= 0)
    columns = [q.astype(np.int32), best.id[q, nth].tolist(), best.score[q, nth] / 10**PLACES]
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _all(rows: pa.RecordBatch, ids: np.ndarray, new: np.ndarray, asked: Asked, best: Best) -> None:
    if rows.num_rows:
        _summed(asked, best, np.cumsum(new) - 1, rows.column(1).to_numpy().astype(np.int64), rows.column(2).to_numpy(), ids[new])


def best(weights: DataFrame, asked: Asked, k: int) -> DataFrame:
    """(q, id, score, rank) of weights (id, t, weight), all above 0: of each query the k rows of the largest sums."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = weights.schema["id"].dataType
    schema = pa.schema([("q", pa.int32()), ("id", to_arrow_type(kind)), ("score", pa.float64())])
    shipped = weights.sparkSession.sparkContext.broadcast(asked)
    dealt = weights.select("id", F.col("t").cast("int").alias("t"), F.col("weight").cast("double").alias("weight")).repartition("id").sortWithinPartitions("id")
    found = dealt.mapInArrow(lambda batches: _found(batches, shipped.value, k, schema), f"q int, id {kind.simpleString()}, score double")
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
