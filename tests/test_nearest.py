import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import nearest


def brute(index, queries, k, metric):
    out = set()
    for qid, q in queries:
        scored = []
        for i, v in index:
            if v is None or len(v) != len(q) or any(x is None or not np.isfinite(x) for x in v):
                continue
            a, b = np.array(q, float), np.array(v, float)
            if metric == "L2":
                s = -np.sqrt(((a - b) ** 2).sum())
            else:
                s = (a * b).sum()
                if metric == "COSINE":
                    n = np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())
                    if n == 0:
                        continue
                    s = s / n
            scored.append((-round(float(s), 6), i))
        for rank, (s, i) in enumerate(sorted(scored)[:k], 1):
            out.add((qid, i, round((s if metric == "L2" else -s) + 0.0, 6), rank))
    return out


def tables(kind=str):
    rng = random.Random(6)
    vec = lambda n: [float(np.float32(rng.gauss(0, 1))) for _ in range(n)]
    index = [(k, vec(8)) for k in range(300)]
    index += [(1000 + k, index[7][1]) for k in range(60)]  # more equal vectors than k
    index += [(2000 + k, [x * 1000 for x in vec(8)]) for k in range(20)] + [(3000 + k, [1000.0 + 1e-4 * k] * 8) for k in range(30)]
    index += [(4000, None), (4001, [0.0] * 8), (4002, [float("nan")] * 8), (4003, [None] + [1.0] * 7), (4004, vec(5)), (4005, []), (4006, [float("inf")] * 8)]
    rng.shuffle(index)
    queries = [(k, vec(8)) for k in range(9)] + [(20, index[3][1] or vec(8)), (21, [0.0] * 8), (22, vec(5)), (23, [1000.0] * 8), (24, dict(index)[7]), (25, vec(3))]
    queries = [(k, q) for k, q in queries if q and all(x is not None and np.isfinite(x) for x in q)]
    return [(kind(k), v) for k, v in index], queries


@pytest.mark.parametrize("metric", ["COSINE", "IP", "L2"])
@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, metric, small):
    index, queries = tables(str if small else int)
    if small:  # tiles of queries, shares of the index, blocks of a few scores
        monkeypatch.setattr(nearest, "MOST_QUERIES", 4)
        monkeypatch.setattr(nearest, "BLOCK_SCORES", 64)
    i = spark.createDataFrame(index, f"id {'string' if small else 'long'}, embedding array<{'double' if small else 'float'}>").repartition(5)
    q = spark.createDataFrame(queries, "query_id long, query array<float>").repartition(2)
    got = nearest.knn(i, q, 7, metric)
    rows = got.collect()
    single = lambda v: v and [x if x is None else float(np.float32(x)) for x in v]
    want = brute([(k, v if small else single(v)) for k, v in index], [(k, single(v)) for k, v in queries], 7, metric)
    assert {(r.query_id, r.id, round(r.score, 6), r.rank) for r in rows} == want and len({(r.query_id, r.rank) for r in rows}) == len(rows)
    assert got.columns == ["query_id", "id", "score", "rank"]


def test_plan_has_no_row_for_a_pair(spark):
    i = spark.range(5000).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding"))
    q = spark.range(40).select(F.col("id").alias("query_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("query"))
    plan = nearest.knn(i, q, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan and "MapInArrow" in plan


def test_empty_sides(spark):
    none, one = spark.createDataFrame([], "id long, embedding array<float>"), spark.createDataFrame([(1, [1.0])], "query_id long, query array<float>")
    assert nearest.knn(none, one, 3).count() == 0
    assert nearest.knn(one.toDF("id", "embedding"), none.toDF("query_id", "query"), 3).count() == 0


def test_many_equal_queries(spark, monkeypatch):
    monkeypatch.setattr(nearest, "MOST_QUERIES", 10)
    i = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(50)], "id long, embedding array<float>")
    q = spark.range(200).select(F.col("id").alias("query_id"), F.array(F.lit(0.0), F.lit(1.0)).alias("query"))
    got = nearest.knn(i, q, 2)
    assert got.count() == 400 and {r.id for r in got.select("id").distinct().collect()} == {0, 1}
