import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from siltstone.operators import retrieval as r


def channel(spark, ids):
    return spark.createDataFrame([(1, i, k + 1) for k, i in enumerate(ids)], "query_id long, id string, rank int")


def test_rrf(spark):
    got = r.rrf([channel(spark, ["d1", "d2", "d3"]), channel(spark, ["d3", "d4"])]).orderBy("rank").collect()
    assert [(x.id, round(x.score, 6)) for x in got] == [("d3", 0.032266), ("d1", 0.016393), ("d2", 0.016129), ("d4", 0.016129)]
    weighted = r.rrf([channel(spark, ["a"]), channel(spark, ["b"])], weights=[1.0, 3.0]).orderBy("rank").collect()
    assert [x.id for x in weighted] == ["b", "a"]


def test_top(spark):
    fused = r.rrf([channel(spark, ["d1", "d2", "d3"])])
    docs = spark.createDataFrame([("d1", "　 "), ("d2", "x"), ("d3", "y")], "id string, content string")
    assert [(x.id, x.rank) for x in r.top(fused, docs, r.Options()).orderBy("rank").collect()] == [("d2", 1), ("d3", 2)]
    assert r.top(fused, docs, r.Options(threshold=0.5)).count() == 0
    assert [x.id for x in r.top(fused, docs, r.Options(top_k=1), rerank=lambda h: h.withColumn("rank", -F.col("rank"))).collect()] == ["d3"]
    with pytest.raises(ValueError):
        r.Options(top_k=11)


def test_access(spark):
    grants = spark.createDataFrame([("ann", 3), ("ann", 1), ("ann", 3), ("ann", 0)], "subject string, dataset_id long")
    assert sorted(x.dataset_id for x in r.granted(grants, "ann").collect()) == [1, 3]
    docs = spark.createDataFrame([(k, k % 4) for k in range(8)], "id long, dataset_id long")
    assert r.within_grants(docs, grants, "bob").count() == 0
    with pytest.raises(ValueError):
        r.granted(grants, " ")


def test_vectors(spark):
    good = [(1, [1.0, 0.0]), (2, [0.0, 1.0])]
    for bad in ([(0, [1.0, 0.0])], [(-1, [1.0, 0.0])], [(3, [1.0, 0.0]), (3, [1.0, 0.0])], [(3, [1.0])], [(3, [float("nan"), 1.0])], [(3, [float("inf"), 1.0])]):
        with pytest.raises(PySparkException):
            r.validated(spark.createDataFrame(good + bad, "chunk_id long, embedding array<double>"), 2, "m").collect()
    with pytest.raises(ValueError):
        r.validated(spark.createDataFrame(good, "chunk_id long, embedding array<double>"), 2, " ")
    have = r.validated(spark.createDataFrame(good, "chunk_id long, embedding array<double>"), 2, "m")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "chunk_id long")
    assert [x.chunk_id for x in r.delete(have, ids(1, 1), "chunk_id").collect()] == [2]
    assert r.delete(have, ids(), "chunk_id").count() == 2
    with pytest.raises(PySparkException):
        r.delete(have, ids(0), "chunk_id").collect()


def test_queries_and_limits(spark):
    q = spark.createDataFrame([(1, "  x \n")], "query_id long, query string")
    assert r.checked_queries(q).first().query == "x"
    for bad in (" 　", "y" * 2001):
        with pytest.raises(PySparkException):
            r.checked_queries(spark.createDataFrame([(1, bad)], "query_id long, query string")).collect()
    hits = spark.createDataFrame([("a", "s", "c"), ("", "s", "c" * 100), (None, "s", "c" * 90), ("", "t", "c" * 90)], "id string, source string, content string")
    assert hits.select(r.fusion_key().alias("k")).distinct().count() == 3
    with pytest.raises(ValueError):
        r.bm25(q, q, [])


@pytest.fixture(scope="module")
def vectors(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    centers = rng.normal(size=(20, 16)) * 3
    rows = [(k, ((centers[k % 20] + rng.normal(size=16)) * rng.choice([0.2, 1, 5])).astype(np.float32).tolist()) for k in range(2000)]
    rows += [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [1.0] * 15)] + [(6000 + k, rows[5][1]) for k in range(40)]
    return spark.createDataFrame(rows, "id long, embedding array<float>").repartition(4).cache()


def _same(found, exact):
    """Equal hits, and scores but for the last place, where two ways of adding up may round apart."""
    a, b = ({(x.query_id, x.rank): x for x in df.collect()} for df in (found, exact))
    assert a.keys() == b.keys() and all(abs(a[key].score - b[key].score) < 2e-6 and a[key].id == b[key].id for key in a)


@pytest.mark.parametrize("metric", ["COSINE", "IP", "L2"])
def test_stored_index(spark, vectors, tmp_path, metric, monkeypatch):
    from siltstone.operators import annindex as ann
    from siltstone.operators import generations, nearest

    stored = ann.StoredIndex(f"file://{tmp_path}/index")
    with pytest.raises(LookupError):
        stored.rows(spark)
    assert stored.create(vectors.where("id < 5003 or id >= 6000"), 20, metric) >= 0.95
    lists = stored.lists(spark)
    assert lists.metric == metric and lists.dims == 16 and 1 <= lists.probes <= 20
    rows = stored.rows(spark)
    assert rows.count() == 2043 and rows.where("list_id = -1").count() == 2
    queries = vectors.where("id % 50 = 0 and id < 2000").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    exact = nearest.knn(vectors, queries, 10, metric)
    _same(stored.search(queries, 10, 20), exact)
    assert ann.recall(stored.search(queries, 10), exact) >= 0.95
    monkeypatch.setattr(nearest, "MOST_QUERIES", 15)
    monkeypatch.setattr(ann, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(generations, "BROADCAST_ROWS", 0)
    _same(stored.search(queries, 10, 20), exact)
    monkeypatch.undo()
    new = vectors.where("id % 4 = 0 and id < 2000").select("id", F.transform("embedding", lambda x: x * 2).alias("embedding"))
    stored.add(new)
    stored.delete(spark.createDataFrame([(k,) for k in (1, 5, 5, 999_999)], "id long"))
    stored.add(vectors.where("id = 1").select((F.col("id") + 7000).alias("id"), "embedding"))
    state = vectors.where("(id < 5003 or id >= 6000) and id not in (1, 5) and not (id % 4 = 0 and id < 2000)").unionByName(new).unionByName(vectors.where("id = 1").select((F.col("id") + 7000).alias("id"), "embedding"))
    after = nearest.knn(state, queries, 10, metric)
    for _ in range(2):
        assert stored.rows(spark).count() == state.count()
        _same(stored.search(queries, 10, 20), after)
        stored.compact(spark)
    # What a failed write left behind is never seen.
    vectors.where("id < 9").select("id").write.parquet(f"file://{tmp_path}/index/gone/before=9")
    at = generations.current(spark, stored.root).n + 1
    vectors.where("id < 9").select("id").write.parquet(f"file://{tmp_path}/index/gone/before={at}")
    assert stored.rows(spark).count() == state.count()
    stored.delete(spark.createDataFrame([(2,)], "id long"))
    assert stored.rows(spark).count() == state.count() - 1


def test_lists_need_vectors(spark, vectors):
    from siltstone.operators import annindex as ann

    for bad in ("false", "id = 5000", "id in (1, 5003)"):
        with pytest.raises(ValueError):
            ann.fit(vectors.where(bad))


def test_a_search_reads_few_row_groups(spark, vectors, tmp_path):
    from siltstone.operators import annindex as ann

    stored = ann.StoredIndex(f"file://{tmp_path}/index")
    stored.create(vectors.where("id < 5000"), 20)
    named = stored.rows(spark).select("list_id", F.input_file_name().alias("file")).distinct()
    files = named.groupBy("list_id").count().agg(F.max("count")).first()[0]
    plan = stored.search(vectors.where("id = 3").select(F.col("id").alias("query_id"), F.col("embedding").alias("query")), 5, 1)
    assert files <= 2 and plan.count() == 5
    scan = stored.rows(spark).where(F.col("list_id").isin([3]))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(list_id), EqualTo(list_id,3)]" in scan or "In(list_id, [3])" in scan


def test_every_fiftieth_vector_asks_in_blocks(spark, monkeypatch):
    from siltstone.plans import catalog
    from siltstone.runtime import table

    sf = "/root/testdata/sf0.001"
    want = {r.vec_id for r in table(spark, sf, "embeddings").where("vec_id % 50 = 0").select("vec_id").collect()}
    names = ("knn_cosine", "bm25_search", "exact_id_channel")
    monkeypatch.setattr("siltstone.operators.nearest.MOST_QUERIES", 10_000)
    run = lambda: {name: {tuple(x) for x in catalog.QUERIES[name](spark, sf).collect()} for name in names}
    whole = run()
    assert len(want) > 5 and all({x[0] for x in whole[name]} == want for name in names)
    monkeypatch.setattr("siltstone.operators.retrieval.MOST_QUERIES", 4)
    monkeypatch.setattr("siltstone.operators.nearest.MOST_QUERIES", 3)
    assert run() == whole


def test_bad_query_vectors_fail(spark):
    index = spark.createDataFrame([(1, [1.0, 0.0])], "id long, embedding array<double>")
    ask = lambda v: spark.createDataFrame([(1, v)], "query_id long, query array<double>")
    assert r.knn(index, ask([0.0, 1.0]), 1, dims=2).count() == 1
    for bad in (None, [1.0], [float("nan"), 1.0], [1.0, None], [1.0, float("inf")]):
        with pytest.raises(PySparkException):
            r.knn(index, ask(bad), 1, dims=2).collect()
    docs = spark.createDataFrame([(1, "a b")], "id long, content string")
    for query, v in ((" ", [1.0, 0.0]), (None, [1.0, 0.0]), ("x" * 2001, [1.0, 0.0]), ("a", [1.0])):
        with pytest.raises(PySparkException):
            r.hybrid(docs, index, spark.createDataFrame([(1, query, v)], "query_id long, query string, vector array<double>"), dims=2).collect()


def test_stored_terms_search_as_texts_do(spark):
    rows = [(1, "a b a", "x"), (2, None, "b"), (3, "", None), (4, "b c", "a a"), (5, "d", "d")]
    docs = spark.createDataFrame(rows, "id long, content string, title string")
    queries = spark.createDataFrame([(1, "a b"), (2, "A, b!"), (3, "a b"), (4, "none here")], "query_id long, query string")
    fields = ["content", "title"]
    got = r.search_terms(r.inverted_index(docs, fields), r.lengths(docs, fields), queries)
    want = sorted(map(tuple, r.bm25(docs, queries, fields).collect()))
    assert sorted(map(tuple, got.collect())) == want and {w[0] for w in want} == {1, 2, 3}


def test_ranks_are_exact_in_small_blocks(spark, monkeypatch):
    """Sums of many rows and ties, a few pairs at a time, against plain Python."""
    import random
    from collections import defaultdict

    from siltstone.operators import scoring

    rng = random.Random(3)
    rows = [(k, t, rng.choice([0.5, 0.25, 1.0 + t / 8])) for k in range(400) for t in rng.sample(range(12), rng.randrange(0, 5))]
    texts = [(q, rng.sample([f"t{t}" for t in range(12)], rng.randrange(0, 6))) for q in range(30)]
    asked = scoring.Asked(spark.createDataFrame(texts, "query_id long, ts array<string>").toArrow())
    wanted, named = asked.frames(spark)
    weights = spark.createDataFrame([(k, f"t{t}", w) for k, t, w in rows], "id long, term string, weight double").join(wanted, "term")
    want = set()
    for q, ts in texts:
        sums = defaultdict(float)
        for k, t, w in rows:
            if f"t{t}" in ts:
                sums[k] += w
        want |= {(q, k, round(s, 6), n) for n, (k, s) in enumerate(sorted(sums.items(), key=lambda x: (-round(x[1], 6), x[0]))[:7], 1)}
    for pairs in (1 << 20, 40, 1):
        monkeypatch.setattr(scoring, "PAIRS", pairs)
        got = scoring.best(weights, asked, 7).join(named, "q").select("query_id", "id", "score", "rank")
        assert {tuple(x) for x in got.collect()} == want


def _sizes(spark, plan):
    """Rows that each shuffle of an executed plan wrote."""
    out, todo = [0], [plan]
    while todo:
        node = todo.pop()
        if "ShuffleExchange" in node.getClass().getSimpleName():
            out.append(node.metrics().apply("shuffleRecordsWritten").value())
        kids = node.children()
        todo += [kids.apply(k) for k in range(kids.size())]
        for name in ("executedPlan", "plan"):
            if name in ("executedPlan",) and node.getClass().getSimpleName() == "AdaptiveSparkPlanExec" or name == "plan" and node.getClass().getSimpleName().endswith("QueryStageExec"):
                todo.append(getattr(node, name)())
    return out


def test_pairs_of_query_and_document_are_not_shuffled(spark):
    """Every query names the source of half of the documents, yet no step between the scan and the result has a row for each pair."""
    docs = spark.range(2000).select("id", F.concat(F.lit("s"), F.col("id") % 2).alias("source"), F.concat(F.lit("s"), F.col("id") % 2).alias("content"))
    queries = spark.range(200).select(F.col("id").alias("query_id"), F.concat(F.lit("s"), F.col("id") % 2, F.lit(" x"), "id").alias("query"))
    for out, n in ((r.exact(docs, queries, "source"), 20), (r.bm25(docs, queries, ["content"]), 10)):
        rows = out.collect()
        assert len(rows) == 200 * n and {x.id % 2 == x.query_id % 2 for x in rows} == {True} and max(x.id for x in rows) < 2 * n
        plan = out._jdf.queryExecution().executedPlan()
        assert max(_sizes(spark, plan)) <= 200 * 8 * n


@pytest.mark.parametrize("metric", ["COSINE", "IP", "L2"])
def test_a_task_holds_a_block_of_scores(metric, monkeypatch):
    """However many queries meet a batch, no more than BLOCK_SCORES of them (or 4 k rows) are scored at a time, and no hit is lost."""
    import numpy as np
    import pyarrow as pa

    from siltstone.operators import annindex as ann
    from siltstone.operators import nearest

    rng = np.random.default_rng(2)
    rows, asked = rng.normal(size=(3000, 8)), rng.normal(size=(50, 8))
    lists = ann.Lists(np.zeros((1, 8)), metric, 8, float(np.linalg.norm(rows, axis=1).max()))
    if metric == "IP":
        lists = ann.Lists(np.zeros((1, 9)), metric, 8, lists.longest)
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(rows.tolist())], ["id", "embedding"])
    (coded,) = ann._assigned(iter([batch]), lists)
    coded = coded.select(["id", "list_id", "code", "step", "error", "length"])
    queries = nearest.Queries(pa.table({"q": pa.array(range(50)), "v": pa.array(asked.tolist())}))
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("list_id", pa.int32()), ("low", pa.float64()), ("high", pa.float64())])
    sizes, bounds = [], ann._bounds
    monkeypatch.setattr(nearest, "BLOCK_SCORES", 5000)
    monkeypatch.setattr(ann, "_bounds", lambda *a: sizes.append(len(a[1]) * len(a[3])) or bounds(*a))
    found = {(q, i) for b in ann._candidates(iter([coded]), queries, lists, 5, 1, schema) for q, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
    assert max(sizes) <= 5000 and sum(sizes) == 50 * 3000
    for q in range(50):
        score = nearest.exact_scores(metric, np.repeat(asked[q : q + 1], 3000, axis=0), rows)
        assert {(q, int(i)) for i in np.argsort(-score)[:5]} <= found
