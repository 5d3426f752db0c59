import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from siltstone.operators import evaluation as ev
from siltstone.operators import mutations
from siltstone.operators import indexing as ix
from siltstone.operators import lifecycle as lc
from siltstone.operators import retrieval as r
from siltstone.operators.registry import Hooks, Registry, only, traced, wrapped


def test_embedding(spark):
    df = spark.createDataFrame([(k, f"word{k} x") for k in range(70)] + [(99, None)], "id long, t string").coalesce(1)
    calls = []
    embedder = ix.hash_embedder(4)
    out = ix.embed(df, "t", embedder, 4).collect()
    assert len(out) == 71 and all(len(x.embedding) == 4 for x in out) and list(out[-1].embedding) == [0.0] * 4
    assert embedder(["A b"]) == embedder(["b a"]) and calls == []
    for bad in (lambda ts: embedder(ts)[1:], lambda ts: [v[:3] for v in embedder(ts)]):
        with pytest.raises(PySparkException):
            ix.embed(df, "t", bad, 4).collect()


def test_the_embedder_digests_a_term_once(monkeypatch):
    import hashlib

    calls, md5 = [], hashlib.md5
    monkeypatch.setattr(ix.hashlib, "md5", lambda x: calls.append(x) or md5(x))
    embedder = ix.hash_embedder(16)
    once = embedder(["a b a", "", "b " * 50])
    assert sorted(calls) == [b"a", b"b"] and once[1] == [0.0] * 16 and abs(sum(x * x for x in once[0]) - 1) < 1e-12
    monkeypatch.setattr(ix, "KNOWN_TERMS", 1)
    assert ix.hash_embedder(16)(["a b a", "", "b " * 50]) == once


def test_collections(spark):
    ix.ensure_collection(spark, "vecs_t", 4)
    ix.ensure_collection(spark, "vecs_t", 4)
    for name, dims in (("vecs_t", 5), ("1bad", 4), ("bad-name", 4)):
        with pytest.raises(ValueError):
            ix.ensure_collection(spark, name, dims)
    spark.sql("DROP TABLE vecs_t")


def counts(spark, stores):
    return {"chunks": stores.read(spark, "chunks").count(), "vectors": stores.read(spark, "vectors").count(), "terms": stores.terms(spark).count(), "documents": stores.read(spark, "documents").count()}


def true_statistics(spark, stores):
    terms, chunks = stores.terms(spark), stores.read(spark, "chunks")
    df = {(r.field, r.term): r["count"] for r in terms.groupBy("field", "term").count().collect()}
    total = {(r.field, None): r.n for r in terms.groupBy("field").agg(F.sum("tf").alias("n")).collect()}
    return df, total, chunks.count()


def test_index_and_search(spark, tmp_path, monkeypatch):
    stores = ix.Stores(f"file://{tmp_path}/index")
    make = lambda *rows: spark.createDataFrame(list(rows), "id long, title string, text string")
    docs = make((1, "one", "# A\nalpha beta"), (2, "two", "gamma " * 300), *[(k, "more", f"word{k}") for k in range(10, 30)])
    embedder = ix.hash_embedder(16)
    assert ix.index_documents(docs, stores, embedder, 16, "hash") == {"chunks": 23, "embedded": 23}
    first = counts(spark, stores)
    assert first == {"chunks": 23, "vectors": 23, "terms": 49, "documents": 22}
    assert ix.index_documents(docs, stores, embedder, 16, "hash") == {"chunks": 23, "embedded": 0}
    assert counts(spark, stores) == first
    before = set((tmp_path / "index").rglob("*.parquet"))
    ix.index_documents(make((2, "two", "delta")), stores, embedder, 16, "hash")
    assert counts(spark, stores) == {"chunks": 22, "vectors": 22, "terms": 46, "documents": 22}  # nothing stale anywhere
    assert before <= set((tmp_path / "index").rglob("*.parquet"))  # and nothing of others written
    assert stores.terms(spark).where("term = 'gamma'").count() == 0
    queries = spark.createDataFrame([(1, " delta ", [float(x) for x in embedder(["delta"])[0]])], "query_id long, query string, vector array<double>")
    for _ in range(2):
        hits = ix.search_index(spark, stores, queries, 16).orderBy("rank").collect()
        assert hits[0].content == "delta" and hits[0].id == "2#0"
        assert [x.id for x in ix.search_index(spark, stores, queries, 16, vectors=False).collect()] == ["2#0"]
        df, total, chunks = true_statistics(spark, stores)
        kept = {(r.field, r.term): (r.n, r.total) for r in stores.segments().every(spark, "statistics").groupBy("field", "term").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).where("n <> 0").collect()}
        assert {k: v[0] for k, v in kept.items() if k[1]} == df and {k: v[1] for k, v in kept.items() if not k[1]} == total and all(v[0] == chunks for k, v in kept.items() if not k[1])
        state = counts(spark, stores)
        stores.compact(spark)
        assert counts(spark, stores) == state
    # A failure between the stores leaves the state before readable, and the next run clears what is left of it.
    put = ix.Segments.put

    def fails(self, rows, name, *rest, **options):
        if name == "vectors":
            raise OSError("disk")
        put(self, rows, name, *rest, **options)

    monkeypatch.setattr(ix.Segments, "put", fails)
    with pytest.raises(OSError, match="disk"):
        ix.index_documents(make((2, "two", "epsilon")), stores, embedder, 16, "hash")
    monkeypatch.undo()
    assert counts(spark, stores) == state and [x.id for x in ix.search_index(spark, stores, queries, 16, vectors=False).collect()] == ["2#0"]
    for gone in ("", None):
        ix.index_documents(make(*[(k, "t", gone) for k in (1, 2, *range(10, 30))]), stores, embedder, 16, "hash")
        assert counts(spark, stores) == {"chunks": 0, "vectors": 0, "terms": 0, "documents": 22}
        assert ix.search_index(spark, stores, queries, 16).count() == 0
        ix.index_documents(docs, stores, embedder, 16, "hash")
        assert counts(spark, stores) == first
    with pytest.raises(PySparkException):
        ix.index_documents(make((0, "t", "x")), stores, embedder, 16, "hash")
    assert counts(spark, stores) == first


def test_block_search_equals_bm25(spark, tmp_path, monkeypatch):
    import random

    from siltstone.operators import postings

    monkeypatch.setattr(postings, "BLOCK", 4)
    rng = random.Random(5)
    words = [f"w{min(rng.randrange(40), rng.randrange(40))}" for _ in range(4000)]
    text = lambda: " ".join(rng.choices(words, k=rng.randrange(1, 60)))
    rows = [(k, rng.choice(["w1 title", "other", None]), text(), rng.choice(["private", "system"])) for k in range(1, 300)]
    docs = spark.createDataFrame(rows, "id long, title string, text string, visibility string").repartition(3)
    stores = ix.Stores(f"file://{tmp_path}/index")
    ix.index_documents(docs, stores, ix.hash_embedder(4), 4, "hash")
    new = [(k, "w2", text(), "private") for k in range(1, 300, 7)]
    ix.index_documents(spark.createDataFrame(new, docs.schema), stores, ix.hash_embedder(4), 4, "hash")
    last = {r[0]: r for r in rows} | {r[0]: r for r in new}
    asked = [(k, " ".join(rng.choices(words, k=rng.randrange(1, 6)))) for k in range(12)] + [(20, "w0 w1"), (21, "w0 w1"), (22, "nowhere")]
    queries = spark.createDataFrame(asked, "query_id long, query string")
    state = spark.createDataFrame([(f"{k}#0", t, x, v) for k, t, x, v in last.values()], "id string, title string, content string, visibility string")
    for small in (False, True):
        if small:
            monkeypatch.setattr(postings, "PUSHED_TERMS", 0)
            monkeypatch.setattr(postings, "BROADCAST_ROWS", 0)
        got = {tuple(x) for x in ix.search_index(spark, stores, queries, 4, r.Options(top_k=2), vectors=False).collect()}
        assert got == {tuple(x) for x in r.bm25(state, queries, ["content", "title"], 8).collect()}
    # Within a filter, hits are those of the whole index that it holds for.
    private = {x.id for x in state.where("visibility = 'private'").collect()}
    every = sorted((x for x in r.bm25(state, queries, ["content", "title"], 1000).collect() if x.id in private), key=lambda x: (x.query_id, x.rank))
    want, seen = set(), {}
    for x in every:
        seen[x.query_id] = seen.get(x.query_id, 0) + 1
        if seen[x.query_id] <= 8:
            want.add((x.query_id, x.id, x.score, seen[x.query_id]))
    assert {tuple(x) for x in ix.search_index(spark, stores, queries, 4, r.Options(top_k=2), vectors=False, where=F.col("visibility") == "private").collect()} == want


def test_a_search_skips_blocks(spark, tmp_path, monkeypatch):
    """Of a frequent term's blocks only the first are read, when a rare term decides; of other terms none."""
    from siltstone.operators import postings

    monkeypatch.setattr(postings, "BLOCK", 8)
    docs = spark.range(1, 2001).select("id", F.lit(None).cast("string").alias("title"), F.concat(F.when(F.col("id") <= 4, F.lit("rare common common common ")).otherwise(F.lit("common ")), F.repeat(F.lit("filler "), F.when(F.col("id") <= 4, 4).otherwise((F.col("id") % 7 + 6)).cast("int")), F.concat(F.lit("x"), "id")).alias("text"))
    stores = ix.Stores(f"file://{tmp_path}/index")
    ix.index_documents(docs, stores, ix.hash_embedder(4), 4, "hash")
    opened, counted = postings.opened, []
    monkeypatch.setattr(postings, "opened", lambda df: counted.append(df.count()) or opened(df))
    queries = spark.createDataFrame([(1, "rare common")], "query_id long, query string")
    assert len(ix.search_index(spark, stores, queries, 4, r.Options(top_k=1), vectors=False).collect()) == 4
    every = stores.segments().every(spark, "postings").where("term = 'common'").count()
    assert every >= 200 and max(counted) < every / 10
    scan = stores.segments().every(spark, "postings").where(F.col("term") == "rare")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,rare)" in scan


def test_evaluation(spark):
    hits = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "query_id long, id string, rank int")
    relevant = spark.createDataFrame([(1, "a"), (1, "z"), (2, "c")], "query_id long, id string")
    row = ev.report(hits, relevant, 2).first()
    assert row.recall_at_2 == 0.75 and row.queries == 2
    asked = spark.createDataFrame([(1, True), (2, False), (3, False), (4, True)], "query_id long, answerable boolean")
    assert ev.no_answer_accuracy(hits, asked).first()[0] == 0.5
    docs = spark.createDataFrame([("a", 1), ("b", 2)], "id string, dataset_id long")
    leaks = ev.acl_leaks(hits.withColumn("subject", F.lit("ann")), docs, spark.createDataFrame([("ann", 1)], "subject string, dataset_id long"))
    assert [x.id for x in leaks.collect()] == ["b"]


def test_sketches_and_histograms_merge(spark):
    rows = spark.range(20000).select((F.col("id") % 2).alias("route"), (F.col("id") % 7).alias("day"), F.when(F.col("id") % 100 != 99, (F.col("id") * 7919 % 20011).cast("double")).alias("millis"))
    windows = ev.sketches(rows, "route", "day")
    assert windows.count() == 14 and windows.select(F.max(F.length("sketch"))).first()[0] < 20000
    for r in ev.merged_quantiles(windows, (0.05, 0.5, 0.95), "route").collect():
        mine = sorted(x.millis for x in rows.where((F.col("route") == r.route) & F.col("millis").isNotNull()).collect())
        assert r.n == len(mine) and r.peak == mine[-1]
        for share, q in zip((0.05, 0.5, 0.95), r.quantiles, strict=True):
            assert abs(sum(x <= q for x in mine) / len(mine) - share) <= ev.RANK_ERROR
    parts = ev.histogram(rows, (0.0, 100.0, 10000.0), "route", "day")
    merged = {(r.route, r.le): (r.n, r.total) for r in ev.merged_histogram(parts, "route").collect()}
    whole = {(r.route, r.le): (r.n, r.total) for r in ev.histogram(rows, (0.0, 100.0, 10000.0), "route").collect()}
    assert merged == whole and len(whole) == 8 and whole[(1, float("inf"))][0] == rows.where("route = 1 AND millis IS NOT NULL").count()
    assert all(merged[(k, 100.0)][0] <= merged[(k, 10000.0)][0] <= merged[(k, float("inf"))][0] for k in (0, 1))
    nothing = rows.where("millis IS NULL")
    assert ev.merged_quantiles(ev.sketches(nothing, "route"), (0.5,), "route").count() == ev.histogram(nothing, (1.0,), "route").count() == 0


def test_writes_count_in_one_pass(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def seen(x):
        calls.add(1)
        return x

    over = sum(k % 3 != 0 and k > 50 for k in range(100))
    noted = F.udf(seen, "long").asNondeterministic()
    rows = spark.range(0, 100, 1, 4).select(noted("id").alias("id"), (F.col("id") % 10).alias("kind"), F.when(F.col("id") % 3 != 0, F.col("id")).alias("maybe"))
    for name, change, touched, left in (
        ("u", mutations.update(rows, F.col("maybe") > 50, kind=99), over, 100), ("d", mutations.delete(rows, F.col("maybe") > 50), over, 100 - over),
        ("none", mutations.delete(rows, F.lit(None).cast("boolean")), 0, 100),
    ):
        calls.value = 0
        assert change.write(f"file://{tmp_path}/{name}") == touched and calls.value == 100
        assert spark.read.parquet(f"file://{tmp_path}/{name}").count() == left and change.count() == touched
    assert mutations.update(rows.limit(0), F.col("kind") == 1, kind=2).write(f"file://{tmp_path}/empty") == 0
    assert mutations.delete(spark.createDataFrame([], "id long"), F.col("id") == 1).write(f"file://{tmp_path}/empty2") == 0
    fresh = mutations.insert(spark.range(3), spark.range(3, 5))
    assert fresh.write(f"file://{tmp_path}/i") == 2 and spark.read.parquet(f"file://{tmp_path}/i").count() == 5


def test_registry_and_hooks(spark):
    reg, log = Registry(), []
    reg.register("head", lambda df: df.limit(1))
    with pytest.raises(ValueError):
        reg.register("head", lambda df: df)
    with pytest.raises(KeyError):
        reg.require("tail")
    assert reg.get("tail") is None and reg.names() == ["head"]
    df = spark.range(3)
    assert wrapped("head", reg.require("head"), only("head"), traced(log))(df).count() == 1 and log[0][0] == "head"
    with pytest.raises(PermissionError):
        wrapped("head", reg.require("head"), only("other"))(df)
    hooks = Hooks().on("t", "id is negative", F.col("id") >= 0).reject("locked")
    assert hooks.apply("t", df).count() == 3 and hooks.apply("other", df).count() == 3
    for table, rows in (("locked", df), ("t", df.select((-F.col("id")).alias("id")))):
        with pytest.raises(PySparkException):
            hooks.apply(table, rows).collect()


def test_runs(spark):
    import datetime as dt

    now = F.lit(dt.datetime(2026, 1, 1))
    runs = spark.createDataFrame([(1, "RUNNING", "ann", "c", None, None, None), (2, "COMPLETED", "ann", "c", None, None, None), (3, "RESUMING", "ann", "c", None, None, None), (4, "RUNNING", "ann", None, None, None, None)], "id long, status string, requested_by string, checkpoint_id string, approval_id string, error_code string, updated_at timestamp")
    stopped = lc.interrupt_runs(runs, F.col("id") < 4, F.lit("a"), now).state
    assert {(x.id, x.status, x.approval_id) for x in stopped.collect()} == {(1, "INTERRUPTED", "a"), (2, "COMPLETED", None), (3, "RESUMING", None), (4, "RUNNING", None)}
    assert lc.claim_runs(lc.interrupt_runs(runs, F.col("id") == 4, F.lit("a"), now).state, F.lit(True), F.lit("ann"), now).count() == 0  # no checkpoint
    stopped = stopped.where("id < 3")
    assert lc.claim_runs(stopped, F.lit(True), F.lit("eve"), now).count() == 0
    taken = lc.claim_runs(stopped, F.lit(True), F.lit("ann"), now)
    assert taken.count() == 1 and lc.claim_runs(taken.state, F.lit(True), F.lit("ann"), now).count() == 0
    assert lc.release_runs(taken.state, F.lit(True), now).count() == 1
    done = lc.finish_runs(taken.state, F.lit(True), now, "boom").state
    assert sorted((x.id, x.status, x.error_code) for x in done.collect()) == [(1, "FAILED", "boom"), (2, "COMPLETED", None)]
