import re

import pytest
from pyspark.sql import functions as F

from siltstone.operators import mutations as m
from siltstone.operators.relational import Edge, NotFound, NotSingular, P, Schema, differences, newest, ordering, tree_paths


@pytest.fixture(scope="module")
def store(spark):
    docs = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, None, None), (4, "d", 9), (5, "e", 2)], "id long, title string, dataset_id long")
    sets = spark.createDataFrame([(1, "one"), (2, "two"), (3, "three")], "id long, name string")
    return Schema({"docs": docs, "sets": sets}, {"docs": {"set": Edge("sets", "dataset_id", "id", True)}, "sets": {"docs": Edge("docs", "id", "dataset_id")}})


def ids(query):
    return sorted(r.id for r in query.df.select("id").collect())


def test_edges(store):
    assert ids(store.query("sets").has("docs")) == [1, 2]
    assert ids(store.query("sets").has_not("docs")) == [3]
    assert ids(store.query("sets").has("docs", P("title").eq("e"))) == [2]
    assert ids(store.query("docs").has_not("set")) == [3, 4]  # a null or dangling key has no neighbour
    assert ids(store.query("docs").where(P("id").lt(3)).traverse("set")) == [1]
    assert ids(store.query("sets").traverse("docs").where(P("title").not_nil())) == [1, 2, 5]
    loaded = {r.id: [x.title for x in r.docs] for r in store.query("sets").load("docs", "docs", ["title"]).df.collect()}
    assert loaded == {1: ["a", "b"], 2: ["e"], 3: []}
    assert {r.id: r.n for r in store.query("sets").neighbour_count("docs", "n").df.collect()} == {1: 2, 2: 1, 3: 0}


def test_three_valued_predicates(store):
    q = store.query("docs")
    assert ids(q.where(P("title").neq("a"))) == [2, 4, 5]
    assert ids(q.where(P("title").notin("a", "b"))) == [4, 5]
    assert ids(q.where(P("title").isin())) == [] and ids(q.where(P("title").notin())) == [1, 2, 3, 4, 5]
    assert ids(q.where(P("title").equal_fold("A"))) == [1] and ids(q.where(P("title").is_nil())) == [3]


def test_rows_and_pages(store):
    q = store.query("docs")
    assert q.count() == 5 and q.exists() and not q.where(F.lit(False)).exists()
    assert q.where(P("id").eq(2)).only().title == "b"
    with pytest.raises(NotFound):
        q.where(F.lit(False)).only()
    with pytest.raises(NotFound):
        q.where(F.lit(False)).first()
    with pytest.raises(NotSingular):
        q.only()
    page = q.page(2, 2)
    assert [r.id for r in page.rows.collect()] == [3, 2] and page.total == 5
    assert q.page(9, 2).rows.count() == 0 and q.page(9, 2).total == 5
    assert sorted(r.id for n in (1, 2, 3) for r in q.page(n, 2).rows.collect()) == [1, 2, 3, 4, 5]
    with pytest.raises(ValueError):
        q.page(0, 2)
    with pytest.raises(ValueError):
        ordering("id", "sideways")
    assert [r.id for r in q.order(ordering("title", "DESC"), ordering("id")).df.collect()] == [3, 5, 4, 2, 1]
    secured = Schema(store.tables, store.edges, {"docs": [lambda df: df.where("id > 3")]})
    assert ids(secured.query("docs")) == [4, 5]


def test_tree_newest_difference(spark):
    folders = spark.createDataFrame([(1, None, "r"), (2, 1, "a"), (3, 2, "b"), (4, 99, "lost")], "id long, parent_id long, name string")
    deep = spark.range(130).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"), F.col("id").cast("string").alias("name")).union(spark.createDataFrame([(500, 501, "x"), (501, 500, "y")], "id long, parent_id long, name string"))
    assert tree_paths(deep).agg(F.count("*"), F.max("depth")).first() == (130, 129)  # a cycle has no path
    assert {r.id: (r.path, r.depth) for r in tree_paths(folders).collect()} == {1: ("r", 0), 2: ("r/a", 1), 3: ("r/a/b", 2)}
    rows = spark.createDataFrame([(1, k) for k in range(3)], "s long, k long")
    assert sorted(r.k for r in newest(rows, "s", 2, "k").collect()) == [1, 2] and newest(rows, "s", 0, "k").count() == 3
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(1,), (3,)], "x int")
    assert sorted(map(tuple, differences(a, b).collect())) == [(1, "got"), (2, "got"), (3, "want")]


def test_paths_by_pointer_doubling(spark, monkeypatch):
    from siltstone.operators import relational

    rounds = []
    monkeypatch.setattr(relational, "cut", lambda df: rounds.append(1) or df.checkpoint())
    chain = spark.range(4096).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"), F.lit("x").alias("name"))
    assert tree_paths(chain).agg(F.count("*"), F.max("depth"), F.max(F.length("path"))).first() == (4096, 4095, 8191)
    assert len(rounds) <= 1 + 13
    rows = [(1, None, "r"), (2, 1, "a"), (2, 1, "again"), (3, 2, "below"), (4, 3, "deeper"), (5, 5, "self"), (6, 7, "p"), (7, 6, "q"), (8, 7, "tail"), (9, 1, None), (10, 99, "lost"), (None, 1, "no id"), (11, 9, "")]
    odd = spark.createDataFrame(rows, "id long, parent_id long, name string")
    assert {r.id: r.path for r in tree_paths(odd).collect()} == {1: "r", 9: "r", 11: "r/"}
    faults = {r.id: r.fault for r in relational.tree_faults(odd).collect()}
    assert faults == {2: "repeated", 3: "lost", 4: "lost", 5: "cycle", 6: "cycle", 7: "cycle", 8: "cycle", 10: "lost", None: "lost"}
    assert tree_paths(odd.where("false")).count() == 0


def test_deep_pages(spark, monkeypatch):
    from siltstone.operators import relational

    monkeypatch.setattr(relational, "SHALLOW", 5)
    keys = [k // 2 for k in range(60)] + [None] * 7
    df = spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "k long, n long")
    order = sorted((k for k in keys if k is not None), reverse=True) + [None] * 7
    for number in range(1, 13):
        got = relational.numbered_page(df, number, 6, "k").collect()
        assert [r.k for r in sorted(got, key=lambda r: (r.k is None, -(r.k or 0)))] == order[(number - 1) * 6 : number * 6] and {r.total for r in got} <= {67}
    many = spark.range(100_000).select(F.col("id").alias("k"))
    plan = relational.numbered_page(many, 1500, 50, "k")
    assert [r.k for r in plan.orderBy(F.desc("k")).collect()] == list(range(99_999 - 1499 * 50, 99_999 - 1500 * 50, -1))
    limits = [int(x) for x in re.findall(r"TakeOrderedAndProject\(limit=(\d+)", plan._jdf.queryExecution().executedPlan().toString())]
    assert limits and max(limits) < 20_000


def test_mutations(spark, store):
    docs = store.tables["docs"]
    change = m.update(docs, F.col("title") > "a", title="z")
    assert change.count() == 3 and sorted((r.id, r.title) for r in change.state.collect()) == [(1, "a"), (2, "z"), (3, None), (4, "z"), (5, "z")]
    assert sorted(r.id for r in m.delete(docs, F.col("title") > "a").state.collect()) == [1, 3]  # unknown keeps the row
    assert m.set_not_nil(docs, F.lit(True), title=None, dataset_id=7).state.where("title is null").count() == 1
    added = m.insert(docs, spark.createDataFrame([(9, None)], "id long, title string"), {"title": "new", "dataset_id": 4}, ("title",))
    assert added.count() == 1 and added.state.where("id = 9").first()[1:] == ("new", 4)
    with pytest.raises(Exception, match="title is required"):
        m.insert(docs, spark.createDataFrame([(9, None)], "id long, title string"), required=("title",)).state.collect()
    products = spark.createDataFrame([("P", "q", "x"), ("", "a", "y")], "product_id string, product_name string, content string")
    have = docs.where("title is not null").select("id", "title", F.lit("old").alias("text"))
    got = {r.title: (r.id, r.text) for r in m.upsert_documents(have, products).collect()}
    assert got == {"a": (1, "y"), "b": (2, "old"), "d": (4, "old"), "e": (5, "old"), "Pq": (6, "x")}
    m.replace_table(spark, docs, "swapped")
    m.replace_table(spark, docs.where("id = 1"), "swapped")
    assert spark.table("swapped").count() == 1
    spark.sql("DROP TABLE swapped")


def test_a_page_past_the_end_of_many_orders(spark, tmp_path):
    from siltstone.plans import relations

    spark.range(5_000_100).select(F.col("id").alias("o_orderkey"), F.lit("O").alias("o_orderstatus"), *[F.lit(0).alias(c) for c in ("o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")]).write.parquet(f"file://{tmp_path}/orders.parquet")
    for name in ("region", "nation", "customer", "documents"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"file://{tmp_path}/{name}.parquet")
    assert relations.QUERIES["page_past_end"](spark, f"file://{tmp_path}").count() == 0
