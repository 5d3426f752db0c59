"""Queries of the relational layer over region, nation, customer, supplier, orders and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone import schema
from siltstone.operators.relational import Edge, NotFound, NotSingular, P, Schema, any_of, differences, newest, none_of, numbered_page, ordering, tree_faults, tree_paths
from siltstone.runtime import table


def _schema(spark, d) -> Schema:
    t = lambda n: table(spark, d, n)
    return Schema(
        {
            "regions": t("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")),
            "nations": t("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region_id")),
            "customers": t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation_id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")),
            "orders": t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"), F.col("o_orderdate").alias("at"), F.col("o_orderpriority").alias("priority")),
            "documents": schema.documents(spark, d).withColumn("owner", F.when(F.col("id") % 7 != 0, F.col("owner_subject"))),
        },
        {
            "regions": {"nations": Edge("nations", "id", "region_id")},
            "nations": {"region": Edge("regions", "region_id", "id", True), "customers": Edge("customers", "id", "nation_id")},
            "customers": {"nation": Edge("nations", "nation_id", "id", True), "orders": Edge("orders", "id", "customer_id")},
            "orders": {"customer": Edge("customers", "customer_id", "id", True)},
        },
    )


def _of(name, build):
    return lambda spark, d: build(_schema(spark, d).query(name))


def _folders(spark, d):
    """Regions over nations over customers as one tree."""
    s = _schema(spark, d).tables
    roots = s["regions"].select(F.col("id").cast("bigint"), F.lit(None).cast("bigint").alias("parent_id"), "name")
    middle = s["nations"].select((F.col("id") + 1000).cast("bigint").alias("id"), F.col("region_id").cast("bigint").alias("parent_id"), "name")
    leaves = s["customers"].select((F.col("id") + 1_000_000).alias("id"), (F.col("nation_id") + 1000).cast("bigint").alias("parent_id"), "name")
    return roots.unionByName(middle).unionByName(leaves)


_FOLDERS = """SELECT r_regionkey::BIGINT AS id, NULL::BIGINT AS parent_id, r_name AS name FROM region
  UNION ALL SELECT n_nationkey + 1000, n_regionkey, n_name FROM nation UNION ALL SELECT c_custkey + 1000000, c_nationkey + 1000, c_name FROM customer"""


def _chains(spark, d):
    """Customers as chains of a hundred folders, each below the one before; the last of every tenth chain is below itself."""
    key = F.col("c_custkey")
    parent = F.when(key % 1000 == 599, key).when(key % 100 != 0, key - 1)
    return table(spark, d, "customer").select(key.alias("id"), parent.alias("parent_id"), (key % 10).cast("string").alias("name"))


def _page(number, size):
    return lambda spark, d: numbered_page(_schema(spark, d).tables["orders"].select("id", "status"), number, size, "id")


def _past_end(spark, d, size=50):
    """A page past the last one, however many orders there are."""
    pages = -(-table(spark, d, "orders").count() // size)
    return _page(max(100_000, pages + 1), size)(spark, d)


def newest_n_history(spark, d):
    return newest(table(spark, d, "conversations"), "conv_id", 2, "turn").select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


def exist_flags(spark, d):
    orders = _schema(spark, d).query("orders")
    return spark.createDataFrame([(s, orders.where(P("status").eq(s)).exists()) for s in ("X", "P")], "status string, found boolean")


def first_only(spark, d):
    """The first row of an order, the one row of an id, and what other numbers of rows give."""
    orders = _schema(spark, d).query("orders")
    last = orders.aggregate(id=F.max("id")).first()["id"]
    rows = [("first", orders.where(P("status").eq("P")).order(ordering("at"), ordering("id")).first()["id"]), ("only", orders.where(P("id").eq(last)).only()["id"])]
    for how, call, error, sign in (("only of many", orders.only, NotSingular, -1), ("first of none", orders.where(P("status").eq("X")).first, NotFound, -2)):
        try:
            call()
        except error:
            rows.append((how, sign))
    return spark.createDataFrame(rows, "how string, id bigint")


def intercepted_queries(spark, d):
    """Rows that an interceptor hides are hidden from queries of their table and of its neighbours."""
    s = _schema(spark, d)
    s.interceptors["orders"] = [lambda df: df.where(P("status").neq("F")), lambda df: df.where(P("total").lt(200000.0))]
    counted = s.query("customers").has("orders").neighbour_count("orders", "orders").df
    return counted.select("id", "orders").unionByName(s.query("orders").aggregate(id=F.lit(-1).cast("bigint"), orders=F.count("*")))


def status_difference(spark, d):
    o = table(spark, d, "orders")
    return differences(o.where("o_orderkey % 2 = 0").select("o_orderstatus", "o_orderpriority"), o.where("o_orderkey % 2 = 1").select("o_orderstatus", "o_orderpriority")).groupBy("o_orderstatus", "o_orderpriority", "missing_from").agg(F.count("*").alias("n"))


def granted_datasets(spark, d):
    """Suppliers' nations as grants, joined to the regions they open."""
    s = _schema(spark, d).tables
    grants = table(spark, d, "supplier").select(F.col("s_name").alias("subject"), F.col("s_nationkey").alias("dataset_id"))
    return grants.join(s["nations"], F.col("dataset_id") == F.col("id")).select("subject", "dataset_id", F.col("name").alias("dataset"))


_N = "SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region_id FROM nation"
_D = f"SELECT *, CASE WHEN id % 7 <> 0 THEN owner_subject END AS owner FROM ({schema.DOCUMENTS_SQL})"
_O = "SELECT o_orderkey AS id, o_custkey AS customer_id, o_orderstatus AS status, o_totalprice AS total, o_orderdate AS at_, o_orderpriority AS priority FROM orders"
_C = "SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation_id, c_acctbal AS balance, c_mktsegment AS segment FROM customer"

#: name -> (query, oracle)
_ALL = {
    "pred_eq_in": (_of("orders", lambda q: q.where(P("status").eq("O"), P("priority").isin("1-URGENT", "2-HIGH"), P("customer_id").notin(1, 2, 3)).select("id", "customer_id")),
        f"SELECT id, customer_id FROM ({_O}) WHERE status = 'O' AND priority IN ('1-URGENT', '2-HIGH') AND customer_id NOT IN (1, 2, 3)"),
    "pred_range": (_of("orders", lambda q: q.where(P("total").gte(100000.0), P("total").lt(200000.0), P("id").gt(10), P("status").lte("O"), P("status").neq("F")).select("id", "total")),
        f"SELECT id, total FROM ({_O}) WHERE total >= 100000 AND total < 200000 AND id > 10 AND status <= 'O' AND status <> 'F'"),
    "pred_string_match": (_of("documents", lambda q: q.where(any_of(P("text").contains("the tion"), P("title").has_prefix("src1-"), P("title").has_suffix("99"))).select("id", "title")),
        f"SELECT id, title FROM ({_D}) WHERE contains(text, 'the tion') OR starts_with(title, 'src1-') OR ends_with(title, '99')"),
    "pred_fold": (_of("documents", lambda q: q.where(any_of(P("lang").equal_fold("EN"), P("text").contains_fold("LICENSE"))).select("id", "lang")),
        f"SELECT id, lang FROM ({_D}) WHERE lower(lang) = 'en' OR contains(lower(text), 'license')"),
    "pred_null": (_of("documents", lambda q: q.where(any_of(P("owner").is_nil(), P("owner").neq("src3") & P("owner").not_nil() & P("id").lt(50))).select("id", "owner")),
        f"SELECT id, owner FROM ({_D}) WHERE owner IS NULL OR (owner <> 'src3' AND owner IS NOT NULL AND id < 50)"),
    "pred_bool_tree": (_of("documents", lambda q: q.where(none_of(any_of(P("owner").eq("src1"), P("lang").eq("en") & P("n_chars").gt(500)))).select("id", "lang", "owner")),
        f"SELECT id, lang, owner FROM ({_D}) WHERE NOT (owner = 'src1' OR (lang = 'en' AND n_chars > 500))"),
    "select_distinct": (_of("customers", lambda q: q.select_unique("segment", "nation_id")), f"SELECT DISTINCT segment, nation_id FROM ({_C})"),
    "has_edge": (_of("customers", lambda q: q.has("orders").select("id", "name")), f"SELECT id, name FROM ({_C}) c WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.id)"),
    "not_has_edge": (_of("customers", lambda q: q.has_not("orders").select("id", "name")), f"SELECT id, name FROM ({_C}) c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.id)"),
    "has_edge_with": (_of("customers", lambda q: q.has("orders", P("status").eq("P"), P("total").gt(100000.0)).has_not("orders", P("priority").eq("1-URGENT")).select("id")),
        f"SELECT id FROM ({_C}) c WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.id AND o_orderstatus = 'P' AND o_totalprice > 100000) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.id AND o_orderpriority = '1-URGENT')"),
    "traverse_o2m": (_of("regions", lambda q: q.where(P("name").eq("ASIA")).traverse("nations").traverse("customers").select("id", "nation_id")),
        f"SELECT id, nation_id FROM ({_C}) WHERE nation_id IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')"),
    "traverse_m2o_distinct": (_of("customers", lambda q: q.where(P("balance").lt(-500.0)).traverse("nation").traverse("region").select("id", "name")),
        "SELECT DISTINCT r_regionkey AS id, r_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal < -500"),
    "eager_load": (_of("regions", lambda q: q.load("nations", "nations", ["name"], P("name").lt("I")).df.select("id", F.array_join("nations.name", ",").alias("nations"), F.size("nations").alias("n"))),
        "SELECT r_regionkey AS id, coalesce(string_agg(n_name, ',' ORDER BY n_name), '') AS nations, count(n_name)::INTEGER AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_name < 'I' GROUP BY 1"),
    "eager_load_counts": (_of("nations", lambda q: q.load("region", "region", ["name"]).neighbour_count("customers", "customers").df.select("id", F.col("region.name").alias("region"), "customers")),
        f"SELECT n.id, r_name AS region, (SELECT count(*) FROM customer WHERE c_nationkey = n.id) AS customers FROM ({_N}) n LEFT JOIN region ON r_regionkey = region_id"),
    "folder_tree_paths": (lambda s, d: tree_paths(_folders(s, d)),
        f"WITH RECURSIVE f AS ({_FOLDERS}), t AS (SELECT id, name AS path, 0 AS depth FROM f WHERE parent_id IS NULL UNION ALL SELECT f.id, t.path || '/' || f.name, t.depth + 1 FROM f JOIN t ON f.parent_id = t.id) SELECT * FROM t"),
    "folder_chains": (lambda s, d: tree_paths(_chains(s, d)).unionByName(tree_faults(_chains(s, d)).select("id", F.col("fault").alias("path"), F.lit(-1).alias("depth"))),
        """SELECT c_custkey AS id, CASE WHEN c_custkey % 1000 = 599 THEN 'cycle' ELSE array_to_string(list_transform(range(c_custkey // 100 * 100, c_custkey + 1), lambda k: (k % 10)::VARCHAR), '/') END AS path,
        CASE WHEN c_custkey % 1000 = 599 THEN -1 ELSE (c_custkey % 100)::INTEGER END AS depth FROM customer"""),
    "granted_datasets": (granted_datasets, "SELECT s_name AS subject, s_nationkey AS dataset_id, n_name AS dataset FROM supplier JOIN nation ON s_nationkey = n_nationkey"),
    "group_count": (_of("orders", lambda q: q.group_by("status", "priority").aggregate(n=F.count("*"))), f"SELECT status, priority, count(*) AS n FROM ({_O}) GROUP BY ALL"),
    "group_min_max_mean_sum": (_of("orders", lambda q: q.group_by("priority").aggregate(lo=F.min("total"), hi=F.max("total"), mean=F.round(F.avg("total"), 4), sum=F.round(F.sum("total"), 2), ids=F.sum("id"))),
        f"SELECT priority, min(total) AS lo, max(total) AS hi, round(avg(total), 4) AS mean, round(sum(total), 2) AS sum, sum(id)::BIGINT AS ids FROM ({_O}) GROUP BY priority"),
    "global_agg": (_of("orders", lambda q: q.aggregate(n=F.count("*"), customers=F.countDistinct("customer_id"), last=F.max("at"))), f"SELECT count(*) AS n, count(DISTINCT customer_id) AS customers, max(at_) AS last FROM ({_O})"),
    "exist_flag": (exist_flags, "SELECT s AS status, EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = s) AS found FROM (VALUES ('X'), ('P')) t(s)"),
    "order_multi": (_of("customers", lambda q: q.order(ordering("segment"), ordering("balance", "DESC"), ordering("id")).limit(20).select("id", "segment", "balance")),
        f"SELECT id, segment, balance FROM ({_C}) ORDER BY segment, balance DESC NULLS FIRST, id LIMIT 20"),
    "order_by_neighbor_count": (_of("customers", lambda q: q.neighbour_count("orders", "n").order(F.col("n").desc(), F.col("id")).limit(15).select("id", "n")),
        f"SELECT id, (SELECT count(*) FROM orders WHERE o_custkey = c.id) AS n FROM ({_C}) c ORDER BY n DESC, id LIMIT 15"),
    "order_by_neighbor_field": (_of("customers", lambda q: q.neighbour_field("nation", "name", "nation").order(ordering("nation"), ordering("id", "DESC")).limit(25).select("id", "nation")),
        f"SELECT c.id, n.name AS nation FROM ({_C}) c JOIN ({_N}) n ON n.id = nation_id ORDER BY nation, c.id DESC LIMIT 25"),
    "page_2_desc_id": (_page(2, 50), f"SELECT id, status, (SELECT count(*) FROM orders) AS total, 2 AS page, 50 AS size FROM ({_O}) ORDER BY id DESC LIMIT 50 OFFSET 50"),
    "page_deep": (_page(250, 50), f"SELECT id, status, (SELECT count(*) FROM orders) AS total, 250 AS page, 50 AS size FROM ({_O}) ORDER BY id DESC LIMIT 50 OFFSET 12450"),
    "page_past_end": (_past_end, "SELECT o_orderkey AS id, o_orderstatus AS status, 0::BIGINT AS total, 1 AS page, 50 AS size FROM orders WHERE false"),
    "first_only": (first_only, f"""SELECT 'first' AS how, id FROM (SELECT id FROM ({_O}) WHERE status = 'P' ORDER BY at_, id LIMIT 1) UNION ALL SELECT 'only', max(id) FROM ({_O})
        UNION ALL SELECT 'only of many', -1 UNION ALL SELECT 'first of none', -2"""),
    "edge_pairs": (_of("nations", lambda q: q.pairs("customers", ["name", "segment"], P("balance").gt(0.0))), f"SELECT nation_id AS id, name, segment FROM ({_C}) WHERE balance > 0"),
    "intercepted_queries": (intercepted_queries, """WITH o AS (SELECT * FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice < 200000)
        SELECT o_custkey AS id, count(*) AS orders FROM o JOIN customer ON c_custkey = o_custkey GROUP BY 1 UNION ALL SELECT -1, count(*) FROM o"""),
    "newest_n_history": (newest_n_history, "SELECT conv_id, turn, role, md5(text) AS text_md5 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 2"),
    "status_difference": (status_difference, """WITH a AS (SELECT o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 2 = 1)
        SELECT o_orderstatus, o_orderpriority, missing_from, count(*) AS n FROM (SELECT *, 'got' AS missing_from FROM (FROM a EXCEPT ALL FROM b) UNION ALL SELECT *, 'want' AS missing_from FROM (FROM b EXCEPT ALL FROM a)) GROUP BY ALL"""),
    "grouping_sets": (lambda s, d: _schema(s, d).query("orders").df.cube("status", "priority").agg(F.count("*").alias("n")).where("n > 1"), f"SELECT status, priority, count(*) AS n FROM ({_O}) GROUP BY CUBE (status, priority) HAVING count(*) > 1"),
    "raw_sql": (lambda s, d: s.sql("SELECT status, count(*) AS n FROM {o} GROUP BY status", o=_schema(s, d).tables["orders"]), f"SELECT status, count(*) AS n FROM ({_O}) GROUP BY status"),
}
QUERIES = {name: q for name, (q, _) in _ALL.items()}
ORACLES = {name: sql for name, (_, sql) in _ALL.items()}
