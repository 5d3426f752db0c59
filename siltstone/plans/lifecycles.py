"""Lifecycle and mutation queries: each returns the state after the step."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from siltstone import schema
from siltstone.operators import lifecycle as lc
from siltstone.operators import mutations as m
from siltstone.operators import retrieval as r
from siltstone.operators.relational import newest
from siltstone.runtime import cut, scratch, table

_NOW, _NOW_SQL = "1996-06-15 00:00:00", "TIMESTAMP '1996-06-15 00:00:00'"


def _now():
    return F.lit(_NOW).cast("timestamp")


def _approvals(spark, d):
    return schema.approvals(spark, d)


_COLS = ("id", "status", "expires_at", "decided_at")


def approval_expire(spark, d):
    return lc.expire(_approvals(spark, d), _now(), lc.BATCH).select(*_COLS)


def _written(spark, change):
    """The state as written, and how many rows were touched on the way."""
    path = scratch(spark, "change")
    touched = change.write(path)
    return spark.read.parquet(path).withColumn("affected", F.lit(touched).cast("long"))


def approval_decide(spark, d):
    change = lc.decide(_approvals(spark, d), F.col("id") % 3 != 0, F.col("id") % 2 == 0, "ann", _now())
    return _written(spark, change).select(*_COLS, "affected")


def approval_claim_release(spark, d):
    a = _approvals(spark, d).withColumns({"checkpoint_id": F.lit("c"), "interrupt_id": F.when(F.col("id") % 4 != 0, F.lit("i")), "run_id": F.lit("r"),
                                          "expires_at": F.when(F.col("id") % 7 != 0, F.col("expires_at"))})
    claimed = lc.claim(a, F.col("id") % 2 == 0, F.col("requester"), F.lit("1995-01-01").cast("timestamp")).state
    return lc.release(claimed, F.col("id") % 5 == 0).state.groupBy("status").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def approval_consume(spark, d):
    """Every approval is called once by id; every third call comes from another requester, every fifth for another tool."""
    a = _approvals(spark, d).withColumn("status", F.when(F.col("status") == "APPROVED", "RESUMING").otherwise(F.col("status")))
    calls = a.select("id", F.when(F.col("id") % 3 == 0, F.col("requester") + 1).otherwise(F.col("requester")).alias("requester"), F.when(F.col("id") % 5 == 0, "other").otherwise(F.col("tool")).alias("tool"))
    return lc.consume(a, calls, _now(), ("requester", "tool")).select("id", "status", "executed_at")


def approval_due(spark, d):
    return lc.due(_approvals(spark, d), _now())


def retention_delete(spark, d):
    return lc.delete_terminal(_approvals(spark, d), lc.before(_now(), lc.RETENTION_HOURS["approvals"]), lc.TERMINAL_APPROVALS, "decided_at").state.select(*_COLS)


def _all_expired(spark, d):
    return lc.transition(_approvals(spark, d), ("PENDING",), "EXPIRED", F.col("expires_at") < _now()).state


def retention_null_trap(spark, d):
    """Expired rows have no decided_at, so the faithful rule keeps them and the fixed one lets them go."""
    cutoff = lc.before(_now(), 168)
    kept = lambda name, fixed: lc.delete_terminal(_all_expired(spark, d), cutoff, lc.TERMINAL_APPROVALS, "decided_at", fixed).state.groupBy("status").agg(F.count("*").alias("n")).withColumn("rule", F.lit(name))
    return kept("faithful", None).unionByName(kept("fixed", "expires_at"))


def audit_timeline(spark, d):
    """Each user's events with the one before, and the seconds between."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.select("event_id", F.lag("event_type").over(w).alias("before"), F.coalesce(F.unix_millis("ts") - F.unix_millis(F.lag("ts").over(w)), F.lit(-1)).cast("bigint").alias("gap_ms"))


def audit_append(spark, d):
    """Rows for approvals that are decided and for new ones, with their secrets redacted; none for those that expire or whose arguments are refused."""
    before = _approvals(spark, d)
    key = F.col("s_suppkey")
    arguments = F.when(key % 7 == 0, F.lit("not JSON")).otherwise(F.format_string('{ "n": %s, "Api-Key": "k%s", "note": "token=t%s"}', key, key, key))
    requests = table(spark, d, "supplier").select((key + 10_000_000_000).alias("id"), F.col("s_nationkey").cast("bigint").alias("requester"), F.col("s_name").alias("tool"), arguments.alias("arguments"))
    decided = lc.decide(before, F.col("id") % 3 == 0, F.col("id") % 2 == 0, "ann", _now()).state
    expired = lc.transition(decided, ("PENDING",), "EXPIRED", F.col("expires_at") < _now()).state
    after = lc.create_approvals(expired, requests, _now())
    none = spark.createDataFrame([], "approval_id bigint, session_id string, tool string, payload string, actor_subject bigint, event_type string, created_at timestamp")
    return lc.audit(none, before, after, _now()).fillna("", ["session_id", "payload"])


def approval_refused(spark, d):
    """Requests by customers, of which some have arguments that are no JSON, too long or missing; the rest as approvals."""
    c, key = table(spark, d, "customer"), F.col("c_custkey")
    arguments = F.when(key % 5 == 0, F.concat(F.lit('"'), F.repeat(F.lit("x"), 100), F.lit('"'))).when(key % 5 == 1, F.lit("{} {")).when(key % 5 == 2, F.concat(F.lit('{"name": "'), "c_name", F.lit('"} {}'))).when(key % 5 == 3, F.format_string("[%s, 1.50]", key))
    requests = c.select(key.alias("id"), F.concat(F.lit("a"), key).alias("approval_id"), F.lit("shell").alias("tool"), F.col("c_mktsegment").alias("requester"), arguments.alias("arguments"))
    none = spark.createDataFrame([], "id bigint, approval_id string, status string, tool string, requester string, arguments_hash string, display_arguments string, created_at timestamp, expires_at timestamp")
    made = lc.create_approvals(none, requests, _now(), most=100).select("approval_id", F.col("status").alias("result"), F.col("arguments_hash").alias("detail"), "display_arguments")
    return made.unionByName(lc.refused_approvals(requests, 100).select("approval_id", F.lit("refused").alias("result"), F.col("error").alias("detail"), F.lit("").alias("display_arguments")))


def approval_checkpoint(spark, d):
    """Checkpoints attached to approvals by customers, twice; some have no interrupt."""
    none = F.lit(None).cast("string")
    a = _approvals(spark, d).withColumns({"checkpoint_id": F.when(F.col("id") % 5 == 0, F.lit("old")), "interrupt_id": none, "run_id": none})
    change = lc.attach_checkpoint(a, F.col("id") % 3 != 0, F.concat(F.lit("c"), "id"), F.when(F.col("id") % 4 == 0, "").otherwise(F.concat(F.lit("i"), "id")), F.concat(F.lit("r"), "id"))
    again = lc.attach_checkpoint(change.state, F.col("id") % 2 == 0, F.lit("late"), F.lit("late"), F.lit("late"))
    return again.state.select("id", "status", *[F.coalesce(c, F.lit("")).alias(c) for c in ("checkpoint_id", "interrupt_id", "run_id")])


def _turns(spark, d):
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "RUNNING").when(F.col("o_orderstatus") == "P", "INTERRUPTED").when(F.col("o_orderkey") % 2 == 0, "COMPLETED").otherwise("FAILED")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("session_id"), status.alias("status"), F.when(status == "COMPLETED", F.col("o_orderdate")).alias("completed_at"), F.lit(None).cast("string").alias("error"))


def turn_complete_once(spark, d):
    """Every third turn is completed, twice: one message each, none for turns already closed."""
    turns = _turns(spark, d)
    none = turns.select("session_id", F.lit("").alias("role"), F.lit("").alias("content"), _now().alias("created_at")).where("false")
    done = turns.where("id % 3 = 0").select("id", F.concat(F.lit("answer "), "id").alias("content"))
    turns, messages = lc.complete_turns(turns, none, done.unionByName(done), _now())
    turns, messages = lc.complete_turns(turns, messages, done, _now())
    states = turns.groupBy(F.col("status").alias("what")).agg(F.count("*").alias("n"), F.count("completed_at").alias("timed"))
    return states.unionByName(messages.groupBy(F.col("role").alias("what")).agg(F.count("*").alias("n"), F.countDistinct("content").alias("timed")))


def turn_retention(spark, d):
    """Turns after a batch of deletions, with those that went."""
    failed = lc.fail_turns(_turns(spark, d), F.col("id") % 4 == 1, "boom").state
    removed = lc.delete_terminal_turns(failed, lc.before(_now(), lc.RETENTION_HOURS["turns"]))
    kept = removed.state.select("id", "status", F.coalesce("error", F.lit("")).alias("error"))
    return kept.unionByName(removed.ids.select("id", F.lit("deleted").alias("status"), F.lit("").alias("error")))


def checkpoint_set(spark, d):
    p = table(spark, d, "part")
    have = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("checkpoint_id"), F.encode("p_name", "utf-8").alias("payload"), F.lit("1996-06-14").cast("timestamp").alias("expires_at"))
    new = p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("checkpoint_id"), F.encode("p_brand", "utf-8").alias("payload"))
    state = lc.set_checkpoints(have, new, _now())
    return lc.live_checkpoints(state, F.lit("1996-06-13").cast("timestamp")).select("checkpoint_id", F.md5("payload").alias("payload_md5"), "expires_at")


def checkpoint_retention(spark, d):
    """Checkpoints after a batch of deletions, with those that went."""
    have = table(spark, d, "part").select(F.col("p_partkey").alias("checkpoint_id"), F.encode("p_name", "utf-8").alias("payload"), (F.lit("1996-06-01").cast("timestamp") + F.make_dt_interval(F.col("p_size"))).alias("expires_at"))
    removed = lc.delete_expired_checkpoints(have, lc.before(_now(), lc.RETENTION_HOURS["checkpoints"]))
    return removed.state.select("checkpoint_id", F.lit("kept").alias("result")).unionByName(removed.ids.select("checkpoint_id", F.lit("deleted").alias("result")))


def session_history(spark, d):
    """Messages of every session whose owner asks for it (sessions of even ids), newest three each."""
    c = table(spark, d, "conversations")
    messages = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("session_id"), "role", "text", F.timestamp_seconds(F.col("turn")).alias("created_at"))
    sessions = c.select(F.col("conv_id").alias("id")).distinct().withColumn("owner", F.when(F.col("id") % 2 == 0, "ann").otherwise("bob"))
    own = lc.history(sessions, messages, F.col("id") >= 0, F.lit("ann"))
    return newest(own, "session_id", 3, "created_at", "id").select("id", "session_id", "role", F.length("text").alias("chars"))


def session_get_or_create(spark, d):
    c = table(spark, d, "conversations").select(F.concat(F.lit("s"), "conv_id").alias("session_id"), F.lit("ann").alias("owner")).distinct()
    have = c.where("session_id like '%3'").withColumn("created_at", F.lit("1996-01-01").cast("timestamp"))
    return lc.get_or_create_sessions(have, c, _now())


def grants_state(spark, d):
    """A grant, the same again, one to a disabled dataset, and a revocation."""
    data = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.when(F.col("n_nationkey") % 4 == 0, "DISABLED").otherwise("ACTIVE").alias("status"))
    grants = table(spark, d, "supplier").select(F.col("s_name").alias("subject"), F.col("s_nationkey").cast("bigint").alias("dataset_id"))
    for subject, dataset in (("new", 3), ("new", 3), ("new", 4), ("other", 5)):
        grants = lc.grant(grants, data, subject, dataset)
    return lc.revoke(grants, "other", 5).state


def orm_update(spark, d):
    a = _approvals(spark, d).withColumn("updated_at", F.col("expires_at"))
    change = m.set_not_nil(a, F.col("decided_at") > F.col("expires_at") - F.expr("INTERVAL 2 DAYS"), tool="changed", status=None)
    return m.update(change.state, F.col("status") == "PENDING", _now(), requester=F.col("requester") + 1).state.select("id", "tool", "status", "requester", "updated_at")


def orm_delete(spark, d):
    change = m.delete(_approvals(spark, d), ~(F.col("decided_at") < _now()))
    return _written(spark, change).select("id", "decided_at", "affected")


def orm_create_bulk(spark, d):
    have = table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit("system").alias("visibility"))
    rows = table(spark, d, "nation").select((F.col("n_nationkey") + 100).alias("id"), F.col("n_name").alias("name"))
    return schema.check_states(m.insert(have, rows, {"visibility": "private"}, ("name",)).state, "visibility", "datasets.visibility")


def vector_upsert(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    new = e.where("chunk_id % 3 = 0").select("chunk_id", F.transform("embedding", lambda x: -x).alias("embedding")).unionByName(e.where("chunk_id < 5").select((F.col("chunk_id") + 1_000_000).alias("chunk_id"), "embedding"))
    return r.upsert(e, r.validated(new.where("chunk_id > 0"), 64, "model"), "chunk_id").select("chunk_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


def vector_delete(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label")
    ids = e.where("label = 3 and chunk_id > 0").select("chunk_id")
    return r.delete(e, ids.unionByName(ids), "chunk_id")


def doc_upsert_by_title(spark, d):
    p = table(spark, d, "part")
    have = p.where("p_size <= 25").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.lit("old").alias("text"))
    have = have.groupBy("title").agg(F.min("id").alias("id"), F.first("text").alias("text")).select("id", "title", "text")
    products = p.where("p_size > 10").select(F.lit(None).cast("string").alias("product_id"), F.col("p_name").alias("product_name"), F.col("p_brand").alias("content"))
    return m.upsert_documents(have, products)


def table_replaced(spark, d):
    """A stored table gives way to a new state whole, twice."""
    name = f"replaced_{uuid.uuid4().hex[:12]}"
    have = table(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    new = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    try:
        m.replace_table(spark, have, name)
        m.replace_table(spark, m.upsert_by(spark.table(name), new.where("id > 2"), ["id"]).state, name)
        return cut(spark.table(name))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def vector_collection(spark, d):
    """A collection is made once, and refused under another dimension or a bad name."""
    from siltstone.operators.indexing import ensure_collection

    name, rows = f"vectors_{uuid.uuid4().hex[:12]}", []
    try:
        for case, dims in ((name, 64), (name, 64), (name, 32), (f"1{name}", 64)):
            try:
                ensure_collection(spark, case, dims)
                rows.append((len(rows), "ready"))
            except ValueError:
                rows.append((len(rows), "refused"))
        table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding").write.insertInto(name)
        rows.append((len(rows), str(spark.table(name).count())))
        return spark.createDataFrame(rows, "step int, result string")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def guarded_writes(spark, d):
    """Named operators behind an allow-list and a trace; rows that pass the hooks, per operator."""
    from siltstone.operators.registry import Hooks, Registry, only, traced, wrapped

    registry, log = Registry(), []
    registry.register("open", lambda df: df.where("status = 'PENDING'"))
    registry.register("closed", lambda df: df.where("status in ('REJECTED', 'EXECUTED')"))
    hooks = Hooks().on("approvals", "id is negative", F.col("id") >= 0).on(None, "status is missing", F.col("status").isNotNull())
    out = []
    for name in registry.names():
        try:
            rows = wrapped(name, registry.require(name), only("open"), traced(log))(_approvals(spark, d))
            out.append((name, hooks.apply("approvals", rows).count()))
        except PermissionError:
            out.append((name, -1))
    return spark.createDataFrame([*out, ("traced", len(log))], "operator string, n bigint")


def chunk_replace(spark, d):
    """Chunks of every tenth document are replaced by one new chunk each."""
    chunks = table(spark, d, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").cast("bigint").alias("chunk_index"), F.md5("text").alias("content"))
    new = chunks.where("document_id % 10 = 0").select("document_id").distinct().select("document_id", F.lit(0).cast("bigint").alias("chunk_index"), F.lit("new").alias("content"))
    return m.upsert_by(chunks, new, ["document_id"]).state


def _chunk_states(spark, d):
    c = table(spark, d, "conversations")
    status = F.when(F.col("conv_id") % 3 == 0, "indexed").when((F.col("conv_id") % 3 == 1) & (F.col("turn") == 1), "failed").when(F.col("turn") % 2 == 0, "indexed").otherwise("pending")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), F.col("conv_id").alias("document_id"), status.alias("vector_status"))


_CHUNK_STATES = """SELECT conv_id * 1000 + turn AS chunk_id, conv_id AS document_id, CASE WHEN conv_id % 3 = 0 THEN 'indexed' WHEN conv_id % 3 = 1 AND turn = 1 THEN 'failed'
  WHEN turn % 2 = 0 THEN 'indexed' ELSE 'pending' END AS vector_status FROM conversations"""


def chunk_counts_by_status(spark, d):
    return _chunk_states(spark, d).groupBy("vector_status").agg(F.count("*").alias("chunks"), F.countDistinct("document_id").alias("documents"))


def doc_status_rollup(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    return lc.document_status(_chunk_states(spark, d), docs)


def run_states(spark, d):
    """Runs interrupted for an approval, claimed by their owner where they have a checkpoint, some released, the rest finished or failed."""
    o, none = table(spark, d, "orders"), F.lit(None).cast("string")
    runs = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "RUNNING").when(F.col("o_orderstatus") == "P", "RESUMING").otherwise("COMPLETED").alias("status"),
                    F.col("o_custkey").cast("string").alias("requested_by"), F.when(F.col("o_orderkey") % 8 != 4, F.concat(F.lit("c"), "o_orderkey")).alias("checkpoint_id"), none.alias("approval_id"), none.alias("error_code"), _now().alias("updated_at"))
    runs = lc.interrupt_runs(runs, F.col("id") % 2 == 0, F.concat(F.lit("a"), "id"), _now()).state
    runs = lc.claim_runs(runs, F.col("id") % 3 != 0, F.col("requested_by"), _now()).state
    runs = lc.release_runs(runs, F.col("id") % 5 == 0, _now()).state
    runs = lc.finish_runs(runs, F.col("id") % 7 == 1, _now(), "boom").state
    runs = lc.finish_runs(runs, F.col("id") % 7 == 2, _now()).state
    return runs.select("id", "status", F.coalesce("approval_id", F.lit("")).alias("approval_id"), F.coalesce("error_code", F.lit("")).alias("error_code"))


def dataset_list(spark, d):
    data = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_brand").alias("visibility"))
    return lc.list_datasets(data, " RING ", "ECONOMY", "").select("id", "name")


def embed_documents(spark, d):
    from siltstone.operators.indexing import embed, hash_embedder

    out = embed(table(spark, d, "documents").select("doc_id", "text"), "text", hash_embedder(), 16)
    return out.select("doc_id", F.round(F.col("embedding")[0].cast("double"), 5).alias("first"), F.round(F.col("embedding")[15].cast("double"), 5).alias("last"))


def lexical_index(spark, d):
    docs = schema.documents(spark, d).select("id", "text", "title")
    return r.inverted_index(docs, ["text", "title"]).groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("dl").cast("bigint").alias("longest"))


def reindex_summary(spark, d):
    from siltstone.operators.indexing import reindex_summary as summary

    return summary(table(spark, d, "documents"), _chunk_states(spark, d))


def chunk_report(spark, d):
    from siltstone.operators.indexing import chunk_report as report

    return report(schema.documents(spark, d), _chunk_states(spark, d))


def upload_documents(spark, d):
    from siltstone.operators.indexing import upload

    have = table(spark, d, "region").select(F.col("r_name").alias("title"), F.lit("ready").alias("status"))
    pages = table(spark, d, "pages").select(F.col("url").alias("source"), F.concat(F.lit("page "), "page_id").alias("title"))
    return upload(have, pages, 3, _now()).select("title", "status", F.coalesce("dataset_id", F.lit(0)).alias("dataset_id"), F.coalesce("source", F.lit("")).alias("source"))


def retrieval_evaluation(spark, d):
    """Leaks and answers of every document as a hit of its own query, judged by grants on two datasets."""
    from siltstone.operators import evaluation as ev

    docs = schema.documents(spark, d)
    hits = docs.select(F.col("id").alias("query_id"), F.lit("ann").alias("subject"), "id")
    grants = spark.createDataFrame([("ann", 1), ("ann", 3)], "subject string, dataset_id bigint")
    leaks = ev.acl_leaks(hits, docs, grants).agg(F.count("*").cast("double").alias("v"))
    asked = docs.select(F.col("id").alias("query_id"), (F.col("id") % 4 != 0).alias("answerable"))
    answers = ev.no_answer_accuracy(hits.where("id % 3 <> 0"), asked).toDF("v")
    cited = ev.citation_accuracy(docs.select("id", F.when(F.col("id") % 5 == 0, F.lit("no such words")).otherwise(F.left("text", F.lit(20))).alias("excerpt")), docs.select("id", F.col("text").alias("content"))).toDF("v")
    late = ev.latency(docs.select(F.col("n_chars").alias("millis"))).toDF("v")
    parts = [df.select(F.lit(name).alias("what"), "v") for name, df in (("leaks", leaks), ("no_answer", answers), ("citations", cited), ("p95", late))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_A = schema.APPROVALS_SQL
QUERIES = {q.__name__: q for q in (
    approval_expire, approval_decide, approval_claim_release, approval_consume, approval_due, retention_delete, retention_null_trap, audit_timeline, audit_append, approval_refused, approval_checkpoint, turn_complete_once, turn_retention,
    checkpoint_set, checkpoint_retention, session_history, session_get_or_create, grants_state, orm_update, orm_delete, orm_create_bulk, vector_upsert, vector_delete, doc_upsert_by_title, chunk_replace,
    table_replaced, vector_collection, guarded_writes, chunk_counts_by_status, doc_status_rollup, run_states, dataset_list, embed_documents, lexical_index, reindex_summary, chunk_report, upload_documents, retrieval_evaluation,
)}
_TURNS = "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN 'RUNNING' WHEN o_orderstatus = 'P' THEN 'INTERRUPTED' WHEN o_orderkey % 2 = 0 THEN 'COMPLETED' ELSE 'FAILED' END AS status, o_orderdate AS at_ FROM orders"
_TERMS = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
ORACLES = {
    "run_states": """WITH a AS (SELECT o_orderkey AS id, o_orderkey % 8 <> 4 AS checkpoint, CASE o_orderstatus WHEN 'O' THEN 'RUNNING' WHEN 'P' THEN 'RESUMING' ELSE 'COMPLETED' END AS s FROM orders),
      b AS (SELECT id, checkpoint, CASE WHEN s = 'RUNNING' AND id % 2 = 0 THEN 'INTERRUPTED' ELSE s END AS s, s = 'RUNNING' AND id % 2 = 0 AS asked FROM a),
      e AS (SELECT id, asked, CASE WHEN s = 'INTERRUPTED' AND checkpoint AND id % 3 <> 0 THEN 'RESUMING' ELSE s END AS s FROM b), f AS (SELECT id, asked, CASE WHEN s = 'RESUMING' AND id % 5 = 0 THEN 'INTERRUPTED' ELSE s END AS s FROM e)
      SELECT id, CASE WHEN s IN ('RUNNING', 'RESUMING') AND id % 7 = 1 THEN 'FAILED' WHEN s IN ('RUNNING', 'RESUMING') AND id % 7 = 2 THEN 'COMPLETED' ELSE s END AS status,
        CASE WHEN asked THEN 'a' || id ELSE '' END AS approval_id, CASE WHEN s IN ('RUNNING', 'RESUMING') AND id % 7 = 1 THEN 'boom' ELSE '' END AS error_code FROM f""",
    "dataset_list": "SELECT p_partkey AS id, p_name AS name FROM part WHERE contains(lower(p_name), 'ring') AND p_type = 'ECONOMY'",
    "embed_documents": f"""WITH t AS (SELECT doc_id, [md5(x)[1] for x in {_TERMS.format('text')}] AS h FROM documents),
      n AS (SELECT doc_id, h, [len([x for x in h if x = d]) for d in ['0','1','2','3','4','5','6','7','8','9','a','b','c','d','e','f']] AS v FROM t),
      s AS (SELECT doc_id, v, sqrt(list_sum([x * x for x in v])) AS norm FROM n)
      SELECT doc_id, round((v[1] / greatest(norm, 1))::FLOAT::DOUBLE, 5) AS first, round((v[16] / greatest(norm, 1))::FLOAT::DOUBLE, 5) AS last FROM s""",
    "lexical_index": f"""WITH e AS (SELECT id, 'text' AS field, {_TERMS.format('text')} AS ts FROM ({schema.DOCUMENTS_SQL}) UNION ALL SELECT id, 'title', {_TERMS.format('title')} FROM ({schema.DOCUMENTS_SQL})),
      l AS (SELECT id, field, len(ts) AS dl, unnest(ts) AS term FROM e), p AS (SELECT id, field, term, dl, count(*) AS tf FROM l GROUP BY ALL)
      SELECT field, term, count(*) AS df, sum(tf)::BIGINT AS cf, max(dl) AS longest FROM p GROUP BY field, term""",
    "reindex_summary": f"SELECT (SELECT count(*) FROM documents) AS documents, count(*) AS chunks, count(*) FILTER (vector_status = 'failed') AS failed FROM ({_CHUNK_STATES})",
    "chunk_report": f"SELECT id, title, chunk_id, vector_status FROM ({schema.DOCUMENTS_SQL}) JOIN ({_CHUNK_STATES}) ON id = document_id",
    "upload_documents": "SELECT r_name AS title, 'ready' AS status, 0::BIGINT AS dataset_id, '' AS source FROM region UNION ALL SELECT 'page ' || page_id, 'indexing', 3, url FROM pages",
    "retrieval_evaluation": f"""WITH d AS ({schema.DOCUMENTS_SQL}) SELECT 'leaks' AS what, (count(*) FILTER (dataset_id NOT IN (1, 3)))::DOUBLE AS v FROM d
      UNION ALL SELECT 'no_answer', round(avg(((id % 3 <> 0) = (id % 4 <> 0))::INT), 6) FROM d
      UNION ALL SELECT 'citations', round(avg(contains(text, CASE WHEN id % 5 = 0 THEN 'no such words' ELSE left(text, 20) END)::INT), 6) FROM d
      UNION ALL SELECT 'p95', round(quantile_cont(n_chars, 0.95), 6) FROM d""",
    "approval_expire": f"WITH a AS ({_A}), due AS (SELECT id FROM a WHERE status = 'PENDING' AND expires_at < {_NOW_SQL} ORDER BY expires_at, id LIMIT 100) SELECT id, CASE WHEN id IN (FROM due) THEN 'EXPIRED' ELSE status END AS status, expires_at, decided_at FROM a",
    "approval_decide": f"""WITH a AS (SELECT *, id % 3 <> 0 AND status = 'PENDING' AND expires_at > {_NOW_SQL} AS hit FROM ({_A}))
      SELECT id, CASE WHEN hit THEN CASE WHEN id % 2 = 0 THEN 'APPROVED' ELSE 'REJECTED' END ELSE status END AS status, expires_at, CASE WHEN hit THEN {_NOW_SQL} ELSE decided_at END AS decided_at, (SELECT count(*) FROM a WHERE hit) AS affected FROM a""",
    "approval_claim_release": f"""WITH a AS (SELECT id, CASE WHEN status = 'APPROVED' AND id % 2 = 0 AND (id % 7 = 0 OR expires_at > TIMESTAMP '1995-01-01') AND id % 4 <> 0 AND id % 5 <> 0 THEN 'RESUMING' ELSE status END AS status FROM ({_A}))
      SELECT status, count(*) AS n, sum(id)::BIGINT AS ids FROM a GROUP BY status""",
    "approval_consume": f"""WITH a AS (SELECT *, status = 'APPROVED' AND id % 3 <> 0 AND id % 5 <> 0 AS hit FROM ({_A}))
      SELECT id, CASE WHEN hit THEN 'EXECUTED' WHEN status = 'APPROVED' THEN 'RESUMING' ELSE status END AS status, CASE WHEN hit THEN {_NOW_SQL} END AS executed_at FROM a""",
    "approval_due": f"SELECT id FROM ({_A}) WHERE status = 'PENDING' AND expires_at < {_NOW_SQL} ORDER BY expires_at, id LIMIT 100",
    "retention_delete": f"SELECT id, status, expires_at, decided_at FROM ({_A}) WHERE NOT coalesce(status IN ('REJECTED', 'EXPIRED', 'EXECUTED') AND decided_at < {_NOW_SQL} - INTERVAL 168 HOUR, false)",
    "retention_null_trap": f"""WITH a AS (SELECT id, CASE WHEN status = 'PENDING' AND expires_at < {_NOW_SQL} THEN 'EXPIRED' ELSE status END AS status, decided_at, expires_at FROM ({_A})), k AS (SELECT {_NOW_SQL} - INTERVAL 168 HOUR AS cutoff)
      SELECT status, count(*) AS n, 'faithful' AS rule FROM a, k WHERE NOT coalesce(status IN ('REJECTED', 'EXPIRED', 'EXECUTED') AND decided_at < cutoff, false) GROUP BY status
      UNION ALL SELECT status, count(*), 'fixed' FROM a, k WHERE NOT coalesce(status IN ('REJECTED', 'EXPIRED', 'EXECUTED') AND coalesce(decided_at, expires_at) < cutoff, false) GROUP BY status""",
    "audit_timeline": "SELECT event_id, lag(event_type) OVER w AS before, coalesce(epoch_us(ts) // 1000 - epoch_us(lag(ts) OVER w) // 1000, -1) AS gap_ms FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "audit_append": f"""SELECT id AS approval_id, '' AS session_id, tool, '' AS payload, requester AS actor_subject, CASE WHEN id % 2 = 0 THEN 'approval.approved' ELSE 'approval.rejected' END AS event_type, {_NOW_SQL} AS created_at
      FROM ({_A}) WHERE status = 'PENDING' AND expires_at > {_NOW_SQL} AND id % 3 = 0
      UNION ALL SELECT s_suppkey + 10000000000, '', s_name, '{{"Api-Key":"[REDACTED]","n":' || s_suppkey || ',"note":"token=[REDACTED]"}}', s_nationkey, 'approval.created', {_NOW_SQL} FROM supplier WHERE s_suppkey % 7 <> 0""",
    "approval_refused": """SELECT 'a' || c_custkey AS approval_id, CASE WHEN c_custkey % 5 IN (2, 3) THEN 'PENDING' ELSE 'refused' END AS result,
      CASE c_custkey % 5 WHEN 0 THEN 'over 100 bytes' WHEN 1 THEN 'not a JSON value' WHEN 2 THEN sha256('{"name":"' || c_name || '"}') WHEN 3 THEN sha256('[' || c_custkey || ',1.50]') ELSE 'no arguments' END AS detail,
      CASE c_custkey % 5 WHEN 2 THEN '{"name":"' || c_name || '"}' WHEN 3 THEN '[' || c_custkey || ',1.50]' ELSE '' END AS display_arguments FROM customer""",
    "approval_checkpoint": f"""WITH a AS (SELECT id, status, id % 5 = 0 AS had, status = 'PENDING' AND id % 5 <> 0 AS free FROM ({_A})),
      b AS (SELECT *, free AND id % 3 <> 0 AND id % 4 <> 0 AS one FROM a), c AS (SELECT *, free AND NOT one AND id % 2 = 0 AS two FROM b)
      SELECT id, status, CASE WHEN had THEN 'old' WHEN one THEN 'c' || id WHEN two THEN 'late' ELSE '' END AS checkpoint_id, CASE WHEN one THEN 'i' || id WHEN two THEN 'late' ELSE '' END AS interrupt_id,
        CASE WHEN one THEN 'r' || id WHEN two THEN 'late' ELSE '' END AS run_id FROM c""",
    "checkpoint_retention": f"""WITH p AS (SELECT p_partkey AS id, TIMESTAMP '1996-06-01' + to_days(p_size) AS at_ FROM part),
      d AS (SELECT id FROM p WHERE at_ < {_NOW_SQL} - INTERVAL 24 HOUR ORDER BY at_, id LIMIT 100)
      SELECT id AS checkpoint_id, CASE WHEN id IN (FROM d) THEN 'deleted' ELSE 'kept' END AS result FROM p""",
    "turn_complete_once": f"""WITH t AS (SELECT *, status IN ('RUNNING', 'INTERRUPTED') AND id % 3 = 0 AS won FROM ({_TURNS}))
      SELECT CASE WHEN won THEN 'COMPLETED' ELSE status END AS what, count(*) AS n, count(*) FILTER (won OR status = 'COMPLETED') AS timed FROM t GROUP BY 1
      UNION ALL SELECT 'assistant', count(*), count(*) FROM t WHERE won HAVING count(*) > 0""",
    "turn_retention": f"""WITH t AS (SELECT id, at_, CASE WHEN status IN ('RUNNING', 'INTERRUPTED') AND id % 4 = 1 THEN 'FAILED' ELSE status END AS now_, status FROM ({_TURNS})),
      d AS (SELECT id FROM t WHERE now_ = 'COMPLETED' AND at_ < {_NOW_SQL} - INTERVAL 720 HOUR ORDER BY at_, id LIMIT 100)
      SELECT id, CASE WHEN id IN (FROM d) THEN 'deleted' ELSE now_ END AS status, CASE WHEN now_ <> status AND id NOT IN (FROM d) THEN 'boom' ELSE '' END AS error FROM t""",
    "checkpoint_set": f"""SELECT p_partkey AS checkpoint_id, md5(CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_name END) AS payload_md5,
      CASE WHEN p_partkey % 2 = 0 THEN TIMESTAMP '1996-06-14' ELSE {_NOW_SQL} + INTERVAL 24 HOUR END AS expires_at FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0""",
    "session_history": "SELECT conv_id * 1000 + turn AS id, conv_id AS session_id, role, length(text)::INTEGER AS chars FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE conv_id % 2 = 0) WHERE n <= 3",
    "session_get_or_create": f"SELECT DISTINCT 's' || conv_id AS session_id, 'ann' AS owner, CASE WHEN conv_id % 10 = 3 THEN TIMESTAMP '1996-01-01' ELSE {_NOW_SQL} END AS created_at FROM conversations",
    "grants_state": "SELECT s_name AS subject, s_nationkey::BIGINT AS dataset_id FROM supplier UNION ALL SELECT 'new', 3",
    "orm_update": f"""SELECT id, CASE WHEN decided_at IS NOT NULL THEN 'changed' ELSE tool END AS tool, status, CASE WHEN status = 'PENDING' THEN requester + 1 ELSE requester END AS requester,
      CASE WHEN status = 'PENDING' THEN {_NOW_SQL} ELSE expires_at END AS updated_at FROM ({_A})""",
    "orm_delete": f"SELECT id, decided_at, (SELECT count(*) FROM ({_A}) WHERE NOT (decided_at < {_NOW_SQL})) AS affected FROM ({_A}) WHERE NOT coalesce(NOT (decided_at < {_NOW_SQL}), false)",
    "orm_create_bulk": "SELECT r_regionkey AS id, r_name AS name, 'system' AS visibility FROM region UNION ALL SELECT n_nationkey + 100, n_name, 'private' FROM nation",
    "vector_upsert": """SELECT vec_id AS chunk_id, round(CASE WHEN vec_id % 3 = 0 AND vec_id > 0 THEN -embedding[1] ELSE embedding[1] END::DOUBLE, 6) AS first FROM embeddings
      UNION ALL SELECT vec_id + 1000000, round(embedding[1]::DOUBLE, 6) FROM embeddings WHERE vec_id < 5""",
    "vector_delete": "SELECT vec_id AS chunk_id, label FROM embeddings WHERE NOT coalesce(label = 3 AND vec_id > 0, false)",
    "doc_upsert_by_title": """WITH have AS (SELECT min(p_partkey) AS id, p_name AS title FROM part WHERE p_size <= 25 GROUP BY p_name), new AS (SELECT p_name AS title, max(p_brand) AS text FROM part WHERE p_size > 10 GROUP BY p_name)
      SELECT id, title, coalesce(new.text, 'old') AS text FROM have LEFT JOIN new USING (title)
      UNION ALL SELECT (SELECT max(id) FROM have) + row_number() OVER (ORDER BY encode(title)), title, text FROM new WHERE title NOT IN (SELECT title FROM have)""",
    "chunk_replace": "SELECT conv_id AS document_id, turn AS chunk_index, md5(text) AS content FROM conversations WHERE conv_id % 10 <> 0 UNION ALL SELECT DISTINCT conv_id, 0, 'new' FROM conversations WHERE conv_id % 10 = 0",
    "table_replaced": "SELECT r_regionkey AS id, r_name AS name FROM region WHERE r_regionkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey > 2) UNION ALL SELECT n_nationkey, n_name FROM nation WHERE n_nationkey > 2",
    "vector_collection": "SELECT k::INTEGER AS step, r AS result FROM (VALUES (0, 'ready'), (1, 'ready'), (2, 'refused'), (3, 'refused')) t(k, r) UNION ALL SELECT 4, count(*)::VARCHAR FROM embeddings",
    "guarded_writes": f"SELECT 'open' AS operator, count(*) AS n FROM ({_A}) WHERE status = 'PENDING' UNION ALL SELECT 'closed', -1 UNION ALL SELECT 'traced', 1",
    "chunk_counts_by_status": f"SELECT vector_status, count(*) AS chunks, count(DISTINCT document_id) AS documents FROM ({_CHUNK_STATES}) GROUP BY vector_status",
    "doc_status_rollup": f"""SELECT id, chunks, indexed, failed, CASE WHEN failed > 0 THEN 'failed' WHEN chunks > 0 AND indexed = chunks THEN 'ready' ELSE 'indexing' END AS status FROM (
      SELECT d.doc_id AS id, count(c.document_id) AS chunks, count(*) FILTER (vector_status = 'indexed') AS indexed, count(*) FILTER (vector_status = 'failed') AS failed
      FROM documents d LEFT JOIN ({_CHUNK_STATES}) c ON c.document_id = d.doc_id GROUP BY d.doc_id)""",
}
