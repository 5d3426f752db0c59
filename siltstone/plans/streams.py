"""Streaming and event queries; streams run to the end of their input inside the query."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import evaluation as ev
from siltstone.operators import lifecycle as lc
from siltstone.runtime import cut, scratch, table
from siltstone.streaming import jobs, stateful


_BOUNDS, _SHARES = (10.0, 25.0, 50.0, 100.0), (0.5, 0.95, 0.99)


def _events(spark, d):
    return table(spark, d, "events")


def event_tumbling(spark, d):
    out = jobs.tumbling(_events(spark, d), "1 day")
    return out.select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


def event_sliding(spark, d):
    return jobs.sliding(_events(spark, d), "6 hours", "3 hours")


def event_session(spark, d):
    return jobs.sessions(_events(spark, d), "2 hours")


def event_tumbling_stream(spark, d):
    """The same daily windows by a stream over the table's files, run to their end."""
    target, checkpoint = scratch(spark, "stream-out"), scratch(spark, "stream-state")
    events = _events(spark, d)
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events*").parquet(d) if not _is_folder(spark, d) else spark.readStream.schema(events.schema).parquet(f"{d}/events.parquet")
    counts = jobs.tumbling(stream, "1 day").select("window_start", "event_type", "n")

    def write(batch, epoch):
        batch.write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    every = spark.read.option("basePath", target).parquet(f"{target}/epoch=*")
    last = every.agg(F.max("epoch").alias("last"))
    return every.join(F.broadcast(last), F.col("epoch") == F.col("last")).select("window_start", "event_type", "n")


def _is_folder(spark, d) -> bool:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{d}/events.parquet")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()


def _tasks(events):
    """Every event as a task (id, process_at, max_retry) of up to three tries of 60 seconds: how long a try takes and whether it is good go by id and try."""
    return events.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("process_at"), (F.col("event_id") % 3).cast("int").alias("max_retry"))


def _results(tasks):
    """The result of each try as a worker would report it, were there a retry after every failure."""
    start, tries = F.col("process_at"), []
    for k in (1, 2, 3):
        seconds, good = (F.col("id") * k) % 80, (F.col("id") + k) % 4 == 0
        tries.append(F.struct((start + F.make_dt_interval(secs=seconds)).alias("at"), F.lit(k).alias("attempt"), good.alias("ok")))
        start = start + F.make_dt_interval(secs=F.least(seconds, F.lit(60)) + stateful.BACKOFF_SECONDS * k * k)
    return tasks.select("id", F.explode(F.array(*tries)).alias("r")).select("id", "r.*")


def task_timers(spark, d):
    """Tasks and their tries' results as one stream, run to its end by timers: each task's last change and how many there were."""
    source, target, state = (scratch(spark, f"timers-{x}") for x in ("in", "out", "state"))
    tasks = _tasks(_events(spark, d))
    put = tasks.select("id", F.lit("task").alias("kind"), F.col("process_at").alias("at"), "process_at", "max_retry", F.lit(60).alias("timeout"))
    ran = _results(tasks).withColumn("kind", F.lit("result"))
    clock = tasks.agg((F.max("process_at") + F.expr("INTERVAL 2 DAYS")).alias("at")).select(F.lit(-1).cast("long").alias("id"), F.lit("clock").alias("kind"), "at")
    put.unionByName(ran, allowMissingColumns=True).unionByName(clock, allowMissingColumns=True).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    groups = max(stateful.TASK_GROUPS, tasks.count() // 1000)  # as all are open at once here
    stateful.run_into(stateful.task_moves(stream, groups=groups), target, state).awaitTermination()
    moves = spark.read.option("basePath", target).parquet(f"{target}/epoch=*")
    last = F.max_by(F.struct("status", "tries", "at"), F.struct("at", "tries", F.col("status") != "active"))
    return moves.groupBy("id").agg(last.alias("m"), F.count("*").alias("moves")).select("id", "m.status", "m.tries", "m.at", "moves")


def message_stream(spark, d):
    """As message_accumulate, from a stream whose state goes when a message has ended or stayed open too long."""
    source, target, state = (scratch(spark, f"messages-{x}") for x in ("in", "out", "state"))
    start = F.lit("2024-01-01").cast("timestamp")
    deltas = _deltas(spark, d).withColumn("at", start + F.make_dt_interval(secs=F.least("seq", F.lit(600))))
    clock = spark.range(1).select(F.lit("").alias("turn_id"), F.lit("clock").alias("type"), (start + F.expr("INTERVAL 2 DAYS")).alias("at"))
    deltas.unionByName(clock, allowMissingColumns=True).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    groups = max(stateful.TURN_GROUPS, table(spark, d, "conversations").count() // 200)  # as all are open at once here
    stateful.run_into(stateful.assembled(stream, groups=groups), target, state).awaitTermination()
    return spark.read.option("basePath", target).parquet(f"{target}/epoch=*").select("turn_id", F.md5("content").alias("content_md5"), "outcome")


def _deltas(spark, d):
    c = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("turn_id"), "text", "turn")
    words = c.select("turn_id", F.posexplode(F.split("text", " ")).alias("seq", "w")).select("turn_id", "seq", F.lit("message").alias("type"), F.concat(F.when(F.col("seq") > 0, " ").otherwise(""), "w").alias("content"))
    ends = c.where("turn % 3 <> 2").select("turn_id", F.lit(1_000_000).alias("seq"), F.when(F.col("turn") % 3 == 0, "done").otherwise("error").alias("type"), F.lit(None).cast("string").alias("content"))
    return words.unionByName(ends)


def message_accumulate(spark, d):
    """Words of conversations as stream deltas, joined back into messages."""
    return jobs.messages(_deltas(spark, d)).select("turn_id", F.md5("content").alias("content_md5"), "outcome")


def pending_index_batch(spark, d):
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), F.when(F.col("turn") % 2 == 0, "pending").otherwise("indexed").alias("vector_status"), (F.col("conv_id") % 5).alias("tries"))
    return jobs.pending_chunks(c, c.where("chunk_id % 7 = 0")).select("chunk_id", "tries")


def due_tasks(spark, d):
    e = _events(spark, d).select("event_id", F.col("event_type").alias("type"), F.when(F.col("event_id") % 4 != 0, F.col("ts")).alias("process_at"), (F.col("event_id") % 4).alias("tries"))
    return jobs.due_tasks(e, F.lit("2024-01-10").cast("timestamp")).groupBy("type").agg(F.count("*").alias("n"))


def task_retries(spark, d):
    """Every event as a task; those that are due run, some fail or take too long; then once more."""
    now = F.lit("2024-01-10").cast("timestamp")
    e = _events(spark, d).select(F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.col("props").alias("payload"), F.when(F.col("event_id") % 4 != 0, F.col("ts").cast("timestamp")).alias("process_at"),
                                 (F.col("event_id") % 7).alias("process_in"), (F.col("event_id") % 2).cast("int").alias("max_retry"), F.lit(60).alias("timeout"))
    none = spark.createDataFrame([], "id bigint, type string, payload string, queue string, process_at timestamp, max_retry int, timeout int, tries int, status string")
    tasks = jobs.enqueue(none, e, now)
    for k, at in enumerate(("2024-01-10 00:00:06", "2024-01-10 00:00:40")):
        at = F.lit(at).cast("timestamp")
        ran = jobs.due_tasks(tasks, at).select("id", (F.col("id") % 3 != k).alias("ok"), F.when(F.col("id") % 5 == 0, 61).otherwise(60).alias("seconds"))
        tasks = cut(jobs.settle(tasks, ran, at))
    return tasks.select("id", "queue", "status", "tries", F.coalesce("process_at", F.lit("1970-01-01").cast("timestamp")).alias("process_at"))


def queue_dispatch(spark, d):
    """Events as a stream of tasks, run to its end by a handler for each type."""
    source, target, state = (scratch(spark, f"queue-{x}") for x in ("in", "out", "state"))
    events = _events(spark, d).select(F.col("event_id").alias("id"), F.col("event_type").alias("type"))
    events.write.parquet(source)
    dispatcher = jobs.Dispatcher()
    for (kind,) in events.select("type").distinct().collect():  # the types that there are
        dispatcher.register(kind, lambda batch, epoch, kind=kind: batch.withColumn("handled_as", F.lit(kind)).write.mode("overwrite").parquet(f"{target}/{kind}/epoch={epoch}"))
    jobs.run_queue(spark.readStream.schema(events.schema).parquet(source), dispatcher, state).awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").parquet(target).select("id", "type", "handled_as")


def maintenance_round(spark, d):
    from siltstone.plans.lifecycles import _approvals, _now, _turns

    checkpoints = table(spark, d, "part").select(F.col("p_partkey").alias("checkpoint_id"), (F.lit("1996-06-01").cast("timestamp") + F.make_dt_interval(F.col("p_size"))).alias("expires_at"))
    approvals, checkpoints, turns = jobs.maintain(_approvals(spark, d), checkpoints, _turns(spark, d), _now())
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    return count(approvals, "approvals").union(count(checkpoints, "checkpoints")).union(count(turns, "turns")).union(count(approvals.where("status = 'EXPIRED'"), "expired"))


def http_metrics(spark, d):
    """Requests by type and bucket of their value; in_flight_peak has the gauge."""
    e = _events(spark, d)
    bucket = F.when(F.col("value") < 10, "<10").when(F.col("value") < 100, "<100").otherwise("more")
    return e.groupBy("event_type", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def _requests(spark, d):
    return _events(spark, d).select("event_type", F.to_date("ts").alias("day"), F.col("value").cast("double").alias("millis"))


def http_histogram(spark, d):
    """Cumulative histograms of requests, stored a day and merged by type."""
    stored = scratch(spark, "histogram")
    ev.histogram(_requests(spark, d), _BOUNDS, "event_type", "day").write.parquet(stored)
    return ev.merged_histogram(spark.read.parquet(stored), "event_type").select("event_type", F.col("le").cast("string").alias("le"), "n", F.round("total", 4).alias("total"))


def latency_sketches(spark, d):
    """Quantiles from sketches stored a day and merged by type: how many values, the peak, and whether the estimates' true ranks are within the bound."""
    stored = scratch(spark, "sketches")
    requests = _requests(spark, d)
    ev.sketches(requests, "event_type", "day").write.parquet(stored)
    got = cut(ev.merged_quantiles(spark.read.parquet(stored), _SHARES, "event_type"))  # a row for each type
    at = [F.struct(F.lit(share).alias("share"), F.col("quantiles")[k].alias("q")) for k, share in enumerate(_SHARES)]
    each = got.select("event_type", "n", "peak", F.explode(F.array(*at)).alias("x")).select("event_type", "n", "peak", "x.*")
    ranks = requests.join(each, "event_type").groupBy("event_type", "share").agg(F.any_value("n").alias("n"), F.any_value("peak").alias("peak"), F.avg((F.col("millis") < F.col("q")).cast("double")).alias("lo"), F.avg((F.col("millis") <= F.col("q")).cast("double")).alias("hi"))
    return ranks.select("event_type", "share", "n", F.round("peak", 6).alias("peak"), ((F.col("lo") <= F.col("share") + ev.RANK_ERROR) & (F.col("hi") >= F.col("share") - ev.RANK_ERROR)).alias("within"))


def in_flight_peak(spark, d):
    e = _events(spark, d)
    spans = e.select(F.col("event_type").alias("route"), F.col("ts").alias("start"), (F.col("ts") + F.expr("INTERVAL 10 MINUTES")).alias("end"))
    return jobs.in_flight(spans).groupBy("route").agg(F.max("in_flight").alias("peak"))


QUERIES = {q.__name__: q for q in (event_tumbling, event_sliding, event_session, event_tumbling_stream, message_accumulate, message_stream, pending_index_batch, due_tasks, task_retries, task_timers, queue_dispatch, maintenance_round, http_metrics, http_histogram, latency_sketches, in_flight_peak)}
_DAY = "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n"
ORACLES = {
    "event_tumbling": f"{_DAY}, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "event_tumbling_stream": f"{_DAY} FROM events GROUP BY ALL",
    "event_sliding": "SELECT time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '1970-01-01') - k * INTERVAL 3 HOUR AS window_start, count(*) AS n FROM events, (VALUES (0), (1)) t(k) GROUP BY 1",
    "event_session": """WITH m AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 2 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m)
      SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 2 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, k""",
    "message_accumulate": "SELECT conv_id || '-' || turn AS turn_id, md5(text) AS content_md5, CASE turn % 3 WHEN 0 THEN 'done' WHEN 1 THEN 'error' ELSE 'open' END AS outcome FROM conversations",
    "pending_index_batch": "SELECT conv_id * 1000 + turn AS chunk_id, conv_id % 5 AS tries FROM conversations WHERE turn % 2 = 0 AND conv_id % 5 < 3 AND (conv_id * 1000 + turn) % 7 <> 0",
    "due_tasks": "SELECT event_type AS type, count(*) AS n FROM events WHERE (event_id % 4 = 0 OR ts <= TIMESTAMP '2024-01-10') AND event_id % 4 < 3 GROUP BY event_type",
    "queue_dispatch": "SELECT event_id AS id, event_type AS type, event_type AS handled_as FROM events",
    "task_retries": """WITH t AS (SELECT event_id AS id, event_id % 2 AS most, CASE WHEN event_id % 4 <> 0 THEN ts ELSE TIMESTAMP '2024-01-10' + to_seconds(event_id % 7) END AS p0 FROM events),
      a AS (SELECT *, p0 <= TIMESTAMP '2024-01-10 00:00:06' AS ran1, id % 3 <> 0 AND id % 5 <> 0 AS ok1, id % 3 <> 1 AND id % 5 <> 0 AS ok2 FROM t),
      b AS (SELECT *, CASE WHEN NOT ran1 THEN 'pending' WHEN ok1 THEN 'completed' WHEN 1 > most THEN 'archived' ELSE 'retry' END AS s1,
            CASE WHEN ran1 AND NOT ok1 AND 1 <= most THEN TIMESTAMP '2024-01-10 00:00:21' ELSE p0 END AS p1, ran1::INT AS n1 FROM a),
      c AS (SELECT *, s1 IN ('pending', 'retry') AND p1 <= TIMESTAMP '2024-01-10 00:00:40' AS ran2, n1 + 1 AS n2 FROM b)
      SELECT id, 'default' AS queue, CASE WHEN NOT ran2 THEN s1 WHEN ok2 THEN 'completed' WHEN n2 > most THEN 'archived' ELSE 'retry' END AS status, CASE WHEN ran2 THEN n2 ELSE n1 END AS tries,
             CASE WHEN ran2 AND NOT ok2 AND n2 <= most THEN TIMESTAMP '2024-01-10 00:00:40' + to_seconds(15 * n2 * n2) ELSE p1 END AS process_at FROM c""",
    "http_metrics": "SELECT event_type, CASE WHEN value < 10 THEN '<10' WHEN value < 100 THEN '<100' ELSE 'more' END AS bucket, count(*) AS n FROM events GROUP BY ALL",
    "in_flight_peak": """WITH m AS (SELECT event_type AS route, ts AS at_, 1 AS c FROM events UNION ALL SELECT event_type, ts + INTERVAL 10 MINUTE, -1 FROM events), s AS (SELECT route, at_, sum(c) AS c FROM m GROUP BY ALL),
      g AS (SELECT route, sum(c) OVER (PARTITION BY route ORDER BY at_) AS n FROM s) SELECT route, max(n)::BIGINT AS peak FROM g GROUP BY route""",
}
_T = "(SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN 'RUNNING' WHEN o_orderstatus = 'P' THEN 'INTERRUPTED' WHEN o_orderkey % 2 = 0 THEN 'COMPLETED' ELSE 'FAILED' END AS status, o_orderdate AS at_ FROM orders)"


def _maintenance_sql() -> str:
    from siltstone.schema import APPROVALS_SQL

    now = "TIMESTAMP '1996-06-15'"
    return f"""WITH a AS ({APPROVALS_SQL}) SELECT 'approvals' AS what, count(*) AS n FROM a WHERE NOT coalesce(status IN ('REJECTED', 'EXECUTED') AND decided_at < {now} - INTERVAL 168 HOUR, false)
      UNION ALL SELECT 'checkpoints', count(*) - count(*) FILTER (TIMESTAMP '1996-06-01' + to_days(p_size) < {now} - INTERVAL 24 HOUR) FROM part
      UNION ALL SELECT 'turns', count(*) - count(*) FILTER (status = 'COMPLETED' AND at_ < {now} - INTERVAL 720 HOUR) FROM {_T}
      UNION ALL SELECT 'expired', count(*) FROM a WHERE status = 'PENDING' AND expires_at < {now}"""


def _timers_sql() -> str:
    """Three tries, each with its start, end, and whether it is good; the next starts only after a failure that leaves retries."""
    ctes, start = ["t AS (SELECT event_id AS id, event_id % 3 AS most, ts::TIMESTAMP AS s1, true AS run1 FROM events)"], "t"
    for k in (1, 2, 3):
        ctes.append(f"""e{k} AS (SELECT *, run{k} AND (id + {k}) % 4 = 0 AND (id * {k}) % 80 <= 60 AS ok{k}, s{k} + to_seconds(least((id * {k}) % 80, 60)) AS end{k} FROM {start})""")
        ctes.append(f"n{k} AS (SELECT *, run{k} AND NOT ok{k} AND {k} <= most AS run{k + 1}, end{k} + to_seconds({15 * k * k}) AS s{k + 1} FROM e{k})")
        start = f"n{k}"
    return f"""WITH {", ".join(ctes)}, f AS (SELECT *, run1::INT + run2::INT + run3::INT AS tries FROM n3)
      SELECT id, CASE WHEN ok1 OR ok2 OR ok3 THEN 'completed' ELSE 'archived' END AS status, tries, CASE tries WHEN 1 THEN end1 WHEN 2 THEN end2 ELSE end3 END AS at, 2 * tries AS moves FROM f"""


ORACLES["http_histogram"] = f"""SELECT event_type, le, count(*) FILTER (le = 'Infinity' OR value <= le::DOUBLE) AS n, round(sum(value) FILTER (le = 'Infinity' OR value <= le::DOUBLE), 4) AS total
  FROM events, (VALUES {", ".join(f"('{b}')" for b in _BOUNDS)}, ('Infinity')) t(le) GROUP BY event_type, le"""
ORACLES["latency_sketches"] = f"""SELECT event_type, share::DOUBLE AS share, count(value) AS n, round(max(value), 6) AS peak, true AS within
  FROM events, (VALUES {", ".join(f"({x})" for x in _SHARES)}) t(share) GROUP BY event_type, share"""
ORACLES["task_timers"] = _timers_sql()
ORACLES["message_stream"] = ORACLES["message_accumulate"]
ORACLES["maintenance_round"] = _maintenance_sql()
