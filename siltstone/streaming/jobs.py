"""Structured Streaming jobs: index queue, maintenance, event windows, message assembly.

Sinks are keyed and idempotent, so a batch that is retried after a failure ends
in the same state. Every job takes a trigger; tests use availableNow.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.operators import lifecycle
from siltstone.runtime import cut, remove

# Terminal events of a message stream; a chunk's tries; a task's queue, retries and seconds.
TERMINAL_EVENTS = ("done", "error")
MOST_RETRIES = 3
TASK_QUEUE, TASK_RETRIES, TASK_SECONDS = "default", 25, 1800
#: Seconds that a failed task waits, times the square of its tries.
BACKOFF_SECONDS = 15
#: How long windows of a stream stay open for late events.
LATE = "1 hour"


def _bounded(events: DataFrame, late: str) -> DataFrame:
    """A stream's state must end some time; a batch has none."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def tumbling(events: DataFrame, size: str, late: str = LATE) -> DataFrame:
    """(window_start, event_type, n, total) per window; of a stream, windows close `late` after their end."""
    events = _bounded(events, late)
    out = events.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str, step: str, late: str = LATE) -> DataFrame:
    events = _bounded(events, late)
    return events.groupBy(F.window("ts", size, step)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "n")


def sessions(events: DataFrame, gap: str, late: str = LATE) -> DataFrame:
    """(user_id, session_start, session_end, n); the end is a gap after the last event."""
    events = _bounded(events, late)
    out = events.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def enqueue(tasks: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """tasks with new ones (id, type, payload and, optionally, queue, process_at, process_in, max_retry, timeout; times in seconds).

    A task starts at process_at, or process_in seconds from now, or now.
    """
    option = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name in new.columns else F.lit(default)
    later = now + F.make_dt_interval(secs=option("process_in", 0))
    rows = new.select(
        "id", "type", "payload", option("queue", TASK_QUEUE).alias("queue"), (F.coalesce(F.col("process_at"), later) if "process_at" in new.columns else later).alias("process_at"),
        option("max_retry", TASK_RETRIES).alias("max_retry"), option("timeout", TASK_SECONDS).alias("timeout"), F.lit(0).alias("tries"), F.lit("pending").alias("status"),
    )
    return tasks.unionByName(rows, allowMissingColumns=True)


def due_tasks(tasks: DataFrame, now: Column) -> DataFrame:
    """Tasks whose time has come and that have tries left: as many as max_retry and one, or MOST_RETRIES where a task names none."""
    left = F.coalesce("tries", F.lit(0)) < (F.coalesce(F.col("max_retry") + 1, F.lit(MOST_RETRIES)) if "max_retry" in tasks.columns else MOST_RETRIES)
    open_ = F.col("status").isin("pending", "retry") if "status" in tasks.columns else F.lit(True)
    return tasks.where((F.coalesce(F.col("process_at"), now) <= now) & left & open_)


def settle(tasks: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """tasks after runs, outcomes (id, ok, seconds): done, to be tried again later, or archived when their retries are used up.

    A run that is longer than its timeout has failed. A task settles once a call.
    """
    ran = outcomes.groupBy(F.col("id").alias("_id")).agg(F.bool_and("ok").alias("_ok"), F.max("seconds").alias("_seconds"))
    out = tasks.join(ran, tasks["id"] == F.col("_id"), "left")
    hit = F.col("_id").isNotNull() & F.col("status").isin("pending", "retry")
    good = F.coalesce(F.col("_ok") & (F.col("_seconds") <= F.col("timeout")), F.lit(False))
    tries = F.col("tries") + 1
    status = F.when(good, "completed").when(tries > F.col("max_retry"), "archived").otherwise("retry")
    waits = now + F.make_dt_interval(secs=(F.lit(BACKOFF_SECONDS) * tries * tries))
    return out.withColumns({
        "status": F.when(hit, status).otherwise(F.col("status")), "process_at": F.when(hit & (status == "retry"), waits).otherwise(F.col("process_at")),
        "tries": F.when(hit, tries).otherwise(F.col("tries")),
    }).drop("_id", "_ok", "_seconds")


class UnknownTask(LookupError):
    """A task of a type that no handler is registered for."""


class Dispatcher:
    """Handlers by task type, for foreachBatch; a type has one handler. A batch with a task of another type fails before any handler runs."""

    def __init__(self):
        self._handlers: dict[str, Callable[[DataFrame, int], None]] = {}

    def register(self, kind: str, handler: Callable[[DataFrame, int], None]) -> None:
        if kind in self._handlers:
            raise ValueError(f"a handler for {kind!r} is registered already")
        self._handlers[kind] = handler

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        other = batch.where(~F.coalesce(F.col("type").isin(*self._handlers), F.lit(False))).select("type").first()
        if other:
            raise UnknownTask(f"no handler for {other['type']!r}")
        for kind, handler in self._handlers.items():
            mine = batch.where(F.col("type") == kind)
            if not mine.isEmpty():
                handler(mine, epoch)


def run_queue(tasks: DataFrame, dispatcher: Dispatcher, checkpoint: str, **trigger) -> StreamingQuery:
    return tasks.writeStream.foreachBatch(dispatcher).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def pending_chunks(chunks: DataFrame, indexed: DataFrame, most_failures: int = MOST_RETRIES) -> DataFrame:
    """Chunks to index: pending, without a vector, tries left."""
    open_ = chunks.where((F.col("vector_status") == "pending") & (F.coalesce("tries", F.lit(0)) < most_failures))
    return open_.join(indexed.select("chunk_id"), "chunk_id", "left_anti")


def index_sink(target: str, embed: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that writes each batch's vectors to its own folder, so a retry overwrites itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        latest = batch.groupBy("chunk_id").agg(F.max_by("content", "version").alias("content"), F.max("version").alias("version"))
        embed(latest).write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    return write


def latest_vectors(spark: SparkSession, target: str) -> DataFrame:
    """What the sink's folders hold, the newest version of each chunk."""
    every = spark.read.option("basePath", target).parquet(f"{target}/epoch=*")
    return every.groupBy("chunk_id").agg(F.max_by(F.struct("embedding", "version"), F.struct("version", "epoch")).alias("x")).select("chunk_id", "x.embedding", "x.version")


def compact_vectors(spark: SparkSession, target: str) -> None:
    """Fold all folders into that of the last epoch, so that reads don't grow with time; to be called between runs of the sink.

    The others go only when the new folder is written, and hold nothing newer, so a stop in between does no harm.
    """
    every = spark.read.option("basePath", target).parquet(f"{target}/epoch=*")
    epochs = sorted(r["epoch"] for r in every.select("epoch").distinct().collect())  # since the last call
    cut(latest_vectors(spark, target)).write.mode("overwrite").parquet(f"{target}/epoch={epochs[-1]}")
    for epoch in epochs[:-1]:
        remove(spark, f"{target}/epoch={epoch}")


def maintain(approvals: DataFrame, checkpoints: DataFrame, turns: DataFrame, now: Column, limit: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round: expire approvals, then drop old checkpoints, approvals and turns: all that are due, or, but for the approvals' deletion, `limit` of each."""
    approvals = lifecycle.expire(approvals, now, limit)
    checkpoints = lifecycle.delete_expired_checkpoints(checkpoints, lifecycle.before(now, lifecycle.RETENTION_HOURS["checkpoints"]), limit).state
    approvals = lifecycle.delete_terminal(approvals, lifecycle.before(now, lifecycle.RETENTION_HOURS["approvals"]), lifecycle.TERMINAL_APPROVALS, "decided_at").state
    turns = lifecycle.delete_terminal_turns(turns, lifecycle.before(now, lifecycle.RETENTION_HOURS["turns"]), limit).state
    return approvals, checkpoints, turns


def run_maintenance(spark: SparkSession, round_: Callable[[int], None], checkpoint: str, seconds: int = lifecycle.MAINTENANCE_SECONDS) -> StreamingQuery:
    """Call round_ once at the start and then every interval; an error is logged and the loop goes on."""

    def step(_: DataFrame, epoch: int) -> None:
        try:
            round_(epoch)
        except Exception as error:  # the next round may well succeed
            spark.sparkContext._jvm.org.apache.logging.log4j.LogManager.getLogger("maintenance").error(str(error))

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def messages(deltas: DataFrame) -> DataFrame:
    """(turn_id, content, outcome) of stream deltas (turn_id, seq, type, content): deltas joined in order, and how it ended."""
    ordered = F.array_sort(F.collect_list(F.when(F.col("type") == "message", F.struct("seq", "content"))))
    last = F.max_by(F.when(F.col("type").isin(*TERMINAL_EVENTS), F.col("type")), F.when(F.col("type").isin(*TERMINAL_EVENTS), F.col("seq")))
    return deltas.groupBy("turn_id").agg(F.array_join(ordered["content"], "").alias("content"), F.coalesce(last, F.lit("open")).alias("outcome"))


def in_flight(requests: DataFrame) -> DataFrame:
    """(route, at, in_flight): a gauge from request rows (start, end, route): +1 and -1 events summed over time, per route.

    A route's history is dealt to tasks by ranges of time; each range starts from
    the sum of those before it.
    """
    from pyspark.sql import Window

    marks = requests.select("route", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("change")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("change")))).alias("m"))
    steps = marks.select("route", "m.at", "m.change").groupBy("route", "at").agg(F.sum("change").alias("change"))
    placed = cut(steps.repartitionByRange("route", "at")).withColumn("_part", F.spark_partition_id())
    sums = placed.groupBy("route", "_part").agg(F.sum("change").alias("_sum"))  # a row for each partition, and for each route
    before = Window.partitionBy("route").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("route", "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("route", "_part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    running = placed.withColumn("_in", F.sum("change").over(within)).join(offsets, ["route", "_part"])
    return running.select("route", "at", (F.col("_in") + F.col("_before")).alias("in_flight"))
