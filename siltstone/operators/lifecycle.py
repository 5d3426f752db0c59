"""Lifecycles of approvals, turns, runs, checkpoints and sessions as guarded updates.

Each step names the states it may leave; rows in any other state are untouched,
which is what compare-and-set gives under one writer. `now` is always a
parameter. Comparison with NULL is unknown, and unknown never deletes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions import text
from siltstone.operators.mutations import Change, delete, numbered_rows, update
from siltstone.runtime import cut

# Retention in hours, batch size, lifetimes in seconds.
RETENTION_HOURS = {"approvals": 168, "checkpoints": 24, "turns": 720}
MAINTENANCE_SECONDS, BATCH = 300, 100
APPROVAL_TTL_SECONDS, CHECKPOINT_TTL_SECONDS = 1800, 86400
TERMINAL_APPROVALS, TERMINAL_TURNS = ("REJECTED", "EXPIRED", "EXECUTED"), ("COMPLETED", "FAILED")


def after(now: Column, seconds: int) -> Column:
    return now + F.make_dt_interval(secs=F.lit(seconds))


def before(now: Column, hours: int) -> Column:
    return now - F.make_dt_interval(hours=F.lit(hours))


def transition(df: DataFrame, allowed: tuple[str, ...], to: str, guard: Column | None = None, **values) -> Change:
    """Rows in an allowed state (and under the guard) go to another; others stay."""
    return update(df, F.col("status").isin(*allowed) & (F.lit(True) if guard is None else guard), status=to, **values)


def first_of(df: DataFrame, predicate: Column, limit: int | None, *order: Column, key: str = "id") -> DataFrame:
    """Keys of the first `limit` rows under the predicate, of all without a limit."""
    return df.where(predicate).select(key) if limit is None else df.where(predicate).orderBy(*order).limit(limit).select(key)


@dataclass(frozen=True)
class Removed:
    """A table after a batch of deletions, and the keys of the rows that went."""

    state: DataFrame
    ids: DataFrame

    def count(self) -> int:
        return self.ids.count()


def _without_first(df: DataFrame, predicate: Column, limit: int | None, key: str, *order: Column) -> Removed:
    """The first `limit` rows under the predicate go; in the order given, then of the key, so that a run that is repeated takes the same. Without a limit all go."""
    if limit is None:
        gone = F.coalesce(predicate, F.lit(False))
        return Removed(df.where(~gone), df.where(gone).select(key))
    if limit <= 0:
        raise ValueError("delete limit must be greater than zero")
    ids = first_of(df, predicate, limit, *order, F.col(key), key=key)
    return Removed(df.join(F.broadcast(ids), key, "left_anti").select(*df.columns), ids)  # `limit` keys


#: What an audit row takes from the approval, by the approval's column.
AUDITED = {"approval_id": "id", "session_id": "session_id", "tool": "tool", "actor_subject": "requester"}
#: States that leave an audit row when they are reached, and those whose row shows the arguments. Expiry and release leave none.
AUDITED_STATES, SHOWN_STATES = ("APPROVED", "REJECTED", "RESUMING", "EXECUTED"), ("EXECUTED",)


def audit(events: DataFrame, before_: DataFrame, after_: DataFrame, now: Column, actor: Column | None = None) -> DataFrame:
    """events with one more for each approval that is new, or was decided, taken up or executed: approval, session, tool, payload and actor.

    The payload is the redacted form of the arguments when they are new or executed, else empty. The actor is the
    requester unless another is given; what an approval has no column for is null.
    """
    was = before_.select(F.col("id").alias("_id"), F.col("status").alias("_was"))
    joined = after_.join(was, after_["id"] == F.col("_id"), "left")
    new = F.col("_id").isNull()
    released = (F.col("_was") == "RESUMING") & (F.col("status") == "APPROVED")
    changed = joined.where(new | ((F.col("_was") != F.col("status")) & F.col("status").isin(*AUDITED_STATES) & ~released))
    taken = {to: F.col(c) if c in after_.columns else F.lit(None).cast("string") for to, c in AUDITED.items()}
    shown = F.col("display_arguments") if "display_arguments" in after_.columns else F.lit(None).cast("string")
    taken["payload"] = F.when(new | F.col("status").isin(*SHOWN_STATES), shown).otherwise(F.lit(""))
    if actor is not None:
        taken["actor_subject"] = actor
    kind = F.concat(F.lit("approval."), F.when(new, "created").otherwise(F.lower("status")))
    return events.unionByName(changed.select(*[c.alias(n) for n, c in taken.items()], kind.alias("event_type"), now.alias("created_at")), allowMissingColumns=True)


def _prepared(requests: DataFrame, most: int) -> DataFrame:
    return requests.withColumn("_prepared", text.prepared_arguments("arguments", most))


def refused_approvals(requests: DataFrame, most: int = text.ARGUMENT_BYTES) -> DataFrame:
    """requests whose arguments can't be kept, without them, and why: (..., error)."""
    return _prepared(requests, most).where("_prepared.error is not null").withColumn("error", F.col("_prepared.error")).drop("_prepared", "arguments")


def create_approvals(df: DataFrame, requests: DataFrame, now: Column, ttl: int = APPROVAL_TTL_SECONDS, most: int = text.ARGUMENT_BYTES) -> DataFrame:
    """df with a PENDING approval for each request (tool, arguments, requester, and what else df has) that isn't refused.

    Of the arguments only their hash and redacted form are kept. A request without an
    approval_id gets a random one, one without an id the next free number; both are
    written before they are used, so they stay what they are.
    """
    rows = _prepared(requests, most).where("_prepared.error is null").withColumns({c: F.col(f"_prepared.{c}") for c in ("arguments_hash", "display_arguments")}).drop("_prepared", "arguments")
    rows = rows.withColumns({"status": F.lit("PENDING"), "created_at": now, "expires_at": after(now, ttl)})
    named = F.coalesce(F.col("approval_id"), text.new_uuid()) if "approval_id" in rows.columns else text.new_uuid()
    rows = cut(rows.withColumn("approval_id", named))
    if "id" not in rows.columns:
        top = df.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
        rows = numbered_rows(rows, "approval_id").join(F.broadcast(top)).withColumn("id", F.col("_n") + F.col("_top")).drop("_n", "_top")
    return df.unionByName(rows, allowMissingColumns=True)


def attach_checkpoint(df: DataFrame, id: Column, checkpoint: Column | str, interrupt: Column | str, run: Column | str) -> Change:
    """PENDING approvals without a checkpoint and interrupt get both, and their run; rows whose new checkpoint or interrupt is empty are left alone."""
    checkpoint, interrupt, run = (c if isinstance(c, Column) else F.lit(c) for c in (checkpoint, interrupt, run))
    free = F.col("checkpoint_id").isNull() & F.col("interrupt_id").isNull()
    return update(df, id & (F.col("status") == "PENDING") & free & (checkpoint != "") & (interrupt != ""), checkpoint_id=checkpoint, interrupt_id=interrupt, run_id=run)


def decide(df: DataFrame, which: Column, approve: Column, by: str, now: Column) -> Change:
    """PENDING and strictly unexpired rows are decided."""
    status = F.when(approve, "APPROVED").otherwise("REJECTED")
    values = {"status": status, "decided_at": now} | ({"decided_by": by} if "decided_by" in df.columns else {})
    return update(df, which & (F.col("status") == "PENDING") & (F.col("expires_at") > now), **values)


def consume(df: DataFrame, calls: DataFrame, now: Column, keys: tuple[str, ...] = ("session_id", "tool", "arguments_hash", "requester")) -> DataFrame:
    """The RESUMING approvals that calls name by id, with equal keys, are EXECUTED, and get executed_at."""
    named = calls.select(F.col("id").alias("_hit"), *[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    match = (df["id"] == F.col("_hit")) & (df["status"] == "RESUMING")
    for k in keys:
        match = match & (df[k] == F.col(f"_{k}"))
    have = F.col("executed_at") if "executed_at" in df.columns else F.lit(None).cast("timestamp")
    hit = F.col("_hit").isNotNull()
    out = df.join(named, match, "left").withColumns({"status": F.when(hit, "EXECUTED").otherwise(F.col("status")), "executed_at": F.when(hit, now).otherwise(have)})
    return out.drop("_hit", *[f"_{k}" for k in keys])


def claim(df: DataFrame, which: Column, owner: Column, now: Column) -> Change:
    """APPROVED, owned approvals with checkpoint, interrupt and run are taken up unless they have expired; without an expiry they never do."""
    whole = F.col("checkpoint_id").isNotNull() & F.col("interrupt_id").isNotNull() & F.col("run_id").isNotNull()
    live = F.col("expires_at").isNull() | (F.col("expires_at") > now)
    return transition(df, ("APPROVED",), "RESUMING", which & (F.col("requester") == owner) & live & whole)


def release(df: DataFrame, which: Column) -> Change:
    return transition(df, ("RESUMING",), "APPROVED", which)


def _past(now: Column) -> Column:
    return (F.col("status") == "PENDING") & (F.col("expires_at") < now)


def due(df: DataFrame, now: Column, limit: int | None = BATCH) -> DataFrame:
    """Ids of the first `limit` PENDING rows strictly past their expiry, of all without a limit: those that expire() returns as EXPIRED."""
    return first_of(df, _past(now), limit, F.col("expires_at"), F.col("id"))


def expire(df: DataFrame, now: Column, limit: int | None = BATCH) -> DataFrame:
    """The due rows become EXPIRED; decided_at stays."""
    if limit is None:
        return df.withColumn("status", F.when(_past(now), "EXPIRED").otherwise(F.col("status")))
    hit = F.broadcast(due(df, now, limit).select(F.col("id").alias("_due")))  # `limit` rows
    out = df.join(hit, df["id"] == F.col("_due"), "left")
    return out.withColumn("status", F.when(F.col("_due").isNotNull(), "EXPIRED").otherwise(F.col("status"))).drop("_due")


def _terminal(cutoff: Column, states: tuple[str, ...], at: str, fixed: str | None) -> Column:
    return F.col("status").isin(*states) & ((F.col(at) if fixed is None else F.coalesce(at, fixed)) < cutoff)


def delete_terminal(df: DataFrame, cutoff: Column, states: tuple[str, ...], at: str, fixed: str | None = None) -> Change:
    """Terminal rows decided before the cutoff go. Rows that never got the time stay, unless `fixed` names a stand-in."""
    return delete(df, _terminal(cutoff, states, at, fixed))


def delete_terminal_turns(df: DataFrame, cutoff: Column, limit: int | None = BATCH) -> Removed:
    """The first `limit` turns that completed or failed before the cutoff go, without a limit all; turns that never got the time stay."""
    return _without_first(df, _terminal(cutoff, TERMINAL_TURNS, "completed_at", None), limit, "id", F.col("completed_at"))


def complete_turns(turns: DataFrame, messages: DataFrame, done: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(turns, messages) after done (turn id, content) completes RUNNING or INTERRUPTED turns, once each, with a message."""
    open_ = turns.where(F.col("status").isin("RUNNING", "INTERRUPTED"))
    won = open_.join(done.dropDuplicates(["id"]), "id").select("id", "session_id", "content")
    hit = won.select(F.col("id").alias("_won"))
    state = turns.join(hit, turns["id"] == F.col("_won"), "left").withColumns({
        "status": F.when(F.col("_won").isNotNull(), "COMPLETED").otherwise(F.col("status")),
        "completed_at": F.when(F.col("_won").isNotNull(), now).otherwise(F.col("completed_at")),
    }).drop("_won")
    added = won.select("session_id", F.lit("assistant").alias("role"), "content", now.alias("created_at"))
    return state, messages.unionByName(added, allowMissingColumns=True)


def fail_turns(df: DataFrame, which: Column, error: str) -> Change:
    """completed_at stays null, as deletion by age relies on."""
    return transition(df, ("RUNNING", "INTERRUPTED"), "FAILED", which, error=error)


def interrupt_turns(df: DataFrame, which: Column, approval: Column) -> Change:
    return transition(df, ("RUNNING",), "INTERRUPTED", which, **({"approval_id": approval} if "approval_id" in df.columns else {}))


def claim_runs(df: DataFrame, which: Column, owner: Column, now: Column) -> Change:
    """INTERRUPTED runs of their owner, with a checkpoint, are taken up by one claimant."""
    return transition(df, ("INTERRUPTED",), "RESUMING", which & (F.col("requested_by") == owner) & F.col("checkpoint_id").isNotNull(), updated_at=now)


def finish_runs(df: DataFrame, which: Column, now: Column, error: str | None = None) -> Change:
    """RUNNING and RESUMING runs complete, or fail with an error code."""
    values = {"updated_at": now} | ({"error_code": error} if error else {})
    return transition(df, ("RUNNING", "RESUMING"), "FAILED" if error else "COMPLETED", which, **values)


def interrupt_runs(df: DataFrame, which: Column, approval: Column, now: Column) -> Change:
    """RUNNING runs wait for an approval; a run that is being resumed isn't interrupted."""
    return transition(df, ("RUNNING",), "INTERRUPTED", which, approval_id=approval, updated_at=now)


def release_runs(df: DataFrame, which: Column, now: Column) -> Change:
    return transition(df, ("RESUMING",), "INTERRUPTED", which, updated_at=now)


def list_datasets(df: DataFrame, name: str = "", kind: str = "", visibility: str = "") -> DataFrame:
    """Filters by part of the name, type and visibility; a blank one admits any."""
    if name.strip():
        df = df.where(F.lower("name").contains(name.strip().lower()))
    for column, value in (("type", kind), ("visibility", visibility)):
        df = df.where(F.col(column) == value) if value.strip() else df
    return df


def set_checkpoints(df: DataFrame, rows: DataFrame, now: Column, ttl: int = CHECKPOINT_TTL_SECONDS) -> DataFrame:
    """New checkpoints live for ttl; known ones get the payload and keep their expiry."""
    merged = df.join(rows.withColumnRenamed("payload", "_new"), "checkpoint_id", "full")
    return merged.select("checkpoint_id", F.coalesce("_new", "payload").alias("payload"), F.coalesce(F.col("expires_at"), after(now, ttl)).alias("expires_at"))


def live_checkpoints(df: DataFrame, now: Column) -> DataFrame:
    return df.where(F.col("expires_at") > now)


def delete_expired_checkpoints(df: DataFrame, cutoff: Column, limit: int | None = BATCH) -> Removed:
    """The first `limit` checkpoints that expired before the cutoff go, without a limit all."""
    return _without_first(df, F.col("expires_at") < cutoff, limit, "checkpoint_id", F.col("expires_at"))


def history(sessions: DataFrame, messages: DataFrame, session: Column, owner: Column) -> DataFrame:
    """Messages of an owned session, oldest first; a foreign session looks like none."""
    own = sessions.where(session & (F.col("owner") == owner)).select(F.col("id").alias("_id"))
    return messages.join(own, F.col("session_id") == F.col("_id"), "left_semi").orderBy("created_at", "id")


def get_or_create_sessions(df: DataFrame, wanted: DataFrame, now: Column) -> DataFrame:
    fresh = wanted.dropDuplicates(["session_id"]).join(df.select("session_id"), "session_id", "left_anti")
    return df.unionByName(fresh.withColumn("created_at", now), allowMissingColumns=True)


def grant(grants: DataFrame, datasets: DataFrame, subject: str, dataset_id: int) -> DataFrame:
    """Once, and only to an ACTIVE dataset."""
    ok = datasets.where((F.col("id") == dataset_id) & (F.col("status") == "ACTIVE")).select(F.lit(subject).alias("subject"), F.col("id").alias("dataset_id"))
    return grants.unionByName(ok.join(grants, ["subject", "dataset_id"], "left_anti"), allowMissingColumns=True)


def revoke(grants: DataFrame, subject: str, dataset_id: int) -> Change:
    return delete(grants, (F.col("subject") == subject) & (F.col("dataset_id") == dataset_id))


def document_status(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, chunks, indexed, failed, status): ready when all are indexed, failed when any is, else indexing."""
    per = chunks.groupBy("document_id").agg(
        F.count("*").alias("chunks"), F.count_if(F.col("vector_status") == "indexed").alias("indexed"), F.count_if(F.col("vector_status") == "failed").alias("failed")
    )
    out = documents.select("id").join(per, F.col("id") == F.col("document_id"), "left").select("id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("chunks", "indexed", "failed")])
    status = F.when(F.col("failed") > 0, "failed").when((F.col("chunks") > 0) & (F.col("indexed") == F.col("chunks")), "ready").otherwise("indexing")
    return out.withColumn("status", status)
