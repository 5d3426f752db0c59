import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from siltstone.operators import lifecycle as lc

NOW = dt.datetime(2026, 1, 10)
AGO, AHEAD = NOW - dt.timedelta(days=30), NOW + dt.timedelta(days=1)
APPROVAL = "id long, status string, expires_at timestamp, decided_at timestamp, requester string, checkpoint_id string, interrupt_id string, run_id string"


@pytest.fixture(scope="module")
def now():
    return F.lit(NOW)


def approvals(spark, *rows):
    return spark.createDataFrame([(k, *r, *[None] * (7 - len(r))) for k, r in enumerate(rows)], APPROVAL)


def states(df):
    return [r.status for r in df.orderBy("id").collect()]


def test_expire_and_decide(spark, now):
    df = approvals(spark, ("PENDING", AGO), ("PENDING", NOW), ("PENDING", AHEAD), ("APPROVED", AGO))
    expired = lc.expire(df, now)
    assert states(expired) == ["EXPIRED", "PENDING", "PENDING", "APPROVED"] and expired.where("decided_at is not null").count() == 0
    assert states(lc.expire(df, now, 0)) == ["PENDING", "PENDING", "PENDING", "APPROVED"]
    assert [r.id for r in lc.due(df, now).collect()] == [0]
    decided = lc.decide(df, F.lit(True), F.col("id") % 2 == 1, "ann", now)
    assert states(decided.state) == ["PENDING", "PENDING", "REJECTED", "APPROVED"] and decided.count() == 1


def test_resume_cycle(spark, now):
    df = approvals(spark, ("APPROVED", AHEAD, None, "ann", "c", "i", "r"), ("APPROVED", AHEAD, None, "ann", "c", "i"), ("APPROVED", AGO, None, "ann", "c", "i", "r"), ("APPROVED", AHEAD, None, "bob", "c", "i", "r"), ("PENDING", AHEAD))
    claimed = lc.claim(df, F.lit(True), F.lit("ann"), now).state
    assert states(claimed) == ["RESUMING", "APPROVED", "APPROVED", "APPROVED", "PENDING"]
    assert states(lc.release(claimed, F.lit(True)).state) == states(df)
    both = approvals(spark, *[("RESUMING", AHEAD, None, "ann", "c", "i", "r")] * 3)
    for calls, want in (([(0, "ann"), (0, "ann")], ["EXECUTED", "RESUMING", "RESUMING"]), ([(1, "bob"), (2, "ann"), (9, "ann")], ["RESUMING", "RESUMING", "EXECUTED"])):
        done = lc.consume(both, spark.createDataFrame(calls, "id long, requester string"), now, ("requester",))
        assert states(done) == want and [r.executed_at for r in done.where("status = 'EXECUTED'").collect()] == [NOW]
    assert states(lc.claim(approvals(spark, ("APPROVED", None, None, "ann", "c", "i", "r")), F.lit(True), F.lit("ann"), now).state) == ["RESUMING"]
    attached = lc.attach_checkpoint(df, F.lit(True), "c9", "i9", "r9")
    assert attached.count() == 1 and (row := attached.state.where("checkpoint_id = 'c9'").first()).id == 4 and row.run_id == "r9"
    assert lc.attach_checkpoint(df, F.lit(True), "", "i9", "r9").count() == 0 and lc.attach_checkpoint(attached.state, F.lit(True), "c", "i", "r").count() == 0
    created = lc.create_approvals(df, spark.createDataFrame([(9, "{}")], "id long, arguments string"), now).where("id = 9").first()
    assert created.status == "PENDING" and created.expires_at == NOW + dt.timedelta(minutes=30) and re.fullmatch(r"[0-9a-f-]{36}", created.approval_id)


def test_audit_rows_are_whole(spark, now):
    df = approvals(spark, ("APPROVED", AHEAD, None, "ann", "c", "i", "r"), ("PENDING", AHEAD), ("RESUMING", AHEAD), ("RESUMING", AHEAD), ("PENDING", AGO)).withColumns({"session_id": F.lit("s"), "tool": F.lit("shell"), "display_arguments": F.lit("{}")})
    none = spark.createDataFrame([], "event_type string, created_at timestamp")
    requests = spark.createDataFrame([(9, "bob", "t", '{"b": 1.0, "a": "x password=hunter2", "Secret": ["deep"]}', "z")], "id long, requester string, tool string, arguments string, session_id string")
    after = lc.create_approvals(lc.claim(lc.expire(df, now), F.lit(True), F.lit("ann"), now).state, requests, now)
    after = after.withColumn("status", F.when(F.col("id") == 2, "EXECUTED").when(F.col("id") == 3, "APPROVED").otherwise(F.col("status")))
    rows = {(r.approval_id, r.event_type, r.session_id, r.tool, r.payload, r.actor_subject, r.created_at) for r in lc.audit(none, df, after, now).collect()}
    shown = '{"Secret":"[REDACTED]","a":"x password=[REDACTED]","b":1.0}'
    assert rows == {(0, "approval.resuming", "s", "shell", "", "ann", NOW), (2, "approval.executed", "s", "shell", "{}", None, NOW), (9, "approval.created", "z", "t", shown, "bob", NOW)}
    assert lc.audit(none, df, after, now, F.lit("eve")).select("actor_subject").distinct().first()[0] == "eve"


def test_no_secret_is_kept(spark, now):
    have = approvals(spark, ("PENDING", AHEAD))
    rows = [('{"password": "hunter2"}',), ('["Authorization: hunter2", "db://u:hunter2@h"]',), ("hunter2",), ('{"a": "' + "hunter2" * 20 + '"}',), (None,), ('"hunter2" trailing',), ('{"q": "token = hunter2"} {"second": 1}',)]
    requests = spark.createDataFrame(rows, "arguments string").withColumns({"tool": F.lit("shell"), "requester": F.lit("ann")})
    made = lc.create_approvals(have, requests, now, most=100)
    new = made.where("id > 0").collect()
    assert len(new) == 3 and sorted(r.id for r in new) == [1, 2, 3] and len({r.approval_id for r in new}) == 3 and len({r.arguments_hash for r in new}) == 3
    assert [tuple(r) for r in made.where("id > 0").collect()] == [tuple(r) for r in new]  # ids stay
    refused = lc.refused_approvals(requests, 100)
    assert sorted(r.error for r in refused.collect()) == ["no arguments", "not a JSON value", "not a JSON value", "over 100 bytes"]
    trail = lc.audit(spark.createDataFrame([], "event_type string, created_at timestamp"), have, made, now)
    assert trail.count() == 3
    for kept in (made, refused, trail):
        assert "arguments" not in kept.columns and "hunter2" not in repr(kept.collect())
    with pytest.raises(ValueError, match="most"):
        lc.create_approvals(have, requests, now, most=0)


def test_retention(spark, now):
    df = approvals(spark, ("REJECTED", AGO, AGO), ("EXPIRED", AGO), ("EXECUTED", AGO, NOW), ("PENDING", AGO, AGO))
    cutoff = lc.before(now, 168)
    assert states(lc.delete_terminal(df, cutoff, lc.TERMINAL_APPROVALS, "decided_at").state) == ["EXPIRED", "EXECUTED", "PENDING"]
    assert states(lc.delete_terminal(df, cutoff, lc.TERMINAL_APPROVALS, "decided_at", "expires_at").state) == ["EXECUTED", "PENDING"]


def test_turns(spark, now):
    turns = spark.createDataFrame([(1, 7, "RUNNING", None, None), (2, 7, "COMPLETED", None, AGO), (3, 7, "INTERRUPTED", None, None), (4, 7, "FAILED", None, None)], "id long, session_id long, status string, error string, completed_at timestamp")
    none = spark.createDataFrame([], "session_id long, role string, content string, created_at timestamp")
    done = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id long, content string")
    turns, messages = lc.complete_turns(turns, none, done, now)
    turns, messages = lc.complete_turns(turns, messages, done, now)
    assert states(turns) == ["COMPLETED", "COMPLETED", "COMPLETED", "FAILED"] and sorted(r.content for r in messages.collect()) == ["x", "z"]
    removed = lc.delete_terminal_turns(turns, lc.before(now, 720 - 24))
    assert states(removed.state) == ["COMPLETED", "COMPLETED", "FAILED"] and [r.id for r in removed.ids.collect()] == [2]
    many = spark.createDataFrame([(k, "COMPLETED", AGO - dt.timedelta(hours=k % 3)) for k in range(9)], "id long, status string, completed_at timestamp")
    removed = lc.delete_terminal_turns(many, now, 4)
    assert sorted(r.id for r in removed.ids.collect()) == [1, 2, 5, 8] and removed.count() == 4 and removed.state.count() == 5
    for limit in (0, -1):
        with pytest.raises(ValueError, match="limit"):
            lc.delete_terminal_turns(many, now, limit)
    removed = lc.delete_terminal_turns(many, now, None)
    assert removed.count() == 9 and removed.state.count() == 0


def test_a_maintenance_round_does_all_that_is_due(spark, now):
    from siltstone.streaming import jobs

    approvals = spark.range(250).select("id", F.lit("PENDING").alias("status"), F.lit(AGO).alias("expires_at"), F.lit(None).cast("timestamp").alias("decided_at"))
    checkpoints = spark.range(251).select(F.col("id").alias("checkpoint_id"), F.when(F.col("id") > 0, F.lit(AGO)).alias("expires_at"))
    turns = spark.range(252).select("id", F.when(F.col("id") < 2, "RUNNING").otherwise("COMPLETED").alias("status"), F.when(F.col("id") > 1, F.lit(AGO)).alias("completed_at"))
    later = now + F.expr("INTERVAL 90 DAYS")
    a, c, t = jobs.maintain(approvals, checkpoints, turns, later)
    assert a.where("status = 'EXPIRED'").count() == 250 and [r.checkpoint_id for r in c.collect()] == [0] and sorted(r.id for r in t.collect()) == [0, 1]
    a, c, t = jobs.maintain(approvals, checkpoints, turns, later, 100)
    assert a.where("status = 'EXPIRED'").count() == 100 and c.count() == 151 and t.count() == 152


def test_checkpoints_sessions_grants(spark, now):
    have = spark.createDataFrame([("a", b"1", AHEAD), ("b", b"2", AGO)], "checkpoint_id string, payload binary, expires_at timestamp")
    new = spark.createDataFrame([("a", b"9"), ("c", b"3")], "checkpoint_id string, payload binary")
    state = {r.checkpoint_id: (bytes(r.payload), r.expires_at) for r in lc.set_checkpoints(have, new, now).collect()}
    assert state == {"a": (b"9", AHEAD), "b": (b"2", AGO), "c": (b"3", AHEAD)}
    removed = lc.delete_expired_checkpoints(have, now)
    assert lc.live_checkpoints(have, now).count() == 1 and [r.checkpoint_id for r in removed.ids.collect()] == ["b"] and [r.checkpoint_id for r in removed.state.collect()] == ["a"]
    assert removed.state.columns == have.columns
    sessions = spark.createDataFrame([(1, "s1", "ann", NOW)], "id long, session_id string, owner string, created_at timestamp")
    more = lc.get_or_create_sessions(sessions, spark.createDataFrame([("s1", "eve"), ("s2", "bob")], "session_id string, owner string"), now)
    assert {r.session_id: r.owner for r in more.collect()} == {"s1": "ann", "s2": "bob"}
    messages = spark.createDataFrame([(2, 1, NOW), (1, 1, NOW), (3, 1, AGO), (4, 2, AGO)], "id long, session_id long, created_at timestamp")
    assert [r.id for r in lc.history(sessions, messages, F.col("id") == 1, F.lit("ann")).collect()] == [3, 1, 2]
    assert lc.history(sessions, messages, F.col("id") == 1, F.lit("eve")).count() == 0
    grants = spark.createDataFrame([("ann", 1)], "subject string, dataset_id long")
    data = spark.createDataFrame([(1, "ACTIVE"), (2, "DISABLED"), (3, "ACTIVE")], "id long, status string")
    for dataset in (1, 2, 3):
        grants = lc.grant(grants, data, "ann", dataset)
    assert sorted(r.dataset_id for r in grants.collect()) == [1, 3]
    assert lc.revoke(grants, "ann", 1).count() == 1 and lc.revoke(grants, "eve", 1).count() == 0


def test_document_status(spark):
    chunks = spark.createDataFrame([(1, "indexed"), (1, "indexed"), (2, "indexed"), (2, "pending"), (3, "failed"), (3, "indexed")], "document_id long, vector_status string")
    got = {r.id: r.status for r in lc.document_status(chunks, spark.range(1, 5)).collect()}
    assert got == {1: "ready", 2: "indexing", 3: "failed", 4: "indexing"}
