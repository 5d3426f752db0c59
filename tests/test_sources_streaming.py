import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from siltstone.sources import files
from siltstone.streaming import jobs, stateful


def test_content_store(tmp_path):
    store = files.ContentStore(str(tmp_path / "root"), most=40)
    source = store.create(7, "guide", "# 安装\n\n正文")
    assert source.startswith("documents/7/guide-") and store.read(source) == "# 安装\n\n正文" and store.managed(source)
    store.write(source, "new")
    assert store.read(source) == "new"
    store.remove(source)
    store.remove(source)
    assert not store.exists(source)
    outside = tmp_path / "secret.md"
    outside.write_text("x")
    os.symlink(outside, tmp_path / "root" / "link.md")
    for bad in ("../secret.md", "link.md", str(outside), "documents/../../secret.md"):
        with pytest.raises(files.OutsideRoot):
            store.read(bad)
    registered = tmp_path / "root" / "own.md"
    registered.write_text("kept")
    with pytest.raises(files.OutsideRoot):
        store.write("own.md", "y")
    store.remove("own.md")
    assert store.read("own.md") == "kept"
    for missing in ("no.md", "", "  "):
        with pytest.raises(files.ContentNotFound):
            store.read(missing)
    small = files.ContentStore(str(tmp_path / "root"), most=4)
    small.create(1, "a", "1234")
    with pytest.raises(files.ContentTooLarge):
        small.create(1, "b", "12345")
    registered.write_text("12345")
    with pytest.raises(files.ContentTooLarge):
        small.read("own.md")


def test_loaders(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.MD").write_text("# A\nx")
    (tmp_path / "sub" / "p.txt").write_text("---\nproduct_id: P1\n---\nbody")
    (tmp_path / "skip.csv").write_text("1")
    (tmp_path / "big.md").write_text("y" * 100)
    got = files.load_documents(spark, f"file://{tmp_path}", 50, skip=True).collect()
    assert sorted(os.path.basename(r.source) for r in got) == ["a.MD", "p.txt"]
    assert [r.product_id for r in files.load_products(spark, f"file://{tmp_path}", 50, skip=True).collect()] == ["P1"]
    with pytest.raises(files.NotReadable, match="skip.csv|big.md"):
        files.load_documents(spark, f"file://{tmp_path}", 50)
    os.remove(tmp_path / "skip.csv")
    with pytest.raises(files.NotReadable, match="big.md"):
        files.load_documents(spark, f"file://{tmp_path}", 50)
    assert files.load_documents(spark, f"file://{tmp_path}").count() == 3
    (tmp_path / "md").write_text("no extension")
    with pytest.raises(files.NotReadable):
        files.load_documents(spark, f"file://{tmp_path}")
    files.write_partitioned(spark.range(4).withColumn("d", F.col("id") % 2), f"file://{tmp_path}/out", "d")
    assert spark.read.parquet(f"file://{tmp_path}/out").where("d = 1").count() == 2


def test_queue_stream(spark, tmp_path):
    source, target = f"file://{tmp_path}/in", f"file://{tmp_path}/vectors"
    schema = "type string, chunk_id long, content string, version int"
    put = lambda *rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
    sink = jobs.index_sink(target, lambda df: df.select("chunk_id", F.array(F.length("content").cast("float")).alias("embedding"), "version"))
    dispatcher = jobs.Dispatcher()
    dispatcher.register("index", sink)
    with pytest.raises(ValueError):
        dispatcher.register("index", sink)

    def drain():
        stream = spark.readStream.schema(schema).parquet(source)
        jobs.run_queue(stream, dispatcher, f"{tmp_path}/state").awaitTermination()

    put(("index", 1, "a", 1), ("index", 1, "aaa", 2))
    drain()
    put(("index", 2, "bb", 1), ("index", 1, "aaaaa", 3))
    drain()
    drain()  # nothing new: nothing changes
    latest = lambda: {r.chunk_id: (r.embedding[0], r.version) for r in jobs.latest_vectors(spark, target).collect()}
    assert latest() == {1: (5.0, 3), 2: (2.0, 1)}
    jobs.compact_vectors(spark, target)
    assert latest() == {1: (5.0, 3), 2: (2.0, 1)} and [p.name for p in (tmp_path / "vectors").iterdir()] == ["epoch=1"]
    put(("index", 2, "bbb", 2))
    drain()
    assert latest() == {1: (5.0, 3), 2: (3.0, 2)}


def test_tasks_without_a_handler_are_not_lost(spark):
    ran = []
    dispatcher = jobs.Dispatcher()
    dispatcher.register("index", lambda batch, epoch: ran.append(batch.count()))
    rows = lambda *kinds: spark.createDataFrame([(k,) for k in kinds], "type string")
    for kinds in (("index", "other"), ("index", None)):
        with pytest.raises(jobs.UnknownTask):
            dispatcher(rows(*kinds), 1)
    assert not ran
    dispatcher(rows("index", "index"), 2)
    assert ran == [2]


def test_queue_options(spark):
    now = dt.datetime(2024, 1, 1)
    none = spark.createDataFrame([], "id long, type string, payload string, queue string, process_at timestamp, max_retry int, timeout int, tries int, status string")
    new = spark.createDataFrame([(1, "a", "x", None, None, 2), (2, "a", "x", 30, None, None), (3, "b", "x", 30, dt.datetime(2023, 1, 1), 0)], "id long, type string, payload string, process_in int, process_at timestamp, max_retry int")
    tasks = jobs.enqueue(none, new, F.lit(now))
    assert {(r.id, r.process_at, r.max_retry, r.timeout, r.queue) for r in tasks.collect()} == {(1, now, 2, 1800, "default"), (2, now + dt.timedelta(seconds=30), 25, 1800, "default"), (3, dt.datetime(2023, 1, 1), 0, 1800, "default")}
    fail = spark.createDataFrame([(1, False, 1), (1, True, 1), (3, True, 1801), (9, True, 1)], "id long, ok boolean, seconds int")
    seen = []
    for k in range(4):
        at = now + dt.timedelta(days=k)
        tasks = jobs.settle(tasks, fail.join(jobs.due_tasks(tasks, F.lit(at)).select("id"), "id", "left_semi"), F.lit(at))
        seen.append([(r.status, r.tries) for r in tasks.orderBy("id").collect()])
        assert tasks.where("id = 1").first().process_at == at + dt.timedelta(seconds=15 * (k + 1) ** 2) or k >= 2
    assert seen == [[("retry", 1), ("pending", 0), ("archived", 1)], [("retry", 2), ("pending", 0), ("archived", 1)], *[[("archived", 3), ("pending", 0), ("archived", 1)]] * 2]


def test_windows_of_streams_close(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, h), "a", 1.0) for h in range(12)]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").write.parquet(f"file://{tmp_path}/e")
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(f"file://{tmp_path}/e")
    plan = jobs.tumbling(stream, "1 hour")._jdf.queryExecution().toString()
    assert "EventTimeWatermark" in plan


def test_windows_stream_equals_batch(spark, tmp_path):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rows = [(at(k * 1.7), k % 3, "ab"[k % 2], float(k)) for k in range(40)]
    spark.createDataFrame(rows, "ts timestamp, user_id int, event_type string, value double").write.parquet(f"file://{tmp_path}/e")
    batch = spark.read.parquet(f"file://{tmp_path}/e")
    for build in (lambda e: jobs.tumbling(e, "6 hours", "1 hour"), lambda e: jobs.sliding(e, "6 hours", "3 hours", "1 hour"), lambda e: jobs.sessions(e, "2 hours", "1 hour")):
        out = build(spark.readStream.schema(batch.schema).parquet(f"file://{tmp_path}/e"))
        name = f"w{id(build)}"
        out.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
        assert sorted(map(repr, spark.table(name).collect())) == sorted(map(repr, build(batch).collect()))


def test_tasks_messages_gauge(spark):
    now = F.lit(dt.datetime(2024, 1, 1))
    tasks = spark.createDataFrame([(1, None, None), (2, dt.datetime(2023, 1, 1), 2), (3, dt.datetime(2025, 1, 1), 0), (4, None, 3)], "id int, process_at timestamp, tries int")
    assert sorted(r.id for r in jobs.due_tasks(tasks, now).collect()) == [1, 2]
    chunks = spark.createDataFrame([(1, "pending", 0), (2, "pending", 3), (3, "indexed", 0), (4, "pending", None)], "chunk_id long, vector_status string, tries int")
    assert sorted(r.chunk_id for r in jobs.pending_chunks(chunks, chunks.where("chunk_id = 4")).collect()) == [1]
    deltas = spark.createDataFrame([("t", 2, "message", "b"), ("t", 1, "message", "a"), ("t", 3, "done", None), ("u", 1, "message", "x"), ("v", 1, "error", "boom")], "turn_id string, seq int, type string, content string")
    assert {r.turn_id: (r.content, r.outcome) for r in jobs.messages(deltas).collect()} == {"t": ("ab", "done"), "u": ("x", "open"), "v": ("", "error")}
    spans = spark.createDataFrame([("r", 1, 5), ("r", 2, 3), ("r", 5, 6)], "route string, start int, end int")
    assert {r["at"]: r.in_flight for r in jobs.in_flight(spans).collect()} == {1: 1, 2: 2, 3: 1, 5: 1, 6: 0}
    many = spark.range(500).select(F.concat(F.lit("r"), F.col("id") % 2).alias("route"), F.col("id").alias("start"), (F.col("id") + F.col("id") % 17 + 1).alias("end"))
    open_ = lambda route, at: sum(1 for k in range(500) if k % 2 == route and k <= at < k + k % 17 + 1)
    rows = jobs.in_flight(many).collect()
    assert len(rows) > 500 and all(r.in_flight == open_(int(r.route[1]), r["at"]) for r in rows)


def test_maintenance_runs_on(spark, tmp_path):
    rounds = []

    def once(epoch):
        rounds.append(epoch)
        raise RuntimeError("this round fails")

    query = jobs.run_maintenance(spark, once, f"{tmp_path}/m", seconds=1)
    query.awaitTermination(6)
    assert query.isActive and len(rounds) >= 2
    query.stop()


def _stream_of(spark, folder, schema, step, tmp_path, name):
    """Puts rows into a folder and runs the stream over it to its end, from where the last call stopped; gives its last progress."""
    def put(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{folder}")
        query = stateful.run_into(step(spark.readStream.schema(schema).parquet(f"file://{folder}")), f"file://{tmp_path}/{name}-out", f"{tmp_path}/{name}-state")
        query.awaitTermination()
        return query.lastProgress["stateOperators"][0]["numRowsTotal"]

    return put


def test_tasks_with_timers(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    schema = "id long, kind string, at timestamp, process_at timestamp, max_retry int, timeout int, attempt int, ok boolean"
    task = lambda id, s, start=None, retries=1, timeout=10: (id, "task", at(s), start and at(start), retries, timeout, None, None)
    result = lambda id, s, attempt, ok: (id, "result", at(s), None, None, None, attempt, ok)
    clock = lambda s: (-1, "clock", at(s), None, None, None, None, None)
    put = _stream_of(spark, tmp_path / "in", schema, lambda s: stateful.task_moves(s, "0 seconds", groups=2), tmp_path, "t")
    open_after = [
        put([task(1, 0), task(2, 0, 50), task(3, 0, retries=0), task(4, 0), task(1, 1), result(1, 10, 1, True), result(4, 5, 1, False), result(4, 6, 1, True), (None, *clock(3)[1:]), (6, None, at(3), None, None, None, None, None), (7, *task(7, 0)[1:2], None, *task(7, 0)[3:]), clock(12)]),
        put([result(2, 55, 1, False), result(4, 21, 2, True), task(5, 13, 14), clock(60)]),  # the stream starts again from its state
        put([result(2, 70, 1, True), result(2, 75, 2, True), result(5, 60, 1, True), clock(200)]),
        put([clock(300)]),
    ]
    moves = {}
    for r in spark.read.parquet(f"file://{tmp_path}/t-out").orderBy("at", "tries").collect():
        moves.setdefault(r.id, []).append((r.status, r.tries, (r["at"] - at(0)).total_seconds()))
    assert moves == {
        1: [("active", 1, 0), ("completed", 1, 10)],  # just in time; the second task of its id changes nothing
        2: [("active", 1, 50), ("retry", 1, 55), ("active", 2, 70), ("completed", 2, 75)],  # a result of the first try comes too late
        3: [("active", 1, 0), ("archived", 1, 10)],
        4: [("active", 1, 0), ("retry", 1, 5), ("active", 2, 20), ("completed", 2, 21)],
        5: [("active", 1, 14), ("retry", 1, 24), ("active", 2, 39), ("archived", 2, 49)],
    }
    assert open_after[0] >= 1 and open_after[-1] == 0


def test_stream_of_messages_equals_batch_and_drops_its_state(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    schema = "turn_id string, seq long, type string, content string, at timestamp"
    first = [("a", 2, "message", "y", at(3)), ("a", 1, "message", "x", at(2)), ("b", 1, "message", "lost", at(2)), ("c", 1, "message", "p", at(4)), ("e", 1, "done", None, at(5)), ("f", 1, "message", None, at(5))]
    second = [("a", 3, "message", "z", at(6)), ("a", 4, "done", None, at(7)), ("c", 3, "error", "boom", at(8)), ("c", 2, "message", "q", at(7)), ("f", 2, "done", None, at(9))]
    put = _stream_of(spark, tmp_path / "in", schema, lambda s: stateful.assembled(s, "1 second", 60, groups=2), tmp_path, "m")
    clock = lambda s: ("", 0, "clock", None, at(s))
    left = [put(first), put(second), put([clock(30)]), put([clock(100)]), put([clock(101)])]
    got = {r.turn_id: (r.content, r.outcome) for r in spark.read.parquet(f"file://{tmp_path}/m-out").collect()}
    batch = {r.turn_id: (r.content, r.outcome) for r in jobs.messages(spark.createDataFrame(first + second, schema)).collect()}
    assert got == batch == {"a": ("xyz", "done"), "b": ("lost", "open"), "c": ("pq", "error"), "e": ("", "done"), "f": ("", "done")}
    assert left[0] == 2 and left[2] == 1 and left[-1] == 0


def test_product_files_stay_below_the_loaders_limit(spark, tmp_path):
    from siltstone.plans import scalars

    spark.range(50_000).select(F.col("id").alias("p_partkey"), F.lit("b").alias("p_brand"), F.lit("name " * 20).alias("p_name"), F.lit("t").alias("p_type"), F.lit(5).alias("p_size")).coalesce(1).write.parquet(f"file://{tmp_path}/part.parquet")
    got = scalars.load_product_files(spark, f"file://{tmp_path}")
    assert got.select("product_id").distinct().count() == 50_000 == got.count()
