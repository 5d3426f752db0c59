"""The way from chunks to the stored blocks: terms by array operations, blocks that move whole, and compaction."""

import pyarrow as pa
from pyspark.sql import functions as F

from siltstone.functions import text, words
from siltstone.operators import indexing as ix
from siltstone.operators import postings
from siltstone.operators import retrieval as r
from siltstone.operators.chunking import chunk

ODD = ["", "a b  a", None, "İstanbul İ", "ΟΔΟΣ Σ", "éa naïve", "x² Ⅷ ١٢", "\U0001d49cb c", "_a_b-c", "ࡰࡱx new letters", "中文。text", "end", "start", " \n ", "ẞﬁ", "9"]


def test_terms_of_batches_are_those_of_expressions(spark):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(ODD)], "k long, t string").coalesce(1)
    want = [x.ts or [] for x in df.select("k", r.terms("t").alias("ts")).orderBy("k").collect()]
    lowered = pa.array([x.t for x in df.select("k", F.lower("t").alias("t")).orderBy("k").collect()])
    holds = words.letters(words.edges(spark))
    for at, n in ((0, len(ODD)), (3, 5), (len(ODD), 0), (2, 1)):
        found, counts = words.split(lowered.slice(at, n), holds)
        assert counts.tolist() == [len(x) for x in want[at : at + n]] == words.count(lowered.slice(at, n), holds).tolist()
        assert found.to_pylist() == [t for x in want[at : at + n] for t in x]
    pieces = chunk(df.withColumn("n", F.size(F.coalesce(r.terms("t"), F.array()))), "t", counted=True)
    assert pieces.where("chunk_index = 0").select("terms", "n").where("terms <> n").count() == 0 and pieces.count() == sum(bool(x and x.strip()) for x in ODD)


def test_blank_is_seen_at_the_first_character(spark):
    rows = ["", " \n 　", "x", " x ", None, " " * 50 + " ", "​", "\n"]
    df = spark.createDataFrame([(x,) for x in rows], "t string").coalesce(1)
    out = df.select(text.is_blank("t").alias("b"), (text.trim_unicode("t") == "").alias("w")).collect()
    assert [x.b for x in out] == [x.w for x in out] == [True, True, False, False, None, True, False, True]
    assert "regexp_replace" not in df.where(text.is_blank("t"))._jdf.queryExecution().optimizedPlan().toString().lower()


def _chunks(spark, n):
    text_ = F.concat(F.lit("all all "), F.repeat(F.lit("some "), (F.col("id") % 4).cast("int")), F.concat(F.lit("w"), (F.col("id") % 9).cast("string")))
    return spark.range(1, n + 1, 1, 2).select(F.col("id").alias("document_id"), (F.col("id") % 3).cast("int").alias("chunk_index"), text_.alias("content"), F.when(F.col("id") % 2 == 0, F.lit("all t")).alias("title"))


def test_postings_move_as_blocks(spark, monkeypatch):
    """What is shuffled and sorted is a row for a task's postings of a term, not a row for a posting; nothing is lost by it, at any sizes."""
    chunks = _chunks(spark, 600)
    want = {tuple(x) for x in r.inverted_index(chunks.withColumn("id", F.struct("document_id", "chunk_index")), ["content", "title"]).select("id.*", "field", "term", "tf", "dl").collect()}
    assert postings.inverted(chunks, ("content", "title")).count() <= 60 < len(want) / 20
    for block, held, part in ((256, 1 << 21, 8192), (4, 50, 3)):
        monkeypatch.setattr(postings, "BLOCK", block)
        monkeypatch.setattr(postings, "HELD", held)
        monkeypatch.setattr(postings, "BATCH_ROWS", part)
        stored = postings.blocks(postings.inverted(chunks, ("content", "title")))
        rows = postings.opened(stored).select("document_id", "chunk_index", "field", "term", "tf", "dl").collect()
        assert len(rows) == len(want) and {tuple(x) for x in rows} == want
        assert stored.agg(F.max("n")).first()[0] <= block and stored.where("most_tf > total OR least_dl < 1 OR total < n").count() == 0
        totals = {(x.field, x.term): (x.n, x.total) for x in postings.statistics(stored, 600, ("content", "title")).collect()}
        assert totals["content", None] == (600, sum(x[4] for x in want if x[2] == "content")) and totals["content", "all"] == (600, 0) and totals["title", "t"] == (300, 0)


def test_compaction_opens_no_block(spark, tmp_path, monkeypatch):
    stores = ix.Stores(f"file://{tmp_path}/index")
    docs = spark.range(1, 201).select("id", F.lit("t").alias("title"), F.concat_ws(" ", F.lit("alpha"), F.concat(F.lit("w"), F.col("id") % 7)).alias("text"))
    ix.index_documents(docs, stores, ix.hash_embedder(4), 4, "hash")
    ix.index_documents(docs.where("id % 5 = 0").withColumn("text", F.lit("beta beta")), stores, ix.hash_embedder(4), 4, "hash")
    state = lambda: {tuple(x) for x in stores.terms(spark).select("document_id", "chunk_index", "field", "term", "tf", "dl").collect()}
    before, opened = state(), postings.opened

    def never(df):
        raise AssertionError("blocks were opened")

    monkeypatch.setattr(postings, "opened", never)
    stores.compact(spark)
    monkeypatch.undo()
    assert state() == before and len(before) == 160 * 3 + 40 * 2
    assert stores.segments().every(spark, "postings").agg(F.sum("n")).first()[0] == len(before)
    # Beyond what is shipped to every task, the documents that are gone are joined.
    ix.index_documents(docs.where("id % 5 = 1").withColumn("text", F.lit("gamma")), stores, ix.hash_embedder(4), 4, "hash")
    before = state()
    monkeypatch.setattr(ix, "BROADCAST_DOCUMENTS", 0)
    stores.compact(spark)
    assert state() == before and postings.opened is opened
