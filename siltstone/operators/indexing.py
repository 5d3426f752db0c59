"""From documents to an index: embed chunks, and write chunks, vectors, terms and lengths.

The stores are folders of Parquet with a segment for each run. A run writes the rows of
its documents alone, and what it writes to all stores is published in one step, so
running it again ends in the same state, a document that has become shorter leaves
nothing behind, and a run that fails leaves what was there.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import words
from siltstone.functions.vector import narrow
from siltstone.operators.chunking import DEFAULT_CHARS, chunk
from siltstone.operators import postings
from siltstone.operators.generations import Segments, State
from siltstone.operators.retrieval import OVERFETCH, Options, checked_queries, knn, rrf, terms, top, validated
from siltstone.runtime import cut, remove, scratch

# Texts an embedding call takes, and the form of a collection's name.
EMBED_BATCH = 32
#: Terms whose place the stand-in embedder remembers.
KNOWN_TERMS = 1 << 18
#: Row groups of the stores, small so that a term is read without its neighbours.
GROUP_BYTES = 8 << 20
COLLECTION_NAME = r"^[A-Za-z_][A-Za-z0-9_]{0,254}$"

Embedder = Callable[[list[str]], list[list[float]]]


def hash_embedder(dims: int = 16) -> Embedder:
    """A stand-in for a model: counts of terms by a digit of their MD5, as a unit vector (all zero without terms)."""

    class Known(dict):
        def __missing__(self, term: str) -> int:
            if len(self) >= KNOWN_TERMS:
                self.clear()
            found = self[term] = (hashlib.md5(term.encode()).digest()[0] >> 4) % dims
            return found

    known = Known()

    def embed(texts: list[str]) -> list[list[float]]:
        found, counts = words.split(pa.array([text.lower() for text in texts], pa.string()), words.alphanumeric())
        coded = found.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        places = np.fromiter(map(known.__getitem__, names), np.int64, len(names))[coded.indices.to_numpy()]
        row = np.repeat(np.arange(len(texts)), counts)
        out = np.bincount(row * dims + places, minlength=len(texts) * dims).reshape(-1, dims).astype(float)
        norm = np.sqrt((out**2).sum(axis=1, keepdims=True))
        return (out / np.where(norm == 0, 1, norm)).tolist()

    return embed


def _embedded(batches: Iterator[pa.RecordBatch], column: str, embedder: Embedder, dims: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index(column)
        texts = [t or "" for t in batch.column(at).to_pylist()]
        vectors: list[list[float]] = []
        for k in range(0, len(texts), EMBED_BATCH):
            part = embedder(texts[k : k + EMBED_BATCH])
            if len(part) != len(texts[k : k + EMBED_BATCH]):
                raise ValueError(f"{len(part)} vectors for {len(texts[k : k + EMBED_BATCH])} texts")
            if any(len(v) != dims for v in part):
                raise ValueError(f"a vector's dimension isn't {dims}")
            vectors += part
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float64()))], [*batch.schema.names, "embedding"])


def embed(df: DataFrame, column: str, embedder: Embedder, dims: int) -> DataFrame:
    """df with an embedding of a text column, in single precision, by calls of EMBED_BATCH texts."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", embedding array<double>"
    return df.mapInArrow(lambda batches: _embedded(batches, column, embedder, dims), schema).withColumn("embedding", narrow(F.col("embedding")))


#: What names a chunk, in every store.
CHUNK = ("document_id", "chunk_index")
_KEY = "document_id bigint, chunk_index int"
FIELDS = ("content", "title")
#: The stores of an index; a document's attributes are what searches can be narrowed by.
STORES = {
    "documents": "document_id bigint, title string, visibility string, owner_subject string, dataset_id bigint",
    "chunks": f"{_KEY}, title string, heading_path string, content string, digest string, terms int",
    "vectors": f"{_KEY}, embedding array<float>",
    "postings": f"{postings.BLOCKS}, block bigint",
    "statistics": "field string, term string, n bigint, total bigint",
}
#: Documents that a search is narrowed to are broadcast up to so many; more are joined by a shuffle.
BROADCAST_DOCUMENTS = 200_000


@dataclass(frozen=True)
class Stores:
    """The stores of one index below root. Every run adds a segment to each and publishes them together, so a reader sees all of a run or nothing."""

    root: str

    def segments(self) -> Segments:
        return Segments(self.root, "document_id")

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        """The live rows of documents, chunks or vectors; terms gives the postings'."""
        return self.segments().read(spark, name)

    def terms(self, spark: SparkSession) -> DataFrame:
        """(document_id, chunk_index, field, term, tf, dl), live."""
        return self.segments().live(postings.opened(self.segments().every(spark, "postings"))).drop("_segment")

    def begin(self, spark: SparkSession) -> State:
        """The state that is written now. One writer at a time is assumed."""
        return self.segments().next(spark, *STORES)

    def put(self, rows: DataFrame, name: str, state: State) -> DataFrame:
        """Write a store's rows of the state; gives them as they were written, so nothing need be computed or kept twice."""
        typed = [F.col(c).cast(t).alias(c) for c, t in (x.strip().split(" ", 1) for x in STORES[name].split(", "))]
        self.segments().put(rows.select(*typed), name, state, **{"parquet.block.size": GROUP_BYTES, "compression": "zstd"})
        return rows.sparkSession.read.parquet(self.segments().path(f"{name}/segment={state.n}"))

    def put_postings(self, parts: DataFrame, state: State) -> DataFrame:
        """Write postings from blocks in any order. They are kept once before, as a shuffle by ranges goes through its input twice."""
        spark, path = parts.sparkSession, scratch(parts.sparkSession, "postings")
        parts.write.options(**{"parquet.enable.dictionary": "false", "compression": "zstd"}).parquet(path)
        out = self.put(postings.blocks(spark.read.parquet(path)), "postings", state)
        remove(spark, path)
        return out

    def live_postings(self, spark: SparkSession) -> DataFrame:
        """Blocks of what self.terms gives."""
        segments = self.segments()
        every, gone = segments.every(spark, "postings"), segments.gone(spark)
        if gone is None or gone.count() <= BROADCAST_DOCUMENTS:
            return postings.kept(every, None if gone is None else gone.toArrow())
        return postings.closed(segments.live(postings.opened(every)))

    def finish(self, documents: DataFrame, state: State) -> None:
        """What the documents (document_id) had before gives way to the state's rows, in all stores at once."""
        self.segments().take(documents, state)
        self.segments().publish(documents.sparkSession, state)

    def compact(self, spark: SparkSession) -> None:
        """All segments become one, so that reads don't grow with the runs."""
        segments = self.segments()
        state = segments.next(spark, *STORES)
        for name in ("documents", "chunks", "vectors"):
            self.put(self.read(spark, name), name, state)
        self.put_postings(self.live_postings(spark), state)
        totals = segments.every(spark, "statistics").groupBy("field", "term").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).where("n > 0")
        segments.put(totals.repartitionByRange("term", "field").sortWithinPartitions("term"), "statistics", state)
        segments.rebase(spark, state, *STORES)


def ensure_collection(spark: SparkSession, name: str, dims: int) -> None:
    """Create a vector table unless it is there; one of another dimension or schema is an error."""
    if not re.match(COLLECTION_NAME, name):
        raise ValueError(f"bad collection name {name!r}")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (chunk_id BIGINT, embedding ARRAY<FLOAT>) USING parquet TBLPROPERTIES ('dims' = '{dims}')")
    have = spark.table(name)
    found = spark.sql(f"SHOW TBLPROPERTIES {name}('dims')").first()["value"]
    if [f.dataType.simpleString() for f in have.schema] != ["bigint", "array<float>"] or found != str(dims):
        raise ValueError(f"{name} is not a collection of {dims} dimensions")


def chunk_id() -> Column:
    """A chunk's name as one string."""
    return F.concat_ws("#", *CHUNK)


def index_documents(docs: DataFrame, stores: Stores, embedder: Embedder, dims: int, model: str, most: int = DEFAULT_CHARS) -> dict[str, int]:
    """Chunk, embed and write docs (id, title, text, and what else of STORES["documents"] there is) as one state of the stores.

    A chunk whose document had one of the same content before keeps that one's vector; only the others are
    embedded. Gives how many chunks there are, and how many were embedded. A failure anywhere leaves the state before.
    """
    spark = docs.sparkSession
    named = docs.withColumnRenamed("id", "document_id")
    mine = cut(named.select("document_id").distinct())
    had = bool(stores.segments().state(spark))
    state = stores.begin(spark)
    known = [c if c in docs.columns else F.lit(None).alias(c) for c in ("title", "visibility", "owner_subject", "dataset_id")]
    stores.put(named.select("document_id", *known), "documents", state)
    every = chunk(named.select("document_id", "title", "text"), most=most, counted=True).withColumn("digest", F.sha2(F.col("content").cast("binary"), 256))
    pieces = stores.put(every.withColumn("terms", F.col("terms") + F.size(terms(F.coalesce("title", F.lit(""))))), "chunks", state)
    keyed, old, fresh = pieces.select(*CHUNK, "digest"), None, pieces
    if had:
        old = stores.read(spark, "chunks").join(mine, "document_id", "left_semi")
        have = stores.read(spark, "vectors").join(old.select(*CHUNK, "digest"), list(CHUNK)).groupBy("document_id", "digest").agg(F.min_by("embedding", "chunk_index").alias("embedding"))
        kept = cut(keyed.join(have, ["document_id", "digest"]).select(*CHUNK, "embedding"))
        fresh = pieces.join(kept.select(*CHUNK), list(CHUNK), "left_anti")
    added = cut(embed(fresh.select(*CHUNK, "content"), "content", embedder, dims).select(*CHUNK, "embedding"))
    stores.put(validated(added.unionByName(kept) if had else added, dims, model, CHUNK), "vectors", state)
    blocks = stores.put_postings(postings.inverted(pieces, FIELDS), state)
    chunks_ = pieces.count()
    changes = postings.statistics(blocks, chunks_, FIELDS)
    if had:  # what the documents had before no longer counts
        gone = postings.statistics(cut(postings.inverted(old, FIELDS)), old.count(), FIELDS, -1)
        changes = changes.unionByName(gone).groupBy("field", "term").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).where("n <> 0 or total <> 0")
    stores.put(changes.repartitionByRange("term", "field").sortWithinPartitions("term"), "statistics", state)
    stores.finish(mine, state)
    return {"chunks": chunks_, "embedded": added.count()}


def search_index(spark: SparkSession, stores: Stores, queries: DataFrame, dims: int, options: Options = Options(), vectors: bool = True, where: Column | None = None) -> DataFrame:
    """(query_id, query, id, score, rank) over the stores, id as chunk_id() gives it: the fused channels, or the keyword one alone.

    where narrows both channels to the chunks of documents whose attributes it holds for, before either is cut to its best;
    terms weigh what they weigh in the whole index.
    """
    most = OVERFETCH * options.top_k
    asked = cut(checked_queries(queries))
    segments = stores.segments()
    if where is None:
        within = lambda df: df
    else:
        allowed = cut(stores.read(spark, "documents").where(where).select("document_id").distinct())
        allowed = F.broadcast(allowed) if allowed.count() <= BROADCAST_DOCUMENTS else allowed
        within = lambda df: df.join(allowed, "document_id", "left_semi")
    hits = postings.search(segments.every(spark, "postings"), segments.every(spark, "statistics"), lambda df: within(segments.live(df)), asked, most)
    words = hits.select("query_id", chunk_id().alias("id"), "score", "rank")
    if not vectors:
        return words
    named = lambda name: within(stores.read(spark, name)).withColumn("id", chunk_id())
    near = knn(named("vectors"), asked.select("query_id", F.col("vector").alias("query")), most, dims=dims)
    return top(rrf([near, words], options.rrf_k), named("chunks"), options)


def upload(documents: DataFrame, files: DataFrame, dataset_id: int, now) -> DataFrame:
    """documents with new rows for files (title, source), in status indexing."""
    rows = files.select("title", "source", F.lit(dataset_id).cast("bigint").alias("dataset_id"), F.lit("indexing").alias("status"), now.alias("created_at"))
    return documents.unionByName(rows, allowMissingColumns=True)


def reindex_summary(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: documents, chunks, failed."""
    counts = chunks.agg(F.count("*").alias("chunks"), F.count_if(F.col("vector_status") == "failed").alias("failed"))
    return documents.agg(F.count("*").alias("documents")).crossJoin(F.broadcast(counts))


def chunk_report(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with the state of each of their chunks."""
    return documents.select("id", "title").join(chunks, F.col("id") == F.col("document_id")).select("id", "title", "chunk_id", "vector_status").orderBy("id", "chunk_id")
