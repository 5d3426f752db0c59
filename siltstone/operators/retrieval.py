"""Retrieval: vector, keyword and exact channels, rank fusion, access control, citations.

Channels are DataFrames (query_id, id, rank, ...), so one plan serves one query
or many. Searches are top-k per query over a whole index: the query set is the
small side and the index is never sorted as a whole.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import vector
from siltstone.functions.text import is_blank, trim_unicode
from siltstone.operators import nearest, scoring
from siltstone.runtime import cut

# Defaults of retrieval and of weighted fusion.
TOP_K, RRF_K, THRESHOLD, OVERFETCH = 5, 60, 0.0, 4
WEIGHTS = {"exact": 3.0, "keyword": 1.5, "vector": 1.0}
CANDIDATES = {"exact": 20, "keyword": 30, "vector": 30}
MOST_TOP_K, MOST_QUERY_CHARS, MOST_RESULT_BYTES = 10, 2000, 32768
BM25_K1, BM25_B = 1.2, 0.75
#: Queries that are broadcast to the index at a time; larger sets are searched in blocks.
MOST_QUERIES = 10_000


@dataclass(frozen=True)
class Options:
    top_k: int = TOP_K
    threshold: float = THRESHOLD
    rrf_k: int = RRF_K

    def __post_init__(self):
        if not 1 <= self.top_k <= MOST_TOP_K:
            raise ValueError(f"top_k must be from 1 to {MOST_TOP_K}")


def ranked(df: DataFrame, most: int, *order: Column, per: str = "query_id") -> DataFrame:
    """df with rank 1..most per query; Spark prunes each task's rows to the limit before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(per).orderBy(*order))).where(F.col("rank") <= most)


def in_blocks(search: Callable[[DataFrame], DataFrame], queries: DataFrame) -> DataFrame:
    """search(block) of all queries: one broadcast block, or several of MOST_QUERIES rows at most, dealt row by row, so that equal ones are no burden."""
    n = queries.count()
    if n <= MOST_QUERIES:
        return search(F.broadcast(queries))
    placed = cut(cut(queries).withColumn("_at", F.monotonically_increasing_id()))
    blocks = -(-2 * n // MOST_QUERIES)
    block = F.pmod(F.col("_at"), F.lit(blocks))
    while placed.groupBy(block.alias("b")).count().agg(F.max("count")).first()[0] > MOST_QUERIES:
        blocks *= 2
        block = F.pmod(F.col("_at"), F.lit(blocks))
    return reduce(DataFrame.unionByName, [search(F.broadcast(placed.where(block == k).drop("_at"))) for k in range(blocks)])


def checked_vectors(queries: DataFrame, dims: int | None) -> DataFrame:
    """queries (query_id, query), failing on a vector of another dimension than dims or with a component that isn't finite."""
    bad = ~vector.is_valid(F.col("query"), F.size("query") if dims is None else dims)
    return queries.where(F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit("bad query vector")).cast("boolean")).otherwise(True))


def knn(index: DataFrame, queries: DataFrame, k: int, metric: str = "COSINE", dims: int | None = None) -> DataFrame:
    """(query_id, id, score, rank) of the k nearest in index (id, embedding) for each of queries (query_id, query), as nearest.knn has them.

    A query vector that is null, not finite, or not of dims components is an error.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    return nearest.knn(index, checked_vectors(queries.select("query_id", "query"), dims), k, metric)


def terms(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def inverted_index(docs: DataFrame, fields: list[str]) -> DataFrame:
    """(id, field, term, tf, dl): the lexical index as a table."""
    each = _tokens(docs, fields)
    long = each.select("id", "field", F.size("terms").alias("dl"), F.explode("terms").alias("term"))
    return long.groupBy("id", "field", "term", "dl").agg(F.count("*").alias("tf"))


def _tokens(docs: DataFrame, fields: list[str]) -> DataFrame:
    if not fields:
        raise ValueError("no field to search")
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(terms(f), F.array().cast("array<string>")).alias("terms")) for f in fields]))
    return docs.select("id", each.alias("x")).select("id", "x.field", "x.terms")


def lengths(docs: DataFrame, fields: list[str]) -> DataFrame:
    """(id, field, dl): how many terms each field has, rows without any too; what BM25 needs beside the inverted index."""
    return _tokens(docs, fields).select("id", "field", F.size("terms").alias("dl"))


def bm25(docs: DataFrame, queries: DataFrame, fields: list[str], most: int = 10) -> DataFrame:
    """(query_id, id, score, rank): Okapi BM25 per field, summed over the fields, over docs (id, fields...).

    Only occurrences of the terms asked for, and each field's length, leave the
    texts, which are split once a block of queries; search_terms splits none.
    """

    def found(wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
        # No text has the empty term, so it can stand for the field itself.
        asked = wanted.select("term").unionByName(docs.sparkSession.createDataFrame([("",)], "term string")).distinct()
        each = _tokens(docs, fields).select("id", "field", F.size("terms").alias("dl"), F.explode(F.concat("terms", F.array(F.lit("")))).alias("term"))
        kept = cut(each.join(F.broadcast(asked), "term", "left_semi").groupBy("id", "field", "dl", "term").agg(F.count("*").alias("tf")))
        return kept.where("term <> ''"), kept.where("term = ''")

    return _bm25(found, queries, most)


def search_terms(index: DataFrame, lengths_: DataFrame, queries: DataFrame, most: int = 10) -> DataFrame:
    """bm25 over a stored inverted index and its lengths: only the rows of the terms asked for are read on."""

    def found(wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
        return index.join(F.broadcast(wanted.select("term").distinct()), "term", "left_semi").select("id", "field", "dl", "term", "tf"), lengths_

    return _bm25(found, queries, most)


def _bm25(found: Callable[[DataFrame], tuple[DataFrame, DataFrame]], queries: DataFrame, most: int) -> DataFrame:
    """found(wanted terms) gives their hits, and all lengths. Queries of one text are searched once, whatever their number."""
    texts = queries.select(F.col("query").alias("query_id")).distinct()

    def search(block: DataFrame) -> DataFrame:
        asked = scoring.Asked(block.select("query_id", F.coalesce(F.array_distinct(terms("query_id")), F.array().cast("array<string>"))).toArrow())
        wanted, named = asked.frames(block.sparkSession)
        hits, lengths_ = found(wanted)
        stats = lengths_.groupBy("field").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
        df = hits.groupBy("field", "term").agg(F.count("*").alias("df"))
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weight = idf * F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("dl") / F.col("avgdl")))
        # df and stats have a row for each term asked for and field, and for each field.
        scored = hits.join(F.broadcast(df), ["field", "term"]).join(F.broadcast(stats), "field").join(F.broadcast(wanted), "term")
        return scoring.best(scored.select("id", "t", weight.alias("weight")), asked, most).join(F.broadcast(named), "q").select("query_id", "id", "score", "rank")

    # `most` rows a text, back to every query that asks it.
    return in_blocks(search, texts).withColumnRenamed("query_id", "query").join(queries.select("query_id", "query"), "query").select("query_id", "id", "score", "rank")


def exact(docs: DataFrame, queries: DataFrame, identifier: str, most: int = CANDIDATES["exact"], pattern: str = r"[A-Za-z]+[0-9]+") -> DataFrame:
    """(query_id, id, score, rank) of docs whose identifier column is named in the query.

    A query needs no more of an identifier's documents than the `most` first, so these alone meet the queries.
    """
    names = F.explode(F.array_distinct(F.transform(F.expr(f"regexp_extract_all(query, '{pattern}', 0)"), F.lower))).alias("name")
    ids = docs.select(F.lower(F.col(identifier)).alias("name"), "id")

    def search(block: DataFrame) -> DataFrame:
        named = block.select("query_id", names)
        first = ranked(ids.join(F.broadcast(named.select("name").distinct()), "name", "left_semi").distinct(), most, F.col("id"), per="name")
        hits = first.join(F.broadcast(named), "name").select("query_id", "id", F.lit(1.0).alias("score")).distinct()
        return ranked(hits, most, F.col("id"))

    return in_blocks(search, queries.select("query_id", "query"))


def fusion_key(id: str = "id", source: str = "source", content: str = "content") -> Column:
    """The id, or the source and the content's first 64 bytes where it is blank."""
    rest = F.concat(F.coalesce(source, F.lit("")), F.lit("\x00"), F.hex(F.substring(F.col(content).cast("binary"), 1, 64)))
    return F.when(F.coalesce(F.col(id).cast("string"), F.lit("")) != "", F.col(id).cast("string")).otherwise(rest)


def rrf(channels: list[DataFrame], k: int = RRF_K, weights: list[float] | None = None) -> DataFrame:
    """(query_id, id, score, rank): sum of weight / (k + rank) over the channels; ties by first channel and rank."""
    weights = weights or [1.0] * len(channels)
    tagged = [c.select("query_id", "id", F.lit(n).alias("channel"), F.col("rank").alias("at"), (F.lit(w) / (F.lit(k) + F.col("rank"))).alias("part")) for n, (c, w) in enumerate(zip(channels, weights, strict=True))]
    both = tagged[0]
    for more in tagged[1:]:
        both = both.unionByName(more)
    fused = both.groupBy("query_id", "id").agg(F.round(F.sum("part"), 12).alias("score"), F.min(F.struct("channel", "at")).alias("seen"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "seen")
    return fused.withColumn("rank", F.row_number().over(order)).drop("seen")


def visible(docs: DataFrame, visibility: str = "", owner: str = "", columns: tuple[str, str] = ("visibility", "owner_subject")) -> DataFrame:
    """Equality on visibility and owner; an empty one admits any."""
    for name, value in zip(columns, (visibility, owner), strict=True):
        docs = docs.where(F.col(name) == value) if value else docs
    return docs


def granted(grants: DataFrame, subject: str) -> DataFrame:
    """dataset_id, each once, that subject may read; a blank subject is an error, and no grant is no access."""
    if not subject.strip():
        raise ValueError("subject is blank")
    return grants.where((F.col("subject") == subject) & (F.col("dataset_id") > 0)).select("dataset_id").distinct()


def within_grants(docs: DataFrame, grants: DataFrame, subject: str) -> DataFrame:
    return docs.join(granted(grants, subject), "dataset_id", "left_semi")


def top(fused: DataFrame, docs: DataFrame, options: Options, content: str = "content", rerank: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Fused hits joined to their documents: blank ones go, then those below the threshold, then all past top_k."""
    hits = fused.join(docs, "id").where(~is_blank(content))
    if options.threshold > 0:
        hits = hits.where(F.col("score") >= options.threshold)
    if rerank:
        hits = rerank(hits)
    order = Window.partitionBy("query_id").orderBy("rank")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= options.top_k)


def checked_queries(queries: DataFrame) -> DataFrame:
    """Trimmed queries; blank ones and those beyond the limit fail."""
    q = F.coalesce(trim_unicode("query"), F.lit(""))
    bad = F.when(q == "", F.raise_error(F.lit("query is blank"))).when(F.length(q) > MOST_QUERY_CHARS, F.raise_error(F.lit("query is too long")))
    return queries.withColumn("query", F.coalesce(bad.cast("string"), q))


def hybrid(docs: DataFrame, vectors: DataFrame, queries: DataFrame, options: Options = Options(), fields: tuple[str, ...] = ("content",), dims: int | None = None) -> DataFrame:
    """Keyword and vector channels of OVERFETCH * top_k candidates each, fused and cut to top_k.

    queries: (query_id, query, vector). Queries are trimmed; blank, too long ones
    and bad vectors fail.
    """
    most = OVERFETCH * options.top_k
    queries = cut(checked_queries(queries))
    near = knn(vectors, queries.select("query_id", F.col("vector").alias("query")), most, dims=dims)
    words = bm25(docs, queries, list(fields), most)
    return top(rrf([near, words], options.rrf_k), docs, options)


def citations(hits: DataFrame) -> DataFrame:
    """hits with a citation: source and chunk, title, section, excerpt."""
    line = F.format_string("[%s#chunk-%d]", "source", "chunk_index")
    parts = F.concat_ws("\n", line, F.concat(F.lit("title: "), "title"), F.when(F.col("heading_path") != "", F.concat(F.lit("section: "), "heading_path")), "content")
    return hits.withColumn("citation", parts)


def within_bytes(hits: DataFrame, most: int = MOST_RESULT_BYTES, text: str = "citation") -> DataFrame:
    """The first hits of each query whose texts fit into `most` bytes together."""
    upto = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hits.withColumn("_bytes", F.sum(F.octet_length(text)).over(upto)).where(F.col("_bytes") <= most).drop("_bytes")


def recall_at(hits: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query_id, relevant, found, recall) of relevant (query_id, id) among the first k hits."""
    found = relevant.join(hits.where(F.col("rank") <= k).select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    per = found.groupBy("query_id").agg(F.count("*").alias("relevant"), F.count("hit").alias("found"))
    return per.withColumn("recall", F.round(F.col("found") / F.col("relevant"), 6))


def validated(vectors: DataFrame, dim: int, model: str, key: tuple[str, ...] = ("chunk_id",)) -> DataFrame:
    """vectors (key, embedding), failing on a bad id, dimension, value or repeated key, and on a blank model.

    The first column of the key is an id; any others are places, from 0.
    """
    if not model.strip():
        raise ValueError("embedding model is blank")
    twice = F.count("*").over(Window.partitionBy(*key)) > 1
    bad = F.coalesce(F.col(key[0]) <= 0, F.lit(True))
    for k in key[1:]:
        bad = bad | F.coalesce(F.col(k) < 0, F.lit(True))
    fault = F.when(bad, "id must be positive").when(~vector.is_valid(F.col("embedding"), dim), "bad vector").when(twice, "id repeats")
    marked = vectors.withColumn("_fault", fault)
    return marked.where(F.when(F.col("_fault").isNull(), True).otherwise(F.raise_error(F.col("_fault")).cast("boolean"))).drop("_fault")


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The state after new rows replace or join the existing ones."""
    return existing.join(new.select(key), key, "left_anti").unionByName(new)


def delete(existing: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The state without the listed ids; repeated ids are fine, ids <= 0 are not."""
    good = F.when(F.col(key) > 0, F.col(key)).otherwise(F.raise_error(F.lit("id must be positive")).cast("bigint"))
    return existing.join(ids.select(good.alias(key)).distinct(), key, "left_anti")
