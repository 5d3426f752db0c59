"""Retrieval queries: every vector whose id is divisible by 50 asks, with words of its document, of whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone import schema
from siltstone.functions import vector
from siltstone.operators import annindex as ann
from siltstone.operators import indexing as ix
from siltstone.operators import retrieval as r
from siltstone.operators.chunking import chunk
from siltstone.plans.chunks import chunks_cte
from siltstone.runtime import cut, scratch, table

_DIMS = 64
_NO_DOCUMENT = "src1 the tion"


def _index(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _queries(spark, d):
    """(query_id, query, vector): of each asking vector its id, the source and three longest words of the document of that id, if there is one, and itself."""
    asked = table(spark, d, "embeddings").where("vec_id % 50 = 0")
    words = F.sort_array(F.transform(F.array_distinct(r.terms("text")), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    docs = table(spark, d, "documents").where("doc_id % 50 = 0").select("doc_id", F.concat_ws(" ", F.concat_ws(" ", "source"), F.concat_ws(" ", F.slice(words, 1, 3)["w"])).alias("query"))
    joined = asked.join(docs, asked["vec_id"] == docs["doc_id"], "left")
    return joined.select(F.col("vec_id").alias("query_id"), F.coalesce("query", F.lit(_NO_DOCUMENT)).alias("query"), F.col("embedding").alias("vector"))


def _vectors(spark, d):
    return table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def _docs(spark, d):
    return schema.documents(spark, d).withColumn("content", F.col("text"))


def _knn(metric):
    return lambda spark, d: r.knn(_index(spark, d), _vectors(spark, d), 10, metric, _DIMS)


def bm25_search(spark, d):
    return r.bm25(_docs(spark, d), _queries(spark, d), ["content"])


def bm25_most_fields(spark, d):
    return r.bm25(_docs(spark, d), _queries(spark, d), ["content", "title"])


def _fused(spark, d, weights=None):
    near = r.knn(_index(spark, d), _vectors(spark, d), 20, dims=_DIMS)
    words = r.bm25(_docs(spark, d), _queries(spark, d), ["content"], 20)
    return r.rrf([near, words], weights=weights)


def _exact(spark, d):
    return r.exact(_docs(spark, d), _queries(spark, d), "source")


def rrf_hybrid(spark, d):
    return r.hybrid(_docs(spark, d), _index(spark, d), _queries(spark, d).withColumn("query", F.concat(F.lit(" "), "query", F.lit("\n"))), dims=_DIMS).select("query_id", "id", "score", "rank")


def rrf_weighted(spark, d):
    near = r.knn(_index(spark, d), _vectors(spark, d), r.CANDIDATES["vector"], dims=_DIMS)
    words = r.bm25(_docs(spark, d), _queries(spark, d), ["content"], r.CANDIDATES["keyword"])
    return r.rrf([_exact(spark, d), words, near], weights=[r.WEIGHTS["exact"], r.WEIGHTS["keyword"], r.WEIGHTS["vector"]])


def hybrid_threshold_topk(spark, d):
    return r.top(_fused(spark, d), _docs(spark, d), r.Options(top_k=10, threshold=0.0145)).select("query_id", "id", "score", "rank")


def reranked_search(spark, d):
    """Keyword hits in the order of a reranker: shortest text first."""
    by_length = Window.partitionBy("query_id").orderBy("n_chars", "id")
    hits = r.rrf([r.bm25(_docs(spark, d), _queries(spark, d), ["content"], 30)])
    return r.top(hits, _docs(spark, d), r.Options(top_k=10), rerank=lambda h: h.withColumn("rank", F.row_number().over(by_length))).select("query_id", "id", "rank")


def acl_filtered_search(spark, d):
    return r.bm25(r.visible(_docs(spark, d), "private", "src3"), _queries(spark, d), ["content"], 5)


def _grants(spark):
    return spark.createDataFrame([("ann", 3), ("ann", 1), ("ann", 3), ("ann", 0), ("bob", 2)], "subject string, dataset_id bigint")


def granted_search(spark, d):
    return r.bm25(r.within_grants(_docs(spark, d), _grants(spark), "ann"), _queries(spark, d), ["content"], 5)


def recheck_after_vector_search(spark, d):
    """Vector hits are ids only; access is checked again where they meet the documents."""
    hits = r.knn(_index(spark, d), _vectors(spark, d), 30, dims=_DIMS)
    return hits.join(r.within_grants(r.visible(_docs(spark, d), "system"), _grants(spark), "ann").select("id", "dataset_id"), "id").select("query_id", "id", "rank", "dataset_id")


def citations(spark, d):
    """Whole chunks, as many as the limit of a result holds; chunked once."""
    chunks = chunk(_docs(spark, d).select("id", "title", "source", "content"), text="content")
    keyed = cut(chunks.withColumns({"document_id": F.col("id"), "id": F.concat_ws("#", "id", "chunk_index")}))
    hits = r.bm25(keyed, _queries(spark, d), ["content"], r.CANDIDATES["keyword"])
    return r.within_bytes(r.citations(hits.join(keyed, "id"))).select("query_id", "rank", "citation")


def _of_label(spark, d):
    """(query_id, id): each asking vector's fellows by label."""
    v = table(spark, d, "embeddings")
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    return v.join(asked, "label").select("query_id", F.col("vec_id").alias("id"))


def recall_at_k(spark, d):
    """Of each asking vector's label, how many are among its 20 nearest."""
    return r.recall_at(r.knn(_index(spark, d), _vectors(spark, d), 20, dims=_DIMS), _of_label(spark, d), 20)


def pack_vectors(spark, d):
    """Which vectors the store would take: positive id, dimension 64, finite values."""
    v = table(spark, d, "embeddings")
    fault = F.when(F.col("vec_id") <= 0, "id").when(~vector.is_valid(F.col("embedding"), 64), "vector").otherwise("none")
    return v.select("vec_id", fault.alias("fault"), F.round(vector.norm(F.col("embedding")), 6).alias("norm"))


def _stored(spark, d, metric):
    stored = ann.StoredIndex(scratch(spark, "vectors"))
    stored.create(_index(spark, d), 16, metric, 20)
    return stored


def knn_inverted_lists(spark, d):
    """All lists are probed, so the hits are the exact ones: nothing is missing from the index, nor lost by its codes."""
    stored = _stored(spark, d, "COSINE")
    return stored.search(_vectors(spark, d), 20, 16)


def knn_index_updates(spark, d):
    """Of a stored index (L2), every third vector is replaced by its negative, every fifth deleted, then all is compacted; all lists are probed."""
    stored, index = _stored(spark, d, "L2"), _index(spark, d)
    stored.add(index.where("id % 3 = 0").select("id", F.transform("embedding", lambda x: -x).alias("embedding")))
    stored.delete(index.where("id % 5 = 1").select("id"))
    stored.compact(spark)
    return stored.search(_vectors(spark, d), 10, 16)


def knn_inverted_lists_recall(spark, d):
    """By metric: queries, their exact 20 nearest, how many of these the tuned number of probes finds, and whether that is enough."""
    out = None
    for metric in vector.METRICS:
        exact = r.knn(_index(spark, d), _vectors(spark, d), 20, metric, _DIMS)
        per = r.recall_at(_stored(spark, d, metric).search(_vectors(spark, d), 20), exact, 20)
        one = per.agg(F.lit(metric).alias("metric"), F.count("*").alias("queries"), F.sum("relevant").alias("relevant"), (F.sum("found") >= 0.95 * F.sum("relevant")).alias("enough"))
        out = one if out is None else out.unionByName(one)
    return out


def _indexed(spark, docs):
    """Stores of docs; ids start at 1 there, as the vector store wants them."""
    stores = ix.Stores(scratch(spark, "index"))
    ix.index_documents(docs, stores, ix.hash_embedder(), 16, "hash")
    return stores


def _untitled(spark, d):
    return _docs(spark, d).select((F.col("id") + 1).alias("id"), F.lit(None).cast("string").alias("title"), "text", "visibility", "owner_subject", "dataset_id")


def index_search(spark, d):
    """From documents to stores to hits: the keyword channel over the stored postings of all chunks."""
    stores = _indexed(spark, _untitled(spark, d))
    return ix.search_index(spark, stores, _queries(spark, d), 16, r.Options(top_k=5), vectors=False)


def index_search_filtered(spark, d):
    """Both channels of a stored index within the private documents of two datasets: words and vectors of whole chunks, fused."""
    stores = _indexed(spark, _untitled(spark, d))
    embedder = ix.hash_embedder()
    texts = _queries(spark, d).select("query_id", "query")
    asked = ix.embed(texts, "query", embedder, 16).withColumn("vector", F.col("embedding").cast("array<double>")).drop("embedding")
    where = (F.col("visibility") == "private") & F.col("dataset_id").isin(1, 3)
    return ix.search_index(spark, stores, asked, 16, r.Options(top_k=5), where=where).select("query_id", "id", "score", "rank")


def reindex_one_percent(spark, d):
    """Every hundredth document is indexed again with one more sentence: the chunks that were embedded, and what the stores hold then."""
    docs = _untitled(spark, d)
    stores = _indexed(spark, docs)
    again = docs.where("id % 100 = 1").withColumn("text", F.concat("text", F.lit("\nOne more sentence.")))
    ran = ix.index_documents(again, stores, ix.hash_embedder(), 16, "hash")
    same = ix.index_documents(docs.where("id % 100 = 2"), stores, ix.hash_embedder(), 16, "hash")
    stores.compact(spark)
    chunks = stores.read(spark, "chunks").agg(F.count("*").alias("chunks"), F.sum("terms").alias("terms"))
    weights = stores.segments().every(spark, "statistics").agg(F.sum(F.when(F.col("term").isNull(), F.col("total"))).alias("total"), F.sum(F.when(F.col("term").isNotNull(), F.col("n"))).alias("df"))
    rows = stores.terms(spark).agg(F.count("*").alias("postings"))
    return chunks.crossJoin(F.broadcast(weights)).crossJoin(F.broadcast(rows)).withColumns({"written": F.lit(ran["chunks"]), "embedded": F.lit(ran["embedded"]), "embedded_same": F.lit(same["embedded"])})


def reindex_shrinks(spark, d):
    """Private documents are indexed again with their titles alone: rows of each document in each store."""
    docs = _docs(spark, d).select((F.col("id") + 1).alias("id"), "title", "text", "visibility")
    stores = _indexed(spark, docs)
    private = docs.where("visibility = 'private'").withColumn("text", F.col("title"))
    ix.index_documents(private, stores, ix.hash_embedder(), 16, "hash")
    per = lambda df, *counts: df.groupBy("document_id").agg(*counts)
    out = per(stores.read(spark, "chunks"), F.count("*").alias("chunks"), F.sum("terms").alias("lengths"))
    out = out.join(per(stores.read(spark, "vectors"), F.count("*").alias("vectors")), "document_id", "full")
    return out.join(per(stores.terms(spark), F.sum("tf").alias("terms")), "document_id", "full")


def exact_id_channel(spark, d):
    return _exact(spark, d)


_WORDS_SQL = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_ASKED = f"""SELECT vec_id AS query_id, CASE WHEN doc_id IS NULL THEN '{_NO_DOCUMENT}' ELSE concat_ws(' ', source, array_to_string(list_transform(list_sort(list_transform(list_distinct({_WORDS_SQL.format('text')}), lambda w: {{'n': -length(w), 'w': encode(w)}}))[1:3], lambda x: decode(x.w)), ' ')) END AS query
  FROM embeddings LEFT JOIN documents ON vec_id = doc_id WHERE vec_id % 50 = 0"""
_Q = f"""q AS ({_ASKED}),
  qv AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 50 = 0)"""


def _knn_sql(metric: str, k: int, name: str = "near", source: str = "embeddings") -> str:
    a, b = "embedding::DOUBLE[]", "v::DOUBLE[]"
    score = {"COSINE": f"list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))", "IP": f"list_dot_product({a}, {b})", "L2": f"list_distance({a}, {b})"}[metric]
    down = "" if metric == "L2" else "DESC"
    return f"""{name} AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score {down}, id)::INTEGER AS rank
      FROM (SELECT query_id, vec_id AS id, round({score}, 6) AS score FROM {source}, qv)) WHERE rank <= {k})"""


def _bm25_sql(docs: str, k: int, name: str = "words", fields: tuple[str, ...] = ("content",), q: str = "q") -> str:
    terms = lambda c: f"list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    each = " UNION ALL ".join(f"SELECT id, '{f}' AS field, {terms(f)} AS ts FROM ({docs})" for f in fields)
    return f"""{name}_t AS ({each}), {name}_s AS (SELECT field, count(*) AS n, avg(len(ts)) AS avgdl FROM {name}_t GROUP BY field),
    {name}_w AS (SELECT DISTINCT query_id, unnest({terms('query')}) AS term FROM {q}),
    {name}_h AS (SELECT id, field, dl, term, count(*) AS tf FROM (SELECT id, field, len(ts) AS dl, unnest(ts) AS term FROM {name}_t) WHERE term IN (SELECT term FROM {name}_w) GROUP BY ALL),
    {name}_d AS (SELECT field, term, count(*) AS df FROM {name}_h GROUP BY ALL),
    {name} AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM (
      SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
      FROM {name}_h JOIN {name}_d USING (field, term) JOIN {name}_s USING (field) JOIN {name}_w USING (term) GROUP BY query_id, id)) WHERE rank <= {k})"""


def _rrf_sql(channels: list[str], weights: list[float] | None = None, name: str = "fused") -> str:
    weights = weights or [1.0] * len(channels)
    union = " UNION ALL ".join(f"SELECT query_id, id, {n} AS channel, rank AS pos, {w}::DOUBLE / (60 + rank) AS part FROM {c}" for n, (c, w) in enumerate(zip(channels, weights)))
    return f"""{name} AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen)::INTEGER AS rank FROM (
      SELECT query_id, id, round(sum(part), 12) AS score, min({{'c': channel, 'a': pos}}) AS seen FROM ({union}) GROUP BY query_id, id))"""


def _hashed_sql(name: str, texts: str) -> str:
    """The stand-in embedding of texts (id, content), in single precision."""
    terms = "list_filter(regexp_split_to_array(lower(content), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
    digits = ", ".join(f"'{x:x}'" for x in range(16))
    return f"""{name}_h AS (SELECT id, list_transform({terms}, lambda x: md5(x)[1]) AS h FROM ({texts})),
      {name}_n AS (SELECT id, list_transform([{digits}], lambda d: len(list_filter(h, lambda x: x = d))) AS c FROM {name}_h),
      {name} AS (SELECT id, list_transform(c, lambda x: (x / greatest(sqrt(list_sum(list_transform(c, lambda y: y * y))), 1e-300))::FLOAT::DOUBLE) AS v FROM {name}_n)"""


_COUNT = "len(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''))"
_DOCS = f"SELECT *, text AS content FROM ({schema.DOCUMENTS_SQL})"
_GRANTED = f"SELECT * FROM ({_DOCS}) WHERE dataset_id IN (1, 3)"
_EXACT = f"""ex AS (SELECT * FROM (SELECT query_id, id, 1.0::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY id)::INTEGER AS rank
  FROM ({_DOCS}) JOIN q ON source = split_part(query, ' ', 1)) WHERE rank <= 20)"""

QUERIES = {
    "knn_cosine": _knn("cosine"), "knn_ip": _knn("IP"), "knn_l2": _knn("L2"), "bm25_search": bm25_search, "bm25_most_fields": bm25_most_fields,
    "rrf_hybrid": rrf_hybrid, "rrf_weighted": rrf_weighted, "hybrid_threshold_topk": hybrid_threshold_topk, "reranked_search": reranked_search, "acl_filtered_search": acl_filtered_search,
    "granted_search": granted_search, "recheck_after_vector_search": recheck_after_vector_search, "exact_id_channel": exact_id_channel,
    "citations": citations, "recall_at_k": recall_at_k, "validate_vectors": pack_vectors,
    "index_search": index_search, "index_search_filtered": index_search_filtered, "reindex_one_percent": reindex_one_percent, "reindex_shrinks": reindex_shrinks, "knn_inverted_lists": knn_inverted_lists, "knn_index_updates": knn_index_updates, "knn_inverted_lists_recall": knn_inverted_lists_recall,
}
ORACLES = {
    "knn_inverted_lists_recall": f"""WITH {_Q}, n AS (SELECT count(*) AS queries, count(*) * least(20, (SELECT count(*) FROM embeddings)) AS relevant FROM q)
      SELECT unnest(['COSINE', 'IP', 'L2']) AS metric, queries, relevant::BIGINT AS relevant, true AS enough FROM n""",
    "knn_index_updates": f"""WITH {_Q}, {_knn_sql('L2', 10, source="(SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN list_transform(embedding, lambda x: -x) ELSE embedding END AS embedding FROM embeddings WHERE vec_id % 5 <> 1)")} SELECT * FROM near""",
    "knn_inverted_lists": f"WITH {_Q}, {_knn_sql('COSINE', 20)} SELECT * FROM near",
    **{f"knn_{m.lower()}": f"WITH {_Q}, {_knn_sql(m, 10)} SELECT * FROM near" for m in ("COSINE", "IP", "L2")},
    "bm25_search": f"WITH {_Q}, {_bm25_sql(_DOCS, 10)} SELECT * FROM words",
    "bm25_most_fields": f"WITH {_Q}, {_bm25_sql(_DOCS, 10, fields=('content', 'title'))} SELECT * FROM words",
    "rrf_hybrid": f"WITH {_Q}, {_knn_sql('COSINE', 20)}, {_bm25_sql(_DOCS, 20)}, {_rrf_sql(['near', 'words'])} SELECT query_id, id, score, n AS rank FROM (SELECT f.*, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INTEGER AS n FROM fused f JOIN documents d ON d.doc_id = f.id WHERE trim(d.text) <> '') WHERE n <= 5",
    "rrf_weighted": f"WITH {_Q}, {_EXACT}, {_knn_sql('COSINE', 30)}, {_bm25_sql(_DOCS, 30)}, {_rrf_sql(['ex', 'words', 'near'], [3.0, 1.5, 1.0])} SELECT * FROM fused",
    "hybrid_threshold_topk": f"WITH {_Q}, {_knn_sql('COSINE', 20)}, {_bm25_sql(_DOCS, 20)}, {_rrf_sql(['near', 'words'])} SELECT query_id, id, score, n AS rank FROM (SELECT f.*, row_number() OVER (PARTITION BY query_id ORDER BY rank)::INTEGER AS n FROM fused f JOIN documents d ON d.doc_id = f.id WHERE trim(d.text) <> '' AND score >= 0.0145) WHERE n <= 10",
    "reranked_search": f"""WITH {_Q}, {_bm25_sql(_DOCS, 30)} SELECT query_id, id, rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY n_chars, id)::INTEGER AS rank
      FROM words JOIN documents d ON d.doc_id = id WHERE trim(d.text) <> '') WHERE rank <= 10""",
    "acl_filtered_search": f"WITH {_Q}, {_bm25_sql(_DOCS + ' WHERE visibility = ' + chr(39) + 'private' + chr(39) + ' AND owner_subject = ' + chr(39) + 'src3' + chr(39), 5)} SELECT * FROM words",
    "granted_search": f"WITH {_Q}, {_bm25_sql(_GRANTED, 5)} SELECT * FROM words",
    "recheck_after_vector_search": f"WITH {_Q}, {_knn_sql('COSINE', 30)} SELECT query_id, id, rank, dataset_id FROM near JOIN ({_GRANTED} AND visibility = 'system') USING (id)",
    "exact_id_channel": f"WITH {_Q}, {_EXACT} SELECT * FROM ex",
    "citations": f"""WITH {chunks_cte(1200)}, {_Q},
      {_bm25_sql("SELECT doc_id || '#' || chunk_index AS id, content FROM chunks", 30)},
      cited AS (SELECT query_id, rank, '[' || source || '#chunk-' || chunk_index || ']' || chr(10) || 'title: ' || source || '-' || c.doc_id || chr(10) || content AS citation
        FROM words w JOIN chunks c ON w.id = c.doc_id || '#' || c.chunk_index JOIN documents d ON d.doc_id = c.doc_id)
      SELECT query_id, rank, citation FROM (SELECT *, sum(strlen(citation)) OVER (PARTITION BY query_id ORDER BY rank) AS b FROM cited) WHERE b <= 32768""",
    "index_search": f"""WITH {chunks_cte(1200)}, {_Q}, {_bm25_sql("SELECT (doc_id + 1) || '#' || chunk_index AS id, content FROM chunks", 20)} SELECT * FROM words""",
    "index_search_filtered": f"""WITH {chunks_cte(1200)}, q AS ({_ASKED}),
      k AS (SELECT (doc_id + 1) || '#' || chunk_index AS id, content, doc_id % 3 = 0 AND doc_id % 5 IN (0, 2) AS may FROM chunks),
      {_bm25_sql("SELECT id, content FROM k", 1 << 40, name="every")}, words AS (SELECT query_id, id, score, nth AS rank FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS nth FROM every JOIN k USING (id) WHERE may) WHERE nth <= 20),
      {_hashed_sql("qv", "SELECT query_id AS id, query AS content FROM q")}, {_hashed_sql("kv", "SELECT id, content FROM k WHERE may")},
      near AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM (
        SELECT qv.id AS query_id, kv.id AS id, round(list_dot_product(qv.v, kv.v) / (sqrt(list_dot_product(qv.v, qv.v)) * sqrt(list_dot_product(kv.v, kv.v))), 6) AS score FROM qv, kv
        WHERE list_sum(qv.v) > 0 AND list_sum(kv.v) > 0) QUALIFY rank <= 20),
      {_rrf_sql(['near', 'words'])} SELECT query_id, id, score, rank FROM fused WHERE rank <= 5""",
    "reindex_one_percent": f"""WITH docs AS (SELECT doc_id, CASE WHEN doc_id % 100 = 0 THEN text || chr(10) || 'One more sentence.' ELSE text END AS text FROM documents), was AS (WITH {chunks_cte(1200)} SELECT * FROM chunks),
      now AS (WITH {chunks_cte(1200).replace("FROM documents", "FROM docs")} SELECT * FROM chunks),
      t AS (SELECT {_COUNT.format('content')} AS n, len(list_distinct(list_filter(regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''))) AS u FROM now),
      m AS (SELECT count(*)::INTEGER AS written, (count(*) FILTER (NOT EXISTS (SELECT 1 FROM was WHERE was.doc_id = now.doc_id AND was.content = now.content)))::INTEGER AS embedded FROM now WHERE doc_id % 100 = 0)
      SELECT count(*) AS chunks, sum(n)::BIGINT AS terms, sum(n)::BIGINT AS total, sum(u)::BIGINT AS df, sum(u)::BIGINT AS postings, max(written) AS written, max(embedded) AS embedded, 0 AS embedded_same FROM t, m""",
    "reindex_shrinks": f"""WITH {chunks_cte(1200)}, now AS (SELECT doc_id, content FROM chunks WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, source || '-' || doc_id FROM documents WHERE doc_id % 3 = 0),
      n AS (SELECT now.doc_id, {_COUNT.format('content')} + {_COUNT.format("source || '-' || now.doc_id")} AS terms FROM now JOIN documents USING (doc_id))
      SELECT doc_id + 1 AS document_id, count(*) AS chunks, count(*) AS vectors, sum(terms)::BIGINT AS terms, sum(terms)::BIGINT AS lengths FROM n GROUP BY doc_id""",
    "recall_at_k": f"""WITH {_Q}, {_knn_sql('COSINE', 20)}, rel AS (SELECT a.vec_id AS query_id, b.vec_id AS id FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 50 = 0)
      SELECT query_id, count(*) AS relevant, count(near.id) AS found, round(count(near.id) / count(*), 6) AS recall FROM rel LEFT JOIN near USING (query_id, id) GROUP BY query_id""",
    "validate_vectors": """SELECT vec_id, CASE WHEN vec_id <= 0 THEN 'id' WHEN len(embedding) <> 64 OR len(list_filter(embedding, lambda x: NOT isfinite(x))) > 0 THEN 'vector' ELSE 'none' END AS fault,
      round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings""",
}
