"""Chunking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators.chunking import chunk, split_sections
from siltstone.runtime import table

_W = r"\t\n\v\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def trim_sql(x: str) -> str:
    return f"regexp_replace({x}, '^[{_W}]+|[{_W}]+$', '', 'g')"


def _cut(most: int, at: str) -> str:
    half = most // 2
    tail = f"substring(t, {at} + {half + 2}, {most - half})"
    return f"""CASE WHEN {at} + {most} >= n THEN n WHEN regexp_matches({tail}, '[\\n。.！!？?；;]')
      THEN {at} + {half + 1} + length(regexp_extract({tail}, '(?s)^.*[\\n。.！!？?；;]')) ELSE {at} + {most} END"""


def chunks_cte(most: int) -> str:
    """CTEs ending in chunks (doc_id, chunk_index, content), for texts without headings."""
    step = f"greatest(cut - {most // 6}, st + 1)"
    return f"""RECURSIVE win AS (
  SELECT doc_id, t, n, 0 AS idx, 0 AS st, {_cut(most, '0')} AS cut FROM (SELECT doc_id, text || chr(10) AS t, length(text) + 1 AS n FROM documents)
  UNION ALL
  SELECT doc_id, t, n, idx + 1, nst, {_cut(most, 'nst')} FROM (SELECT *, {step} AS nst FROM win WHERE st + {most} < n)
), pieces AS (
  SELECT doc_id, idx, {trim_sql("substring(t, st + 1, cut - st)")} AS content FROM win
), chunks AS (
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1)::INTEGER AS chunk_index, content FROM pieces WHERE content <> ''
)"""


def _chunks(spark, d, most=1200):
    return chunk(table(spark, d, "documents").select("doc_id", "text"), most=most).select("doc_id", "chunk_index", "content")


def chunk_documents(spark, d):
    return _chunks(spark, d)


def chunk_small(spark, d):
    return _chunks(spark, d, 300).select("doc_id", "chunk_index", F.md5("content").alias("content_md5"))


def chunk_stats(spark, d):
    per = _chunks(spark, d).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max(F.length("content")).alias("longest"))
    return per.groupBy("chunks").agg(F.count("*").alias("documents"), F.max("longest").alias("longest"))


_MARKDOWN = "concat('# ', lang, '\n', replace(text, ', ', ',\n### s\n'), '\n~~~\n# not\n~~~\n## tail\n', source)"
_MARKDOWN_SQL = "'# ' || lang || chr(10) || replace(text, ', ', ',' || chr(10) || '### s' || chr(10)) || chr(10) || '~~~' || chr(10) || '# not' || chr(10) || '~~~' || chr(10) || '## tail' || chr(10) || source"


def _markdown(spark, d):
    return table(spark, d, "documents").select("doc_id", F.expr(_MARKDOWN).alias("text"))


def markdown_sections(spark, d):
    out = split_sections(_markdown(spark, d))
    return out.groupBy("doc_id", "heading_path").agg(F.count("*").alias("sections"), F.sum(F.length("text")).alias("chars"), F.md5(F.array_join(F.array_sort(F.collect_list("text")), "|")).alias("texts_md5"))


def markdown_chunks(spark, d):
    out = chunk(_markdown(spark, d))
    return out.groupBy("doc_id", "heading_path").agg(F.count("*").alias("chunks"), F.min("chunk_index").alias("first_index"), F.sum(F.length("content")).alias("chars"))


_SECTIONS = f"""
lines AS (
  SELECT doc_id, pos, parts[pos + 1] AS line FROM (
    SELECT doc_id, parts, unnest(range(len(parts))) AS pos FROM (SELECT doc_id, string_split({_MARKDOWN_SQL}, chr(10)) AS parts FROM documents))
), marked AS (
  SELECT *, {trim_sql("line")} AS bare FROM lines
), fenced AS (
  SELECT *, sum((starts_with(bare, '```') OR starts_with(bare, '~~~'))::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS fences FROM marked
), leveled AS (
  SELECT *, CASE WHEN NOT starts_with(bare, '~~~') AND NOT starts_with(bare, '```') AND fences % 2 = 0 AND regexp_matches(bare, '^#{{1,6}} ')
            THEN length(regexp_extract(bare, '^#+')) END AS level FROM fenced
), placed AS (
  SELECT *, {trim_sql("regexp_replace(bare, '^#+', '')")} AS title,
         count(level) OVER (PARTITION BY doc_id ORDER BY pos) AS section, last_value(level IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS current FROM leveled
), pathed AS (
  SELECT *, {", ".join(f"last_value(CASE WHEN level <= {i} THEN {{'l': level, 't': title}} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS p{i}" for i in range(1, 7))} FROM placed
), sections AS (
  SELECT doc_id, section, any_value({"concat_ws(' > ', " + ", ".join(f"CASE WHEN current >= {i} THEN CASE WHEN p{i}.l = {i} THEN p{i}.t ELSE '' END END" for i in range(1, 7)) + ")"}) AS heading_path,
         string_agg(line || chr(10), '' ORDER BY pos) AS text
  FROM pathed WHERE level IS NULL GROUP BY doc_id, section
), kept AS (SELECT * FROM sections WHERE NOT regexp_matches(text, '^[{_W}]*$'))
"""

QUERIES = {
    "chunk_documents": chunk_documents,
    "chunk_small": chunk_small,
    "chunk_stats": chunk_stats,
    "markdown_sections": markdown_sections,
    "markdown_chunks": markdown_chunks,
}
ORACLES = {
    "chunk_documents": f"WITH {chunks_cte(1200)} SELECT * FROM chunks",
    "chunk_small": f"WITH {chunks_cte(300)} SELECT doc_id, chunk_index, md5(content) AS content_md5 FROM chunks",
    "chunk_stats": f"""WITH {chunks_cte(1200)}, per AS (SELECT doc_id, count(*) AS chunks, max(length(content)) AS longest FROM chunks GROUP BY doc_id)
        SELECT chunks, count(*) AS documents, max(longest)::INTEGER AS longest FROM per GROUP BY chunks""",
    "markdown_sections": f"""WITH {_SECTIONS} SELECT doc_id, heading_path, count(*) AS sections, sum(length(text))::BIGINT AS chars,
        md5(string_agg(text, '|' ORDER BY text)) AS texts_md5 FROM kept GROUP BY doc_id, heading_path""",
    "markdown_chunks": f"""WITH RECURSIVE {_SECTIONS}, win AS (
          SELECT doc_id, section, heading_path, t, n, 0 AS idx, 0 AS st, {_cut(1200, '0')} AS cut FROM (SELECT doc_id, section, heading_path, text AS t, length(text) AS n FROM kept)
          UNION ALL
          SELECT doc_id, section, heading_path, t, n, idx + 1, nst, {_cut(1200, 'nst')} FROM (SELECT *, greatest(cut - 200, st + 1) AS nst FROM win WHERE st + 1200 < n)
        ), pieces AS (SELECT doc_id, section, heading_path, idx, {trim_sql("substring(t, st + 1, cut - st)")} AS piece FROM win),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY section, idx) - 1 AS chunk_index FROM pieces WHERE piece <> '')
        SELECT doc_id, heading_path, count(*) AS chunks, min(chunk_index)::INTEGER AS first_index,
               sum(length(piece) + CASE WHEN heading_path = '' THEN 0 ELSE length(heading_path) + 4 END)::BIGINT AS chars
        FROM numbered GROUP BY doc_id, heading_path""",
}
