"""Mixing sources to target weights, with DataFrame functions only.

Tokens are summed per source, each source gets a target and so a repetition
rate, and every document is emitted floor(rate) times plus one copy drawn by a
hash-seeded Bernoulli trial whose probability is the rate's fraction.

Defined cases: a null or blank text has size 0 and is taken 0 words; a null
source is a source of its own, last in order; a null doc_id hashes as an empty
string; repeated rows count and are drawn alike; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.names import fresh
from siltstone.runtime import cut

#: Sources by code point, null last, weigh these in turn.
WEIGHTS = (5, 2, 1)
#: All targets together, as a share of all words.
TOTAL_SHARE = 1.5
#: No target exceeds this many times its source's size.
MOST_REPEATS = 2
SEED = "mix-1"
#: Per-source rows are broadcast up to this many; beyond it they are joined by a shuffle.
BROADCAST_SOURCES = 20_000

_HASH_RANGE = float(1 << 52)


def word_count(text: str | Column) -> Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    text = F.col(text) if isinstance(text, str) else text
    # Runs are counted as their first characters: codegen'd, and no array of words is built.
    squeezed = F.regexp_replace(text, r"[^ \t\n\x0B\f\r]+", "w")
    return F.coalesce(F.length(F.translate(squeezed, " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: str = SEED) -> Column:
    """In [0, 1), from the seed and the id alone, so that reruns agree."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(_HASH_RANGE)


def _numbered(per: DataFrame) -> DataFrame:
    """per with turn, its place from 0 by code point, null last: by ranges, so no task sorts all sources."""
    order = F.col("source").asc_nulls_last()
    placed = cut(per.repartitionByRange(order)).withColumn("_part", F.spark_partition_id())
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_before"))  # a row for each partition
    within = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return placed.withColumn("_in", within).join(F.broadcast(offsets), "_part").select(*per.columns, (F.col("_in") + F.col("_before")).alias("turn"))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, size) -> (source, source_size, target, rate), one row per source.

    All sources not yet capped get level * weight words. What the capped ones
    can't take raises the level of the rest, until no more are above their cap.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("turn") % len(WEIGHTS) + 1).cast("int"))
    per = cut(_numbered(per).select("source", "source_size", weight.alias("weight"), (F.col("source_size") * MOST_REPEATS).alias("cap")))
    level, before = 0.0, None
    while level != before:
        above = F.lit(level) * F.col("weight") > F.col("cap")
        sums = per.agg(F.sum("source_size").alias("all"), F.sum(F.when(above, F.col("cap"))).alias("capped"), F.sum(F.when(~above, F.col("weight"))).alias("weights")).first()
        before = level
        if sums["weights"]:
            level = (TOTAL_SHARE * sums["all"] - (sums["capped"] or 0)) / sums["weights"]
    target = F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight"))
    per = per.withColumn("target", target)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return per.select("source", "source_size", "target", rate.alias("rate"))


def _with_rates(docs: DataFrame, sizes: DataFrame) -> DataFrame:
    per = targets(sizes).withColumnRenamed("source", "_key")
    if per.count() <= BROADCAST_SOURCES:
        per = F.broadcast(per)
    return docs.join(per, docs["source"].eqNullSafe(per["_key"]), "left").drop("_key")


def copies(rate: Column, doc_id: Column) -> Column:
    """floor(rate) plus one with probability equal to the fraction."""
    whole = F.floor(rate)
    return (whole + (uniform(doc_id) < rate - whole).cast("int")).cast("long")


def plan(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) per row of docs (doc_id, text, source)."""
    sized = docs.select("doc_id", "source", word_count("text").alias("size"))
    out = _with_rates(sized, sized.select("source", "size"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies(F.col("rate"), F.col("doc_id"))).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus: each row of docs as many times as the mix takes it, all columns kept."""
    key, rate, copy = fresh(docs, "_key", "_rate", "_copy")
    per = targets(docs.select("source", word_count("text").alias("size"))).select(F.col("source").alias(key), F.col("rate").alias(rate))
    if per.count() <= BROADCAST_SOURCES:
        per = F.broadcast(per)
    joined = docs.join(per, docs["source"].eqNullSafe(per[key]), "left")
    times = copies(F.coalesce(F.col(rate), F.lit(0.0)), docs["doc_id"])
    repeated = joined.withColumn(copy, F.explode(F.array_repeat(F.lit(1), times.cast("int"))))
    return repeated.select(*[docs[c] for c in docs.columns])


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, 2 * source_size AS cap,
         [5, 2, 1][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS weight FROM per
), levels AS (
  SELECT *, cap / weight AS r,
         ((sum(source_size) OVER ())::DOUBLE * 1.5
           - coalesce(sum(cap) OVER (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / (sum(weight) OVER (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lev
  FROM weighed
), top AS (
  SELECT lev AS level FROM levels WHERE lev * weight <= cap ORDER BY r, lev LIMIT 1
), goal AS (
  SELECT source, source_size, least(cap::DOUBLE, (SELECT level FROM top) * weight) AS target FROM weighed
), rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
  FROM sized JOIN goal ON sized.source IS NOT DISTINCT FROM goal.source
)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0 < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
"""
