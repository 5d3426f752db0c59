"""Retrieval quality over a set of judged queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.retrieval import recall_at


def no_answer_accuracy(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """One row: the share of queries (query_id, answerable) that got hits just when they should."""
    got = hits.select("query_id").distinct().withColumn("_hit", F.lit(True))
    right = F.coalesce("_hit", F.lit(False)) == F.col("answerable")
    return queries.join(got, "query_id", "left").agg(F.round(F.avg(right.cast("double")), 6).alias("no_answer_accuracy"))


def citation_accuracy(citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: the share of citations (id, excerpt) whose excerpt is in the cited chunk."""
    found = citations.join(chunks.select("id", "content"), "id", "left")
    return found.agg(F.round(F.avg(F.coalesce(F.col("content").contains(F.col("excerpt")), F.lit(False)).cast("double")), 6).alias("citation_accuracy"))


def acl_leaks(hits: DataFrame, documents: DataFrame, grants: DataFrame) -> DataFrame:
    """Hits (query_id, subject, id) of documents in datasets the subject has no grant for."""
    placed = hits.join(documents.select("id", "dataset_id"), "id")
    return placed.join(grants.select("subject", "dataset_id"), ["subject", "dataset_id"], "left_anti")


def latency(requests: DataFrame, share: float = 0.95) -> DataFrame:
    """One row: the given quantile of milliseconds, exact; it holds all distinct values, `sketches` doesn't."""
    return requests.agg(F.round(F.percentile("millis", F.lit(share)), 6).alias("p"))


#: Size of a quantile sketch, and how far from its share an estimate's rank may be (some six standard errors of it).
SKETCH_SIZE, RANK_ERROR = 400, 0.02


def sketches(requests: DataFrame, *by: str, size: int = SKETCH_SIZE) -> DataFrame:
    """(by..., sketch, n, peak) of milliseconds: KLL sketches, a few kilobytes each, to be stored a window and merged. Null values are left out."""
    known = requests.where(F.col("millis").isNotNull())
    return known.groupBy(*by).agg(F.kll_sketch_agg_double("millis", F.lit(size)).alias("sketch"), F.count("*").alias("n"), F.max("millis").alias("peak"))


def merged_quantiles(windows: DataFrame, shares: tuple[float, ...], *by: str) -> DataFrame:
    """(by..., n, peak, quantiles) of stored sketches: quantiles within RANK_ERROR of their shares in rank, in the shares' order."""
    whole = windows.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"), F.max("peak").alias("peak"))
    return whole.where("n > 0").select(*by, "n", "peak", F.array(*[F.kll_sketch_get_quantile_double("sketch", F.lit(float(s))) for s in shares]).alias("quantiles"))


def histogram(requests: DataFrame, bounds: tuple[float, ...], *by: str) -> DataFrame:
    """(by..., le, n, total): how many requests took at most le milliseconds, and their sum, for each bound and infinity. Null values are left out."""
    known = requests.where(F.col("millis").isNotNull())
    steps = (*bounds, float("inf"))
    within = [F.struct(F.lit(b).alias("le"), F.count_if(F.col("millis") <= b).alias("n"), F.coalesce(F.sum(F.when(F.col("millis") <= b, F.col("millis"))), F.lit(0.0)).alias("total")) for b in steps]
    return known.groupBy(*by).agg(F.array(*within).alias("_h")).select(*by, F.explode("_h").alias("_h")).select(*by, "_h.*")


def merged_histogram(windows: DataFrame, *by: str) -> DataFrame:
    """Stored histograms of the same bounds as one: cumulative counts add up."""
    return windows.groupBy(*by, "le").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def report(hits: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """One row: mean recall at k over the judged queries."""
    return recall_at(hits, relevant, k).agg(F.round(F.avg("recall"), 6).alias(f"recall_at_{k}"), F.count("*").alias("queries"))
