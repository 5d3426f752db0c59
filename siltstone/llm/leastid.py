"""The least id of every group of equal contents, for filters and archives that keep the first of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.runtime import cut

#: Rows of some 50 bytes that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 100_000


def least_ids(rows: DataFrame, content: str, doc_id: str) -> DataFrame:
    """(content, least) of the contents that a larger id than the least has too; minima are taken map-side first, so a hot content is nobody's single task."""
    per = rows.groupBy(content).agg(F.min(doc_id).alias("least"), F.max(doc_id).alias("most"), F.count("*").alias("n"), F.count(doc_id).alias("known"))
    return cut(per.where("most > least or known < n").where("least is not null").select(content, "least"))


def sized(rows: DataFrame) -> DataFrame:
    """rows, broadcast if they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows
