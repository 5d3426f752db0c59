"""Which labelled rows a model may learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.runtime import cut

HELD_OUT_OF = 5


def held_out(doc_id: Column) -> Column:
    """True if crc32(doc_id as text) mod 5 is 0; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % HELD_OUT_OF == 0


def chosen(salt: str, share: float, *by: Column) -> Column:
    """True for a share of all rows, by a hash of the columns alone."""
    return F.pmod(F.xxhash64(F.lit(salt), *[F.coalesce(c.cast("string"), F.lit("")) for c in by]), F.lit(1 << 32)) < F.lit(share * (1 << 32))


def share_of(df: DataFrame, most: int) -> float:
    """The share of df's rows that makes about most rows."""
    return min(1.0, most / max(1, df.count()))


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, kind: int | None = None) -> DataFrame:
    """(text, y) of about most labelled documents outside the held-out fold, all if there are fewer.

    The ids are picked by hash first, so the side that is broadcast has about
    most rows whatever the input, and no text but the picked ones is shuffled.
    Repeated rows count once; an id of many texts is picked from by their hashes.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("y"))
    known = known.where(~held_out(F.col("_id")) & (F.col("y").isin(0, 1) if kind is None else F.col("y") == kind))
    picked = cut(known.where(chosen(label, share_of(known, most), F.col("_id"))).dropDuplicates(["_id", "y"]))
    narrow = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("digest"))
    found = narrow.join(F.broadcast(picked), narrow["doc_id"] == picked["_id"]).dropDuplicates(["_id", "y", "digest"])
    found = cut(found.select("_id", "digest", "text", "y"))
    share = share_of(found, 2 * most)
    return (found if share == 1.0 else found.where(chosen("rows", share, F.col("_id"), F.col("digest")))).select("text", "y")
