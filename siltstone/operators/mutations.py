"""Writes as state changes: each returns the table's state after it, and how many rows it touched.

Spark's files are immutable, so a mutation is a plan from the old state to the
new; ``replace_table`` makes it durable.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Change:
    state: DataFrame
    affected: DataFrame  # one row: affected
    #: Of an update or delete: the rows before it, which of them it touches, and what it makes of them.
    step: tuple[DataFrame, Column, Callable[[DataFrame], DataFrame]] | None = None

    def count(self) -> int:
        return self.affected.first()["affected"]

    def write(self, path: str) -> int:
        """Write the state to a new folder and say how many rows were touched.

        Updates and deletes are counted while they are written, in one pass: they
        move no rows, so each task counts what it writes, and Spark takes the count of a
        task once, repeated or not. Other changes are counted by a pass of their own.
        """
        if not self.step:
            self.state.write.parquet(path)
            return self.count()
        source, hit, becomes = self.step
        seen = Observation()
        becomes(source.observe(seen, F.count_if(hit).alias("affected"))).write.parquet(path)
        return seen.get["affected"]


def _changed(df: DataFrame, hit: Column, becomes: Callable[[DataFrame], DataFrame]) -> Change:
    return Change(becomes(df), df.agg(F.count_if(hit).alias("affected")), (df, hit, becomes))


def update(df: DataFrame, predicate: Column, now: Column | None = None, **values) -> Change:
    """Set columns where the predicate holds (unknown counts as false); updated_at follows if there is one."""
    values = {n: v if isinstance(v, Column) else F.lit(v) for n, v in values.items()}
    if now is not None and "updated_at" in df.columns:
        values.setdefault("updated_at", now)
    hit = F.coalesce(predicate, F.lit(False))
    new = {n: F.when(hit, v.cast(df.schema[n].dataType)).otherwise(F.col(n)) for n, v in values.items()}
    return _changed(df, hit, lambda rows: rows.withColumns(new))


def set_not_nil(df: DataFrame, predicate: Column, **values) -> Change:
    """As update, leaving columns whose new value is None."""
    return update(df, predicate, **{n: v for n, v in values.items() if v is not None})


def delete(df: DataFrame, predicate: Column) -> Change:
    """Rows whose predicate is unknown stay."""
    hit = F.coalesce(predicate, F.lit(False))
    return _changed(df, hit, lambda rows: rows.where(~hit))


def insert(df: DataFrame, rows: DataFrame, defaults: dict | None = None, required: tuple[str, ...] = ()) -> Change:
    """Append rows: missing columns get their default or null, a null in a required one fails."""
    for name, value in (defaults or {}).items():
        value = value if isinstance(value, Column) else F.lit(value)
        rows = rows.withColumn(name, F.coalesce(F.col(name), value) if name in rows.columns else value)
    for name in required:
        rows = rows.withColumn(name, F.coalesce(F.col(name), F.raise_error(F.lit(f"{name} is required")).cast(rows.schema[name].dataType)))
    return Change(df.unionByName(rows, allowMissingColumns=True), rows.agg(F.count("*").alias("affected")))


def upsert_by(df: DataFrame, rows: DataFrame, key: list[str]) -> Change:
    """Rows replace those of equal key."""
    return Change(df.join(rows.select(*key), key, "left_anti").unionByName(rows, allowMissingColumns=True), rows.agg(F.count("*").alias("affected")))


def upsert_documents(df: DataFrame, products: DataFrame) -> DataFrame:
    """Products as documents by title, product_id before product_name: known titles keep their id, new ones get the next."""
    title = F.concat(F.coalesce("product_id", F.lit("")), F.coalesce("product_name", F.lit("")))
    incoming = products.select(title.alias("title"), F.col("content").alias("text")).groupBy("title").agg(F.max("text").alias("text"))
    top = df.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    merged = df.join(incoming.withColumnRenamed("text", "_text"), "title", "full")
    kept = merged.where("id is not null").withColumn("text", F.coalesce("_text", "text")).drop("_text")
    # Ids of new titles: their place in title order, by ranges, without gathering them in one task.
    fresh = merged.where("id is null").select("title", F.col("_text").alias("text"))
    numbered = numbered_rows(fresh, "title").join(F.broadcast(top)).select((F.col("_n") + F.col("_top")).alias("id"), "title", "text")
    return kept.select("id", "title", "text").unionByName(numbered)


def numbered_rows(df: DataFrame, by: str) -> DataFrame:
    """df with _n from 1 in the order of `by`: counts per range, then numbers within each."""
    from pyspark.sql import Window

    from siltstone.runtime import cut

    placed = cut(df.repartitionByRange(by)).withColumn("_part", F.spark_partition_id())
    counts = placed.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_before"))  # a row for each partition
    within = F.row_number().over(Window.partitionBy("_part").orderBy(by))
    return placed.withColumn("_in", within).join(F.broadcast(offsets), "_part").withColumn("_n", F.col("_in") + F.col("_before")).drop("_part", "_in", "_before")


def replace_table(spark: SparkSession, df: DataFrame, name: str) -> None:
    """Write the new state whole under a fresh name, then move the old table aside and the new one in its place.

    A failed write leaves the old table; between the two renames, which are
    metadata only, the name is briefly absent. One writer per table is assumed.
    """
    token = uuid.uuid4().hex[:12]
    df.write.saveAsTable(f"{name}_{token}")
    known = spark.catalog.tableExists(name)
    if known:
        spark.sql(f"ALTER TABLE {name} RENAME TO {name}_old_{token}")
    spark.sql(f"ALTER TABLE {name}_{token} RENAME TO {name}")
    if known:
        spark.sql(f"DROP TABLE {name}_old_{token}")
