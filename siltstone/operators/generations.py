"""Numbered states of a folder of tables, published by one atomic step.

A writer puts what belongs to state n into folders of that number, over what a
failed try may have left there, and publishes n last. A reader asks which state is
published and reads only what belongs to it, so it never sees half a write. `base` is
the oldest number that still counts. One writer at a time is assumed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.runtime import _in_store, cut, exists, remove

#: Keys that are gone, of some 20 bytes each, which are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


class State(NamedTuple):
    n: int
    base: int


def current(spark: SparkSession, root: str) -> State | None:
    """The published state with the largest number, None if there is none."""
    store, at = _in_store(spark, f"{root.rstrip('/')}/published")
    if not store.exists(at):
        return None
    names = [str(x.getPath().getName()) for x in store.listStatus(at)]
    return max((State(*map(int, name.split("-"))) for name in names), default=None)


def publish(spark: SparkSession, root: str, state: State) -> None:
    """Make a directory, which a store does whole or not at all; earlier marks go, as no reader needs them."""
    before = current(spark, root)
    store, at = _in_store(spark, f"{root.rstrip('/')}/published/{state.n}-{state.base}")
    if not store.mkdirs(at):
        raise OSError(f"state {state.n} of {root} can't be published")
    if before and before != state:
        remove(spark, f"{root.rstrip('/')}/published/{before.n}-{before.base}")


@dataclass(frozen=True)
class Segments:
    """Tables of one root, a folder for each write: rows of a key are those of its last write, unless a later one took the key away.

    A write puts rows into <table>/segment=n and the keys that it replaces or deletes into
    gone/before=n. Reads union the segments, as many as writes since the last compaction.
    """

    root: str
    key: str

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def state(self, spark: SparkSession) -> State | None:
        return current(spark, self.root)

    def next(self, spark: SparkSession, *names: str) -> State:
        """The state that is written now. What a failed try left in its folders goes."""
        state = self.state(spark)
        n, base = (state.n + 1, state.base) if state else (0, 0)
        for path in (*(self.path(f"{name}/segment={n}") for name in names), self.path(f"gone/before={n}")):
            if exists(spark, path):
                remove(spark, path)
        return State(n, base)

    def put(self, rows: DataFrame, name: str, state: State, **options: object) -> None:
        rows.write.options(**options).parquet(self.path(f"{name}/segment={state.n}"))

    def take(self, keys: DataFrame, state: State) -> None:
        """The keys' rows of earlier segments are dead from this state on."""
        keys.select(self.key).distinct().write.parquet(self.path(f"gone/before={state.n}"))

    def _each(self, spark: SparkSession, name: str, column: str, first: int, last: int) -> DataFrame | None:
        paths = [(n, self.path(f"{name}={n}")) for n in range(first, last + 1)]
        found = [spark.read.parquet(path).withColumn(column, F.lit(n)) for n, path in paths if exists(spark, path)]
        return reduce(DataFrame.unionByName, found) if found else None

    def every(self, spark: SparkSession, name: str) -> DataFrame:
        """All rows of a table, dead ones too, with _segment."""
        state = self.state(spark)
        found = state and self._each(spark, f"{name}/segment", "_segment", state.base, state.n)
        if found is None:
            raise LookupError(f"nothing is published at {self.root}")
        return found

    def gone(self, spark: SparkSession) -> DataFrame | None:
        """(_gone, _before): keys, and the segment that their rows must be of, or of a later one, to live. None if nothing was ever replaced."""
        state = self.state(spark)
        gone = self._each(spark, "gone/before", "_before", state.base + 1, state.n)
        return None if gone is None else cut(gone.groupBy(F.col(self.key).alias("_gone")).agg(F.max("_before").alias("_before")))

    def live(self, rows: DataFrame) -> DataFrame:
        """rows (key, _segment, ...) that no later write replaced or deleted."""
        latest = self.gone(rows.sparkSession)
        if latest is None:
            return rows
        latest = F.broadcast(latest) if latest.count() <= BROADCAST_ROWS else latest
        return rows.join(latest, (rows[self.key] == F.col("_gone")) & (F.col("_segment") < F.col("_before")), "left_anti")

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return self.live(self.every(spark, name)).drop("_segment")

    def publish(self, spark: SparkSession, state: State) -> None:
        publish(spark, self.root, state)

    def rebase(self, spark: SparkSession, state: State, *names: str) -> None:
        """Publish a state whose segments hold everything, and drop the older ones."""
        old = self.state(spark)
        publish(spark, self.root, State(state.n, state.n))
        for n in range(old.base, state.n):
            for path in (*(self.path(f"{name}/segment={n}") for name in names), self.path(f"gone/before={n}")):
                remove(spark, path)
