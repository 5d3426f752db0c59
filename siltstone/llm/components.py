"""Connected components by alternating large-star and small-star rounds.

Every round is two grouped minima, taken map-side first, and two joins under
salted keys, so no node's neighbours are ever gathered in one task, and nothing
but two numbers a round reaches the driver.

Defined cases: edges of a node with itself, repeated ones and both directions of
one are allowed; nulls are not; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.runtime import cut


#: Pairs that a partition of a round's result is to hold.
PAIRS_A_TASK = 200_000
#: A node's neighbours are dealt to so many groups when they learn its least one, however many they are.
SALTS = 8


def _salted(rows: DataFrame, by: str) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))


def _spread(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _large_star(pairs: DataFrame) -> DataFrame:
    both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _salted(both.where("v > u"), "v").join(_spread(low), ["u", "salt"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    down = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = _salted(down, "v").join(_spread(low), ["u", "salt"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _mark(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of non-null longs -> (node, component), the least node of each component.

    Only nodes with an edge to another node appear, and not the least node itself.
    """
    pairs = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(pairs)
    while mark[0]:
        # No more partitions, and so files, than the pairs of the round before ask for; a round makes twice as many at most.
        pairs = cut(_small_star(_large_star(pairs)).coalesce(-(-2 * mark[0] // PAIRS_A_TASK)))
        before, mark = mark, _mark(pairs)
        if mark == before:
            break
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))


def least_of(labels: DataFrame, values: DataFrame) -> DataFrame:
    """labels (node, component) as above, values (node, value) -> (node, value), the least of the node's component.

    Every node of a component has a row, its least one too. Minima are taken map-side
    first and dealt back under salted keys, so a giant component is nobody's single task.
    """
    every = labels.union(labels.select(F.col("component").alias("node"), "component").distinct())
    least = every.join(values, "node").groupBy("component").agg(F.min("value").alias("value"))
    return _salted(every, "node").join(_spread(least), ["component", "salt"]).select("node", "value")


class Forest:
    """Union of links inside one task, kept as the least index of each tree."""

    def __init__(self, n: int):
        self.label = np.arange(n, dtype=np.int64)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while True:
            a, b = label[i], label[j]
            open_ = a != b
            if not open_.any():
                return
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            low = np.minimum(a, b)
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label[:] = up

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        child = np.flatnonzero(self.label != np.arange(len(self.label)))
        return child, self.label[child]
