"""A small relational query layer: predicates, edges, traversals, eager loads, order, pages.

A Query holds a DataFrame, so every call only grows the logical plan; Catalyst
prunes columns, pushes filters and picks joins. Edges are declared once, in a
Schema, as equal columns of two tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.runtime import cut


class NotFound(LookupError):
    """No row where one was asked for."""


class NotSingular(LookupError):
    """More than one row where one was asked for."""


class P:
    """Predicates on a column. NULL compares as unknown, so such rows are in neither a predicate nor its negation."""

    def __init__(self, name: str):
        self.column = F.col(name)

    def eq(self, v) -> Column:
        return self.column == v

    def neq(self, v) -> Column:
        return self.column != v

    def isin(self, *vs) -> Column:
        return self.column.isin(*vs) if vs else F.lit(False)

    def notin(self, *vs) -> Column:
        return ~self.column.isin(*vs) if vs else F.lit(True)

    def gt(self, v) -> Column:
        return self.column > v

    def gte(self, v) -> Column:
        return self.column >= v

    def lt(self, v) -> Column:
        return self.column < v

    def lte(self, v) -> Column:
        return self.column <= v

    def contains(self, v: str) -> Column:
        return self.column.contains(v)

    def has_prefix(self, v: str) -> Column:
        return self.column.startswith(v)

    def has_suffix(self, v: str) -> Column:
        return self.column.endswith(v)

    def equal_fold(self, v: str) -> Column:
        return F.lower(self.column) == v.lower()

    def contains_fold(self, v: str) -> Column:
        return F.lower(self.column).contains(v.lower())

    def is_nil(self) -> Column:
        return self.column.isNull()

    def not_nil(self) -> Column:
        return self.column.isNotNull()


def all_of(*predicates: Column) -> Column:
    out = F.lit(True)
    for p in predicates:
        out = out & p
    return out


def any_of(*predicates: Column) -> Column:
    out = F.lit(False)
    for p in predicates:
        out = out | p
    return out


def none_of(predicate: Column) -> Column:
    return ~predicate


def ordering(name: str, direction: str = "ASC") -> Column:
    """Nulls last ascending and first descending; any other direction is an error."""
    if direction not in ("ASC", "DESC"):
        raise ValueError(f"unknown direction {direction!r}")
    return F.col(name).asc_nulls_last() if direction == "ASC" else F.col(name).desc_nulls_first()


@dataclass(frozen=True)
class Edge:
    """From each row to the rows of another table with other.there == here; `single` if there is one at most."""

    table: str
    here: str
    there: str
    single: bool = False


@dataclass
class Schema:
    tables: dict[str, DataFrame]
    edges: dict[str, dict[str, Edge]] = field(default_factory=dict)
    #: Applied to every query of a table, e.g. row-level security.
    interceptors: dict[str, list[Callable[[DataFrame], DataFrame]]] = field(default_factory=dict)

    def query(self, table: str) -> Query:
        df = self.tables[table]
        for step in self.interceptors.get(table, []):
            df = df.transform(step)
        return Query(self, table, df)


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    page: int
    size: int
    total: int


class Query:
    def __init__(self, schema: Schema, table: str, df: DataFrame, traversed: bool = False, ordered: tuple = ()):
        self.schema, self.table, self.df, self.traversed, self.ordered = schema, table, df, traversed, ordered

    def _with(self, df: DataFrame, **changed) -> Query:
        return Query(self.schema, self.table, df, **({"traversed": self.traversed, "ordered": self.ordered} | changed))

    def _edge(self, name: str) -> Edge:
        return self.schema.edges[self.table][name]

    def where(self, *predicates: Column) -> Query:
        return self._with(self.df.where(all_of(*predicates)))

    def _neighbours(self, edge: str, predicates: tuple[Column, ...]) -> tuple[DataFrame, Column]:
        e = self._edge(edge)
        side = self.schema.query(e.table).where(*predicates).df.where(F.col(e.there).isNotNull()).select(F.col(e.there).alias("_there"))
        return side, F.col(e.here) == F.col("_there")

    def has(self, edge: str, *predicates: Column) -> Query:
        """Rows with a neighbour (that satisfies the predicates)."""
        side, on = self._neighbours(edge, predicates)
        return self._with(self.df.join(side, on, "left_semi"))

    def has_not(self, edge: str, *predicates: Column) -> Query:
        side, on = self._neighbours(edge, predicates)
        return self._with(self.df.join(side, on, "left_anti"))

    def traverse(self, edge: str) -> Query:
        """The neighbours themselves, each once."""
        e = self._edge(edge)
        target = self.schema.query(e.table)
        # A semi join keeps each neighbour once without a distinct over its columns.
        keys = self.df.where(F.col(e.here).isNotNull()).select(F.col(e.here).alias("_here"))
        return Query(self.schema, e.table, target.df.join(keys, F.col(e.there) == F.col("_here"), "left_semi"), traversed=True)

    def load(self, edge: str, into: str, columns: list[str], *predicates: Column) -> Query:
        """Rows with their neighbours as a sorted array of structs (a struct for a single edge); none gives an empty array."""
        e = self._edge(edge)
        side = self.schema.query(e.table).where(*predicates).df
        packed = side.select(F.col(e.there).alias("_there"), F.struct(*columns).alias("_row"))
        if e.single:
            return self._with(self.df.join(packed, F.col(e.here) == F.col("_there"), "left").withColumnRenamed("_row", into).drop("_there"))
        lists = packed.groupBy("_there").agg(F.sort_array(F.collect_list("_row")).alias(into))
        joined = self.df.join(lists, F.col(e.here) == F.col("_there"), "left").drop("_there")
        return self._with(joined.withColumn(into, F.coalesce(into, F.array().cast(joined.schema[into].dataType))))

    def pairs(self, edge: str, columns: list[str], *predicates: Column) -> DataFrame:
        """(id, columns...) a row for each neighbour: what load gives, for hubs whose neighbours are too many for one row."""
        e = self._edge(edge)
        side = self.schema.query(e.table).where(*predicates).df.select(F.col(e.there).alias("_there"), *columns)
        return self.df.select("id", F.col(e.here).alias("_here")).join(side.withColumnsRenamed({"id": "_id"}), F.col("_here") == F.col("_there")).drop("_here", "_there")

    def neighbour_count(self, edge: str, into: str) -> Query:
        e = self._edge(edge)
        counts = self.schema.query(e.table).df.groupBy(F.col(e.there).alias("_there")).agg(F.count("*").alias(into))
        joined = self.df.join(counts, F.col(e.here) == F.col("_there"), "left").drop("_there")
        return self._with(joined.withColumn(into, F.coalesce(into, F.lit(0))))

    def neighbour_field(self, edge: str, name: str, into: str) -> Query:
        """A field of a single neighbour, e.g. to order by."""
        e = self._edge(edge)
        side = self.schema.query(e.table).df.select(F.col(e.there).alias("_there"), F.col(name).alias(into))
        return self._with(self.df.join(side, F.col(e.here) == F.col("_there"), "left").drop("_there"))

    def order(self, *by: Column) -> Query:
        return self._with(self.df.orderBy(*by), ordered=by)

    def limit(self, n: int) -> Query:
        return self._with(self.df.limit(n))

    def offset(self, n: int) -> Query:
        return self._with(self.df.offset(n))

    def unique(self) -> Query:
        return self._with(self.df.distinct())

    def select(self, *columns: str) -> DataFrame:
        return self.df.select(*columns)

    def select_unique(self, *columns: str) -> DataFrame:
        return self._with(self.df.select(*columns)).unique().df

    def group_by(self, *columns: str) -> Grouped:
        return Grouped(self.df, columns)

    def aggregate(self, **fns: Column) -> DataFrame:
        return self.df.agg(*[c.alias(n) for n, c in fns.items()])

    def count(self) -> int:
        return self.df.count()

    def exists(self) -> bool:
        return not self.df.isEmpty()

    def ids(self) -> DataFrame:
        return self.df.select("id")

    def first(self):
        rows = self.df.take(1)
        if not rows:
            raise NotFound(self.table)
        return rows[0]

    def only(self):
        rows = self.df.take(2)
        if not rows:
            raise NotFound(self.table)
        if len(rows) > 1:
            raise NotSingular(self.table)
        return rows[0]

    def page(self, number: int, size: int) -> Page:
        """The total before paging, and one page; by id descending unless ordered."""
        if number < 1 or size < 1:
            raise ValueError("page number and size start at 1")
        df = self.df if self.ordered else self.df.orderBy(F.col("id").desc())
        return Page(df.offset((number - 1) * size).limit(size), number, size, self.df.count())


@dataclass
class Grouped:
    df: DataFrame
    columns: tuple[str, ...]

    def aggregate(self, **fns: Column) -> DataFrame:
        return self.df.groupBy(*self.columns).agg(*[c.alias(n) for n, c in fns.items()])


#: Rows before a page's end up to which the page is simply the last of the first rows, and ranges of keys of a deeper one at least.
SHALLOW, RANGES = 10_000, 64


def numbered_page(df: DataFrame, number: int, size: int, key: str) -> DataFrame:
    """A page with the total on each of its rows, no window over all rows; the largest keys come first, null last.

    Of a deep page the keys alone are counted by ranges, a row a range to the driver, and only the
    range that holds the page is then read and sorted.
    """
    total = df.agg(F.count("*").alias("total"))
    skip = (number - 1) * size
    rows = df
    if skip + size > SHALLOW:
        rows, skip = _range_of(df, key, skip, size)
    rows = rows.orderBy(F.col(key).desc()).offset(skip).limit(size)
    return rows.crossJoin(F.broadcast(total)).withColumns({"page": F.lit(number), "size": F.lit(size)})


def _range_of(df: DataFrame, key: str, skip: int, size: int) -> tuple[DataFrame, int]:
    """The rows of the ranges of keys that hold a page, and how many of them come before it."""
    n = max(RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.select(F.col(key).alias("k")).where("k is not null").repartitionByRange(n, F.col("k").desc())  # equal keys are in one range
    ranges = dealt.groupBy(F.spark_partition_id()).agg(F.min("k").alias("low"), F.max("k").alias("high"), F.count("*").alias("n")).collect()
    before, low, high, first = 0, None, None, skip
    for r in sorted(ranges, key=lambda r: r["high"], reverse=True):
        if before < skip + size and before + r["n"] > skip:
            if high is None:
                high, first = r["high"], skip - before
            low = r["low"]
        before += r["n"]
    held = F.lit(False) if high is None else F.col(key).between(F.lit(low), F.lit(high))
    if skip + size > before:  # the page reaches into the rows without a key
        held = held | F.col(key).isNull()
        first = first if high is not None else skip - before
    return df.where(held), first


def _climbed(folders: DataFrame, separator: str) -> DataFrame:
    """(id, up, path, depth) of the ids that occur once, after each row has jumped over as many ancestors as it could: up is null if a root was reached.

    Every round doubles how far a row has come, so there are as many as the depth has binary digits. It
    ends when a round brings no row to its end: what is left goes in circles. Rows whose ancestor isn't there go.
    """
    once = folders.where("id is not null").groupBy("id").agg(F.count("*").alias("n"), F.first("parent_id").alias("up"), F.first("name").alias("path")).where("n = 1")
    state = cut(once.select("id", "up", "path", F.lit(0).alias("depth")))
    open_, before = state.where("up is not null").count(), -1
    while open_ and open_ != before:
        above = state.select(F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("path").alias("_path"), F.col("depth").alias("_depth"))
        hit = F.col("_id").isNotNull()
        joined = state.join(above, F.col("up") == F.col("_id"), "left").where(F.col("up").isNull() | hit)
        state = cut(joined.select("id", F.col("_up").alias("up"), F.when(hit, F.concat_ws(separator, "_path", "path")).otherwise(F.col("path")).alias("path"), F.when(hit, F.col("depth") + F.col("_depth") + 1).otherwise(F.col("depth")).alias("depth")))
        before, open_ = open_, state.where("up is not null").count()
    return state


def tree_paths(folders: DataFrame, separator: str = "/") -> DataFrame:
    """(id, path, depth) of folders (id, parent_id, name), by pointer doubling, however deep.

    Folders that no root leads to, as in a cycle or below a missing one, have no path; nor have ids that
    occur more than once, which are not followed. tree_faults names them.
    """
    return _climbed(folders, separator).where("up is null").select("id", "path", "depth")


def tree_faults(folders: DataFrame) -> DataFrame:
    """(id, fault) of the folders without a path: repeated, cycle (in one or below it), or lost (below a missing, null or repeated one)."""
    climbed = _climbed(folders.withColumn("name", F.lit("")), "").select(F.col("id").alias("_id"), "up")
    per = folders.groupBy("id").agg(F.count("*").alias("n"))
    joined = per.join(climbed, F.col("id") == F.col("_id"), "left")
    fault = F.when(F.col("n") > 1, "repeated").when(F.col("_id").isNull(), "lost").when(F.col("up").isNotNull(), "cycle")
    return joined.select("id", fault.alias("fault")).where("fault is not null")


def newest(df: DataFrame, per: str, n: int, *by: str) -> DataFrame:
    """The newest n rows of each group; n <= 0 keeps all."""
    if n <= 0:
        return df
    order = Window.partitionBy(per).orderBy(*[F.col(b).desc_nulls_last() for b in by])
    return df.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n).drop("_rank")


def differences(want: DataFrame, got: DataFrame) -> DataFrame:
    """Rows in one but not in the other, repeats counted, with the side they are missing from."""
    return want.exceptAll(got).withColumn("missing_from", F.lit("got")).unionByName(got.exceptAll(want).withColumn("missing_from", F.lit("want")))
