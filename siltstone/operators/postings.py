"""The lexical index as blocks of postings by term, and BM25 over it that reads only the blocks it needs.

A task closes blocks of the chunks that it sees, some HELD postings at a time; of these small
ones of a term are put together by a shuffle of blocks, so no posting is ever a row that is sorted.
A block has up to BLOCK postings of one field and term, those of the most occurrences
first, and says how many it has, their most occurrences and their least length: what
bounds their scores whatever the corpus statistics become. Blocks are sorted by term, so
a search reads the row groups of its terms. Statistics are kept as changes, a row for
each field, and each field and term, that a write touched; their sums are exact.

A search first scores the best block of each term. The k-th best of these sums is a
floor for each query, and a block whose bound, with all that the query's other terms can add,
stays below the floor of every query that asks for its term is not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import words
from siltstone.operators.retrieval import BM25_B, BM25_K1, in_blocks, ranked, terms
from siltstone.runtime import cut

BLOCK = 256
#: Postings of a field that a task holds before it closes their blocks, some 100 bytes each while it does.
HELD = 1 << 21
#: Blocks that leave a task at a time.
BATCH_ROWS = 8192
#: Terms that are pushed to the scan as a filter; a larger set is joined.
PUSHED_TERMS = 200
#: Blocks to be read that are broadcast as a list; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Scores are rounded to six places before they are ranked.
_SLACK = 1e-6

#: A list's numbers are the bytes of one value, little-endian as in LISTS, which is moved as it is.
BLOCKS = "field string, term string, n int, total long, most_tf long, least_dl int, documents binary, chunks binary, tfs binary, dls binary"
LISTS = {"documents": np.dtype("<i8"), "chunks": np.dtype("<i4"), "tfs": np.dtype("<i4"), "dls": np.dtype("<i4")}
_NAMES = [x.split()[0] for x in BLOCKS.split(", ")]


def _closed(field: str | pa.Array, terms_: pa.Array, group: np.ndarray, postings: list[np.ndarray], size: int) -> pa.RecordBatch:
    """Postings (document, chunk, tf, dl), each of a group, become blocks: the most occurrences first, then the shortest. A group's field and term are its place in these."""
    most = 0xFFFF  # the order of longer chunks is open
    key = (group.astype(np.int64) << 32) | ((most - np.minimum(postings[2], most)).astype(np.int64) << 16) | np.minimum(postings[3], most)
    order = np.argsort(key, kind="stable")
    group, postings = group[order], [x[order].astype(kind, copy=False) for x, kind in zip(postings, LISTS.values(), strict=True)]
    n = len(group)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]][:n])
    within = np.arange(n) - np.repeat(first, np.diff(np.r_[first, n]))
    starts = np.flatnonzero(within % size == 0)
    at, offsets = pa.array(group[starts]), np.r_[starts, n].astype(np.int32)
    fields = pa.array([field] * len(starts), pa.string()) if isinstance(field, str) else field.take(at)
    total, most_tf, least_dl = (f.reduceat(x, starts) if n else x for f, x in ((np.add, postings[2].astype(np.int64)), (np.maximum, postings[2]), (np.minimum, postings[3])))
    heads = [fields, terms_.take(at).cast(pa.string()), pa.array(np.diff(offsets)), pa.array(total), pa.array(most_tf.astype(np.int64)), pa.array(least_dl)]
    lists = [pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets * np.int32(x.itemsize)), pa.py_buffer(x)]) for x in postings]
    return pa.RecordBatch.from_arrays([*heads, *lists], _NAMES)


def _in_parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, BATCH_ROWS):
        yield batch.slice(at, BATCH_ROWS)


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of blocks, for each posting its row, and (document, chunk, tf, dl)."""
    flat = []
    for name, kind in LISTS.items():
        x = batch.column(name)
        at = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1] if len(x) else [0, 0]
        flat.append(np.frombuffer(x.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].view(kind))
    return np.repeat(np.arange(batch.num_rows), batch.column("n").to_numpy()), flat


def _inverted(batches: Iterator[pa.RecordBatch], fields: tuple[str, ...], at: np.ndarray, size: int, held: int) -> Iterator[pa.RecordBatch]:
    """Of rows (document_id, chunk_index, a lower-case text for each field): blocks of some `held` postings at a time."""
    holds, waiting = words.letters(at), {f: [] for f in fields}

    def close(field: str) -> Iterator[pa.RecordBatch]:
        parts, waiting[field] = waiting[field], []
        # One numbering of the terms of all parts.
        every = pa.concat_arrays([names for names, _, _ in parts]).dictionary_encode()
        number, upto = every.indices.to_numpy(), np.cumsum([0] + [len(names) for names, _, _ in parts])
        group = np.concatenate([number[start + code] for start, (_, code, _) in zip(upto, parts)])  # noqa: B905
        yield from _in_parts(_closed(field, every.dictionary, group, [np.concatenate(x) for x in zip(*[p for _, _, p in parts], strict=True)], size))

    for batch in batches:
        n = batch.num_rows
        document, index = (batch.column(c).to_numpy() for c in (0, 1))
        for field, texts in zip(fields, batch.columns[2:], strict=True):
            terms_, counts = words.split(texts, holds)
            coded = terms_.dictionary_encode()
            key, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), counts), return_counts=True)
            if len(key):
                row = key % n
                waiting[field].append((coded.dictionary, key // n, [document[row], index[row], tf.astype(np.int32), counts[row]]))
            if sum(len(code) for _, code, _ in waiting[field]) >= held:
                yield from close(field)
    for field in fields:
        if waiting[field]:
            yield from close(field)


def inverted(chunks_: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Blocks of chunks, of those that a task sees one after the other: the inverted index, made where a chunk is, without a shuffle. blocks() puts them together."""
    at, size, held = words.edges(chunks_.sparkSession), BLOCK, HELD
    lowered = [F.coalesce(F.lower(f), F.lit("")).alias(f) for f in fields]
    rows = chunks_.select(F.col("document_id").cast("long").alias("document_id"), F.col("chunk_index").cast("int").alias("chunk_index"), *lowered)
    return rows.mapInArrow(lambda batches: _inverted(batches, fields, at, size, held), BLOCKS)


def _merged(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Blocks, sorted by term and field: those of one become as few as they can."""
    for batch in batches:
        if batch.num_rows:
            codes = [batch.column(c).dictionary_encode().indices.to_numpy() for c in (0, 1)]
            new = np.r_[True, (codes[0][1:] != codes[0][:-1]) | (codes[1][1:] != codes[1][:-1])]
            row, lists = _flat(batch)
            first = pa.array(np.flatnonzero(new))
            yield from _in_parts(_closed(batch.column(0).take(first), batch.column(1).take(first), (np.cumsum(new) - 1)[row], lists, size))


def blocks(parts: DataFrame) -> DataFrame:
    """Blocks of all parts, sorted by term, with a number each; a term that is everywhere is dealt to several tasks."""
    order = ["term", "field", F.col("most_tf").desc(), "least_dl", F.xxhash64("documents", "chunks")]
    rows = parts.select(*_NAMES).repartitionByRange(*order).sortWithinPartitions(*order)
    size = BLOCK
    return rows.mapInArrow(lambda batches: _merged(batches, size), BLOCKS).withColumn("block", F.monotonically_increasing_id())


def _kept(batches: Iterator[pa.RecordBatch], keys: np.ndarray, before: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    """Blocks without the postings of documents that a later segment replaced: keys, in order, are dead in segments less than `before`."""
    for batch in batches:
        row, lists = _flat(batch)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, lists[0]), len(keys) - 1)
            live = (keys[at] != lists[0]) | (batch.column("_segment").to_numpy()[row] >= before[at])
            row, lists = row[live], [x[live] for x in lists]
        yield _closed(batch.column("field"), batch.column("term"), row, lists, size)


def kept(blocks_: DataFrame, gone: pa.Table | None = None) -> DataFrame:
    """Blocks of blocks (with _segment), without the postings of gone (document_id, and the segment from which on its rows live), which is shipped to every task."""
    gone = pa.table({"key": pa.array([], pa.int64()), "before": pa.array([], pa.int32())}) if gone is None else gone.sort_by(gone.column_names[0])
    shipped, size = blocks_.sparkSession.sparkContext.broadcast(tuple(gone.column(c).to_numpy() for c in (0, 1))), BLOCK
    return blocks_.drop("block").mapInArrow(lambda batches: _kept(batches, *shipped.value, size), BLOCKS)


def _regrouped(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Of rows (field, term, document_id, chunk_index, tf, dl): blocks of a batch's postings each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = [batch.column(c).dictionary_encode() for c in (0, 1)]
        key = codes[0].indices.to_numpy().astype(np.int64) * max(1, len(codes[1].dictionary)) + codes[1].indices.to_numpy()
        _, first, group = np.unique(key, return_index=True, return_inverse=True)
        at = pa.array(first)
        yield _closed(batch.column(0).take(at), batch.column(1).take(at), group, [batch.column(c).to_numpy() for c in range(2, 6)], size)


def closed(rows: DataFrame) -> DataFrame:
    """Blocks of (document_id, chunk_index, field, term, tf, dl), as opened() gives them."""
    size = BLOCK
    return rows.select("field", "term", "document_id", "chunk_index", "tf", "dl").mapInArrow(lambda batches: _regrouped(batches, size), BLOCKS)


def _opened(batches: Iterator[pa.RecordBatch], rest: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, (document, chunk, tf, dl) = _flat(batch)
        at = pa.array(row)
        lists = [pa.array(x) for x in (document, chunk, tf.astype(np.int64), dl)]
        yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in rest], *lists], [*rest, "document_id", "chunk_index", "tf", "dl"])


def opened(blocks_: DataFrame) -> DataFrame:
    """(field, term, ..., document_id, chunk_index, tf, dl) of blocks; other columns stay."""
    rest = [c for c in blocks_.columns if c not in (*_NAMES[2:], "block")]
    schema = ", ".join(f"`{c}` {blocks_.schema[c].dataType.simpleString()}" for c in rest) + ", document_id long, chunk_index int, tf long, dl int"
    return blocks_.select(*rest, "n", *LISTS).mapInArrow(lambda batches: _opened(batches, rest), schema)


def statistics(blocks_: DataFrame, rows: int, fields: tuple[str, ...], sign: int = 1) -> DataFrame:
    """(field, term, n, total) of the blocks of `rows` chunks: for each field (term null) its rows and their length together, and for each term in how many it is.

    A field is as long as its terms are many, so no text is split again.
    """
    sums = blocks_.groupBy("field").agg(F.sum("total").alias("total"))
    every = blocks_.sparkSession.createDataFrame([(f,) for f in fields], "field string").join(F.broadcast(sums), "field", "left").where(F.lit(rows > 0))
    per_field = every.select("field", F.lit(None).cast("string").alias("term"), F.lit(rows).cast("long").alias("n"), F.coalesce("total", F.lit(0)).cast("long").alias("total"))
    per = blocks_.groupBy("field", "term").agg(F.sum("n").cast("long").alias("n")).withColumn("total", F.lit(0).cast("long"))
    return per_field.unionByName(per).select("field", "term", (F.col("n") * sign).alias("n"), (F.col("total") * sign).alias("total"))


def _among(df: DataFrame, wanted: DataFrame, asked: list[str] | None) -> DataFrame:
    if asked is None:
        return df.join(F.broadcast(wanted.select("term").distinct()), "term", "left_semi")
    # Equalities reach the scan one by one, a long list only as its bounds.
    return df.where(reduce(Column.__or__, [F.col("term") == t for t in asked], F.lit(False)))


def _weight(tf: str, dl: str) -> Column:
    return F.col("idf") * F.col(tf) * (BM25_K1 + 1) / (F.col(tf) + BM25_K1 * (1 - BM25_B + BM25_B * F.col(dl) / F.col("avgdl")))


def search(blocks_: DataFrame, stats: DataFrame, live: Callable[[DataFrame], DataFrame], queries: DataFrame, most: int = 10) -> DataFrame:
    """(query_id, document_id, chunk_index, score, rank) of queries (query_id, query), as retrieval.bm25 has them.

    live takes rows with document_id and _segment and keeps those that may be found. Queries of one text are searched once.
    """
    names = ("document_id", "chunk_index")
    texts = queries.select(F.col("query").alias("query_id")).distinct()

    def one(asking: DataFrame) -> DataFrame:
        wanted = cut(asking.select("query_id", F.explode(F.array_distinct(terms("query_id"))).alias("term")))
        asked = [r["term"] for r in wanted.select("term").distinct().limit(PUSHED_TERMS + 1).collect()]
        asked = asked if len(asked) <= PUSHED_TERMS else None
        fields = stats.where("term is null").groupBy("field").agg(F.sum("n").alias("rows"), F.try_divide(F.sum("total"), F.sum("n")).alias("avgdl"))
        df = _among(stats, wanted, asked).groupBy("field", "term").agg(F.sum("n").alias("df")).where("df > 0")
        # A row for each field and term that is asked for.
        weights = cut(df.join(F.broadcast(fields), "field").select("field", "term", F.log(1 + (F.col("rows") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "avgdl"))
        mine = _among(blocks_, wanted, asked)
        heads = cut(mine.select("field", "term", "_segment", "block", "most_tf", "least_dl").join(F.broadcast(weights), ["field", "term"]).select("field", "term", "_segment", "block", _weight("most_tf", "least_dl").alias("bound")))
        tops = cut(heads.groupBy("field", "term").agg(F.max("bound").alias("top"), F.max_by(F.struct("_segment", "block"), "bound").alias("at")))

        def scored(which: DataFrame) -> DataFrame:
            which = F.broadcast(which) if which.count() <= BROADCAST_ROWS else which
            rows = live(opened(mine.join(which, ["_segment", "block"], "left_semi")))
            hits = rows.join(F.broadcast(weights), ["field", "term"]).join(F.broadcast(wanted), "term")
            total = hits.groupBy("query_id", *names).agg(F.round(F.sum(_weight("tf", "dl")), 6).alias("score"))
            # The id as text breaks ties, as where chunks are named.
            return ranked(total, most, F.col("score").desc(), F.concat_ws("#", *names))

        first = scored(cut(tops.select("at._segment", "at.block").distinct()))
        floors = first.groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("have")).where(F.col("have") == most)
        sums = wanted.join(F.broadcast(tops), "term").groupBy("query_id").agg(F.sum("top").alias("sum"))
        per_query = wanted.join(sums, "query_id").join(floors, "query_id", "left")
        # What a block's bound must reach for the least demanding of the queries that ask for its term.
        need = per_query.join(F.broadcast(tops), "term").groupBy("field", "term").agg(F.min(F.coalesce("floor", F.lit(0.0)) - F.col("sum") + F.col("top")).alias("need"))
        kept = cut(heads.join(F.broadcast(cut(need)), ["field", "term"]).where(F.col("bound") >= F.col("need") - _SLACK).select("_segment", "block"))
        return scored(kept)

    found = in_blocks(one, texts).withColumnRenamed("query_id", "query")
    # `most` rows a text, back to every query that asks it.
    return found.join(queries.select("query_id", "query"), "query").select("query_id", *names, "score", "rank")
