"""Markdown sections, sliding windows and chunks.

A document becomes chunks inside one Arrow batch function: its lines, sections
and windows never leave the task, so chunking shuffles nothing however long the
texts are. The section rules are also given as window SQL over lines in
``sections_by_lines`` for use where no Python worker is wanted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import words
from siltstone.functions.text import _SPACES, WHITE, trim_unicode

DEFAULT_CHARS = 1200
# Where a window may end early, and what parts a heading path.
BOUNDARIES = "\n。.！!？?；;"
PATH_SEPARATOR = " > "


def sections(text: str) -> list[tuple[str, str]]:
    """(heading path, text) of each part under a heading; fences hide headings."""
    found: list[tuple[str, str]] = []
    path: list[str] = []
    body: list[str] = []
    fenced = False

    def close() -> None:
        joined = "".join(body)
        if joined.strip(_SPACES):
            found.append((PATH_SEPARATOR.join(path), joined))
        body.clear()

    for line in text.split("\n"):
        bare = line.strip(_SPACES)
        if bare.startswith(("```", "~~~")):
            fenced = not fenced
        elif not fenced:
            title = bare.lstrip("#")
            level = len(bare) - len(title)
            if 1 <= level <= 6 and title.startswith(" "):
                close()
                path = (path + [""] * level)[: level - 1] + [title.strip(_SPACES)]
                continue
        body.append(line + "\n")
    close()
    return found or [("", text)]


def windows(text: str, most: int = DEFAULT_CHARS) -> list[str]:
    """Overlapping pieces of at most `most` characters (one more if it ends at a boundary)."""
    most = most if most > 0 else DEFAULT_CHARS
    pieces, at = [], 0
    while at + most < len(text):
        tail = text[at + most // 2 + 1 : at + most + 1]
        last = max(tail.rfind(mark) for mark in BOUNDARIES)
        cut = at + most // 2 + 2 + last if last >= 0 else at + most
        pieces.append(text[at:cut])
        at = max(cut - most // 6, at + 1)
    return [*pieces, text[at:]]


def pieces(text: str | None, most: int) -> Iterator[tuple[str, str]]:
    """(heading path, content) of each chunk of a document, in order."""
    for path, body in sections(text or ""):
        for piece in windows(body, most):
            if trimmed := piece.strip(_SPACES):
                yield path, f"# {path}\n\n{trimmed}" if path else trimmed


def _chunked(batches: Iterator[pa.RecordBatch], text: str, most: int, edges: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    holds = None if edges is None else words.letters(edges)
    for batch in batches:
        column = batch.schema.get_field_index(text)
        row, index, path, content = [], [], [], []
        for k, value in enumerate(batch.column(column)):
            for n, (p, c) in enumerate(pieces(value.as_py(), most)):
                row.append(k)
                index.append(n)
                path.append(p)
                content.append(c)
        kept = batch.drop_columns([text]).take(pa.array(row, pa.int64()))
        made = {"chunk_index": pa.array(index, pa.int32()), "heading_path": pa.array(path, pa.string()), "content": pa.array(content, pa.string())}
        if holds is not None:
            made["terms"] = pa.array(words.count(pa.array([c.lower() for c in content], pa.string()), holds), pa.int32())
        yield pa.RecordBatch.from_arrays([*kept.columns, *made.values()], [*kept.schema.names, *made])


def chunk(docs: DataFrame, text: str = "text", most: int = DEFAULT_CHARS, counted: bool = False) -> DataFrame:
    """docs with `text` replaced by chunk_index (from 0 per document), heading_path and content, a row per chunk; counted: and terms, how many the content has."""
    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text)
    schema = f"{rest}, chunk_index int, heading_path string, content string" + (", terms int" if counted else "")
    edges = words.edges(docs.sparkSession) if counted else None
    return docs.mapInArrow(lambda batches: _chunked(batches, text, most, edges), schema)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(k, n, path, body) for k, text in enumerate(batch.column(1)) for n, (path, body) in enumerate(sections(text.as_py() or ""))]
        at, number, path, body = zip(*rows, strict=True) if rows else ((),) * 4
        keys = batch.column(0).take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([keys, pa.array(number, pa.int64()), pa.array(path, pa.string()), pa.array(body, pa.string())], [batch.schema.names[0], "section", "heading_path", "text"])


def split_sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, section, heading_path, text) of each section, where the text is read."""
    return docs.select(key, text).mapInArrow(_split, f"`{key}` {docs.schema[key].dataType.simpleString()}, section long, heading_path string, text string")


def sections_by_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, section, heading_path, text): the same sections by windows over exploded lines."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n", -1)).alias("pos", "line")).withColumn("bare", trim_unicode("line"))
    order = Window.partitionBy(key).orderBy("pos")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fence = F.col("bare").startswith("```") | F.col("bare").startswith("~~~")
    lines = lines.withColumn("fence", fence).withColumn("fences", F.sum(F.col("fence").cast("int")).over(upto))
    heading = ~F.col("fence") & (F.col("fences") % 2 == 0) & F.col("bare").rlike("^#{1,6} ")
    lines = lines.withColumn("level", F.when(heading, F.length(F.regexp_extract("bare", "^#+", 0)))).withColumn(
        "title", F.when(heading, trim_unicode(F.regexp_replace("bare", "^#+", "")))
    )
    lines = lines.withColumn("section", F.count("level").over(upto)).withColumn("current", F.last("level", True).over(upto))
    for i in range(1, 7):
        last = F.last(F.when(F.col("level") <= i, F.struct("level", "title")), True).over(upto)
        lines = lines.withColumn(f"p{i}", F.when(F.col("current") >= i, F.when(last["level"] == i, last["title"]).otherwise("")))
    bodies = (
        lines.where("level is null").groupBy(key, "section")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("rows"), *[F.first(f"p{i}").alias(f"p{i}") for i in range(1, 7)])
        .select(key, "section", F.concat_ws(PATH_SEPARATOR, *[f"p{i}" for i in range(1, 7)]).alias("heading_path"), F.concat(F.array_join("rows.line", "\n"), F.lit("\n")).alias("text"))
        .where(~F.col("text").rlike(f"^[{WHITE}]*$"))
    )
    bare = docs.where(~F.coalesce(F.col(text), F.lit("")).rlike(f"^[{WHITE}]*$")).join(bodies.select(key).distinct(), key, "left_anti")
    return bodies.unionByName(bare.select(key, F.lit(0).cast("bigint").alias("section"), F.lit("").alias("heading_path"), F.col(text).alias("text")))
