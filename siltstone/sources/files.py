"""Files of the knowledge base: a bounded reader for many, a content store for single ones.

``load_documents`` is a distributed scan by Spark's binary reader. ContentStore
serves single documents on the driver, as an API would; it owns the folder
``documents/`` under its root and may only read elsewhere in it.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.products import parse_products

# What is read, and how much of it.
EXTENSIONS = ("md", "markdown", "txt")
MOST_BYTES = 5 << 20
MANAGED = "documents"


class ContentNotFound(FileNotFoundError):
    pass


class OutsideRoot(PermissionError):
    pass


class ContentTooLarge(ValueError):
    pass


class NotReadable(ValueError):
    """A file of another extension, or too large."""


def load_documents(spark: SparkSession, root: str, most: int = MOST_BYTES, skip: bool = False) -> DataFrame:
    """(source, length, text) of the files below root; names and lengths are checked before any content is read.

    A file of another extension or over `most` bytes is an error, unless such files are to be skipped.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.substring_index("path", "/", -1)
    readable = name.contains(".") & F.lower(F.substring_index(name, ".", -1)).isin(*EXTENSIONS) & (F.col("length") <= most)
    if not skip and (bad := files.where(~readable).select("path", "length").first()):
        raise NotReadable(f"{bad['path']} ({bad['length']} bytes): only {', '.join(EXTENSIONS)} of {most} bytes at most are read")
    return files.where(readable).select(F.col("path").alias("source"), "length", F.col("content").cast("string").alias("text"))


def load_products(spark: SparkSession, root: str, most: int = MOST_BYTES, skip: bool = False) -> DataFrame:
    """The products of all files below root."""
    return parse_products(load_documents(spark, root, most, skip))


def write_partitioned(df: DataFrame, to: str, *by: str) -> None:
    """Chunks, vectors or terms as Parquet, clustered by the columns they are looked up with."""
    df.repartition(*by).write.mode("overwrite").partitionBy(*by).parquet(to)


class ContentStore:
    """Single documents below a root folder; sources are paths relative to it."""

    def __init__(self, root: str, most: int = MOST_BYTES, clock: Callable[[], int] = time.time_ns):
        self.root, self.most, self.clock = os.path.realpath(root), most, clock

    def _path(self, source: str) -> str:
        """Where a source is, links followed; an error if that is outside the root."""
        if not source.strip():
            raise ContentNotFound(source)
        path = os.path.realpath(os.path.join(self.root, source))
        if os.path.isabs(source) or os.path.commonpath([self.root, path]) != self.root:
            raise OutsideRoot(source)
        return path

    def _sized(self, content: str) -> bytes:
        data = content.encode()
        if len(data) > self.most:
            raise ContentTooLarge(f"{len(data)} bytes, at most {self.most}")
        return data

    def managed(self, source: str) -> bool:
        try:
            return os.path.relpath(self._path(source), self.root).split(os.sep)[0] == MANAGED
        except (OutsideRoot, ContentNotFound):
            return False

    def exists(self, source: str) -> bool:
        return os.path.isfile(self._path(source))

    def read(self, source: str) -> str:
        path = self._path(source)
        if not os.path.isfile(path):
            raise ContentNotFound(source)
        if os.path.getsize(path) > self.most:
            raise ContentTooLarge(source)
        with open(path, encoding="utf-8", newline="") as f:
            return f.read()

    def create(self, dataset_id: int, slug: str, content: str) -> str:
        data = self._sized(content)
        source = f"{MANAGED}/{dataset_id}/{slug}-{_base36(self.clock())}.md"
        path = self._path(source)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "xb") as f:
            f.write(data)
        return source

    def write(self, source: str, content: str) -> None:
        data = self._sized(content)
        if not self.managed(source):
            raise OutsideRoot(source)
        path = self._path(source)
        with open(f"{path}.new", "wb") as f:
            f.write(data)
        os.replace(f"{path}.new", path)

    def remove(self, source: str) -> None:
        """Of managed files; one that is gone already is fine, registered ones stay."""
        if self.managed(source) and self.exists(source):
            os.remove(self._path(source))


def _base36(n: int) -> str:
    digits = ""
    while True:
        n, d = divmod(n, 36)
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + digits
        if not n:
            return digits
