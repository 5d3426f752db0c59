"""The corpus pipeline: from raw documents to packed sequences of token ids.

Each stage takes (spark, docs, sf_dir), with docs the whole output of the stage
before, and returns a DataFrame; all but the last return the columns of
``documents``, whatever else those are called. Results are written as Parquet and
read again between stages. An empty table goes through every stage as one, and texts
are taken whole, however long; the stages' docstrings say what becomes of nulls and
repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import mixing, packing, similar, superkmer, toxicity
from siltstone.runtime import prepare, scratch, table


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled ones among docs.

    A null text is scored as an empty one; repeated rows are scored alike and stay or go together; a null id can't be labelled.
    """
    prepare(spark)
    return toxicity.reject(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 5-word Jaccard 0.8 or more, the document of the least id stays; SimHash finds the candidates.

    Null and blank texts are one group. A null id comes last; ties go by a hash of the text, and rows equal in both are one.
    """
    prepare(spark)
    return similar.keep_one(docs)


def _substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that occur earlier go; n_chars follows the text.

    Every row stays, also one whose text is then empty; a null text stays null. Rows come in order of id, null last, then of a hash of the text.
    """
    prepare(spark)
    out = superkmer.remove_repeats(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks.

    A null source is one of its own, last in order. Repeated rows are drawn alike, and blank texts count as no words.
    """
    prepare(spark)
    return mixing.mix(docs)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences with their token ids. A null text is its end id alone; repeated rows are packed each."""
    prepare(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", _toxicity),
    ("simhash near-dedup", _near_duplicates),
    ("substring dedup", _substrings),
    ("mixing", _mixing),
    ("packing", _packing),
]

#: The classifier and the tokenizer are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and read again."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        path = scratch(spark, f"stage-{k}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
