"""The queries of this subpackage: each operator over its whole table, digests derived from its output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm import filteraudit, fim, license, mixing, orderminhash, packing, quality, simhash, superkmer, tokenio, toxicity, vecdedup, warc
from siltstone.runtime import scratch, shared_dir, table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "tokens")
    tokenio.write(table(spark, sf_dir, "documents"), folder)
    return tokenio.read(spark, folder, with_ids=False)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_dir(spark)
    return mixing.plan(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecdedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superkmer.digest(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orderminhash.compare(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(fim.restore(fim.transform(table(spark, sf_dir, "documents"))))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.digest(warc.salvage(spark, folder, with_payload=False))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_token_files": op2_token_files,
    "op3_source_mixing": op3_source_mixing,
    "op4_packing": op4_packing,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_simhash": op7_simhash,
    "op8_order_minhash": op8_order_minhash,
    "op9_license_scan": op9_license_scan,
    "op10_toxicity": op10_toxicity,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_filter_audit": op12_filter_audit,
    "op13_warc": op13_warc,
}
ORACLES = {
    "op3_source_mixing": mixing.ORACLE,
    "op5_embedding_dedup": vecdedup.ORACLE,
    "op6_substring_dedup": superkmer.ORACLE,
    "op11_fill_in_middle": fim.ORACLE,
    "op12_filter_audit": filteraudit.ORACLE,
    "op13_warc": warc.ORACLE,
}
