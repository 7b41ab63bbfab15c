"""Queries of the llm operators over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boilerplate, language, lookalike, mixing, namelink, residue, survivor, tokens


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(_t(spark, d, "documents"))


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sizes = mixing.sized(_t(spark, d, "documents"), "doc_id", "text", "source")
    rates = mixing.rates(sizes, _t(spark, d, "mix_targets"))
    return mixing.mix(sizes, rates, "doc_id"), rates


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.reached(*_mixture(spark, d))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.furniture_lines(_t(spark, d, "fetched_docs"))


def p1_bodies(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "fetched_docs").select("doc_id", boilerplate.main_body("body").alias("main_body"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.found(_t(spark, d, "fetched_docs"))


def p5_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The rows of p5_found with how they are known."""
    return residue.evidence(_t(spark, d, "fetched_docs"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return namelink.same_organisation(_t(spark, d, "kb_records"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return namelink.membership(_t(spark, d, "kb_records"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return survivor.survivors(_t(spark, d, "kb_records"), _t(spark, d, "kb_sources"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.same_reading(_t(spark, d, "query_terms").where("stop = false"), _t(spark, d, "kb_records"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return language.mislabelled(language.segments(_t(spark, d, "documents")))


def p9_segments(spark: SparkSession, d: str) -> DataFrame:
    return language.segments(_t(spark, d, "documents")).select("doc_id", "seg_no", "lang", "confidence", "start", "length")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_bodies": p1_bodies, "p5_found": p5_found, "p5_evidence": p5_evidence, "p3_found": p3_found, "p3_groups": p3_groups, "p4_found": p4_found, "p6_found": p6_found, "p7_ids": p7_ids, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found, "p9_segments": p9_segments}


def oracle_sql() -> dict[str, str]:
    return {"p4_found": survivor.SQL}
