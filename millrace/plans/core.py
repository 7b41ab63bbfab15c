"""All queries of the core operators over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import units
from . import files, joins, records, tables, texts
from .tables import t


def _harmonized(spark: SparkSession, d: str) -> DataFrame:
    return units.harmonize(*(t(spark, d, n) for n in ("price_hits", "sites", "fx_rates", "unit_factors")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _harmonized(spark, d).where("not stated").select("hit_id", "common_unit", "amount_e4")


def p2_units(spark: SparkSession, d: str) -> DataFrame:
    """All converted rows with the scale that was decoded, and whether decoding changed the row's own likeliest reading."""
    return _harmonized(spark, d).select("hit_id", "common_unit", "common_amount", "scale", "changed", "stated")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return tables.where_numeric_and(spark, d)


def queries() -> dict:
    return {"p2_found": p2_found, "p2_units": p2_units, **tables.Q, **texts.Q, **records.Q, **files.Q, **joins.Q}


def oracle_sql() -> dict[str, str]:
    return tables.SQL | texts.SQL | records.SQL | files.SQL | joins.SQL
