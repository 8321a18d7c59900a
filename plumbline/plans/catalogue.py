"""Every query of the library over the driver's tables, and the SQL it must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.plans import q_clean, q_layout, q_measures, q_more, q_pages, q_rows, q_tables, q_text  # noqa: F401
from plumbline.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["q_S63_reasons"](spark, sf_dir)
