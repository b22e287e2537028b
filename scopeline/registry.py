"""All queries of the engine by name, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .oracles import ORACLES
from .queries import QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session geometry from events: bins, median box and reason a recording."""
    return QUERIES["session_geometry_reasons"](spark, sf_dir)
