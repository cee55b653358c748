"""Queries over packed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.operators.packed_values import split_values
from quillspark.session import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per descriptor of papers.mesh_terms."""
    values = split_values(table(spark, sf_dir, "papers"), "record_id", "mesh_terms", table(spark, sf_dir, "mesh_descriptors"))
    return values.selectExpr("id AS record_id", "pos", "value AS term")


QUERIES = {"p5_found": p5_found}
SQL: dict[str, str] = {}
