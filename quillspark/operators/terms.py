"""Term lists split at semicolons, and statistics over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def simple_terms(column: str) -> Column:
    """Semicolon-separated terms, trimmed, empty ones left out."""
    trimmed = F.transform(F.split(column, ";"), lambda t: F.regexp_replace(F.regexp_replace(t, r"^\s+", ""), r"\s+$", ""))
    return F.filter(trimmed, lambda t: t != "")


def term_rows(papers: DataFrame, terms_col: str = "mesh_terms") -> DataFrame:
    """One row (condition, term) for each term of each paper."""
    return papers.where(F.col(terms_col).isNotNull()).select("condition", F.explode(simple_terms(terms_col)).alias("term"))


def frequencies(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("n"))


def top_terms(rows: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent terms of each condition, ties by term."""
    order = W.partitionBy("condition").orderBy(F.desc("n"), "term")
    return frequencies(rows, "condition").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def condition_terms(papers: DataFrame, terms_col: str = "mesh_terms") -> DataFrame:
    """Coverage, distinct terms, terms per paper and mean term length of each condition."""
    present = F.nullif(F.col(terms_col), F.lit(""))
    listed = papers.select("condition", present.alias("packed"), F.when(present.isNotNull(), simple_terms(terms_col)).alias("terms"))
    per_paper = listed.groupBy("condition").agg(
        (F.count("packed") / F.count(F.lit(1)) * 100).alias("coverage"),
        F.avg(F.size("terms")).alias("terms_per_paper"),
        F.median(F.size("terms")).alias("median_terms"),
    )
    lengths = listed.select("condition", F.explode("terms").alias("term")).groupBy("condition").agg(F.count_distinct("term").alias("distinct_terms"), F.avg(F.length("term")).alias("avg_term_length"))
    return per_paper.join(lengths, "condition", "left").withColumn("distinct_terms", F.coalesce("distinct_terms", F.lit(0)).cast("long"))
