"""Corpus size over time: yearly totals, trend and growth."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspark.functions.stats import slope_p_value


def by_year(grid: DataFrame) -> DataFrame:
    """Total, mean, sample deviation and active conditions of each year over a filled grid."""
    return grid.groupBy("file_year").agg(F.sum("papers").alias("total"), F.avg("papers").alias("mean"), F.stddev_samp("papers").alias("std"), F.count_if(F.col("papers") > 0).alias("active"))


def trend(totals: DataFrame, year: str = "file_year", total: str = "total") -> DataFrame:
    """One row: slope, R2, early and late means and growth between them.

    Early and late are the first and last five years if there are ten or more, else the
    halves. The numbering runs over one row per year.
    """
    order = W.orderBy(year)
    numbered = totals.withColumn("n", F.row_number().over(order)).withColumn("years", F.count(F.lit(1)).over(W.partitionBy()))
    span = F.when(F.col("years") >= 10, 5).otherwise(F.floor(F.col("years") / 2))
    late_from = F.when(F.col("years") >= 10, F.col("years") - 5).otherwise(F.floor(F.col("years") / 2))
    fitted = numbered.agg(
        F.count(F.lit(1)).alias("years"),
        F.regr_slope(total, year).alias("slope"),
        F.regr_r2(total, year).alias("r2"),
        F.avg(F.when(F.col("n") <= span, F.col(total))).alias("early"),
        F.avg(F.when(F.col("n") > late_from, F.col(total))).alias("late"),
    )
    growth = F.when(F.col("early") > 0, (F.col("late") - F.col("early")) / F.col("early") * 100).otherwise(0.0)
    return fitted.where("years > 1").withColumn("growth", growth)


def trend_with_p_value(totals: DataFrame) -> DataFrame:
    """The trend with the two-sided p-value of its slope, and whether it is below 0.05."""

    @F.arrow_udf("double")
    def p_value(r2: pa.Array, years: pa.Array) -> pa.Array:
        return pa.array([slope_p_value(r, n) for r, n in zip(r2.to_pylist(), years.to_pylist())], pa.float64())

    fitted = trend(totals).withColumn("p_value", p_value("r2", "years"))
    return fitted.withColumn("significant", F.col("p_value") < 0.05)
