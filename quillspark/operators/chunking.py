"""Adaptive time buckets: the coarsest bucket of each row whose count fits a cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

LEVELS = ("year", "month", "week", "day", "six_hours", "quarter_hour")


def bucket(ts: Column, level: str) -> Column:
    """The bucket's name; weeks start on days 1, 8, 15, 22 and 29 of the month."""
    day = F.date_format(ts, "yyyy/MM/dd")
    week = F.concat(F.date_format(ts, "yyyy/MM"), F.lit("w"), (F.floor((F.day(ts) - 1) / 7) + 1).cast("string"))
    return {
        "year": F.date_format(ts, "yyyy"),
        "month": F.date_format(ts, "yyyy/MM"),
        "week": week,
        "day": day,
        "six_hours": F.concat(day, F.lit("h"), F.floor(F.hour(ts) / 6).cast("string")),
        "quarter_hour": F.concat(day, F.lit("q"), (F.hour(ts) * 4 + F.floor(F.minute(ts) / 15)).cast("string")),
    }[level]


def chunks(df: DataFrame, keys: list[str], ts_col: str, cap: int) -> DataFrame:
    """The chunks that cover all rows: (keys, level, bucket, n, kept, lost).

    Counts come from the finest level once and are summed up the levels; a chunk is taken at
    the first level where it fits. At the last level up to `cap` rows are kept, as the remote
    source does; `lost` counts the others. Rows without a time are left out.
    """
    ts = F.col(ts_col)
    counts = df.where(ts.isNotNull()).select(*keys, *[bucket(ts, level).alias(level) for level in LEVELS]).groupBy(*keys, *LEVELS).agg(F.count(F.lit(1)).alias("n"))
    # the levels are nested, so that one shuffle by key and year serves all windows
    for i, level in enumerate(LEVELS):
        counts = counts.withColumn(f"n_{level}", F.sum("n").over(W.partitionBy(*keys, *LEVELS[: i + 1])))
    chosen, name = F.lit(LEVELS[-1]), F.col(LEVELS[-1])
    for level in reversed(LEVELS[:-1]):
        fits = F.col(f"n_{level}") <= cap
        chosen, name = F.when(fits, level).otherwise(chosen), F.when(fits, F.col(level)).otherwise(name)
    taken = counts.groupBy(*keys, chosen.alias("level"), name.alias("bucket")).agg(F.sum("n").alias("n"))
    return taken.select(*keys, "level", "bucket", "n", F.least("n", F.lit(cap)).alias("kept"), F.greatest(F.col("n") - cap, F.lit(0)).alias("lost"))
