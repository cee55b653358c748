"""Session helpers shared by all operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only where the cluster names none (a local test session) a temporary folder is set.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-shared-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def materialise(df: DataFrame) -> DataFrame:
    """Compute once into the shared folder, so that later reads survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_buckets(spark: SparkSession) -> int:
    """The number of buckets used to spread a hot key; follows the cluster's own setting."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
