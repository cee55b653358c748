"""Incremental ingest: new record files join the corpus once each."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from quillspark.sources.corpus_files import CSV_SCHEMA, DIALECT, normalised


def ingest_csv(spark: SparkSession, root: str, target: str, checkpoint: str, null_texts: list[str] | None = None) -> StreamingQuery:
    """Append the CSV files that are new since the last run to the corpus table, then stop.

    Rows, names and partitions are those of `write_corpus`, so that both write one table.
    """
    new = normalised(spark.readStream.schema(CSV_SCHEMA).options(**DIALECT).csv(f"{root}/*"), null_texts)
    return new.writeStream.format("parquet").partitionBy("folder", "file_year").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
