"""The steps tied together: fetch what is still open, validate the corpus, embed the best conditions.

Every step is a function of tables and a folder; errors are raised, and a step that is run
again replaces what it wrote. `python -m quillspark.plans.pipeline --help` lists the parameters.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import quality, querytext, temporal, vectors
from quillspark.plans import corpus_queries
from quillspark.session import materialise, table
from quillspark.sources import corpus_files, records_xml, remote


@dataclass(frozen=True)
class Parameters:
    tables: str = "."
    out: str = "out"
    conditions: int = 60
    min_quality: float = 80.0
    batch_size: int = 32
    width: int = 768
    max_tokens: int | None = None
    test_mode: bool = False

    @property
    def years(self) -> list[int] | None:
        """The years that are embedded: in test mode only the last five."""
        return list(range(2020, 2025)) if self.test_mode else None

    @property
    def first(self) -> int:
        return 3 if self.test_mode else self.conditions


def parameters(arguments: list[str] | None = None) -> Parameters:
    """The parameters given on a command line."""
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--tables", default=".", help="folder of the Parquet tables")
    parser.add_argument("--out", default="out", help="folder for everything that is written")
    parser.add_argument("--conditions", type=int, default=60, help="conditions to embed, best first")
    parser.add_argument("--min-quality", type=float, default=80.0, help="least score of an embedded condition")
    parser.add_argument("--batch-size", type=int, default=32, help="texts of a model batch")
    parser.add_argument("--width", type=int, default=768, help="width of the vectors")
    parser.add_argument("--max-tokens", type=int, help="tokens of a text that the model sees; all, if not given")
    parser.add_argument("--test-mode", action="store_true", help="three conditions, years 2020 to 2024")
    return Parameters(**vars(parser.parse_args(arguments)))


def open_work(catalog: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """(condition, query, file_year) of every condition and year whose last state is not `complete`."""
    done = quality.latest(checkpoint, ["condition", "year"], "ts", "entry_id").where("lower(status) = 'complete'")
    done = done.select("condition", F.col("year").try_cast("int").alias("file_year"))
    queries = catalog.select(F.col("name").alias("condition"), querytext.condition_search("name", "search_query").alias("query"))
    return quality.year_grid(catalog).join(queries, "condition").join(done, ["condition", "file_year"], "left_anti").select("condition", "query", "file_year")


def retrieve(work: DataFrame, make_client: Callable, out: str, parallel: int = 4, after: float = remote.PAUSE_WITHOUT_KEY) -> None:
    """Fetch the work into the corpus table and note what was found, retrieved and failed.

    The documents are written first, so that the corpus and the logs come from one fetch.
    """
    spark = work.sparkSession
    chunks = materialise(remote.plan_documents(work, make_client, parallel=parallel))
    remote.fetch_documents(chunks, make_client, parallel, after).write.mode("overwrite").parquet(f"{out}/documents")
    documents = spark.read.parquet(f"{out}/documents")
    records = records_xml.parse_records(documents.where("xml is not null"), "xml", ["condition", "file_year"])
    corpus_files.write_corpus(records.where("error is null").drop("error"), f"{out}/corpus")
    keys = ["condition", "file_year"]
    found = chunks.groupBy(keys).agg(F.sum("found").alias("total_found"), F.count("error").alias("plan_errors"))
    got = records.groupBy(keys).agg(F.count_if(F.col("error").isNull()).alias("total_retrieved"), F.count("error").alias("record_errors"))
    failed = documents.groupBy(keys).agg(F.count("error").alias("fetch_errors"))
    counts = work.select(keys).join(found, keys, "left").join(got, keys, "left").join(failed, keys, "left").na.fill(0)
    stamped = materialise(counts.withColumn("ts", F.current_timestamp()).withColumn("entry_id", F.xxhash64(*keys, "ts")).withColumn("year", F.col("file_year").cast("string")))
    corpus_files.append_log(corpus_files.with_completeness(stamped).select("entry_id", "condition", "year", "total_found", "total_retrieved", "completeness", "ts"), f"{out}/completeness")
    status = F.when(F.expr("plan_errors + record_errors + fetch_errors > 0"), "error").otherwise("complete")
    corpus_files.append_log(stamped.select("entry_id", "condition", "year", status.alias("status"), "ts"), f"{out}/checkpoint")


def validate(spark: SparkSession, tables: str, out: str) -> None:
    """Write the scores, the yearly matrix, gaps and advice (if there are any), the trend, the summary and the report."""
    papers, catalog = table(spark, tables, "papers"), table(spark, tables, "condition_catalog")
    scores = materialise(corpus_queries.score_export(spark, tables))
    corpus_files.export_csv(corpus_files.with_headings(scores), f"{out}/quality_scores", F.desc("Quality_Score"), "Condition_Folder")
    corpus_files.export_csv(corpus_queries.temporal_export(spark, tables), f"{out}/temporal_counts", "year")
    missing = quality.missing_years(catalog, papers)
    gaps = materialise(quality.data_gaps(missing, quality.empty_years(table(spark, tables, "completeness"), missing)))
    if not gaps.isEmpty():
        corpus_files.export_csv(gaps, f"{out}/data_gaps", "condition", "file_year")
    advice = materialise(corpus_queries.retrieval_advice(spark, tables))
    if not advice.isEmpty():
        corpus_files.export_csv(advice, f"{out}/retrieval_advice", "quality_score", "condition")
    trend = temporal.trend_with_p_value(temporal.by_year(quality.filled_grid(catalog, quality.year_stats(papers))))
    corpus_files.export_json(trend, f"{out}/trend")
    numbers = materialise(corpus_queries.validation_summary(spark, tables))
    corpus_files.export_summary(numbers, f"{out}/summary")
    lines = numbers.orderBy("section", "name").select(F.format_string("%s, %s: %,.1f", "section", "name", "value").alias("line"))
    lines.coalesce(1).write.mode("overwrite").text(f"{out}/report")


def embed(spark: SparkSession, tables: str, out: str, given: Parameters, make_encoder: Callable | None = None) -> None:
    """Write the selection, the conditions it skips, the papers' mean vectors by year and condition, and their similarities."""
    papers, catalog = table(spark, tables, "papers"), table(spark, tables, "condition_catalog")
    chosen = materialise(quality.selection(quality.condition_stats(papers), given.min_quality, given.first))
    corpus_files.export_csv(chosen, f"{out}/selection", "rank")
    held = quality.corpus(papers).select("condition").distinct()
    corpus_files.export_csv(catalog.select(F.col("name").alias("condition"), "folder").join(held, "condition", "left_anti"), f"{out}/skipped", "condition")
    wanted = quality.corpus(papers, given.years).join(chosen.select("condition"), "condition", "left_semi")
    texts = wanted.select("condition", "file_year", vectors.paper_text().alias("text")).where("text <> ''")
    width, limit, batch = given.width, given.max_tokens, given.batch_size
    encoded = vectors.encode_texts(texts, "text", make_encoder or (lambda: vectors.encoder(vectors.HashingModel(width), limit, batch)))
    vectors.write_centroids(encoded, "condition", "file_year", "vec", width, out)
    centroids = spark.read.parquet(f"{out}/centroid")
    pairs = materialise(vectors.similarity(centroids, "condition"))
    names = [r.a for r in pairs.select("a").distinct().orderBy("a").collect()]  # at most the chosen conditions
    if names:
        corpus_files.export_csv(vectors.similarity_matrix(pairs, names), f"{out}/similarity", "a")
    corpus_files.export_json(centroids.select("condition", F.col("vec").alias("embedding"), F.size("vec").alias("embedding_dim"), F.col("years").alias("years_available")), f"{out}/embeddings")


def main(arguments: list[str] | None = None) -> None:
    given = parameters(arguments)
    spark = SparkSession.builder.appName("corpus").getOrCreate()
    validate(spark, given.tables, f"{given.out}/validation")
    embed(spark, given.tables, f"{given.out}/embedding", given)


if __name__ == "__main__":
    main()
