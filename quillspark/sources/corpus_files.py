"""The corpus as files: condition-year CSV in and out, Parquet, inventory and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CSV_COLUMNS = ["PMID", "Title", "Abstract", "Journal", "Year", "MeSH_Terms", "Authors", "FirstAuthorAffiliation", "Condition"]
CSV_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in CSV_COLUMNS])
DIALECT = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}
# Fixed value: texts that the usual data-frame readers take for a missing value.
NULL_TEXTS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def read_corpus_csv(spark: SparkSession, root: str, null_texts: list[str] | None = None) -> DataFrame:
    """All <root>/<folder>/<folder>_<year>.csv files as one table with folder and file_year.

    Empty texts are nulls; `null_texts` names others that are, for example NULL_TEXTS.
    """
    raw = spark.read.schema(CSV_SCHEMA).options(**DIALECT).csv(f"{root}/*/*.csv")
    return normalised(raw, null_texts)


def normalised(raw: DataFrame, null_texts: list[str] | None = None) -> DataFrame:
    """CSV rows, of a batch or a stream, with the table's names, nulls, folder and file_year."""
    path = F.col("_metadata.file_path")
    names = [F.when(~F.col(c).isin(null_texts or [""]), F.col(c)).alias(c.lower()) for c in CSV_COLUMNS]
    folder, year = F.url_decode(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)), F.regexp_extract(path, r"_(\d{4})\.csv$", 1)
    return raw.select(*names, folder.alias("folder"), year.try_cast("int").alias("file_year"))


# The headings of the exported score table, and this package's names for them.
SCORE_HEADINGS = {
    "Condition": "condition", "Condition_Folder": "folder", "Quality_Score": "quality_score", "Total_Papers": "total_papers", "Unique_PMIDs": "unique_pmids",
    "Papers_With_Abstracts": "papers_with_abstracts", "Abstract_Coverage_%": "abstract_coverage", "Papers_With_MeSH": "papers_with_mesh", "MeSH_Coverage_%": "mesh_coverage",
    "Year_Coverage_%": "year_coverage", "Missing_Years": "missing_years", "Cross_Year_Duplicates_%": "duplicate_rate", "Quality_Issues": "quality_issues", "Anomalous_Years": "anomalous_years",
}


def with_table_names(scores: DataFrame) -> DataFrame:
    """A score table with either kind of headings, with this package's names."""
    return scores.withColumnsRenamed({old: new for old, new in SCORE_HEADINGS.items() if old in scores.columns})


def with_headings(scores: DataFrame) -> DataFrame:
    """A score table with the headings of the export, in their order."""
    return scores.select(*[F.col(new).alias(old) for old, new in SCORE_HEADINGS.items()])


def write_corpus(papers: DataFrame, path: str) -> None:
    """Parquet by condition folder and year; a rerun replaces only the partitions it writes."""
    folder = F.translate("condition", "/ ", "__")
    papers.withColumn("folder", folder).repartition("folder", "file_year").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("folder", "file_year").parquet(path)


def export_csv(df: DataFrame, path: str, *order: str | Column) -> None:
    """One small report as a single CSV file with a header, in order."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").options(header=True, quote='"', escape='"').csv(path)


def export_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def export_summary(numbers: DataFrame, path: str) -> None:
    """A long table of (section, name, value) as one JSON object by section; the table has a row per number."""
    by_section = numbers.groupBy("section").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("numbers"))
    whole = by_section.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("section", F.to_json("numbers").alias("numbers"))))).alias("summary"))
    whole.select(F.to_json("summary").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def file_listing(spark: SparkSession, root: str) -> DataFrame:
    """(folder, file, file_year, bytes) of every CSV file, empty ones too, from the file system's own listing."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/*/*.csv")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    rows = [(f.getPath().getParent().getName(), f.getPath().getName(), f.getLen()) for f in found]
    listed = spark.createDataFrame(rows, "folder string, file string, bytes long")
    return listed.withColumn("file_year", F.regexp_extract("file", r"_(\d{4})\.csv$", 1).try_cast("int"))


def inventory(listing: DataFrame, first: int = 1975, last: int = 2024) -> DataFrame:
    """Files, megabytes, years and year coverage of each folder."""
    year = F.when(F.col("file_year").between(first, last), F.col("file_year"))
    stats = listing.groupBy("folder").agg(F.count(F.lit(1)).alias("files"), (F.sum("bytes") / 2**20).alias("mb"), F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.count_distinct(year).alias("years"))
    return stats.withColumn("year_coverage", F.col("years") / (last - first + 1) * 100)


def file_states(listing: DataFrame, papers: DataFrame) -> DataFrame:
    """Each file as `unreadable` (no byte, so not even a header), `empty` (a header only) or `filled`."""
    counts = papers.groupBy("folder", "file_year").agg(F.count(F.lit(1)).alias("papers"))
    joined = listing.join(counts, ["folder", "file_year"], "left")
    state = F.when(F.col("bytes") == 0, "unreadable").when(F.col("papers").isNull(), "empty").otherwise("filled")
    return joined.select("folder", "file_year", F.coalesce("papers", F.lit(0)).alias("papers"), state.alias("state"))


def line_counts(spark: SparkSession, root: str) -> DataFrame:
    """Physical lines of each file without its header, 0 at least."""
    lines = spark.read.text(f"{root}/*/*.csv").groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    return lines.select("file", F.greatest(F.col("n") - 1, F.lit(0)).alias("lines"))


_STATE = "map<string, map<string, struct<status: string, total_found: bigint, total_retrieved: bigint, completeness: double, timestamp: string>>>"


def read_state_json(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a checkpoint or completeness JSON file, one row per condition and year.

    The columns of the other kind of file are null; a file that cannot be read as such holds none.
    """
    state = spark.read.text(path, wholetext=True).select(F.from_json("value", _STATE).alias("state"))
    years = state.select(F.explode("state").alias("condition", "years")).select("condition", F.explode("years").alias("year", "entry"))
    return years.select("condition", "year", "entry.status", "entry.total_found", "entry.total_retrieved", "entry.completeness", F.col("entry.timestamp").try_cast("timestamp").alias("ts"))


def append_log(entries: DataFrame, path: str) -> None:
    """Add entries to an append-only log table (checkpoint or completeness)."""
    entries.write.mode("append").parquet(path)


def with_completeness(log: DataFrame) -> DataFrame:
    """Percent retrieved; 100 where nothing was found."""
    return log.withColumn("completeness", F.when(F.col("total_found") > 0, F.col("total_retrieved") / F.col("total_found") * 100).otherwise(100.0))
