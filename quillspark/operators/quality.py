"""Completeness and quality of a corpus per condition and year, as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: The expected years, both included.
FIRST_YEAR, LAST_YEAR = 1975, 2024
YEARS = LAST_YEAR - FIRST_YEAR + 1


def blank_to_null(column: str | Column) -> Column:
    return F.nullif(F.col(column) if isinstance(column, str) else column, F.lit(""))


def corpus(papers: DataFrame, years: list[int] | None = None) -> DataFrame:
    """The columns that the statistics need, empty texts as nulls, inside the expected years or only the given ones."""
    wanted = F.col("file_year").between(FIRST_YEAR, LAST_YEAR) if years is None else F.col("file_year").isin(years)
    narrow = papers.where(wanted & F.col("condition").isNotNull())
    return narrow.select("condition", "file_year", *[blank_to_null(c).alias(c) for c in ("pmid", "title", "abstract", "mesh_terms")])


def meaningful(abstract: Column) -> Column:
    return (F.length(abstract) > 100) & ~F.lower(abstract).contains("no abstract")


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def year_stats(papers: DataFrame, years: list[int] | None = None) -> DataFrame:
    """One row of counts and rates per condition and year; null ids count as one value.

    `new_ids` counts a condition's ids in the year in which they first appear, so that their sum
    is the condition's number of distinct ids: one reading of the papers serves both levels.
    """
    abstract = F.col("abstract")
    per_id = corpus(papers, years).groupBy("condition", "file_year", "pmid").agg(
        F.count(F.lit(1)).alias("papers"),
        F.count(abstract).alias("abstracts"),
        F.count_if(meaningful(abstract)).alias("meaningful"),
        F.count("mesh_terms").alias("mesh"),
        F.sum(F.length(abstract)).alias("length"),
    )
    first = F.min("file_year").over(W.partitionBy("condition", "pmid"))
    counts = per_id.withColumn("new", F.col("pmid").isNotNull() & (F.col("file_year") == first)).groupBy("condition", "file_year").agg(
        *[F.sum(c).alias(c) for c in ("papers", "abstracts", "meaningful", "mesh")],
        (F.sum("papers") - F.count(F.lit(1))).alias("duplicates"),
        F.coalesce(F.sum("length") / F.nullif(F.sum("abstracts"), F.lit(0)), F.lit(0.0)).alias("avg_abstract_len"),
        F.count_if("new").alias("new_ids"),
    )
    return counts.withColumn("abstract_rate", percent(F.col("abstracts"), F.col("papers"))).withColumn("mesh_rate", percent(F.col("mesh"), F.col("papers")))


def issue(papers: Column, abstract_rate: Column, duplicates: Column) -> Column:
    """The first rule that a year breaks, else null."""
    return F.when(papers == 0, "empty").when(abstract_rate < 50, "low_abstract_rate").when(duplicates > papers * 0.05, "high_duplicates")


def with_outliers(years: DataFrame, key: str = "condition", count: str = "papers") -> DataFrame:
    """Tukey fences of each key's positive counts, if it has more than 5 years, and which counts lie outside."""
    n = F.col(count)
    fences = years.groupBy(key).agg(F.expr(f"percentile(if({count} > 0, {count}, null), array(0.25, 0.75))").alias("q"), F.count(F.lit(1)).alias("n_years"))
    iqr = F.col("q")[1] - F.col("q")[0]
    fences = fences.select(key, F.when(F.col("n_years") > 5, F.greatest(F.lit(0.0), F.col("q")[0] - 1.5 * iqr)).alias("lower"), F.when(F.col("n_years") > 5, F.col("q")[1] + 1.5 * iqr).alias("upper"))
    outside = (n > 0) & ((n < F.col("lower")) | (n > F.col("upper")))
    return years.join(fences, key).withColumn("outlier", F.coalesce(outside, F.lit(False)))


def quality_score(missing: Column, papers: Column, good: Column, mesh: Column, duplicate_rate: Column, issues: Column, anomalies: Column) -> Column:
    """100 less the penalties: missing years, low abstract and term coverage, duplicates, issues, outliers."""

    def low(part: Column, weight: float) -> Column:
        rate = part / papers * 100
        return F.when((papers > 0) & (rate < 70), (70 - rate) * weight).otherwise(F.lit(0.0))

    duplicates = F.when(duplicate_rate > 5, F.least(F.lit(10.0), duplicate_rate * 0.5)).otherwise(F.lit(0.0))
    total = F.lit(100.0) - F.least(F.lit(30.0), missing * 0.6) - low(good, 0.35) - low(mesh, 0.28) - duplicates
    return F.greatest(F.lit(0.0), total - F.least(F.lit(10.0), issues * 2.0) - F.least(F.lit(5.0), anomalies * 1.0))


def confidence(score: Column) -> Column:
    return F.when(score >= 80, "high").when(score >= 60, "medium").otherwise("low")


def condition_stats(papers: DataFrame, years: list[int] | None = None) -> DataFrame:
    """Totals, coverage, duplicate rate, issues, outlier years, score and class of each condition.

    With `years`, only these are read, and expected.
    """
    expected = YEARS if years is None else len(set(years))
    years = with_outliers(year_stats(papers, years))
    years = years.withColumn("issue", issue(F.col("papers"), F.col("abstract_rate"), F.col("duplicates")))
    totals = years.groupBy("condition").agg(
        F.sum("papers").alias("total_papers"),
        F.sum("meaningful").alias("papers_with_abstracts"),
        F.sum("mesh").alias("papers_with_mesh"),
        F.sum("duplicates").alias("duplicate_pmids"),
        F.count(F.lit(1)).alias("found_years"),
        F.count("issue").alias("quality_issues"),
        F.count_if("outlier").alias("anomalous_years"),
        F.sum("new_ids").alias("unique_pmids"),
    )
    stats = totals.withColumn("missing_years", F.lit(expected) - F.col("found_years")).withColumn("year_coverage", F.col("found_years") / expected * 100)
    rate = F.when((F.col("total_papers") > 0) & (F.col("unique_pmids") > 0), (F.col("total_papers") - F.col("unique_pmids")) / F.col("total_papers") * 100).otherwise(0.0)
    stats = stats.withColumn("duplicate_rate", rate)
    score = quality_score(*[F.col(c) for c in ("missing_years", "total_papers", "papers_with_abstracts", "papers_with_mesh", "duplicate_rate", "quality_issues", "anomalous_years")])
    stats = stats.withColumn("quality_score", score).withColumn("confidence", confidence(F.col("quality_score")))
    return stats.withColumn("abstract_coverage", percent(F.col("papers_with_abstracts"), F.col("total_papers"))).withColumn("mesh_coverage", percent(F.col("papers_with_mesh"), F.col("total_papers")))


def year_grid(catalog: DataFrame, name_col: str = "name") -> DataFrame:
    """Every condition with every expected year: a row generator over the dimension, not a join."""
    return catalog.select(F.col(name_col).alias("condition"), F.explode(F.sequence(F.lit(FIRST_YEAR), F.lit(LAST_YEAR))).alias("file_year"))


def missing_years(catalog: DataFrame, papers: DataFrame) -> DataFrame:
    """Expected years without a paper."""
    found = corpus(papers).select("condition", "file_year").distinct()
    return year_grid(catalog).join(found, ["condition", "file_year"], "left_anti")


def empty_years(completeness: DataFrame, missing: DataFrame) -> DataFrame:
    """Missing years that were fetched and brought nothing: their last log entry says that no row came."""
    last = latest(completeness, ["condition", "year"], "ts", "entry_id").where("total_retrieved = 0")
    return missing.join(last.select("condition", F.col("year").try_cast("int").alias("file_year")), ["condition", "file_year"], "left_semi")


def data_gaps(missing: DataFrame, empty: DataFrame) -> DataFrame:
    """Every gap with its type: a year never fetched, or one whose file is empty."""
    never = missing.join(empty, ["condition", "file_year"], "left_anti")
    return never.withColumn("type", F.lit("Missing Data")).unionByName(empty.withColumn("type", F.lit("Empty File")))


def selection(stats: DataFrame, least: float = 80.0, first: int = 60, rounded: bool = True) -> DataFrame:
    """The best `first` conditions with a score of at least `least`, best first, ties by name.

    The exported score, which has one decimal, decides; with `rounded=False` the raw one does.
    """
    score = F.round("quality_score", 1) if rounded else F.col("quality_score")
    best = stats.withColumn("score", score).where(F.col("score") >= least).orderBy(F.desc("score"), "condition").limit(first)
    return best.select(F.row_number().over(W.orderBy(F.desc("score"), "condition")).alias("rank"), "condition", "score")


def filled_grid(catalog: DataFrame, years: DataFrame) -> DataFrame:
    """The grid with the papers of each cell, 0 where there are none."""
    counted = years.select("condition", "file_year", "papers")
    return year_grid(catalog).join(counted, ["condition", "file_year"], "left").select("condition", "file_year", F.coalesce("papers", F.lit(0)).cast("long").alias("papers"))


def retrieval_advice(stats: DataFrame, missing: DataFrame) -> DataFrame:
    """For conditions under 60: what to fetch again, and the first ten missing years."""
    listed = missing.groupBy("condition").agg(F.sort_array(F.collect_list("file_year")).alias("years"))  # at most one per expected year
    low = stats.where("quality_score < 60").join(listed, "condition", "left")
    abstract_rate = F.col("abstract_coverage")
    reasons = F.array_compact(
        F.array(
            F.when(F.col("missing_years") > 0, F.concat(F.lit("Missing "), F.col("missing_years"), F.lit(" years"))),
            F.when(F.col("duplicate_rate") > 5, F.lit("High duplicates")),
            F.when(abstract_rate < 50, F.lit("Low abstract coverage")),
        )
    )
    first = F.concat(F.array_join(F.slice("years", 1, 10), ", "), F.when(F.size("years") > 10, "...").otherwise(""))
    return low.select("condition", F.round("quality_score", 1).alias("quality_score"), "total_papers", F.array_join(reasons, "; ").alias("issues"), F.coalesce(first, F.lit("")).alias("missing_list"))


def latest(log: DataFrame, keys: list[str], by: str, tie: str) -> DataFrame:
    """The last entry of each key in an append-only log."""
    order = W.partitionBy(*keys).orderBy(F.col(by).desc_nulls_last(), F.col(tie).desc())
    return log.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
