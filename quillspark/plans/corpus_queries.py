"""Queries for the corpus statistics, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspark.operators import chunking, quality, querytext, temporal, terms, vectors
from quillspark.session import materialise, table
from quillspark.sources.corpus_files import with_completeness

QUERIES: dict = {}
SQL: dict[str, str] = {}

# -- shared parts of the SQL twins

_C = """c AS (SELECT condition, file_year, nullif(pmid, '') AS pmid, nullif(title, '') AS title, nullif(abstract, '') AS abstract, nullif(mesh_terms, '') AS mesh_terms
  FROM papers WHERE file_year BETWEEN 1975 AND 2024 AND condition IS NOT NULL)"""
_YS = (
    _C
    + """, ys AS (SELECT condition, file_year, count(*) AS papers, count(abstract) AS abstracts,
  count(*) FILTER (WHERE length(abstract) > 100 AND NOT contains(lower(abstract), 'no abstract')) AS meaningful, count(mesh_terms) AS mesh,
  count(*) - count(DISTINCT coalesce(pmid, chr(1) || 'null')) AS duplicates, coalesce(avg(length(abstract)), 0.0) AS avg_abstract_len,
  count(abstract) * 100.0 / count(*) AS abstract_rate, count(mesh_terms) * 100.0 / count(*) AS mesh_rate FROM c GROUP BY ALL)"""
)
_OUT = (
    _YS
    + """, fq AS (SELECT condition, quantile_cont(papers, 0.25) AS q1, quantile_cont(papers, 0.75) AS q3, count(*) AS ny FROM ys GROUP BY ALL),
  fences AS (SELECT condition, CASE WHEN ny > 5 THEN greatest(0.0, q1 - 1.5 * (q3 - q1)) END AS lower, CASE WHEN ny > 5 THEN q3 + 1.5 * (q3 - q1) END AS upper FROM fq),
  oy AS (SELECT ys.*, lower, upper, coalesce(papers < lower OR papers > upper, false) AS outlier,
    CASE WHEN papers = 0 THEN 'empty' WHEN abstract_rate < 50 THEN 'low_abstract_rate' WHEN duplicates > papers * 0.05 THEN 'high_duplicates' END AS issue
    FROM ys JOIN fences USING (condition))"""
)
_CS = (
    _OUT
    + """, t AS (SELECT condition, sum(papers)::BIGINT AS total_papers, sum(meaningful)::BIGINT AS papers_with_abstracts, sum(mesh)::BIGINT AS papers_with_mesh,
    sum(duplicates)::BIGINT AS duplicate_pmids, count(*) AS found_years, count(issue) AS quality_issues, count(*) FILTER (WHERE outlier) AS anomalous_years FROM oy GROUP BY ALL),
  u AS (SELECT condition, count(DISTINCT pmid) AS unique_pmids FROM c GROUP BY ALL),
  cs0 AS (SELECT t.*, unique_pmids, 50 - found_years AS missing_years, found_years / 50.0 * 100 AS year_coverage,
    CASE WHEN unique_pmids > 0 THEN (total_papers - unique_pmids) * 100.0 / total_papers ELSE 0.0 END AS duplicate_rate,
    papers_with_abstracts * 100.0 / total_papers AS abstract_coverage, papers_with_mesh * 100.0 / total_papers AS mesh_coverage FROM t JOIN u USING (condition)),
  cs1 AS (SELECT *, greatest(0.0, 100.0 - least(30.0, missing_years * 0.6) - CASE WHEN abstract_coverage < 70 THEN (70 - abstract_coverage) * 0.35 ELSE 0 END
    - CASE WHEN mesh_coverage < 70 THEN (70 - mesh_coverage) * 0.28 ELSE 0 END - CASE WHEN duplicate_rate > 5 THEN least(10.0, duplicate_rate * 0.5) ELSE 0 END
    - least(10.0, quality_issues * 2.0) - least(5.0, anomalous_years * 1.0)) AS quality_score FROM cs0),
  cs AS (SELECT *, CASE WHEN quality_score >= 80 THEN 'high' WHEN quality_score >= 60 THEN 'medium' ELSE 'low' END AS confidence FROM cs1)"""
)
_GRID = "g AS (SELECT name AS condition, y::INT AS file_year FROM condition_catalog, range(1975, 2025) AS r(y))"
_MISS = _GRID + ", miss AS (SELECT g.* FROM g WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.condition = g.condition AND c.file_year = g.file_year))"
_EMPTY = "e AS (SELECT condition, year FROM (SELECT * FROM completeness QUALIFY row_number() OVER (PARTITION BY condition, year ORDER BY ts DESC NULLS LAST, entry_id DESC) = 1) WHERE total_retrieved = 0)"
_FILLED = _GRID + ", filled AS (SELECT g.condition, g.file_year, coalesce(ys.papers, 0) AS papers FROM g LEFT JOIN ys ON ys.condition = g.condition AND ys.file_year = g.file_year)"
_BY = _FILLED + ", byyear AS (SELECT file_year, sum(papers)::BIGINT AS total, avg(papers) AS mean, stddev_samp(papers) AS std, count(*) FILTER (WHERE papers > 0) AS active FROM filled GROUP BY ALL)"
_SIMPLE = "list_filter(list_transform(string_split(mesh_terms, ';'), lambda x: regexp_replace(regexp_replace(x, '^\\s+', ''), '\\s+$', '')), lambda x: x <> '')"
_TERMS = f"""tp AS (SELECT condition, nullif(mesh_terms, '') AS packed, CASE WHEN nullif(mesh_terms, '') IS NOT NULL THEN {_SIMPLE} END AS terms FROM papers),
  tr AS (SELECT condition, unnest(terms) AS term FROM tp WHERE terms IS NOT NULL)"""
_VECS = """v AS (SELECT condition, aggregate_embedding AS e, years_covered[len(years_covered)] AS year FROM condition_embeddings WHERE len(aggregate_embedding) = 128
    AND NOT list_bool_or(list_transform(aggregate_embedding, lambda x: x IS NULL OR isnan(x)))),
  el AS (SELECT condition, year, unnest(e)::DOUBLE AS x, generate_subscripts(e, 1) AS i FROM v)"""


def _r(*columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _papers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers")


def _stats(spark: SparkSession, d: str) -> DataFrame:
    return quality.condition_stats(_papers(spark, d))


def _years(spark: SparkSession, d: str) -> DataFrame:
    return quality.year_stats(_papers(spark, d))


def _catalog(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "condition_catalog")


def _filled(spark: SparkSession, d: str) -> DataFrame:
    return quality.filled_grid(_catalog(spark, d), _years(spark, d))


# -- quality


@query(f"WITH {_YS} SELECT condition, file_year, papers, abstracts, meaningful, mesh, duplicates, {_r('avg_abstract_len', 'abstract_rate', 'mesh_rate')} FROM ys")
def year_stats(spark: SparkSession, d: str) -> DataFrame:
    return _years(spark, d).selectExpr("condition", "file_year", "papers", "abstracts", "meaningful", "mesh", "duplicates", *[f"round({c}, 6) AS {c}" for c in ("avg_abstract_len", "abstract_rate", "mesh_rate")])


_SCORES = ["condition", "total_papers", "unique_pmids", "papers_with_abstracts", "papers_with_mesh", "duplicate_pmids", "missing_years", "quality_issues", "anomalous_years", "confidence"]
_RATES = ["quality_score", "abstract_coverage", "mesh_coverage", "year_coverage", "duplicate_rate"]


@query(f"WITH {_CS} SELECT {', '.join(_SCORES)}, {_r(*_RATES)} FROM cs")
def condition_scores(spark: SparkSession, d: str) -> DataFrame:
    """Score, class, coverage and duplicate rate of every condition."""
    return _stats(spark, d).selectExpr(*_SCORES, *[f"round({c}, 6) AS {c}" for c in _RATES])


@query(f"WITH {_OUT} SELECT condition, file_year, papers, {_r('lower', 'upper')} FROM oy WHERE outlier")
def outlier_years(spark: SparkSession, d: str) -> DataFrame:
    return quality.with_outliers(_years(spark, d)).where("outlier").selectExpr("condition", "file_year", "papers", "round(lower, 6) AS lower", "round(upper, 6) AS upper")


@query(f"WITH {_OUT} SELECT condition, file_year, issue FROM oy WHERE issue IS NOT NULL")
def year_issues(spark: SparkSession, d: str) -> DataFrame:
    named = quality.issue(F.col("papers"), F.col("abstract_rate"), F.col("duplicates"))
    return _years(spark, d).withColumn("issue", named).where("issue is not null").select("condition", "file_year", "issue")


@query(f"WITH {_OUT} SELECT condition, file_year, round(abstract_rate, 6) AS abstract_rate FROM oy WHERE abstract_rate < 50 AND papers > 0")
def low_coverage_years(spark: SparkSession, d: str) -> DataFrame:
    return _years(spark, d).where("abstract_rate < 50 and papers > 0").selectExpr("condition", "file_year", "round(abstract_rate, 6) AS abstract_rate")


@query(f"WITH {_CS} SELECT condition, round(year_coverage, 6) AS year_coverage, missing_years FROM cs WHERE year_coverage < 80")
def incomplete_conditions(spark: SparkSession, d: str) -> DataFrame:
    return _stats(spark, d).where("year_coverage < 80").selectExpr("condition", "round(year_coverage, 6) AS year_coverage", "missing_years")


@query(f"WITH {_CS} SELECT row_number() OVER (ORDER BY round(quality_score, 1) DESC, condition)::INT AS rank, condition, round(quality_score, 1) AS quality_score FROM cs QUALIFY rank <= 10")
def top_conditions(spark: SparkSession, d: str) -> DataFrame:
    """The ten best scores, numbered (a top-k report over one row per condition)."""
    best = _stats(spark, d).selectExpr("condition", "round(quality_score, 1) AS quality_score").orderBy(F.desc("quality_score"), "condition").limit(10)
    return best.select(F.row_number().over(W.orderBy(F.desc("quality_score"), "condition")).alias("rank"), "condition", "quality_score")


@query(f"WITH {_CS}, b AS (SELECT *, row_number() OVER (ORDER BY year_coverage DESC, condition) AS b, row_number() OVER (ORDER BY year_coverage, condition) AS w FROM cs) SELECT 'best' AS side, condition, round(year_coverage, 6) AS year_coverage FROM b WHERE b <= 5 UNION ALL SELECT 'worst', condition, round(year_coverage, 6) FROM b WHERE w <= 5")
def coverage_extremes(spark: SparkSession, d: str) -> DataFrame:
    """The five best and worst year coverages."""
    stats = _stats(spark, d).selectExpr("condition", "round(year_coverage, 6) AS year_coverage")
    best = stats.orderBy(F.desc("year_coverage"), "condition").limit(5).select(F.lit("best").alias("side"), "*")
    return best.unionByName(stats.orderBy("year_coverage", "condition").limit(5).select(F.lit("worst").alias("side"), "*"))


@query(f"WITH {_CS} SELECT sum(total_papers)::BIGINT AS papers, sum(unique_pmids)::BIGINT AS summed_pmids, (SELECT count(DISTINCT pmid) FROM c) AS distinct_pmids, round(avg(quality_score), 6) AS mean_score, round(median(quality_score), 6) AS median_score, count(*) FILTER (WHERE confidence = 'high') AS high, count(*) FILTER (WHERE confidence = 'medium') AS medium, count(*) FILTER (WHERE confidence = 'low') AS low, CASE WHEN avg(quality_score) >= 80 THEN 'high' WHEN avg(quality_score) >= 60 THEN 'medium' ELSE 'low' END AS verdict FROM cs")
def grand_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals, mean and median score and class counts; ids summed per condition and truly distinct."""
    stats = _stats(spark, d).agg(
        F.sum("total_papers").alias("papers"), F.sum("unique_pmids").alias("summed_pmids"), F.round(F.avg("quality_score"), 6).alias("mean_score"), F.round(F.median("quality_score"), 6).alias("median_score"),
        *[F.count_if(F.col("confidence") == c).alias(c) for c in ("high", "medium", "low")], quality.confidence(F.avg("quality_score")).alias("verdict"),
    )
    distinct = quality.corpus(_papers(spark, d)).agg(F.count_distinct("pmid").alias("distinct_pmids"))
    names = [*stats.columns, "distinct_pmids"]
    return stats.unionByName(distinct, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in names])


@query(f"WITH {_CS} SELECT least(19, floor((quality_score - lo) / nullif(hi - lo, 0) * 20))::INT AS bin, count(*) AS n FROM cs, (SELECT min(quality_score) AS lo, max(quality_score) AS hi FROM cs) GROUP BY ALL")
def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Scores in 20 bins between the least and the greatest."""
    every = W.partitionBy()  # one row per condition
    stats = _stats(spark, d).select("quality_score", F.min("quality_score").over(every).alias("low"), F.max("quality_score").over(every).alias("high"))
    place = F.floor((F.col("quality_score") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)) * 20)
    return stats.groupBy(F.least(F.lit(19), place).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_CS} SELECT missing_years, count(*) AS n, CASE WHEN missing_years = 0 THEN 'green' WHEN missing_years <= 10 THEN 'orange' ELSE 'red' END AS colour FROM cs GROUP BY ALL")
def missing_year_bars(spark: SparkSession, d: str) -> DataFrame:
    colour = F.when(F.col("missing_years") == 0, "green").when(F.col("missing_years") <= 10, "orange").otherwise("red")
    return _stats(spark, d).groupBy("missing_years").agg(F.count(F.lit(1)).alias("n")).withColumn("colour", colour)


@query(f"WITH {_CS} SELECT condition, round(abstract_coverage, 6) AS abstract_coverage, round(mesh_coverage, 6) AS mesh_coverage FROM cs WHERE total_papers > 100")
def coverage_rates(spark: SparkSession, d: str) -> DataFrame:
    return _stats(spark, d).where("total_papers > 100").selectExpr("condition", "round(abstract_coverage, 6) AS abstract_coverage", "round(mesh_coverage, 6) AS mesh_coverage")


@query(f"WITH {_CS} SELECT count(*) FILTER (WHERE missing_years > 10) AS many_missing_years, count(*) FILTER (WHERE abstract_coverage < 70) AS low_abstracts, count(*) FILTER (WHERE mesh_coverage < 70) AS low_terms, count(*) FILTER (WHERE duplicate_rate > 5) AS many_duplicates, count(*) FILTER (WHERE anomalous_years > 0) AS with_outliers FROM cs")
def issue_tallies(spark: SparkSession, d: str) -> DataFrame:
    tests = {"many_missing_years": "missing_years > 10", "low_abstracts": "abstract_coverage < 70", "low_terms": "mesh_coverage < 70", "many_duplicates": "duplicate_rate > 5", "with_outliers": "anomalous_years > 0"}
    return _stats(spark, d).agg(*[F.count_if(F.expr(test)).alias(name) for name, test in tests.items()])


@query(f"WITH {_CS}, {_MISS}, l AS (SELECT condition, list(file_year ORDER BY file_year) AS y FROM miss GROUP BY ALL) SELECT cs.condition, round(quality_score, 1) AS quality_score, total_papers, concat_ws('; ', CASE WHEN missing_years > 0 THEN 'Missing ' || missing_years || ' years' END, CASE WHEN duplicate_rate > 5 THEN 'High duplicates' END, CASE WHEN abstract_coverage < 50 THEN 'Low abstract coverage' END) AS issues, coalesce(array_to_string(y[1:10], ', ') || CASE WHEN len(y) > 10 THEN '...' ELSE '' END, '') AS missing_list FROM cs LEFT JOIN l ON l.condition = cs.condition WHERE quality_score < 60")
def retrieval_advice(spark: SparkSession, d: str) -> DataFrame:
    return quality.retrieval_advice(_stats(spark, d), quality.missing_years(_catalog(spark, d), _papers(spark, d)))


@query(f"WITH {_CS}, r AS (SELECT condition, round(quality_score, 1) AS score FROM cs WHERE round(quality_score, 1) >= 80) SELECT row_number() OVER (ORDER BY score DESC, condition)::INT AS rank, condition, score FROM r QUALIFY rank <= 60")
def embedding_selection(spark: SparkSession, d: str) -> DataFrame:
    """The 60 best conditions with an exported score of 80 or more (a top-k report)."""
    return quality.selection(_stats(spark, d))


@query(f"WITH {_CS}, r AS (SELECT condition, quality_score AS score FROM cs WHERE quality_score >= 80) SELECT row_number() OVER (ORDER BY round(score, 9) DESC, condition)::INT AS rank, condition, round(score, 6) AS score FROM r QUALIFY rank <= 60")
def embedding_selection_raw(spark: SparkSession, d: str) -> DataFrame:
    """The same by the raw score."""
    stats = _stats(spark, d).withColumn("quality_score", F.round("quality_score", 9))
    return quality.selection(stats, rounded=False).withColumn("score", F.round("score", 6))


@query(f"WITH {_CS} SELECT n.name AS condition, n.folder FROM condition_catalog n WHERE NOT EXISTS (SELECT 1 FROM cs WHERE cs.condition = n.name)")
def skipped_conditions(spark: SparkSession, d: str) -> DataFrame:
    """Catalogue entries without any paper, which a selection warns of and skips."""
    held = quality.corpus(_papers(spark, d)).select("condition").distinct()
    return _catalog(spark, d).selectExpr("name AS condition", "folder").join(held, "condition", "left_anti")


@query("WITH c AS (SELECT condition, file_year, nullif(pmid, '') AS pmid, nullif(abstract, '') AS abstract FROM papers WHERE file_year BETWEEN 2020 AND 2024 AND condition IS NOT NULL) SELECT condition, count(*) AS total_papers, count(DISTINCT pmid) AS unique_pmids, count(DISTINCT file_year) AS found_years, 5 - count(DISTINCT file_year) AS missing_years, round(count(*) FILTER (WHERE length(abstract) > 100 AND NOT contains(lower(abstract), 'no abstract')) * 100.0 / count(*), 6) AS abstract_coverage FROM c GROUP BY ALL")
def recent_scores(spark: SparkSession, d: str) -> DataFrame:
    """The condition statistics of the test years 2020 to 2024 only; the subset prunes the scan."""
    stats = quality.condition_stats(_papers(spark, d), list(range(2020, 2025)))
    return stats.select("condition", "total_papers", "unique_pmids", "found_years", "missing_years", F.round("abstract_coverage", 6).alias("abstract_coverage"))


@query(f"WITH {_TERMS.replace('FROM papers)', 'FROM papers WHERE file_year IN (2015, 2018, 2020, 2022, 2024))')} SELECT term, count(*) AS n FROM tr GROUP BY ALL")
def sample_year_terms(spark: SparkSession, d: str) -> DataFrame:
    """Term frequencies in the five years that the term report samples."""
    papers = _papers(spark, d).where(F.col("file_year").isin(2015, 2018, 2020, 2022, 2024))
    return terms.frequencies(terms.term_rows(papers))


# -- gaps and time


@query(f"WITH {_C}, {_MISS} SELECT condition, file_year FROM miss")
def missing_years(spark: SparkSession, d: str) -> DataFrame:
    return quality.missing_years(_catalog(spark, d), _papers(spark, d))


@query(f"WITH {_C}, {_MISS}, {_EMPTY} SELECT condition, file_year, CASE WHEN (condition, file_year::VARCHAR) IN (SELECT (condition, year) FROM e) THEN 'Empty File' ELSE 'Missing Data' END AS type FROM miss")
def data_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Missing years and, told apart by the log, years that were fetched but are empty."""
    missing = quality.missing_years(_catalog(spark, d), _papers(spark, d))
    return quality.data_gaps(missing, quality.empty_years(table(spark, d, "completeness"), missing))


@query(f"WITH {_C}, {_MISS} SELECT file_year, count(*) AS n FROM miss GROUP BY ALL HAVING count(*) > 0.2 * (SELECT count(*) FROM condition_catalog)")
def systematic_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Years missing for more than a fifth of the conditions."""
    return _gap_counts(spark, d).where("n > 0.2 * conditions").select("file_year", "n")


def _gap_counts(spark: SparkSession, d: str) -> DataFrame:
    """Of each expected year, how many conditions there are and how many miss it."""
    filled = quality.filled_grid(_catalog(spark, d), _years(spark, d))
    return filled.groupBy("file_year").agg(F.count(F.lit(1)).alias("conditions"), F.count_if(F.col("papers") == 0).alias("n"))


@query(f"WITH {_C}, {_MISS}, n AS (SELECT file_year, count(*) AS n FROM miss GROUP BY ALL HAVING count(*) > 0.2 * (SELECT count(*) FROM condition_catalog)) SELECT row_number() OVER (ORDER BY n DESC, file_year)::INT AS rank, file_year, n FROM n QUALIFY rank <= 5")
def worst_gap_years(spark: SparkSession, d: str) -> DataFrame:
    """The five systematic gap years that most conditions miss (a top-k report)."""
    worst = systematic_gaps(spark, d).orderBy(F.desc("n"), "file_year").limit(5)
    return worst.select(F.row_number().over(W.orderBy(F.desc("n"), "file_year")).alias("rank"), "file_year", "n")


@query(f"WITH {_YS}, {_FILLED} SELECT condition, file_year, papers FROM filled")
def temporal_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _filled(spark, d)


@query(f"WITH {_YS}, {_BY} SELECT file_year, total, {_r('mean', 'std')}, active FROM byyear")
def papers_by_year(spark: SparkSession, d: str) -> DataFrame:
    return temporal.by_year(_filled(spark, d)).selectExpr("file_year", "total", "round(mean, 6) AS mean", "round(std, 6) AS std", "active")


@query(f"WITH {_YS}, {_BY}, n AS (SELECT *, row_number() OVER (ORDER BY file_year) AS k FROM byyear), f AS (SELECT count(*) AS years, regr_slope(total, file_year) AS slope, regr_r2(total, file_year) AS r2, avg(total) FILTER (WHERE k <= 5) AS early, avg(total) FILTER (WHERE k > 45) AS late FROM n) SELECT years, {_r('slope', 'r2', 'early', 'late')}, round(CASE WHEN early > 0 THEN (late - early) / early * 100 ELSE 0 END, 6) AS growth FROM f")
def yearly_trend(spark: SparkSession, d: str) -> DataFrame:
    """Slope, R2 and growth of the yearly totals."""
    fitted = temporal.trend(temporal.by_year(_filled(spark, d)))
    return fitted.selectExpr("years", *[f"round({c}, 6) AS {c}" for c in ("slope", "r2", "early", "late", "growth")])


# Student's t by Simpson's rule over its density
_P_VALUE = """f AS (SELECT count(*) AS years, regr_slope(total, file_year) AS slope, regr_r2(total, file_year) AS r2 FROM byyear),
  t AS (SELECT *, years - 2 AS df, sqrt(r2 * (years - 2) / (1 - r2)) AS t FROM f),
  i AS (SELECT sum(CASE WHEN k IN (0, 4000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * pow(1 + pow(t * k / 4000, 2) / df, -(df + 1) / 2.0)) * t / 4000 / 3 AS area FROM t, range(4001) AS r(k) GROUP BY t)
  SELECT years, round(slope, 6) AS slope, round(r2, 6) AS r2, round(1 - 2 * area * exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(df * pi()), 6) + 0.0 AS p_value,
    1 - 2 * area * exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(df * pi()) < 0.05 AS significant FROM t, i"""


@query(f"WITH {_YS}, {_BY}, {_P_VALUE}")
def yearly_trend_p_value(spark: SparkSession, d: str) -> DataFrame:
    """Slope and R2 with the p-value of the slope."""
    fitted = temporal.trend_with_p_value(temporal.by_year(_filled(spark, d)))
    return fitted.select("years", *[(F.round(c, 6) + 0.0).alias(c) for c in ("slope", "r2", "p_value")], "significant")


@query(f"WITH {_YS}, {_FILLED}, {_EMPTY}, top AS (SELECT condition FROM filled GROUP BY ALL ORDER BY sum(papers) DESC, condition LIMIT 30) SELECT condition, file_year, CASE WHEN papers > 0 THEN 1.0 WHEN (condition, file_year::VARCHAR) IN (SELECT (condition, year) FROM e) THEN 0.5 ELSE 0.0 END::DOUBLE AS cell FROM filled SEMI JOIN top USING (condition)")
def coverage_heatmap(spark: SparkSession, d: str) -> DataFrame:
    """The 30 largest conditions by year: 1 where there are papers, 0.5 where the file is empty, else 0."""
    grid = _filled(spark, d)
    top = grid.groupBy("condition").agg(F.sum("papers").alias("n")).orderBy(F.desc("n"), "condition").limit(30).select("condition")
    empty = quality.empty_years(table(spark, d, "completeness"), grid.where("papers = 0").select("condition", "file_year")).withColumn("empty", F.lit(0.5))
    shown = grid.join(top, "condition", "left_semi").join(empty, ["condition", "file_year"], "left")
    return shown.select("condition", "file_year", F.when(F.col("papers") > 0, 1.0).otherwise(F.coalesce("empty", F.lit(0.0))).alias("cell"))


@query(f"WITH {_YS}, {_FILLED} SELECT CASE WHEN grouping(file_year) = 1 THEN 'TOTAL' ELSE file_year::VARCHAR END AS year, condition, sum(papers)::BIGINT AS papers FROM filled GROUP BY GROUPING SETS ((file_year, condition), (condition))")
def temporal_with_total(spark: SparkSession, d: str) -> DataFrame:
    """The temporal matrix in long form with a TOTAL row per condition."""
    grid = _filled(spark, d)
    sets = grid.groupingSets([["file_year", "condition"], ["condition"]], "file_year", "condition").agg(F.sum("papers").alias("papers"), F.grouping("file_year").alias("g"))
    return sets.select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("file_year").cast("string")).alias("year"), "condition", "papers")


_LONG = "SELECT CASE WHEN grouping(file_year) = 1 THEN 'TOTAL' ELSE file_year::VARCHAR END AS year, condition, sum(papers)::BIGINT AS papers FROM filled GROUP BY GROUPING SETS ((file_year, condition), (condition))"


@query(f"WITH {_YS}, {_FILLED}, w AS ({_LONG}) SELECT * FROM (PIVOT w ON condition USING sum(papers)::BIGINT GROUP BY year)")
def temporal_export(spark: SparkSession, d: str) -> DataFrame:
    """The exported matrix: a row per year and one TOTAL, a column per condition of the catalogue."""
    names = [r.name for r in _catalog(spark, d).select("name").distinct().orderBy("name").collect()]  # the columns
    return temporal_with_total(spark, d).groupBy("year").pivot("condition", names).agg(F.sum("papers"))


@query("SELECT year, condition, sum(total_found)::BIGINT AS found, sum(total_retrieved)::BIGINT AS retrieved, round(CASE WHEN sum(total_found) > 0 THEN sum(total_retrieved) * 100.0 / sum(total_found) ELSE 100.0 END, 6) AS pct FROM completeness GROUP BY ROLLUP (condition, year)")
def completeness_report(spark: SparkSession, d: str) -> DataFrame:
    """Found and retrieved per condition and year, per condition and in all."""
    found, got = F.sum("total_found"), F.sum("total_retrieved")
    pct = F.when(found > 0, got / found * 100).otherwise(100.0)
    return table(spark, d, "completeness").rollup("condition", "year").agg(found.alias("found"), got.alias("retrieved"), F.round(pct, 6).alias("pct"))


@query("SELECT condition, year, lower(status) AS status FROM checkpoint QUALIFY row_number() OVER (PARTITION BY condition, year ORDER BY ts DESC NULLS LAST, entry_id DESC) = 1")
def checkpoint_state(spark: SparkSession, d: str) -> DataFrame:
    """The last status of each condition and year."""
    return quality.latest(table(spark, d, "checkpoint"), ["condition", "year"], "ts", "entry_id").select("condition", "year", F.lower("status").alias("status"))


@query(f"WITH {_GRID}, s AS (SELECT condition, year, lower(status) AS status FROM checkpoint QUALIFY row_number() OVER (PARTITION BY condition, year ORDER BY ts DESC NULLS LAST, entry_id DESC) = 1) SELECT g.condition, g.file_year FROM g WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.condition = g.condition AND s.year = g.file_year::VARCHAR AND s.status = 'complete')")
def open_work(spark: SparkSession, d: str) -> DataFrame:
    """Conditions and years that a resumed run still has to fetch."""
    done = checkpoint_state(spark, d).where("status = 'complete'").select("condition", F.col("year").try_cast("int").alias("file_year"))
    return quality.year_grid(_catalog(spark, d)).join(done, ["condition", "file_year"], "left_anti")


@query("SELECT name, folder, replace(replace(name, '/', '_'), ' ', '_') AS made_folder, replace(folder, '_', ' ') AS display, CASE WHEN length(name) > 20 THEN substring(name, 1, 17) || '...' ELSE name END AS label, coalesce(search_query, '\"' || name || '\"[Title/Abstract] OR \"' || replace(replace(lower(name), ' and ', ' '), '/', ' ') || '\"[Title/Abstract]') AS search, coalesce(n, 0) AS papers FROM condition_catalog LEFT JOIN (SELECT condition, count(*) AS n FROM papers GROUP BY ALL) p ON p.condition = name")
def catalog_names(spark: SparkSession, d: str) -> DataFrame:
    """Folder, display name, short label, search text and papers of every condition."""
    name = F.col("name")
    label = F.when(F.length(name) > 20, F.concat(F.substring(name, 1, 17), F.lit("..."))).otherwise(name)
    counts = _papers(spark, d).groupBy(F.col("condition").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return _catalog(spark, d).join(counts, "name", "left").select(
        "name", "folder", F.translate(name, "/ ", "__").alias("made_folder"), F.translate("folder", "_", " ").alias("display"), label.alias("label"),
        querytext.condition_search("name", "search_query").alias("search"), F.coalesce("n", F.lit(0)).alias("papers"),
    )


_BUCKETS = "SELECT condition, retrieved_at AS ts, strftime(retrieved_at, '%Y') AS year, strftime(retrieved_at, '%Y/%m') AS month, strftime(retrieved_at, '%Y/%m') || 'w' || ((day(retrieved_at) - 1) // 7 + 1)::INT AS week, strftime(retrieved_at, '%Y/%m/%d') AS day, strftime(retrieved_at, '%Y/%m/%d') || 'h' || (hour(retrieved_at) // 6)::INT AS six_hours, strftime(retrieved_at, '%Y/%m/%d') || 'q' || (hour(retrieved_at) * 4 + minute(retrieved_at) // 15)::INT AS quarter_hour FROM papers WHERE retrieved_at IS NOT NULL"


def _chunk_sql(cap: int) -> str:
    levels = chunking.LEVELS
    counts = ", ".join(f"count(*) OVER (PARTITION BY condition, {level}) AS n_{level}" for level in levels)
    case = " ".join(f"WHEN n_{level} <= {cap} THEN '{level}'" for level in levels[:-1]) + f" ELSE '{levels[-1]}'"
    value = " ".join(f"WHEN '{level}' THEN {level}" for level in levels)
    return f"WITH b AS ({_BUCKETS}), n AS (SELECT *, {counts} FROM b), l AS (SELECT *, CASE {case} END AS level FROM n) SELECT condition, level, CASE level {value} END AS bucket, count(*) AS n, least(count(*), {cap}) AS kept, greatest(count(*) - {cap}, 0) AS lost FROM l GROUP BY ALL"


@query(_chunk_sql(50))
def time_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The time chunks that cover each condition's arrivals with at most 50 rows each."""
    return chunking.chunks(_papers(spark, d).select("condition", "retrieved_at"), ["condition"], "retrieved_at", 50)


# -- terms


@query(f"WITH {_TERMS} SELECT term, count(*) AS n FROM tr GROUP BY ALL")
def term_counts(spark: SparkSession, d: str) -> DataFrame:
    return terms.frequencies(terms.term_rows(_papers(spark, d)))


@query(f"WITH {_TERMS}, n AS (SELECT condition, term, count(*) AS n FROM tr GROUP BY ALL) SELECT condition, term, n, row_number() OVER (PARTITION BY condition ORDER BY n DESC, term)::INT AS rank FROM n QUALIFY rank <= 10")
def top_terms(spark: SparkSession, d: str) -> DataFrame:
    return terms.top_terms(terms.term_rows(_papers(spark, d)))


@query(f"WITH {_TERMS}, a AS (SELECT condition, count(packed) * 100.0 / count(*) AS coverage, avg(len(terms)) AS terms_per_paper, median(len(terms))::DOUBLE AS median_terms FROM tp GROUP BY ALL), b AS (SELECT condition, count(DISTINCT term) AS distinct_terms, avg(length(term)) AS avg_term_length FROM tr GROUP BY ALL) SELECT a.condition, {_r('coverage', 'terms_per_paper', 'median_terms', 'avg_term_length')}, coalesce(distinct_terms, 0) AS distinct_terms FROM a LEFT JOIN b ON a.condition = b.condition")
def condition_terms(spark: SparkSession, d: str) -> DataFrame:
    return terms.condition_terms(_papers(spark, d)).selectExpr("condition", *[f"round({c}, 6) AS {c}" for c in ("coverage", "terms_per_paper", "median_terms", "avg_term_length")], "distinct_terms")


@query(f"WITH {_TERMS}, a AS (SELECT condition, count(packed) * 100.0 / count(*) AS coverage FROM tp GROUP BY ALL) SELECT round(avg(coverage), 6) AS mean_coverage, round(stddev_pop(coverage), 6) AS std_coverage, (SELECT count(DISTINCT term) FROM tr) AS distinct_terms FROM a")
def term_summary(spark: SparkSession, d: str) -> DataFrame:
    papers = _papers(spark, d)
    coverage = terms.condition_terms(papers).agg(F.round(F.avg("coverage"), 6).alias("mean_coverage"), F.round(F.stddev_pop("coverage"), 6).alias("std_coverage"))
    distinct = terms.term_rows(papers).agg(F.count_distinct("term").alias("distinct_terms"))
    both = coverage.unionByName(distinct, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


# -- vectors


@query("SELECT record_id, concat_ws(' ', '[TITLE] ' || nullif(title, ''), '[ABSTRACT] ' || substring(nullif(abstract, ''), 1, 2000), '[MESH] ' || replace(nullif(mesh_terms, ''), ';', ', ')) AS text FROM papers")
def encoder_texts(spark: SparkSession, d: str) -> DataFrame:
    """The reference's texts, with its cut of the abstract; `encoder_whole_texts` has all of it."""
    return _papers(spark, d).select("record_id", vectors.paper_text(abstract_limit=vectors.REFERENCE_ABSTRACT).alias("text"))


@query("SELECT record_id, concat_ws(' ', '[TITLE] ' || nullif(title, ''), '[ABSTRACT] ' || nullif(abstract, ''), '[MESH] ' || replace(nullif(mesh_terms, ''), ';', ', ')) AS text FROM papers")
def encoder_whole_texts(spark: SparkSession, d: str) -> DataFrame:
    """The text of every paper with its whole abstract, as `paper_centroids` encodes it."""
    return _papers(spark, d).select("record_id", vectors.paper_text().alias("text"))


@query()
def paper_centroids(spark: SparkSession, d: str) -> DataFrame:
    """Mean vector per condition and year; the texts' vectors are masked means over all their tokens.

    The token vectors come from the offline stand-in model; any other model goes in its place.
    """
    texts = _papers(spark, d).where("condition is not null").select("condition", "file_year", vectors.paper_text().alias("text"))
    encoded = vectors.encode_texts(texts, "text", lambda: vectors.hashing_encoder(128))
    return vectors.mean_vector(encoded, ["condition", "file_year"], "vec", 128)


def _centroids(spark: SparkSession, d: str) -> DataFrame:
    return vectors.mean_vector(table(spark, d, "condition_embeddings"), ["condition"], "aggregate_embedding", 128)


@query(f"WITH {_VECS}, m AS (SELECT condition, i, avg(x) AS x, count(*) AS n FROM el GROUP BY ALL) SELECT condition, any_value(n) AS n, round(sum(x), 4) AS total, round(sqrt(sum(x * x)), 4) AS norm FROM m GROUP BY condition")
def condition_centroids(spark: SparkSession, d: str) -> DataFrame:
    """Size, element sum and length of each condition's mean vector."""
    total = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x)
    return _centroids(spark, d).select("condition", "n", F.round(total, 4).alias("total"), F.round(F.sqrt(vectors.dot(F.col("vec"), F.col("vec"))), 4).alias("norm"))


@query(f"WITH {_VECS}, m AS (SELECT condition, i, avg(x) AS x FROM el GROUP BY ALL), l AS (SELECT condition, list(x ORDER BY i) AS vec FROM m GROUP BY ALL) SELECT p.condition AS a, q.condition AS b, round(list_cosine_similarity(p.vec, q.vec), 5) AS cos FROM l p JOIN l q ON p.condition <= q.condition")
def condition_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of every two conditions' mean vectors."""
    return vectors.similarity(_centroids(spark, d), "condition").select("a", "b", F.round("cos", 5).alias("cos"))


@query(f"WITH {_VECS}, m AS (SELECT condition, i, avg(x) AS x FROM el GROUP BY ALL), l AS (SELECT condition, list(x ORDER BY i) AS vec FROM m GROUP BY ALL), s AS (SELECT p.condition AS a, q.condition AS b, round(list_cosine_similarity(p.vec, q.vec), 5) AS cos FROM l p, l q WHERE p.condition IS NOT NULL AND q.condition IS NOT NULL) SELECT * FROM (PIVOT s ON b USING first(cos) GROUP BY a)")
def similarity_export(spark: SparkSession, d: str) -> DataFrame:
    """The same as a square matrix with a row and a column per condition."""
    pairs = materialise(condition_similarity(spark, d).where("a is not null and b is not null"))
    names = [r.a for r in pairs.select("a").distinct().orderBy("a").collect()]  # the columns
    return vectors.similarity_matrix(pairs, names)


@query(f"WITH {_VECS}, m AS (SELECT condition, year, i, avg(x) AS x FROM el WHERE year IS NOT NULL GROUP BY ALL), l AS (SELECT condition, year, list(x ORDER BY i) AS vec FROM m GROUP BY ALL), w AS (SELECT condition, year, vec, lag(vec) OVER o AS before, year - lag(year) OVER o AS year_gap, count(*) OVER (PARTITION BY condition) AS k FROM l WINDOW o AS (PARTITION BY condition ORDER BY year)) SELECT condition, year, year_gap, round(list_distance(vec, before), 4) AS drift FROM w WHERE k > 5 AND before IS NOT NULL")
def semantic_drift(spark: SparkSession, d: str) -> DataFrame:
    """Distance of each condition's yearly mean vector to the one before; the year is the last one covered."""
    return vectors.drift(_yearly_centroids(spark, d), "condition", "year").withColumn("drift", F.round("drift", 4))


def _yearly_centroids(spark: SparkSession, d: str) -> DataFrame:
    dated = table(spark, d, "condition_embeddings").withColumn("year", F.try_element_at("years_covered", F.lit(-1))).where("year is not null")
    return vectors.mean_vector(dated, ["condition", "year"], "aggregate_embedding", 128)


@query(f"WITH {_VECS}, m AS (SELECT condition, year, i, avg(x) AS x FROM el WHERE year IS NOT NULL GROUP BY ALL), l AS (SELECT condition, year, list(x ORDER BY i) AS vec FROM m GROUP BY ALL), w AS (SELECT condition, year, vec, lag(vec) OVER o AS before, count(*) OVER (PARTITION BY condition) AS k FROM l WINDOW o AS (PARTITION BY condition ORDER BY year)), top AS (SELECT condition FROM l GROUP BY ALL ORDER BY count(*) DESC, condition LIMIT 10) SELECT condition, year, round(list_distance(vec, before), 4) AS drift FROM w SEMI JOIN top USING (condition) WHERE k > 5 AND before IS NOT NULL")
def drift_of_longest_series(spark: SparkSession, d: str) -> DataFrame:
    """The drift of the ten conditions with the most years (a top-k report)."""
    centroids = _yearly_centroids(spark, d)
    longest = centroids.groupBy("condition").agg(F.count(F.lit(1)).alias("years")).orderBy(F.desc("years"), "condition").limit(10)
    moved = vectors.drift(centroids.join(longest.select("condition"), "condition", "left_semi"), "condition", "year")
    return moved.select("condition", "year", F.round("drift", 4).alias("drift"))


@query("WITH e AS (SELECT * FROM condition_embeddings WHERE condition IS NOT NULL) SELECT condition, (SELECT sum(total_papers) FROM e x WHERE x.condition = e.condition)::BIGINT AS total_papers, (SELECT count(*) FROM e x WHERE x.condition = e.condition) AS slices, (SELECT list_sort(list_distinct(list(y))) FROM (SELECT unnest(years_covered) AS y FROM e x WHERE x.condition = e.condition)) AS years_covered FROM e GROUP BY condition")
def embedding_metadata(spark: SparkSession, d: str) -> DataFrame:
    """What the metadata file of each condition holds: papers, slices and years."""
    stored = table(spark, d, "condition_embeddings").where("condition is not null")
    totals = stored.groupBy("condition").agg(F.sum("total_papers").alias("total_papers"), F.count(F.lit(1)).alias("slices"))
    years = stored.select("condition", F.explode("years_covered").alias("y")).where("y is not null").groupBy("condition").agg(F.sort_array(F.collect_set("y")).alias("years_covered"))
    return totals.join(years, "condition", "left")


@query("SELECT count(DISTINCT condition) AS conditions, count(aggregate_embedding) AS vectors, max(len(aggregate_embedding))::INT AS embedding_dim, sum(total_papers)::BIGINT AS total_papers, (SELECT min(y) FROM (SELECT unnest(years_covered) AS y FROM condition_embeddings))::INT AS first_year, (SELECT max(y) FROM (SELECT unnest(years_covered) AS y FROM condition_embeddings))::INT AS last_year, round(avg(len(list_distinct(years_covered))), 6) AS mean_years FROM condition_embeddings")
def embedding_summary(spark: SparkSession, d: str) -> DataFrame:
    """The numbers of the embedding summary, in one row."""
    size = F.when(F.col("aggregate_embedding").isNotNull(), F.size("aggregate_embedding"))
    years = F.when(F.col("years_covered").isNotNull(), F.size(F.array_distinct("years_covered")))
    return table(spark, d, "condition_embeddings").agg(
        F.count_distinct("condition").alias("conditions"), F.count("aggregate_embedding").alias("vectors"), F.max(size).alias("embedding_dim"), F.sum("total_papers").alias("total_papers"),
        F.min(F.array_min("years_covered")).alias("first_year"), F.max(F.array_max("years_covered")).alias("last_year"), F.round(F.avg(years), 6).alias("mean_years"),
    )


@query("SELECT condition, min(y)::INT AS first_year, max(y)::INT AS last_year, count(DISTINCT y) AS years FROM (SELECT condition, unnest(years_covered) AS y FROM condition_embeddings) GROUP BY ALL")
def embedding_years(spark: SparkSession, d: str) -> DataFrame:
    years = table(spark, d, "condition_embeddings").select("condition", F.explode("years_covered").alias("y"))
    return years.groupBy("condition").agg(F.min("y").alias("first_year"), F.max("y").alias("last_year"), F.count_distinct("y").alias("years"))


# -- further reports and exports


@query("SELECT record_id, condition, length(abstract) AS abstract_length FROM papers WHERE length(abstract) >= 50")
def kept_records(spark: SparkSession, d: str) -> DataFrame:
    """Records whose abstract is long enough to be kept."""
    return _papers(spark, d).where(F.length("abstract") >= 50).select("record_id", "condition", F.length("abstract").alias("abstract_length"))


@query(f"WITH {_CS} SELECT condition, round(quality_score, 1) AS quality_score FROM cs ORDER BY quality_score, condition LIMIT 10")
def lowest_conditions(spark: SparkSession, d: str) -> DataFrame:
    """The ten lowest scores (a top-k report)."""
    return _stats(spark, d).selectExpr("condition", "round(quality_score, 1) AS quality_score").orderBy("quality_score", "condition").limit(10)


@query(f"WITH {_CS} SELECT CASE WHEN length(condition) > 20 THEN substring(condition, 1, 17) || '...' ELSE condition END AS label, total_papers FROM cs ORDER BY total_papers DESC, condition LIMIT 15")
def largest_conditions(spark: SparkSession, d: str) -> DataFrame:
    """The 15 conditions with the most papers, by short label (a top-k report)."""
    label = F.when(F.length("condition") > 20, F.concat(F.substring("condition", 1, 17), F.lit("..."))).otherwise(F.col("condition"))
    return _stats(spark, d).orderBy(F.desc("total_papers"), "condition").limit(15).select(label.alias("label"), "total_papers")


@query(f"WITH {_CS} SELECT condition, replace(replace(condition, '/', '_'), ' ', '_') AS folder, {', '.join(f'round({c}, 1) AS {c}' for c in _RATES)}, {', '.join(c for c in _SCORES if c not in ('condition', 'confidence', 'duplicate_pmids'))} FROM cs")
def score_export(spark: SparkSession, d: str) -> DataFrame:
    """The 14 columns of the exported score table, rates with one decimal."""
    kept = [c for c in _SCORES if c not in ("condition", "confidence", "duplicate_pmids")]
    return _stats(spark, d).select("condition", F.translate("condition", "/ ", "__").alias("folder"), *[F.round(c, 1).alias(c) for c in _RATES], *kept)


@query(f"WITH {_TERMS} SELECT term, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, term)::INT AS rank FROM tr GROUP BY term QUALIFY rank <= 10")
def most_frequent_terms(spark: SparkSession, d: str) -> DataFrame:
    """The ten most frequent terms overall (a top-k report)."""
    best = term_counts(spark, d).orderBy(F.desc("n"), "term").limit(10)
    return best.select("term", "n", F.row_number().over(W.orderBy(F.desc("n"), "term")).alias("rank"))


@query("SELECT condition, count(*) AS n, count(DISTINCT pmid) AS distinct_ids, count(DISTINCT CASE WHEN years > 1 THEN pmid END) AS in_several_years FROM (SELECT condition, nullif(pmid, '') AS pmid, count(DISTINCT file_year) OVER (PARTITION BY condition, nullif(pmid, '')) AS years FROM papers WHERE nullif(pmid, '') IS NOT NULL) GROUP BY ALL")
def cross_year_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Ids that a condition holds in more than one year."""
    ids = _papers(spark, d).select("condition", "file_year", quality.blank_to_null("pmid").alias("pmid")).where("pmid is not null")
    per_id = ids.groupBy("condition", "pmid").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("file_year").alias("years"))
    return per_id.groupBy("condition").agg(F.sum("rows").alias("n"), F.count(F.lit(1)).alias("distinct_ids"), F.count_if(F.col("years") > 1).alias("in_several_years"))


@query("SELECT count(*) AS entries, count(*) FILTER (WHERE lower(status) = 'complete') AS complete FROM (SELECT * FROM checkpoint QUALIFY row_number() OVER (PARTITION BY condition, year ORDER BY ts DESC NULLS LAST, entry_id DESC) = 1)")
def work_done(spark: SparkSession, d: str) -> DataFrame:
    """How many condition-years have a state, and how many are complete."""
    return checkpoint_state(spark, d).agg(F.count(F.lit(1)).alias("entries"), F.count_if(F.col("status") == "complete").alias("complete"))


@query("SELECT folder, count(DISTINCT file_year) AS files, min(file_year) AS first_year, max(file_year) AS last_year, round(count(DISTINCT CASE WHEN file_year BETWEEN 1975 AND 2024 THEN file_year END) / 50.0 * 100, 6) AS year_coverage FROM papers GROUP BY ALL")
def corpus_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Years on file and year coverage of every folder."""
    bounded = F.when(F.col("file_year").between(quality.FIRST_YEAR, quality.LAST_YEAR), F.col("file_year"))
    stats = _papers(spark, d).groupBy("folder").agg(F.count_distinct("file_year").alias("files"), F.min("file_year").alias("first_year"), F.max("file_year").alias("last_year"), F.count_distinct(bounded).alias("n"))
    return stats.select("folder", "files", "first_year", "last_year", F.round(F.col("n") / quality.YEARS * 100, 6).alias("year_coverage"))


@query("SELECT condition, count(DISTINCT y) AS years FROM (SELECT condition, unnest(years_covered) AS y FROM condition_embeddings) GROUP BY ALL ORDER BY years DESC, condition LIMIT 10")
def longest_series(spark: SparkSession, d: str) -> DataFrame:
    """The ten conditions with the most years of embeddings (a top-k report)."""
    return embedding_years(spark, d).select("condition", "years").orderBy(F.desc("years"), "condition").limit(10)


@query("SELECT vec_id, condition, aggregate_embedding::DOUBLE[] AS embedding, len(aggregate_embedding) AS embedding_dim, list_sort(list_distinct(years_covered)) AS years_available FROM condition_embeddings WHERE aggregate_embedding IS NOT NULL AND NOT list_bool_or(list_transform(aggregate_embedding, lambda x: x IS NULL OR isnan(x)))")
def embedding_export(spark: SparkSession, d: str) -> DataFrame:
    """What the downstream join file holds of each stored embedding that is a vector of numbers."""
    numbers = F.forall("aggregate_embedding", lambda x: x.isNotNull() & ~F.isnan(x))
    kept = table(spark, d, "condition_embeddings").where(F.col("aggregate_embedding").isNotNull() & numbers)
    return kept.select("vec_id", "condition", F.col("aggregate_embedding").cast("array<double>").alias("embedding"), F.size("aggregate_embedding").cast("long").alias("embedding_dim"), F.sort_array(F.array_distinct("years_covered")).alias("years_available"))


@query("SELECT condition, year, total_found, total_retrieved, round(CASE WHEN total_found > 0 THEN total_retrieved * 100.0 / total_found ELSE 100.0 END, 6) AS completeness FROM completeness QUALIFY row_number() OVER (PARTITION BY condition, year ORDER BY ts DESC NULLS LAST, entry_id DESC) = 1")
def completeness_state(spark: SparkSession, d: str) -> DataFrame:
    """The last completeness entry of each condition and year, its percentage made anew."""
    last = quality.latest(table(spark, d, "completeness"), ["condition", "year"], "ts", "entry_id")
    return with_completeness(last).select("condition", "year", "total_found", "total_retrieved", F.round("completeness", 6).alias("completeness"))


_LAST = "SELECT * FROM completeness QUALIFY row_number() OVER (PARTITION BY condition, year ORDER BY ts DESC NULLS LAST, entry_id DESC) = 1"


@query(f"SELECT n.folder, l.condition, l.year, total_found - total_retrieved AS lacking, l.year || ': ' || format('{{:,}}', total_retrieved) || ' / ' || format('{{:,}}', total_found) || ' (' || format('{{:.1f}}', round(total_retrieved * 100.0 / total_found, 1)) || '%)' AS line FROM ({_LAST}) l JOIN condition_catalog n ON n.name = l.condition WHERE total_found > 0 AND total_retrieved < total_found")
def completeness_detail(spark: SparkSession, d: str) -> DataFrame:
    """The report's lines on catalogued conditions and years that are below 100 percent."""
    last = quality.latest(table(spark, d, "completeness"), ["condition", "year"], "ts", "entry_id").where("total_found > 0 and total_retrieved < total_found")
    held = last.join(_catalog(spark, d).selectExpr("name AS condition", "folder"), "condition")
    pct = F.round(F.col("total_retrieved") * 100.0 / F.col("total_found"), 1)
    line = F.format_string("%s: %,d / %,d (%.1f%%)", "year", "total_retrieved", "total_found", pct)
    return held.select("folder", "condition", "year", (F.col("total_found") - F.col("total_retrieved")).alias("lacking"), line.alias("line"))


@query(f"WITH {_CS}, {_GRID}, gaps AS (SELECT count(*) AS n FROM g WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.condition = g.condition AND c.file_year = g.file_year)) SELECT 'scores' AS section, name, value FROM (SELECT count(*)::DOUBLE AS conditions, sum(total_papers)::DOUBLE AS papers, sum(unique_pmids)::DOUBLE AS summed_pmids, sum(papers_with_abstracts)::DOUBLE AS with_abstracts, sum(papers_with_mesh)::DOUBLE AS with_terms, round(avg(quality_score), 6) AS mean_score, round(median(quality_score), 6) AS median_score, (count(*) FILTER (WHERE quality_score < 60))::DOUBLE AS to_fetch_again FROM cs) UNPIVOT (value FOR name IN (conditions, papers, summed_pmids, with_abstracts, with_terms, mean_score, median_score, to_fetch_again)) UNION ALL SELECT 'gaps', 'missing_years', n::DOUBLE FROM gaps")
def validation_summary(spark: SparkSession, d: str) -> DataFrame:
    """The numbers of the validation report and its summary file: (section, name, value)."""
    scores = _stats(spark, d).agg(
        F.count(F.lit(1)).alias("conditions"), F.sum("total_papers").alias("papers"), F.sum("unique_pmids").alias("summed_pmids"), F.sum("papers_with_abstracts").alias("with_abstracts"), F.sum("papers_with_mesh").alias("with_terms"),
        F.round(F.avg("quality_score"), 6).alias("mean_score"), F.round(F.median("quality_score"), 6).alias("median_score"), F.count_if(F.col("quality_score") < 60).alias("to_fetch_again"),
    )
    gaps = quality.missing_years(_catalog(spark, d), _papers(spark, d)).agg(F.count(F.lit(1)).alias("missing_years"))

    def long(section: str, row: DataFrame) -> DataFrame:
        values = [F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in row.columns]
        return row.select(F.lit(section).alias("section"), F.inline(F.array(*values)))

    return long("scores", scores).unionByName(long("gaps", gaps))


@query(f"WITH {_TERMS}, s AS (SELECT name, ord FROM condition_catalog ORDER BY md5(name || '42'), name LIMIT 30), a AS (SELECT condition, count(packed) * 100.0 / count(*) AS coverage FROM tp GROUP BY ALL), b AS (SELECT condition, count(DISTINCT term) AS distinct_terms FROM tr GROUP BY ALL) SELECT name, ord, round(coverage, 6) AS coverage, coalesce(distinct_terms, 0) AS distinct_terms FROM s LEFT JOIN a ON a.condition = name LEFT JOIN b ON b.condition = name")
def condition_sample(spark: SparkSession, d: str) -> DataFrame:
    """A seeded sample of 30 conditions (the sampling operator itself) with the term coverage of their papers."""
    sample = _catalog(spark, d).orderBy(F.md5(F.concat("name", F.lit("42"))), "name").limit(30).select("name", "ord")
    papers = _papers(spark, d).join(sample.select(F.col("name").alias("condition")), "condition", "left_semi")
    stats = terms.condition_terms(papers).select(F.col("condition").alias("name"), F.round("coverage", 6).alias("coverage"), "distinct_terms")
    return sample.join(stats, "name", "left").select("name", "ord", "coverage", F.coalesce("distinct_terms", F.lit(0)).cast("long").alias("distinct_terms"))


@query("WITH f AS (SELECT folder, count(DISTINCT file_year) AS files, count(DISTINCT CASE WHEN file_year BETWEEN 1975 AND 2024 THEN file_year END) / 50.0 * 100 AS coverage FROM papers GROUP BY ALL) SELECT count(*) AS folders, sum(files)::BIGINT AS files, round(avg(coverage), 6) AS mean_coverage FROM f")
def inventory_totals(spark: SparkSession, d: str) -> DataFrame:
    """Folders, files and mean year coverage of the whole corpus."""
    return corpus_inventory(spark, d).agg(F.count(F.lit(1)).alias("folders"), F.sum("files").alias("files"), F.round(F.avg("year_coverage"), 6).alias("mean_coverage"))


@query(f"WITH {_YS}, {_FILLED} SELECT file_year, {', '.join(f'''sum(papers) FILTER (WHERE file_year // 10 = {y // 10} AND papers > 0)::BIGINT AS d{y}''' for y in range(1970, 2030, 10))} FROM filled GROUP BY ALL")
def decade_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Papers of each year pivoted by decade, with the decades given."""
    grid = _filled(spark, d).where("papers > 0").withColumn("decade", F.concat(F.lit("d"), (F.floor(F.col("file_year") / 10) * 10).cast("string")))
    pivot = grid.groupBy("file_year").pivot("decade", [f"d{y}" for y in range(1970, 2030, 10)]).agg(F.sum("papers"))
    return quality.year_grid(_catalog(spark, d)).select("file_year").distinct().join(pivot, "file_year", "left")
