"""Queries of the numbered problems, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import cooccurrence as co
from quillspark.llm import close_pairs, leakage, neighbours, packing, splitting, text_quality
from quillspark.llm import term_frequency as tf
from quillspark.llm.sql_twins import SQL  # noqa: F401
from quillspark.operators.packed_values import parse_field
from quillspark.operators.terms import simple_terms
from quillspark.session import table


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, terms): the descriptors of each paper, in lower case."""
    papers = table(spark, sf_dir, "papers").select("record_id", "mesh_terms")
    parsed = parse_field(papers, "mesh_terms", table(spark, sf_dir, "mesh_descriptors"))
    return parsed.select("record_id", F.transform("values.value", F.lower).alias("terms"))


def p1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most similar embeddings of every usable embedding."""
    return neighbours.most_similar(table(spark, sf_dir, "condition_embeddings"), "vec_id", "aggregate_embedding", 128)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with a similarity of 0.8 or more, each among the ten most similar of the other."""
    embeddings = table(spark, sf_dir, "condition_embeddings")
    return close_pairs.mutual_close_pairs(embeddings, "vec_id", "aggregate_embedding", 128, 0.8).selectExpr("a AS vec_a", "b AS vec_b")


def p2_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every descriptor with its occurrences, records and mark."""
    return tf.term_frequencies(_terms(spark, sf_dir), "record_id", "terms")


def _simple_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers = table(spark, sf_dir, "papers")
    return papers.select("record_id", F.transform(simple_terms("mesh_terms"), F.lower).alias("terms"))


def p2_semicolon_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counters over fields cut at semicolons only, which SQL can cut as well."""
    return tf.term_frequencies(_simple_terms(spark, sf_dir), "record_id", "terms")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The descriptors that are too rare or too common."""
    return p2_frequencies(spark, sf_dir).where("mark is not null").select("term", "mark")


def p4_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every two descriptors named together, with lift and PMI."""
    return co.cooccurrence(_terms(spark, sf_dir), "terms")


def p4_semicolon_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs over fields cut at semicolons only, which SQL can cut as well."""
    pairs = co.cooccurrence(_simple_terms(spark, sf_dir), "terms")
    return pairs.withColumn("lift", F.round("lift", 6)).withColumn("pmi", F.round("pmi", 6))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs in at least 5 papers and one of 2000, at least four times as often as by chance."""
    pairs = co.cooccurrence(_terms(spark, sf_dir), "terms", min_together=5)
    return co.at_least(pairs, 2000, 4).selectExpr("item_a AS term_a", "item_b AS term_b")


#: Field, limit and overlap, in code points.
_LIMITS = [("abstract", 2000, 200), ("title", 250, 25)]


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every oversized abstract and title."""
    papers = table(spark, sf_dir, "papers")
    cut = [splitting.split_texts(papers, "record_id", field, limit, overlap).withColumn("field", F.lit(field)) for field, limit, overlap in _LIMITS]
    return cut[0].unionByName(cut[1]).withColumnRenamed("id", "record_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oversized fields and the worst boundary at which they had to be cut."""
    return splitting.cut_kinds(p3_pieces(spark, sf_dir), "record_id", "field")


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and the model input of 512 tokens that each goes to."""
    return packing.pack_texts(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the items that leaked into them, longest runs and coverage."""
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_leaks(spark, sf_dir).select("doc_id", "item_id")


def p7_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without their leaked spans."""
    return leakage.remove_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics, failed rules and kind of every document."""
    judged = text_quality.text_quality(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "common_words"))
    return judged.withColumnRenamed("id", "doc_id")


def p8_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics that SQL can make as well, and the published rules on them."""
    shares = ("mean_word_len", "end_punct_share", "common_share")
    rules = F.filter("published", lambda r: r.isin("gopher_word_count", "gopher_mean_word_length", "gopher_stop_words", "fineweb_line_punctuation"))
    return p8_quality(spark, sf_dir).select("doc_id", "n_chars", "n_words", "n_lines", *[F.round(c, 6).alias(c) for c in shares], rules.alias("failed"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are not natural prose."""
    return p8_quality(spark, sf_dir).where("kind <> 'prose'").select("doc_id", "kind")


QUERIES = {
    f.__name__: f
    for f in (p1_neighbours, p1_found, p2_frequencies, p2_semicolon_terms, p2_found, p3_pieces, p3_found, p4_together, p4_semicolon_pairs, p4_found, p6_packed, p7_leaks, p7_found, p7_cleaned, p8_quality, p8_statistics, p8_found)
}

