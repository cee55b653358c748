"""Texts for the encoder, mean vectors, cosine similarity and drift."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspark.session import materialise

#: Code points of an abstract that the reference keeps.
REFERENCE_ABSTRACT = 2000


def paper_text(title: str = "title", abstract: str = "abstract", terms: str = "mesh_terms", abstract_limit: int | None = None) -> Column:
    """[TITLE] t [ABSTRACT] a [MESH] terms; absent parts are left out.

    The abstract is whole, unless `abstract_limit` asks for its first code points only.
    """

    def part(mark: str, value: Column) -> Column:
        return F.concat(F.lit(mark), value)

    def present(name: str) -> Column:
        return F.nullif(F.col(name), F.lit(""))

    body = present(abstract) if abstract_limit is None else F.substring(present(abstract), 1, abstract_limit)
    return F.concat_ws(" ", part("[TITLE] ", present(title)), part("[ABSTRACT] ", body), part("[MESH] ", F.replace(present(terms), F.lit(";"), F.lit(", "))))


class HashingModel:
    """An offline stand-in for a language model: every word has a fixed random token vector.

    A model gives `tokens`, the token ids of a text, and `states`, the vectors of a padded batch
    of ids; what a real model computes from its weights, this one draws from the word's hash.
    """

    def __init__(self, width: int = 768):
        self.width = width

    def tokens(self, text: str) -> list[int]:
        return [1 + zlib.crc32(word.encode()) for word in text.lower().split()]

    def states(self, ids: np.ndarray) -> np.ndarray:
        words, at = np.unique(ids, return_inverse=True)
        mixed = (words.astype(np.uint64)[:, None] << np.uint64(32)) + np.arange(self.width, dtype=np.uint64)
        for _ in range(2):
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return np.where(mixed >> np.uint64(63), 1, -1).astype(np.float32)[at].reshape(*ids.shape, self.width)


def masked_mean(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The mean of each text's token vectors, padding left out; zeros for a text without tokens."""
    return (states * mask[:, :, None]).sum(1) / np.maximum(mask.sum(1, keepdims=True), 1)


def encoder(model, max_tokens: int | None = None, batch: int = 32, step: int = 512) -> Callable[[list[str]], np.ndarray]:
    """Texts to vectors: padded batches, the mean over each text's own tokens.

    `max_tokens` keeps the first tokens of a text, as a model with a fixed window does; else
    all of them count, window by window of `step` tokens.
    """

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), model.width), np.float32)
        ids = [model.tokens(text)[:max_tokens] for text in texts]
        order = sorted(range(len(ids)), key=lambda i: len(ids[i]))  # so that little is padded
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            longest = max(1, *(len(ids[i]) for i in own))
            total, n = np.zeros((len(own), model.width)), np.array([[max(1, len(ids[i]))] for i in own])
            for begin in range(0, longest, step):
                parts = [ids[i][begin : begin + step] for i in own]
                wide = max(1, *map(len, parts))
                mask = np.array([[1] * len(p) + [0] * (wide - len(p)) for p in parts])
                padded = np.array([p + [0] * (wide - len(p)) for p in parts])
                total += masked_mean(model.states(padded), mask) * mask.sum(1, keepdims=True)
            out[own] = total / n
        return out

    return encode


def hashing_encoder(width: int = 768, max_tokens: int | None = None) -> Callable[[list[str]], np.ndarray]:
    return encoder(HashingModel(width), max_tokens)


def encode_texts(df: DataFrame, text_col: str, make_encoder: Callable[[], Callable] = hashing_encoder, into: str = "vec") -> DataFrame:
    """Add a vector per text; the encoder is made once per Python worker, empty texts give null."""

    @F.arrow_udf("array<float>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = make_encoder()
        for batch in batches:
            texts = batch.to_pylist()
            vectors = iter(encoder([t for t in texts if t]))
            yield pa.array([next(vectors).tolist() if t else None for t in texts], pa.list_(pa.float32()))

    return df.withColumn(into, encode.asNondeterministic()(F.col(text_col)))


def mean_vector(df: DataFrame, keys: list[str], vector: str, width: int) -> DataFrame:
    """The mean of each key's usable vectors, summed up map-side in one aggregate of any width."""
    good = df.where((F.size(vector) == width) & ~F.exists(vector, lambda x: F.isnan(x) | x.isNull()))
    dense = good.select(*keys, array_to_vector(F.col(vector).cast("array<double>")).alias("_vec"))
    return dense.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), Summarizer.mean(F.col("_vec")).alias("_mean")).select(*keys, "n", vector_to_array("_mean").alias("vec"))


def write_centroids(df: DataFrame, key: str, year: str, vector: str, width: int, root: str) -> None:
    """The tables centroid_year (key, year, vec, n) and centroid (key, vec, n, years) under a folder.

    The overall mean is weighted by vectors, from the yearly means that are already written.
    """
    mean_vector(df.where(F.col(year).isNotNull()), [key, year], vector, width).write.mode("overwrite").parquet(f"{root}/centroid_year")
    yearly = df.sparkSession.read.parquet(f"{root}/centroid_year").select(key, year, "n", array_to_vector("vec").alias("_vec"))
    total = yearly.groupBy(key).agg(F.sum("n").alias("n"), Summarizer.mean(F.col("_vec"), F.col("n").cast("double")).alias("_mean"), F.sort_array(F.collect_set(year)).alias("years"))
    total.select(key, "n", vector_to_array("_mean").alias("vec"), "years").write.mode("overwrite").parquet(f"{root}/centroid")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null if a vector has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def similarity(centroids: DataFrame, key: str, tile_rows: int = 512) -> DataFrame:
    """Cosine of every two centroids, a <= b; null if one has no length.

    The centroids are dealt to tiles of about `tile_rows`; every two tiles meet in a task of
    their own, which multiplies them. Any number of centroids is compared in full.
    """
    held = materialise(centroids.select(F.col(key).alias("key"), "vec"))
    tiles = max(1, -(-held.count() // tile_rows))
    dealt = held.withColumn("tile", F.pmod(F.xxhash64("key"), F.lit(tiles)).cast("int"))
    left = dealt.select("key", "vec", F.col("tile").alias("i"), F.explode(F.sequence(F.col("tile"), F.lit(tiles - 1))).alias("j"))
    right = dealt.select(F.col("key").alias("other"), F.col("vec").alias("other_vec"), F.explode(F.sequence(F.lit(0), F.col("tile"))).alias("i"), F.col("tile").alias("j"))

    def product(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"a": pa.array([], pa.string()), "b": pa.array([], pa.string()), "cos": pa.array([], pa.float64())})
        names_a, names_b = (np.array(names.to_pylist(), object) for names in (a["key"], b["other"]))
        x, y = (np.array(vecs.to_pylist(), float) for vecs in (a["vec"], b["other_vec"]))
        lengths = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)
        cos = np.divide(x @ y.T, lengths, out=np.full(lengths.shape, np.nan), where=lengths > 0)
        one, other = np.nonzero(np.ones(cos.shape, bool) if a["i"][0] != a["j"][0] else names_a[:, None] <= names_b[None, :])
        swap = names_a[one] > names_b[other]
        low, high = np.where(swap, names_b[other], names_a[one]), np.where(swap, names_a[one], names_b[other])
        return pa.table({"a": pa.array(low, pa.string()), "b": pa.array(high, pa.string()), "cos": pa.array(cos[one, other], pa.float64(), from_pandas=True)})

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(product, "a string, b string, cos double")


def similarity_matrix(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The square matrix of a similarity's pairs, one row and one column per key."""
    both = pairs.unionByName(pairs.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "cos"))
    return both.groupBy("a").pivot("b", keys).agg(F.first("cos"))


def drift(centroids: DataFrame, key: str, year: str) -> DataFrame:
    """Distance to the previous available year, for keys with more than five years."""
    order = W.partitionBy(key).orderBy(year)
    moved = centroids.withColumn("before", F.lag("vec").over(order)).withColumn("year_gap", F.col(year) - F.lag(year).over(order)).withColumn("years", F.count(F.lit(1)).over(W.partitionBy(key)))
    return moved.where("years > 5 and before is not null").select(key, year, "year_gap", distance(F.col("vec"), F.col("before")).alias("drift"))
