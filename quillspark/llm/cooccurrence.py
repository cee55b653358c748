"""How often two items occur in the same record, and how much more often than by chance.

Each basket's items are made distinct and ordered, its ordered pairs are emitted and counted
map-side before the one shuffle. Single items and the baskets themselves are counted in the
same pass, so the marginals need no second reading.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import materialise

#: Baskets with more items are cut into blocks; the pairs of any two blocks are made apart.
BLOCK = 128


def _pairs(baskets: DataFrame) -> DataFrame:
    """(a, b, n): counted pairs, with (a, null) for items and (null, null) for baskets."""
    small = baskets.where(F.size("items") <= BLOCK)
    heads = small.select(F.posexplode(F.array_insert("items", 1, F.lit(None))).alias("at", "a"), "items")
    near = heads.select("a", F.explode(F.when(F.col("at") == 0, F.array(F.lit(None).cast("string"))).otherwise(F.array_insert(F.slice("items", F.col("at") + 1, F.greatest(F.size("items") - F.col("at"), F.lit(0))), 1, F.lit(None)))).alias("b"))
    return near


def _block_pairs(baskets: DataFrame, spread: int) -> DataFrame:
    """The same for baskets of any size: every two blocks of a basket meet in a row of their own.

    Only the numbers of the blocks are paired in the basket's own task; they are spread before
    the blocks join them.
    """
    starts = F.sequence(F.lit(1), F.size("items"), F.lit(BLOCK))
    large = baskets.where(F.size("items") > BLOCK).select(F.monotonically_increasing_id().alias("basket"), F.transform(starts, lambda s: F.slice("items", s, BLOCK)).alias("blocks"))
    numbers = large.select("basket", F.explode(F.sequence(F.lit(0), F.size("blocks") - 1)).alias("i"), (F.size("blocks") - 1).alias("last"))
    numbers = numbers.select("basket", "i", F.explode(F.sequence("i", "last")).alias("j")).repartition(spread, "basket", "i", "j")
    left = large.select("basket", F.posexplode("blocks").alias("i", "left"))
    right = large.select("basket", F.posexplode("blocks").alias("j", "right"))
    both = numbers.join(left, ["basket", "i"]).join(right, ["basket", "j"])
    within = both.where("i = j").select(F.posexplode("left").alias("at", "a"), "left")
    within = within.select("a", F.explode(F.array_insert(F.slice("left", F.col("at") + 2, BLOCK), 1, F.lit(None))).alias("b"))
    across = both.where("i < j").select(F.explode("left").alias("a"), "right").select("a", F.explode("right").alias("b"))
    return within.unionByName(across).unionByName(large.select(F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b")))


def cooccurrence(df: DataFrame, items_col: str, min_together: int = 1) -> DataFrame:
    """Pairs of items found together: (item_a, item_b, together, count_a, count_b, total, lift, pmi).

    item_a < item_b by code point. `together`, `count_a` and `count_b` are numbers of rows of
    `df` that hold both, the first and the second; `total` is the number of rows with at least
    one item; lift = together * total / (count_a * count_b) and pmi is its logarithm to base 2.
    An item named twice in a row counts once; null items are ignored; repeated rows count
    again; rows with null or empty arrays count nowhere; an empty table gives no rows.

    Only pairs in at least `min_together` rows are kept. No basket is cut short: large ones are
    handled block by block.
    """
    distinct = df.select(F.sort_array(F.array_distinct(F.filter(items_col, lambda t: t.isNotNull()))).alias("items")).where(F.size("items") > 0)
    distinct = materialise(distinct)  # both ways read it
    emitted = _pairs(distinct).unionByName(_block_pairs(distinct, df.sparkSession.sparkContext.defaultParallelism))
    counts = materialise(emitted.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= min_together) | F.col("a").isNull()))
    items = counts.where("a is not null and b is null")
    total = sum(r.n for r in counts.where("a is null").collect())  # one row
    together = counts.where("b is not null").selectExpr("a AS item_a", "b AS item_b", "n AS together")
    marked = together.join(items.selectExpr("a AS item_a", "n AS count_a"), "item_a").join(items.selectExpr("a AS item_b", "n AS count_b"), "item_b")
    return with_lift(marked.withColumn("total", F.lit(total)))


def with_lift(pairs: DataFrame) -> DataFrame:
    """Add lift and PMI, in floating point, so that no product of counts overflows."""
    lift = F.col("together").cast("double") / F.col("count_a") * F.col("total") / F.col("count_b")
    return pairs.select("item_a", "item_b", "together", "count_a", "count_b", "total", lift.alias("lift"), F.log2(lift).alias("pmi"))


def at_least(pairs: DataFrame, share: int, times: int) -> DataFrame:
    """Pairs in at least one of `share` rows and at least `times` as often as by chance, in exact numbers of any size."""

    def exact(*factors) -> F.Column:
        product = F.col(factors[0]).cast("decimal(19,0)")
        for factor in factors[1:]:
            product = product * (F.lit(factor) if isinstance(factor, int) else F.col(factor)).cast("decimal(19,0)")
        return product

    return pairs.where((exact("together", share) >= F.col("total")) & (exact("together", "total") >= exact("count_a", "count_b") * F.lit(times)))
