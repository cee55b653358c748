"""How often every distinct term occurs, and in how many records.

Tokens are hash-partitioned and ordered by record. One pass over a partition keeps three
numbers per term: occurrences, records, and the last record seen. A token adds to the
records only if its record differs from the term's last one, so no set of records is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillspark.session import materialise, shuffle_buckets

#: Records that are looked at for hot terms.
HOT_SAMPLE = 20_000


class LastSeenCounters:
    """Occurrences, records and last record of each term; records must arrive in order."""

    def __init__(self):
        self.codes: dict[str | None, int] = {}
        self.occurrences = np.zeros(1024, np.int64)
        self.records = np.zeros(1024, np.int64)
        self.last = np.zeros(1024, np.int64)

    def add(self, terms: pa.Array, records: np.ndarray) -> None:
        encoded = terms.dictionary_encode(null_encoding="encode")
        known = np.array([self.codes.setdefault(t, len(self.codes)) for t in encoded.dictionary.to_pylist()], np.int64)
        if not len(known):
            return
        if len(self.codes) > len(self.last):
            grow = max(len(self.codes), 2 * len(self.last)) - len(self.last)
            self.occurrences, self.records, self.last = (np.concatenate([x, np.zeros(grow, np.int64)]) for x in (self.occurrences, self.records, self.last))
        codes = known[encoded.indices.to_numpy(zero_copy_only=False)]
        order = np.argsort(codes, kind="stable")  # by term, the records stay in order
        codes, records = codes[order], records[order]
        first = np.r_[True, codes[1:] != codes[:-1]]
        heads = codes[first]
        new = np.r_[True, records[1:] != records[:-1]] | first
        new[first] = (self.records[heads] == 0) | (self.last[heads] != records[first])
        np.add.at(self.occurrences, codes, 1)
        np.add.at(self.records, codes[new], 1)
        self.last[heads] = records[np.r_[np.flatnonzero(first)[1:], len(codes)] - 1]

    def rows(self) -> pa.RecordBatch:
        n = len(self.codes)
        return pa.RecordBatch.from_arrays([pa.array(self.codes, pa.string()), pa.array(self.occurrences[:n]), pa.array(self.records[:n])], ["term", "occurrences", "records"])


def count_terms(df: DataFrame, record_col: str, terms_col: str, buckets: int | None = None) -> DataFrame:
    """One row (term, occurrences, records) per distinct term of an array column.

    A term named several times in a record adds to `occurrences` each time and to `records`
    once, also where the record's rows are repeated or spread. Null terms and rows without
    a record id are not counted; empty arrays add nothing; an empty table gives no rows.
    The row of the null term counts the records that hold at least one term.

    A term's tokens meet in one task, so that a task's counters are those of its own terms. Only
    the tokens of hot terms, which a sample of records tells, are spread by their record; the
    counters of their shares add up.
    """
    shares = buckets or shuffle_buckets(df.sparkSession)
    named = df.where(F.col(record_col).isNotNull()).select(F.xxhash64(record_col).alias("record"), F.filter(terms_col, lambda t: t.isNotNull()).alias("terms")).where(F.size("terms") > 0)
    named = materialise(named)  # the sample and the count read it
    part = F.pmod(F.xxhash64("record", F.lit("hot")), F.lit(max(1, named.count() // HOT_SAMPLE))) == 0
    sample = named.where(part).select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    sample = sample.select("term", "n", (F.col("n") * shares > F.sum("n").over(W.partitionBy())).alias("hot"))
    hot = [r.term for r in sample.where("hot").collect()]  # fewer than there are shares
    tokens = named.select("record", F.explode(F.array_append("terms", F.lit(None))).alias("term"))
    share = F.when(F.col("term").isNull() | F.col("term").isin(hot), F.pmod("record", F.lit(shares))).otherwise(0)
    ordered = tokens.repartition(shares, "term", share).sortWithinPartitions("record")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = LastSeenCounters()
        for batch in batches:
            counters.add(batch.column(1), batch.column(0).to_numpy())
        yield counters.rows()

    partial = ordered.mapInArrow(count, "term string, occurrences long, records long")
    return partial.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def term_frequencies(df: DataFrame, record_col: str, terms_col: str, min_records: int = 3, max_share: float = 0.2, buckets: int | None = None) -> DataFrame:
    """Terms with their counts and a mark: (term, occurrences, records, total_records, mark).

    `mark` is `rare` if fewer than `min_records` records hold the term, `common` if more
    than `max_share` of all records with a term do, else null; `rare` wins if both hold.
    """
    counts = materialise(count_terms(df, record_col, terms_col, buckets))
    total = sum(r.records for r in counts.where("term is null").collect())  # one row
    mark = F.when(F.col("records") < min_records, "rare").when(F.col("records") > total * max_share, "common")
    return counts.where("term is not null").select("term", "occurrences", "records", F.lit(total).alias("total_records"), mark.alias("mark"))
