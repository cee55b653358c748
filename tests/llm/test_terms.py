from collections import Counter
from itertools import combinations

import pytest

from quillspark.llm import cooccurrence, queries
from quillspark.llm.cooccurrence import cooccurrence as together
from quillspark.llm.term_frequency import term_frequencies

SCHEMA = "record long, terms array<string>, term string, total long"


def frame(spark, rows):
    return spark.createDataFrame([(r, t, "x", 1) for r, t in rows], SCHEMA)


ROWS = [(i, ["hot", f"t{i % 7}", f"u{i % 50}", f"u{i % 50}"]) for i in range(200)] + [(5, ["hot", "again"]), (300, None), (301, []), (302, [None, "x"]), (None, ["lost"]), (303, ["", "x"])]


@pytest.mark.parametrize("buckets", [1, 3, 16])
def test_frequencies(spark, buckets):
    got = {r.term: r for r in term_frequencies(frame(spark, ROWS).repartition(5), "record", "terms", 3, 0.5, buckets).collect()}
    kept = [(r, [t for t in ts or [] if t is not None]) for r, ts in ROWS if r is not None]
    occurrences = Counter(t for _, ts in kept for t in ts)
    records = Counter(t for t, _ in {(t, r) for r, ts in kept for t in ts})
    total = len({r for r, ts in kept if ts})
    assert {t: (r.occurrences, r.records, r.total_records) for t, r in got.items()} == {t: (n, records[t], total) for t, n in occurrences.items()}
    assert {t: r.mark for t, r in got.items()} == {t: "rare" if n < 3 else "common" if n > total / 2 else None for t, n in records.items()}


def test_no_terms(spark):
    assert term_frequencies(frame(spark, []), "record", "terms").count() == 0
    assert together(frame(spark, []), "terms").count() == 0


@pytest.mark.parametrize("block", [128, 2])
def test_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(cooccurrence, "BLOCK", block)
    got = {(r.item_a, r.item_b): r for r in together(frame(spark, ROWS), "terms", 2).collect()}
    baskets = [sorted({t for t in ts or [] if t is not None}) for _, ts in ROWS]
    baskets = [b for b in baskets if b]
    single, pairs = Counter(t for b in baskets for t in b), Counter(p for b in baskets for p in combinations(b, 2))
    assert {p: (r.together, r.count_a, r.count_b, r.total) for p, r in got.items()} == {p: (n, single[p[0]], single[p[1]], len(baskets)) for p, n in pairs.items() if n >= 2}
    r = got["hot", "t1"]
    assert abs(r.lift - r.together * r.total / (r.count_a * r.count_b)) < 1e-12 and abs(2**r.pmi - r.lift) < 1e-9


def test_counts_beyond_the_range_of_their_products(spark):
    rows = [("a", "b", 9_000_000_000, 10_000_000_000, 10_000_000_000, 40_000_000_000), ("a", "c", 9_999_999_999, 10_000_000_000, 10_000_000_000, 40_000_000_000), ("a", "d", 10_000_000_000, 10_000_000_000, 10_000_000_000, 40_000_000_000)]
    pairs = spark.createDataFrame(rows, "item_a string, item_b string, together long, count_a long, count_b long, total long")
    got = {r.item_b: r.lift for r in cooccurrence.with_lift(pairs).collect()}
    assert abs(got["b"] - 3.6) < 1e-12 and abs(got["d"] - 4) < 1e-12
    assert [r.item_b for r in cooccurrence.at_least(pairs, 2000, 4).collect()] == ["d"]


def test_hot_and_odd_terms(spark):
    rows = [(i, ["hot"] * 3 + ["\0record", f"r{i}"]) for i in range(300)]
    got = {r.term: (r.occurrences, r.records, r.mark) for r in term_frequencies(frame(spark, rows), "record", "terms", 3, 0.5, 4).collect()}
    assert got["hot"] == (900, 300, "common") and got["\0record"] == (300, 300, "common") and got["r7"] == (1, 1, "rare") and len(got) == 302


def test_a_large_basket(spark):
    many = [f"i{n:04}" for n in range(500)]
    assert together(frame(spark, [(1, many), (2, many[:3])]), "terms").count() == 500 * 499 // 2
    two = together(frame(spark, [(1, many), (2, many[:300]), (3, many)]), "terms").groupBy("together").count().collect()
    assert {r.together: r["count"] for r in two} == {3: 300 * 299 // 2, 2: 500 * 499 // 2 - 300 * 299 // 2}


def test_the_registered_pairs_are_all_pairs(spark, sf):
    baskets = [sorted({t for t in r.terms or [] if t is not None}) for r in queries._terms(spark, sf).collect()]
    pairs = Counter(p for b in baskets for p in combinations(b, 2))
    assert min(pairs.values()) == 1
    assert {(r.item_a, r.item_b): r.together for r in queries.p4_together(spark, sf).collect()} == dict(pairs)
    single, total = Counter(t for b in baskets for t in b), sum(map(bool, baskets))
    found = {p for p, n in pairs.items() if n >= 5 and 2000 * n >= total and n * total >= 4 * single[p[0]] * single[p[1]]}
    assert {(r.term_a, r.term_b) for r in queries.p4_found(spark, sf).collect()} == found
