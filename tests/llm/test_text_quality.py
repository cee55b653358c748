import numpy as np

import pytest

from quillspark.llm.text_quality import text_quality

COMMON = "the of and to in a is was for with that on we by this it".split()
KINDS = {
    "The outcome was measured in a small group of people, and it is clear that the treatment was of use to them.": "prose",
    "We asked for a short\nanswer that fits in the\nspace of a line, and this\nis what was given to us.": "prose",
    "- first thing\n- second thing\n- third thing": "list",
    "aspirin 5 mg, ibuprofen 10 mg, paracetamol 20 mg, codeine 3 mg, morphine 4 mg": "list",
    "Contents\nalpha ...... 3\nbeta ...... 17\ngamma ...... 99": "list",
    "Group\tAge\tDose\nplacebo\t12.5\t33%\ndrug\t9 ± 2\t41\nboth\tns\t7": "table",
    "| a | 1 | 2 |\n|---|---|---|\n| b | 3.5 | n/a |": "table",
    "": "junk", None: "junk", "  \n ": "junk", "---": "junk", "!!!!!": "junk",
    "Home | Login | Share | Home | Print | Login | Home | Menu": "junk",
    "page not found\npage not found\npage not found\npage not found": "junk",
    "a group: 12.5 / 33%\nb group: ns / 4 ± 2\nc group: 7 / n/a": "table",
    "Q" * 200: "junk",
    "<div><span id=a1></span></div><div><span id=a2></span></div>": "junk",
    "xkq zzrt vprl qqwx bnmk lkjh trwq pzxc vbnq wrtk": "junk",
    "T h e _ b u r d e n _ o f _ i t _ a l l": "junk",
    "00000000  a4 9a ed c3 e1 82 f9 56\n00000010  72 c7 a3 74 2d 55 e5 01": "junk",
}


def common(spark, listed):
    return spark.createDataFrame([(w,) for w in listed], "word string")


@pytest.mark.parametrize("shipped", [1000, 2])
def test_quality_kinds(spark, shipped):
    df = spark.createDataFrame([(i, t, "x", 1.0) for i, t in enumerate(KINDS)] + [(0, next(iter(KINDS)), "x", 1.0)], "id long, text string, kind string, n_words double")
    got = text_quality(df, "id", "text", common(spark, [*COMMON, None, "The"]), max_shipped=shipped).toPandas()
    assert len(got) == len(KINDS) + 1 and not got.isna().any().any()
    found = {r.id: r.kind for r in got.itertuples()}
    assert {t: found[i] for i, t in enumerate(KINDS)} == KINDS
    assert ((got.kind == "prose") == (got.reasons.str.len() == 0)).all()
    first = got[got.id == 0].iloc[0]
    words = next(iter(KINDS)).split()
    assert first.n_words == len(words) and abs(first.mean_word_len - np.mean([len(w) for w in words])) < 1e-9
    assert first.end_punct_share == 1.0 and first.n_chars == len(next(iter(KINDS)))


def test_quality_of_long_and_no_texts(spark):
    long = "We asked for the answer and it was given to us in time. " * 20_000
    df = spark.createDataFrame([(1, long), (2, "x" * 1_000_000)], "id long, text string")
    assert {r.id: r.kind for r in text_quality(df, "id", "text", common(spark, COMMON)).collect()} == {1: "prose", 2: "junk"}
    assert text_quality(df.limit(0), "id", "text", common(spark, COMMON)).count() == 0
    assert text_quality(df, "id", "text", common(spark, [])).count() == 2


@pytest.mark.parametrize("text", ["a: " + "1," * 50_000 + "x", "a: " + "1  " * 30_000 + "x", "<" * 100_000, "(1) " * 25_000, ". " * 50_000, "2001; 1" * 15_000, "n/a / " * 20_000, "\t" * 100_000 + "1"])
def test_long_lines_take_linear_time(text):
    import time

    import pyarrow as pa

    from quillspark.llm.text_quality import _measure, character_classes

    classes, began = character_classes(), time.process_time()
    _measure(pa.array([text]), lambda tokens, _: np.zeros(len(tokens), bool), classes)
    assert time.process_time() - began < 2


def test_published_rules_are_recorded(spark):
    df = spark.createDataFrame([(1, "Short text of the kind."), (2, "- a\n- b\n- c..."), (3, "We asked for the answer and it was given to us in time. " * 10)], "id long, text string")
    failed = {r.id: set(r.published) for r in text_quality(df, "id", "text", common(spark, COMMON)).collect()}
    assert failed[1] == {"gopher_word_count", "fineweb_short_lines"} and not failed[3]
    assert {"gopher_bullets", "gopher_ellipsis", "gopher_symbols", "gopher_alphabetic_words", "fineweb_line_punctuation"} - failed[2] == {"fineweb_line_punctuation"}
