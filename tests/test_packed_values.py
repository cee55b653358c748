import time

import pytest
from pyspark.sql import functions as F

from quillspark.operators.packed_values import Parser, split_values

ENTRIES = ["Adults, Middle Years", "Deficiency, Prentor", "Deficiency, Prentor, Regional", '"Sham" Procedures', "Codes; Billing | Coding", "Patients' \"Good Day\" Reports", "Plain Term"]
PARSER = Parser(ENTRIES)

CASES = {
    None: [], "": [], " \t\n ": [], "N/A": [], "nan": [], "; ;": [], "-": [], "[]": [],
    "A b; C d ;E f;": ["A b", "C d", "E f"],
    "A|B\nC\tD\r\nE； F • G<br/>H<BR>I": list("ABCDEFGHI"),
    "adults,   MIDDLE years, X": ["adults, MIDDLE years", "X"],
    "Adults, Middle Years\nX": ["Adults, Middle Years", "X"],
    "X,Deficiency, Prentor, Regional,Y": ["X", "Deficiency, Prentor, Regional", "Y"],
    "X, Deficiency, Prentor, Y": ["X", "Deficiency, Prentor", "Y"],
    '"Sham" Procedures; "A"': ['"Sham" Procedures', "A"],
    '"""Sham"" Procedures", "A"': ['"Sham" Procedures', "A"],
    '["\\"Sham\\" Procedures", "Fenwor\\u00e9 X"]': ['"Sham" Procedures', "Fenworé X"],
    "['A b', \"Plinth's Units\", 'it\\'s']": ["A b", "Plinth's Units", "it's"],
    '"Codes; Billing | Coding" | A': ["Codes; Billing | Coding", "A"],
    "Codes; Billing | Coding | A": ["Codes; Billing | Coding", "A"],
    "Patients' \"Good Day\" Reports; A": ["Patients' \"Good Day\" Reports", "A"],
    '"A; B; C"': ["A", "B", "C"],
    '"A; B': ["A", "B"],
    "A (Acute); B/therapy": ["A (Acute)", "B/therapy"],
    "• A\n• Adults, Middle Years\n1. B\n- C": ["A", "Adults, Middle Years", "B", "C"],
    "[A; B": ["A", "B"],
    "A; A; A": ["A", "A", "A"],
}


@pytest.mark.parametrize("text", CASES)
def test_grammar(text):
    assert [v for v, _ in PARSER.parse(text)] == CASES[text]


def test_malformed_values_are_flagged():
    assert PARSER.parse('"A; B')[0] == ("A", "quote")
    assert PARSER.parse("[A; B")[0] == ("A", "bracket")
    assert PARSER.parse("A; B")[0] == ("A", None)


MALFORMED = [
    "[a;" * 20_000, "[" * 100_000, "'a;" * 20_000, "“a;" * 30_000, "['" * 40_000, '"' * 100_000, "\\" * 100_000, "- " * 50_000, "(1) " * 30_000, "<br" + " " * 100_000,
    "[" * 20_000 + "A" + "]" * 20_000, "\"'" * 20_000 + ";" + "'\"" * 20_000, "{([" * 10_000 + "a;" + "])}" * 10_000, "[Codes " * 20_000, " " * 100_000 + "[" + " " * 100_000,
]


@pytest.mark.parametrize("text", MALFORMED, ids=range(len(MALFORMED)))
def test_malformed_fields_take_linear_time(text):
    began = time.process_time()
    PARSER.parse(text)
    assert time.process_time() - began < 3  # a tenth of it on an idle machine


@pytest.mark.parametrize("text", ["Terms", "Available", "No", "MeSH", "indexed"])
def test_single_words_of_placeholders_are_values(text):
    assert PARSER.parse(text) == [(text, None)]


def test_nested_brackets_and_quotes():
    assert [v for v, _ in PARSER.parse("[[A; [B]]; \"'C'\"]; D")] == ["A", "B", "'C'", "D"]
    assert PARSER.parse("[" * 20_000 + "A" + "]" * 20_000) == [("A", None)]


def test_long_field():
    assert len(PARSER.parse("; ".join(f"term {i}" for i in range(50_000)))) == 50_000
    assert PARSER.parse("x" * 500_000) == [("x" * 500_000, None)]


@pytest.mark.parametrize("max_shipped", [100, 2])
def test_operator(spark, max_shipped):
    rows = [(i, text, "x", "y", 9) for i, text in enumerate(CASES)] + [(None, "A; B", "x", "y", 9), (3, "A; B", "x", "y", 9)]
    df = spark.createDataFrame(rows, "id long, packed string, value string, entry string, pos int")
    vocabulary = spark.createDataFrame([(e,) for e in [*ENTRIES, None, ""]], "descriptor string")
    got = split_values(df, "id", "packed", vocabulary, max_shipped=max_shipped).collect()
    want = sorted((str(i), pos, v) for i, text, *_ in rows for pos, (v, _) in enumerate(PARSER.parse(text), 1))
    assert sorted((str(r.id), r.pos, r.value) for r in got) == want


FORMS = [
    "X • {} • Y", "X<br/>{}<BR>Y", "1. {}\n2. X", "({}); X", "“{}”; X", "«{}»|X", "‘{}’, X", "[({}), X]", "['{}', \"X\"]", "{{{}}}", "X； {}；Y", "X、{}", "- {}", "(1) {}",
    "['1. {}']", "\"'{}'; X\"", "X\u2028{}", "  {}  ",
]


@pytest.mark.parametrize("max_shipped", [100, 2])
def test_every_form_of_a_listed_entry(spark, max_shipped):
    broken = [e.replace(", ", ",\n ") for e in ENTRIES[:3]]
    texts = [form.format(e) for form in FORMS for e in [*ENTRIES, *broken, "Ringed • Entry", '"Sham Cure" Trials', '"Sham\nCure" Trials']]
    vocabulary = [*ENTRIES, "Ringed • Entry", '"Sham Cure" Trials']
    parser = Parser(vocabulary)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, packed string")
    got = {(r.id, r.pos): (r.value, r.error) for r in split_values(df, "id", "packed", spark.createDataFrame([(e,) for e in vocabulary], "descriptor string"), max_shipped=max_shipped).collect()}
    assert got == {(i, pos): v for i, text in enumerate(texts) for pos, v in enumerate(parser.parse(text), 1)}
    assert [v for v, _ in parser.parse("X • Adults,\n Middle Years • Y")] == ["X", "Adults, Middle Years", "Y"]


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, packed string")
    assert split_values(df, "id", "packed").count() == 0


def test_whole_table_has_no_cut_descriptor(spark, sf):
    values = split_values(spark.read.parquet(f"{sf}/papers.parquet"), "record_id", "mesh_terms", spark.read.parquet(f"{sf}/mesh_descriptors.parquet"))
    assert values.count() > 1000
    cut = values.where("value rlike '[;|\\\\[\\\\]]'").join(spark.read.parquet(f"{sf}/mesh_descriptors.parquet").selectExpr("lower(descriptor) as known"), [F.lower("value") == F.col("known")], "left_anti")
    assert cut.count() == 0
