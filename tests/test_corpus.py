import json
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quillspark.functions.stats import slope_p_value, t_p_value
from quillspark.operators import chunking, quality, terms, vectors
from quillspark.operators.querytext import date_constraint, search_text
from quillspark.plans import corpus_queries, pipeline
from quillspark.sources import corpus_files, records_xml, remote
from quillspark.streaming.ingest import ingest_csv

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in Path(sf).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return tuple(map(plain, value)) if isinstance(value, list) else value


@pytest.mark.parametrize("name", corpus_queries.SQL)
def test_sql_twin(spark, sf, duck, name):
    df = corpus_queries.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = duck.execute(corpus_queries.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == Counter(tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in result.fetchall())


@pytest.mark.parametrize(
    "case,score,level",
    [
        ((0, 1000, 900, 900, 0.0, 0, 0), 100.0, "high"), ((10, 1000, 600, 500, 8.0, 3, 2), 72.9, "medium"), ((0, 1000, 0, 0, 0.0, 0, 0), 55.9, "low"),
        ((0, 0, 0, 0, 0.0, 50, 0), 90.0, "high"), ((50, 0, 0, 0, 0.0, 0, 0), 70.0, "medium"), ((0, 1000, 900, 900, 5.0, 0, 0), 100.0, "high"),
        ((0, 1000, 900, 900, 5.2, 0, 0), 97.4, "high"), ((50, 1000, 0, 0, 20.0, 5, 5), 0.9, "low"),
    ],
)
def test_score(spark, case, score, level):
    df = spark.createDataFrame([case], "m long, p long, a long, t long, d double, i long, o long")
    value = quality.quality_score(*[F.col(c) for c in "mpatdio"])
    r = df.select(value.alias("s"), quality.confidence(value).alias("c")).first()
    assert abs(r.s - score) < 1e-9 and r.c == level


def test_outliers(spark):
    counts = [10, 12, 11, 13, 12, 100]
    rows = [("a", 2000 + i, n) for i, n in enumerate(counts)] + [("b", 2000 + i, n) for i, n in enumerate(counts[1:])]
    got = quality.with_outliers(spark.createDataFrame(rows, "condition string, file_year int, papers long")).where("outlier").collect()
    assert [(r.condition, r.papers, r.lower, r.upper) for r in got] == [("a", 100, 9.0, 15.0)]


def test_p_values():
    assert abs(t_p_value(2, 10) - 0.073388) < 1e-6
    assert slope_p_value(1.0, 5) == 0 and slope_p_value(None, 5) is None
    assert abs(slope_p_value(0.0, 9) - 1) < 1e-12


def test_simple_terms(spark):
    df = spark.createDataFrame([("A; B;; ;C\t",), (None,)], "t string")
    assert [r[0] for r in df.select(terms.simple_terms("t")).collect()] == [["A", "B", "C"], None]


def test_paper_text(spark):
    df = spark.createDataFrame([("T", "X", "a; b"), (None, "", None)], "title string, abstract string, mesh_terms string")
    assert [r[0] for r in df.select(vectors.paper_text()).collect()] == ["[TITLE] T [ABSTRACT] X [MESH] a,  b", ""]


def test_paper_text_is_whole(spark):
    df = spark.createDataFrame([("T", "x" * 5000 + " end", "m")], "title string, abstract string, mesh_terms string")
    r = df.select(vectors.paper_text().alias("whole"), vectors.paper_text(abstract_limit=vectors.REFERENCE_ABSTRACT).alias("cut")).first()
    assert r.whole == "[TITLE] T [ABSTRACT] " + "x" * 5000 + " end [MESH] m" and r.cut == "[TITLE] T [ABSTRACT] " + "x" * 2000 + " [MESH] m"


def test_centroids_hold_whole_abstracts(spark, tmp_path):
    for name, end in (("a", "end"), ("b", "other")):
        df = spark.createDataFrame([("A", 2001, "T", "word " * 400 + end, "m")], "condition string, file_year int, title string, abstract string, mesh_terms string")
        df.write.parquet(str(tmp_path / name / "papers.parquet"))
    vecs = [corpus_queries.paper_centroids(spark, str(tmp_path / name)).first().vec for name in "ab"]
    assert vecs[0] != vecs[1]


def test_the_encoder_counts_every_word():
    a, b = vectors.hashing_encoder(64)(["word " * 600 + "end", "word " * 600 + "other"])
    assert (a != b).any()


def test_vectors(spark):
    df = spark.createDataFrame([("A", 2001, [0.0, 0.0])] * 3 + [("A", 2002, [4.0, 0.0]), ("A", 2002, None), ("A", 2002, [float("nan"), 1.0])], "k string, y int, v array<float>")
    assert vectors.mean_vector(df, ["k"], "v", 2).first().vec == [1.0, 0.0]
    years = spark.createDataFrame([("x", 2000 + 2 * i, [3.0 * i, 4.0 * i]) for i in range(7)] + [("y", 2000 + i, [1.0, i + 0.0]) for i in range(5)], "k string, y int, vec array<double>")
    assert {(r.y, r.year_gap, r.drift) for r in vectors.drift(years, "k", "y").collect()} == {(2000 + 2 * i, 2, 5.0) for i in range(1, 7)}
    pair = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0])], "k string, vec array<double>")
    got = {(r.a, r.b): r.cos for r in vectors.similarity(pair, "k").collect()}
    assert abs(got["a", "b"] - math.sqrt(0.5)) < 1e-9 and abs(got["a", "a"] - 1) < 1e-9
    x = np.random.default_rng(1).normal(size=(60, 4))
    many = spark.createDataFrame([(f"k{i:02}", v.tolist()) for i, v in enumerate(x)] + [("zero", [0.0] * 4)], "k string, vec array<double>")
    want = (x @ x.T) / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(x, axis=1)
    for tile_rows in (1000, 7):
        got = {(r.a, r.b): r.cos for r in vectors.similarity(many, "k", tile_rows).collect()}
        assert len(got) == 61 * 62 // 2 and all(a <= b for a, b in got) and got["k00", "zero"] is None
        assert all(abs(got[f"k{i:02}", f"k{j:02}"] - want[i, j]) < 1e-9 for i in range(60) for j in range(i, 60))
    matrix = {r.a: r.asDict() for r in vectors.similarity_matrix(vectors.similarity(pair, "k"), ["a", "b"]).collect()}
    assert abs(matrix["b"]["a"] - math.sqrt(0.5)) < 1e-9 and abs(matrix["b"]["b"] - 1) < 1e-9
    encoded = vectors.encode_texts(spark.createDataFrame([("one two",), ("",), (None,)], "t string"), "t").collect()
    assert len(encoded[0].vec) == 768 and encoded[1].vec is None and encoded[2].vec is None


class Model:
    """Token vectors (length of the word, its place)."""

    width = 2

    def tokens(self, text):
        return [len(w) for w in text.split()]

    def states(self, ids):
        assert (ids.shape[1]) <= 4
        return np.stack([ids, ids * 2], axis=2).astype(np.float32)


def test_centroid_tables(spark, tmp_path):
    df = spark.createDataFrame([("A", 2001, [0.0, 0.0])] * 3 + [("A", 2002, [4.0, 0.0]), ("B", 2002, [1.0, 1.0])], "k string, y int, v array<double>")
    for _ in range(2):
        vectors.write_centroids(df, "k", "y", "v", 2, str(tmp_path))
    assert {(r.k, r.y): (r.n, r.vec) for r in spark.read.parquet(str(tmp_path / "centroid_year")).collect()} == {("A", 2001): (3, [0.0, 0.0]), ("A", 2002): (1, [4.0, 0.0]), ("B", 2002): (1, [1.0, 1.0])}
    assert {r.k: (r.n, r.vec, r.years) for r in spark.read.parquet(str(tmp_path / "centroid")).collect()} == {"A": (4, [1.0, 0.0], [2001, 2002]), "B": (1, [1.0, 1.0], [2002])}


def test_masked_mean_and_truncation():
    texts = ["a bb ccc", "dddd", "", "a " * 9 + "b" * 11]
    whole = vectors.encoder(Model(), batch=3, step=4)(texts)
    assert np.allclose(whole, [[2, 4], [4, 8], [0, 0], [2, 4]])
    cut = vectors.encoder(Model(), max_tokens=2, step=4)(texts)
    assert np.allclose(cut, [[1.5, 3], [4, 8], [0, 0], [1, 2]])
    states = vectors.HashingModel(64).states(np.array([[5, 7, 5]]))
    assert states.shape == (1, 3, 64) and (states[0, 0] == states[0, 2]).all() and (states[0, 0] != states[0, 1]).any()


def test_chunks_cover_each_row_once(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    got = chunking.chunks(events, ["event_type"], "ts", 5)
    total = got.agg(F.sum("n"), F.sum("kept"), F.sum("lost")).first()
    assert total[0] == events.count() and total[1] + total[2] == total[0]
    assert got.where("n > 5 and level <> 'quarter_hour'").count() == 0
    assert chunking.chunks(events.limit(0), ["event_type"], "ts", 5).count() == 0


def test_date_constraints():
    date = '"{}"[Date - Publication]'.format
    assert date_constraint() == date("1975") + " : " + date("2024")
    assert date_constraint(year=1999) == date("1999") and date_constraint(year=1999, month=3) == date("1999/03")
    assert date_constraint(year=1999, month=3, day=4) == date("1999/03/04")
    assert date_constraint(year=1999, month=3, day=4, hours=(6, 11)) == '"1999/03/04 06:00"[PDAT] : "1999/03/04 11:59"[PDAT]'
    assert date_constraint(year=1999, month=3, day=4, minutes=(15, 29)) == '"1999/03/04 00:15"[PDAT] : "1999/03/04 00:29"[PDAT]'
    assert date_constraint(year=1999, month=3, date_range=("a", "b")) == date("a") + " : " + date("b")
    assert search_text("q", year=2000).endswith(' AND (q) AND "2000"[Date - Publication]')


class Client:
    """A source of a fixed number of articles per day of March 2001."""

    def __init__(self, per_day=40):
        self.per_day = per_day

    def count(self, text):
        import re

        dates = re.findall(r'"(\d{4})(?:/(\d\d))?(?:/(\d\d))?(?: (\d\d):(\d\d))?"', text)
        year, month, day, hour, _ = dates[0]
        if year != "2001" or month not in ("", "03"):
            return 0
        if hour:
            return self.per_day // 4 if int(dates[1][3]) - int(hour) == 5 else self.per_day // 96
        return self.per_day * (1 if day and len(dates) == 1 else int(dates[1][2]) - int(day) + 1 if day else 31)

    def ids(self, text, limit):
        return list(range(min(self.count(text), limit)))

    def fetch(self, ids):
        return "<Set>" + "".join(f"<PubmedArticle><PMID>{i}</PMID><Abstract><AbstractText>{'word ' * 20}</AbstractText></Abstract></PubmedArticle>" for i in ids) + "</Set>"


@pytest.mark.parametrize("cap,chunks", [(10_000, 1), (1239, 5), (279, 29), (39, 124)])
def test_plan_covers_the_year(cap, chunks):
    plan = list(remote.plan_chunks("c", "q", 2001, Client().count, cap))
    assert len(plan) == chunks and sum(c.found for c in plan) == 1240 and all(c.lost == 0 for c in plan)


def test_fetch_and_parse(spark):
    work = spark.createDataFrame([("c", "q", 2001), ("c", "q", 2002)], "condition string, query string, file_year int")
    plan = remote.plan_documents(work, Client, 500, 2)
    assert sorted((r.found, r.lost) for r in plan.collect()) == sorted((c.found, c.lost) for c in remote.plan_chunks("c", "q", 2001, Client().count, 500))
    documents = remote.fetch_documents(plan, Client, 2, after=0)
    records = records_xml.parse_records(documents, "xml", ["condition", "file_year"])
    assert records.count() == 1240 and records.where("error is not null").count() == 0


def test_failing_batches_are_reported():
    class Broken(Client):
        def fetch(self, ids):
            raise OSError("no route")

    waits = []
    assert list(remote.fetch_chunk(Broken(), '"2001/03/04"[Date - Publication]', sleep=waits.append)) == [(None, "no route")]
    assert waits == [2.0, 2.0]


class Silent(Client):
    def count(self, text):
        raise OSError("no route")


def test_a_failing_plan_gives_error_rows(spark):
    work = spark.createDataFrame([("c", "q", 2001)], "condition string, query string, file_year int")
    assert [(r.file_year, r.xml, r.error) for r in remote.fetch_documents(remote.plan_documents(work, Silent), Silent).collect()] == [(2001, None, "no route")]


def test_fetches_keep_to_the_rate():
    calls = []

    class Counted(Client):
        def fetch(self, ids):
            calls.append(time.monotonic())
            return super().fetch(ids)

    list(remote.fetch_chunk(Counted(1000), '"2001"[Date - Publication]', cap=600, after=0.05))
    assert len(calls) == 6 and min(b - a for a, b in zip(calls, calls[1:])) >= 0.05


ARTICLE = """<Set><PubmedArticle><PMID>7</PMID><ArticleTitle>Use of <i>E. coli</i> in x</ArticleTitle><Journal><ISOAbbreviation>J X</ISOAbbreviation></Journal>
<PubDate><MedlineDate>1998 Dec-1999 Jan</MedlineDate></PubDate><Abstract><AbstractText Label="AIM">To see <b>how</b> it goes in a longer text than fifty.</AbstractText><AbstractText>More.</AbstractText></Abstract>
<MeshHeading><DescriptorName>A, b</DescriptorName></MeshHeading><MeshHeading><DescriptorName>C</DescriptorName></MeshHeading>
<AuthorList><Author><LastName>Li</LastName><Affiliation> Uni </Affiliation></Author><Author><CollectiveName>G</CollectiveName></Author>{more}</AuthorList></PubmedArticle>
<PubmedArticle><PMID>8</PMID><Abstract><AbstractText>short</AbstractText></Abstract></PubmedArticle></Set>"""


def test_xml_records(spark):
    more = "".join(f"<Author><LastName>L{i}</LastName><ForeName>F</ForeName></Author>" for i in range(12))
    df = spark.createDataFrame([(1, ARTICLE.replace("{more}", more)), (2, "<broken"), (3, None)], "k int, xml string")
    rows = {r.k: r for r in records_xml.parse_records(df, "xml", ["k"]).collect()}
    assert set(rows) == {1, 2} and rows[2].error and rows[2].pmid is None
    r = rows[1]
    assert (r.pmid, r.title, r.year, r.mesh_terms, r.journal, r.firstauthoraffiliation) == ("7", "Use of E. coli in x", "1998", "A, b; C", "J X", "Uni")
    assert r.abstract == "AIM: To see how it goes in a longer text than fifty. More." and r.authors.startswith("Li; L0, F") and len(r.authors.split("; ")) == 10
    assert records_xml.parse_records(df.where("k = 1"), "xml", ["k"], leading_only=True).count() == 0


def test_corpus_files(spark, tmp_path):
    header = ",".join(corpus_files.CSV_COLUMNS) + "\n"
    for folder, year, body in [("A_b", 2000, '1,T,"two\nlines, ""quoted""",J,2000,x; y,,,A/b\n2,NA,,J,2000,,,,A/b\n'), ("A_b", 2001, ""), ("C", 2000, "3,T,x,J,1999,z,,,C\n")]:
        (tmp_path / "in" / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / folder / f"{folder}_{year}.csv").write_text(header + body)
    (tmp_path / "in" / "C" / "C_2002.csv").write_text("")
    root = str(tmp_path / "in")
    papers = corpus_files.read_corpus_csv(spark, root)
    rows = {r.pmid: r for r in papers.collect()}
    assert len(rows) == 3 and rows["1"].abstract == 'two\nlines, "quoted"' and rows["2"].abstract is None and rows["2"].title == "NA"
    assert (rows["1"].folder, rows["1"].file_year, rows["1"].condition) == ("A_b", 2000, "A/b")
    assert corpus_files.read_corpus_csv(spark, root, corpus_files.NULL_TEXTS).where("pmid = 2").first().title is None
    listing = corpus_files.file_listing(spark, root)
    states = {(r.folder, r.file_year): r.state for r in corpus_files.file_states(listing, papers).collect()}
    assert states == {("A_b", 2000): "filled", ("A_b", 2001): "empty", ("C", 2000): "filled", ("C", 2002): "unreadable"}
    stock = {r.folder: r for r in corpus_files.inventory(listing).collect()}
    assert stock["C"].files == 2 and stock["C"].years == 2 and stock["C"].year_coverage == 4.0
    assert {r.file: r.lines for r in corpus_files.line_counts(spark, root).collect()}["A_b_2000.csv"] == 3
    corpus_files.write_corpus(papers, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("folder = 'A_b'").count() == 2
    corpus_files.export_csv(papers.select("pmid", "abstract"), str(tmp_path / "csv"), "pmid")
    assert spark.read.csv(str(tmp_path / "csv"), header=True, multiLine=True, escape='"').count() == 3
    corpus_files.export_json(papers, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 3
    log = spark.createDataFrame([(0, 0), (4, 3)], "total_found long, total_retrieved long")
    assert [r.completeness for r in corpus_files.with_completeness(log).orderBy("total_found").collect()] == [100.0, 75.0]
    for _ in range(2):
        corpus_files.append_log(log, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4


def test_state_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"C d": {"2000": {"status": "complete", "timestamp": "2024-01-02T03:04:05"}, "2001": {"status": "error", "timestamp": "x"}}, "E": {}}))
    (tmp_path / "b.json").write_text(json.dumps({"C d": {"2000": {"total_found": 4, "total_retrieved": 3, "completeness": 75.0, "timestamp": None}}}))
    (tmp_path / "c.json").write_text('{"C d": {"2000"')
    a, b = (corpus_files.read_state_json(spark, str(tmp_path / f"{name}.json")).collect() for name in "ab")
    assert sorted((r.condition, r.year, r.status, r.ts is not None, r.total_found) for r in a) == [("C d", "2000", "complete", True, None), ("C d", "2001", "error", False, None)]
    assert [(r.year, r.total_found, r.total_retrieved, r.completeness, r.status) for r in b] == [("2000", 4, 3, 75.0, None)]
    assert corpus_files.read_state_json(spark, str(tmp_path / "c.json")).count() == 0


def test_incremental_ingest(spark, tmp_path):
    header = ",".join(corpus_files.CSV_COLUMNS) + "\n"
    (tmp_path / "in" / "A").mkdir(parents=True)
    for year in (2000, 2001):
        (tmp_path / "in" / "A" / f"A_{year}.csv").write_text(header + f"{year},T,x,J,2000,,,,A\n")
        ingest_csv(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
        assert spark.read.parquet(str(tmp_path / "out")).count() == year - 1999
    written = corpus_files.read_corpus_csv(spark, str(tmp_path / "in")).where("file_year = 2001")
    corpus_files.write_corpus(written.withColumn("file_year", F.lit(2005)), str(tmp_path / "batch"))
    both = spark.read.parquet(str(tmp_path / "out")).unionByName(spark.read.parquet(str(tmp_path / "batch")))
    assert {(r.pmid, r.folder, r.file_year, r.abstract, r.authors) for r in both.collect()} == {("2000", "A", 2000, "x", None), ("2001", "A", 2001, "x", None), ("2001", "A", 2005, "x", None)}


def test_score_headings_and_summary(spark, sf, tmp_path):
    scores = corpus_queries.score_export(spark, sf)
    exported = corpus_files.with_headings(scores)
    assert exported.columns[:3] == ["Condition", "Condition_Folder", "Quality_Score"] and len(exported.columns) == 14
    again = corpus_files.with_table_names(exported)
    assert sorted(again.columns) == sorted(scores.columns) and corpus_files.with_table_names(scores).columns == scores.columns
    corpus_files.export_summary(corpus_queries.validation_summary(spark, sf), str(tmp_path / "summary"))
    summary = json.loads(spark.read.text(str(tmp_path / "summary")).first()[0])
    assert json.loads(summary["scores"])["conditions"] == scores.count() and "missing_years" in json.loads(summary["gaps"])


def test_pipeline(spark, sf, tmp_path):
    out = str(tmp_path)
    given = pipeline.parameters(["--tables", sf, "--out", out, "--conditions", "4", "--min-quality", "20", "--width", "16"])
    assert (given.first, given.years) == (4, None) and pipeline.parameters(["--test-mode"]).years == [2020, 2021, 2022, 2023, 2024]
    for _ in range(2):  # a second run replaces the first
        pipeline.validate(spark, sf, out)
    scores = spark.read.csv(f"{out}/quality_scores", header=True)
    assert scores.count() == corpus_queries.condition_scores(spark, sf).count() and "Abstract_Coverage_%" in scores.columns
    assert spark.read.csv(f"{out}/temporal_counts", header=True).where("year = 'TOTAL'").count() == 1
    assert spark.read.csv(f"{out}/data_gaps", header=True).count() == corpus_queries.data_gaps(spark, sf).count()
    assert spark.read.text(f"{out}/report").where("value like 'scores, conditions:%'").count() == 1
    pipeline.embed(spark, sf, out, given)
    chosen = [r.condition for r in spark.read.csv(f"{out}/selection", header=True).collect()]
    centroids = spark.read.parquet(f"{out}/centroid")
    assert 0 < len(chosen) <= 4 and {r.condition for r in centroids.collect()} == set(chosen) and len(centroids.first().vec) == 16
    assert spark.read.csv(f"{out}/similarity", header=True).count() == len(chosen) and spark.read.json(f"{out}/embeddings").count() == len(chosen)


def test_retrieval_and_resume(spark, tmp_path):
    out = str(tmp_path)
    catalog = spark.createDataFrame([("C d", "C_d", None)], "name string, folder string, search_query string")
    log = spark.createDataFrame([(i, "C d", str(y), "Complete", None) for i, y in enumerate(range(1975, 2025)) if y not in (2001, 2002)], "entry_id long, condition string, year string, status string, ts timestamp")
    work = pipeline.open_work(catalog, log)
    assert {(r.condition, r.file_year) for r in work.collect()} == {("C d", 2001), ("C d", 2002)} and work.first().query.startswith('"C d"')
    pipeline.retrieve(work, Client, out, 2, 0)
    assert spark.read.parquet(f"{out}/corpus").where("folder = 'C_d' and file_year = 2001").count() == 1240
    assert {(r.year, r.total_found, r.total_retrieved, r.completeness) for r in spark.read.parquet(f"{out}/completeness").collect()} == {("2001", 1240, 1240, 100.0), ("2002", 0, 0, 100.0)}
    checkpoint = spark.read.parquet(f"{out}/checkpoint")
    assert {r.status for r in checkpoint.collect()} == {"complete"}
    assert pipeline.open_work(catalog, log.unionByName(checkpoint)).count() == 0
    pipeline.retrieve(work, Silent, out, 2, 0)
    assert spark.read.parquet(f"{out}/checkpoint").where("status = 'error'").count() == 2


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
