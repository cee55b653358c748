import re

import pytest

from quillspark.llm.splitting import cut_kinds, pieces_of, split_texts


def sentence(n):
    return "A" + "b" * (n - 2) + "."


TEXTS = {
    "sentences": " ".join(sentence(90) for _ in range(12)),
    "paragraphs": "\n\n".join(" ".join(sentence(40) for _ in range(3)) for _ in range(6)),
    "words": "word " * 100,
    "forced": "x" * 950,
    "mixed": "y" * 260 + " " + " ".join(sentence(50) for _ in range(9)),
    "spaces": " \t\n" + ("ab cd\n" * 80) + " ",
    "exact": sentence(200) + " " + sentence(200),
}


def kind_of(text, limit):
    text = text.strip()
    if any(len(w) > limit for w in text.split()):
        return "forced"
    return "sentence" if all(len(s.strip()) <= limit for s in re.split(r"(?<=[.!?])(?=\s)", text)) else "word"


@pytest.mark.parametrize("name", TEXTS)
@pytest.mark.parametrize("overlap", [0, 20])
def test_pieces_round_trip(name, overlap):
    text = TEXTS[name].strip()
    pieces = pieces_of(text, 200, overlap)
    assert all(end - start <= 200 and core - start <= overlap for start, core, end, _ in pieces)
    assert "".join("".join(text[core:end].split()) for _, core, end, _ in pieces) == "".join(text.split())
    for (_, _, before, _), (start, core, _, _) in zip(pieces, pieces[1:]):
        assert start <= core and before <= core and not text[before:core].strip()
    kinds = {p[3] for p in pieces}
    worst = "forced" if "forced" in kinds else "word" if "word" in kinds else "sentence"
    assert worst == kind_of(text, 200)


def test_full_overlap_cuts_long_sentences():
    text = " ".join(("word " * 39 + "end.") for _ in range(3))
    assert [core - start for start, core, _, _ in pieces_of(text, 200, 20)] == [0, 0, 0]
    full = pieces_of(text, 200, 20, full_overlap=True)
    assert all(end - start <= 200 for start, _, end, _ in full) and all(14 <= core - start <= 20 for start, core, _, _ in full[1:])
    assert "".join("".join(text[core:end].split()) for _, core, end, _ in full) == "".join(text.split())


def test_strong_boundaries_win():
    pieces = pieces_of(TEXTS["paragraphs"], 200, 0)
    assert all(TEXTS["paragraphs"][end : end + 2] in ("\n\n", "") for _, _, end, _ in pieces)


def test_split_operator(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate([*TEXTS.values(), None, "", "short", " " * 500, "long words " * 100_000])] + [(0, TEXTS["sentences"], "x", 1), (None, TEXTS["words"], "x", 1)]
    df = spark.createDataFrame(rows, "id long, text string, piece string, start int")
    got = split_texts(df, "id", "text", 200, 20).toPandas()
    assert (got.text.str.len() <= 200).all()
    assert set(got.id.dropna()) == {0, 1, 2, 3, 4, 5, 6, 11}
    assert len(got[got.id == 0]) == 2 * len(pieces_of(TEXTS["sentences"], 200, 20))
    kinds = {r.id: r.cut for r in cut_kinds(split_texts(df, "id", "text", 200, 20), "id").collect()}
    assert {i: k for i, k in kinds.items() if i is not None and i < 7} == {i: kind_of(t, 200) for i, t in enumerate(TEXTS.values())}
    assert split_texts(df.limit(0), "id", "text", 200, 20).count() == 0
    with pytest.raises(ValueError):
        split_texts(df, "id", "text", 200, 200)
