import numpy as np

from quillspark.llm import packing
from quillspark.llm.packing import best_filling, minimum_bin_slack, pack_texts, token_counter


def test_best_filling_is_optimal():
    rng = np.random.default_rng(7)
    for _ in range(200):
        lengths = rng.integers(1, 31, rng.integers(1, 9))
        best = max(s for m in range(1 << len(lengths)) if (s := sum(int(x) for i, x in enumerate(lengths) if m >> i & 1)) <= 30)
        filling = best_filling(np.bincount(lengths, minlength=31).tolist(), 30)
        assert sum(k * n for k, n in filling.items()) == best
        assert all(n <= (lengths == k).sum() for k, n in filling.items())


def test_packing_wastes_little():
    lengths = np.random.default_rng(8).integers(1, 300, 5000)
    filled = np.bincount(minimum_bin_slack(lengths, 512), lengths)
    assert filled.max() <= 512 and len(filled) <= 1.005 * lengths.sum() / 512 + 1


def test_pack_operator(spark):
    texts = ["one two three", None, "", "word " * 2000, "x" * 30_000, "same text", "same text", " "]
    df = spark.createDataFrame([(i if i != 6 else 5, t, "x", 1) for i, t in enumerate(texts)], "id long, text string, container string, piece int")
    got = pack_texts(df, "id", "text", 64, group_items=3).toPandas()
    tokens = dict(enumerate(token_counter()(texts)))
    assert got.groupby("id").tokens.sum().to_dict() == {0: tokens[0], 3: tokens[3], 4: tokens[4], 5: tokens[5] * 2, 7: tokens[7]}
    assert (got.groupby("container").tokens.sum() <= 64).all()
    assert (got.groupby("container").tokens.sum() == got.groupby("container").filled.first()).all()
    assert got[got.id == 3].sort_values("piece").first_token.tolist() == list(range(0, tokens[3], 64))
    assert got[got.id == 0].piece.tolist() == [1]
    places = got.groupby("container").place.apply(sorted)
    assert all(p == list(range(1, len(p) + 1)) for p in places)
    assert pack_texts(df.limit(0), "id", "text").count() == 0


def test_long_stretches_count_as_the_tokenizer_counts_them():
    import base64

    import tiktoken

    lines = map(bytes.split, open(f"{packing.TOKENIZERS}/{packing.VOCABULARY}", "rb"))
    encoding = tiktoken.Encoding("own", pat_str=packing.WORDS, mergeable_ranks={base64.b64decode(a): int(b) for a, b in lines}, special_tokens={})
    texts = ["a " + "abcdefg" * 700 + " b", "的一是不了人我在有他" * 500, "x " + "word-" * 900]
    assert packing.token_counter()(texts) == [len(encoding.encode_ordinary(t)) for t in texts]
