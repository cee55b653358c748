import numpy as np

from quillspark.llm.automaton import ItemAutomaton, Tokens, words_of
from quillspark.llm.leakage import find_leaks, merged, remove_leaks


def brute(docs, items, n):
    out = set()
    for d, text in docs:
        words = words_of(text)
        for i, item in items:
            w = words_of(item)
            m = min(n, len(w))
            if m and {tuple(w[a : a + m]) for a in range(len(w) - m + 1)} & {tuple(words[a : a + m]) for a in range(len(words) - m + 1)}:
                out.add((d, i))
    return out


def test_leaks_against_brute_force(spark):
    rng = np.random.default_rng(6)
    items = [(i, " ".join(rng.choice(list("abcd"), rng.integers(1, 14)))) for i in range(40)] + [(90, ""), (91, None), (92, "?!"), (93, "a b")]
    docs = [(i, ", ".join(rng.choice(list("ABCDe"), rng.integers(1, 60)))) for i in range(150)] + [(900, None), (901, ""), (902, "a_b a"), (0, "a b c a b c")]
    documents = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, item_id long, longest string")
    evaluation = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    want = brute(docs, items, 5)
    for shard, most in ((200_000, 2_000_000), (60, 2_000_000), (60, 10)):
        got = find_leaks(documents, evaluation, min_words=5, shard_words=shard, max_shipped=most)
        assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    assert find_leaks(documents.limit(0), evaluation, min_words=5).count() == 0
    assert find_leaks(documents, evaluation.limit(0), min_words=5).count() == 0


def test_longest_run_and_removal(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    documents = spark.createDataFrame([(1, "Before. One two THREE four five six seven eight nine ten eleven twelve, thirteen. After it all some more words follow here to the end."), (2, item), (3, "clean text"), (4, None)], "doc_id long, text string")
    evaluation = spark.createDataFrame([(7, item)], "item_id long, text string")
    leaks = {r.doc_id: r for r in find_leaks(documents, evaluation).collect()}
    assert set(leaks) == {1, 2} and leaks[1].longest == 13 and leaks[2].item_coverage == 1.0
    cleaned = {r.doc_id: r for r in remove_leaks(documents, evaluation, max_coverage=0.6).collect()}
    other = evaluation.unionByName(spark.createDataFrame([(8, "after it all"), (9, "to the end")], "item_id long, text string"))
    for most in (9, 1000):
        pieces = {r.doc_id: r for r in remove_leaks(documents, other, max_coverage=0.9, shard_words=9, max_shipped=most).collect()}
        assert pieces[1].text == "Before.  some more words follow here ." and pieces[1].removed_words == 19
    assert cleaned[1].text == "Before. . After it all some more words follow here to the end." and cleaned[1].removed_words == 13
    assert cleaned[2].dropped and cleaned[2].text is None
    assert cleaned[3].text == "clean text" and cleaned[4].text is None and not cleaned[4].dropped


def test_automaton_state_travels():
    automaton = ItemAutomaton.build([(1, "a b c"), (2, "b c d"), (3, "x")], 2)
    again = ItemAutomaton.unpack(automaton.pack())
    tokens = Tokens(["", "x a b c d", None, "A_B! b", "d"])
    assert list(again.leaks(tokens)) == list(automaton.leaks(tokens)) == [(1, 1, [(1, 3)]), (1, 2, [(2, 4)]), (1, 3, [(0, 0)]), (3, 1, [(0, 1)])]
    assert merged([(5, 6), (1, 2), (2, 4)]) == [(1, 6)]


def test_many_item_words_take_little_memory():
    import tracemalloc

    rng = np.random.default_rng(2)
    words = [f"w{n}" for n in range(50_000)]
    items = [(i, " ".join(words[w] for w in rng.integers(0, 50_000, 100))) for i in range(2_000)]
    packed = ItemAutomaton.build(items, 12).pack()  # 200,000 words, of which up to ten such shards travel
    tracemalloc.start()
    held = ItemAutomaton.unpack(packed)
    assert tracemalloc.get_traced_memory()[1] < 30e6 and len(held.owners) == 2_000
    tracemalloc.stop()


def test_cleaned_texts_of_the_given_table(spark):
    documents, items = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/eval_items.parquet")
    passages = [tuple(w[a : a + min(12, len(w))]) for r in items.collect() if (w := words_of(r.text)) for a in range(len(w) - min(12, len(w)) + 1)]
    by_length = {n: {p for p in passages if len(p) == n} for n in {len(p) for p in passages}}
    got = {r.doc_id: r for r in remove_leaks(documents, items).collect()}
    cut = 0
    for r in documents.collect():
        words, leaked = words_of(r.text), set()
        for n, some in by_length.items():
            for a in range(len(words) - n + 1):
                if tuple(words[a : a + n]) in some:
                    leaked.update(range(a, a + n))
        own = got[r.doc_id]
        assert own.removed_words == len(leaked) and own.dropped == (len(leaked) > 0.5 * len(words))
        if leaked and not own.dropped:
            cut += 1
            assert words_of(own.text) == [w for i, w in enumerate(words) if i not in leaked]
        elif not own.dropped:
            assert own.text == r.text
    assert cut > 3


def test_every_text_of_a_repeated_id_counts(spark):
    evaluation = spark.createDataFrame([(7, "one two three"), (7, "four five six"), (7, "one two three")], "item_id long, text string")
    documents = spark.createDataFrame([(1, "x one two three y"), (2, "four five six one two three"), (3, "three four")], "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.longest, r.covered, r.item_words) for r in find_leaks(documents, evaluation).collect())
    assert got == [(1, 7, 3, 3, 6), (2, 7, 3, 6, 6)]
    assert {r.doc_id: r.removed_words for r in remove_leaks(documents, evaluation).collect()} == {1: 3, 2: 6, 3: 0}
