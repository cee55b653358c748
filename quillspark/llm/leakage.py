"""Held-out test items that leaked into a corpus.

The items' words form generalised suffix automata, one per shard of items, built in tasks of
their own. Each document's words are streamed through them once; at every word the state is
the longest run of words, ending there, that some item holds. Runs long enough are leaks, with
the items that hold them; the spans they cover can be cut out of the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.automaton import WORD, ItemAutomaton, Tokens
from quillspark.session import materialise

#: Words of test items in one automaton, about.
SHARD_WORDS = 200_000
#: Words of test items whose automata travel with the tasks (some 80 bytes a word); beyond, documents go to the automata.
MAX_SHIPPED_WORDS = 2_000_000
#: Texts whose words are held at once.
TEXTS_AT_ONCE = 2_000


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans made disjoint."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def _automata(items: DataFrame, item_col: str, text_col: str, min_words: int, shard_words: int) -> tuple[DataFrame, int, int]:
    """(shard, packed): the automata that together hold all items; their number, and the words of all items."""
    narrow = items.select(F.col(item_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    words = narrow.agg(F.sum(F.regexp_count("text", F.lit(r"[\p{L}\p{N}]+")))).first()[0] or 0
    shards = max(1, -(-words // shard_words))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, str]]] = {}
        for batch in batches:
            for shard, item, text in zip(*(column.to_pylist() for column in batch.columns)):
                held.setdefault(shard, []).append((item, text))
        for shard in sorted(held):  # one shard to a partition
            packed = ItemAutomaton.build(held.pop(shard), min_words).pack()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([packed], pa.binary())], ["shard", "packed"])

    dealt = narrow.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), "id", "text")
    return materialise(dealt.repartitionById(shards, "shard").mapInArrow(build, "shard int, packed binary")), shards, words


def _found(texts: list[str | None], automata: list[ItemAutomaton]) -> Iterator[tuple[int, int, int, list[tuple[int, int]], int]]:
    """(text, its words, item, spans, words of the item) of every leak in a batch of texts."""
    for begin in range(0, len(texts), TEXTS_AT_ONCE):
        tokens = Tokens(texts[begin : begin + TEXTS_AT_ONCE])
        for automaton in automata:
            for text, item, spans in automaton.leaks(tokens):
                yield begin + text, int(tokens.counts[text]), item, spans, automaton.sizes[item]


_FOUND = "row long, item_id long, longest int, covered int, item_words int, item_coverage double, doc_coverage double, spans array<int>"


def _as_batch(rows: list[int], texts: list[str | None], automata: list[ItemAutomaton]) -> pa.RecordBatch:
    out = []
    for text, n_words, item, spans, size in _found(texts, automata):
        disjoint = merged(spans)
        covered = sum(b - a + 1 for a, b in disjoint)
        out.append((rows[text], item, max(b - a + 1 for a, b in spans), covered, size, min(1.0, covered / size), covered / n_words, [x for span in disjoint for x in span]))
    columns = list(zip(*out)) or [()] * 8
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in _FOUND.split(", ")])


def _shipped(automata: DataFrame):
    """The automata, broadcast as they lie in the rows; their size is bounded by the number of words."""
    return automata.sparkSession.sparkContext.broadcast([bytes(r.packed) for r in automata.collect()])


def _at_automata(rows: DataFrame, automata: DataFrame, shards: int) -> DataFrame:
    """Leaks in (row, text), each text sent to every shard's tasks: for items of any number."""
    parts = max(1, -(-rows.sparkSession.sparkContext.defaultParallelism // shards))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, automaton = None, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for number in table["task"].unique().to_pylist():
                own = table.filter(pc.equal(table["task"], number))
                if number != task:
                    task, automaton = number, None
                for packed in own["packed"].drop_null().to_pylist():
                    automaton = ItemAutomaton.unpack(packed)
                asked = own.filter(pc.is_valid(own["row"]))
                if len(asked) and automaton:
                    yield _as_batch(asked["row"].to_pylist(), asked["text"].to_pylist(), [automaton])

    left = automata.select(F.explode(F.sequence(F.col("shard") * parts, F.col("shard") * parts + (parts - 1))).alias("task"), "packed")
    part = F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")
    right = rows.select("row", "text", F.explode(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s * parts + part)).alias("task"))
    both = left.unionByName(right, allowMissingColumns=True).repartitionById(shards * parts, "task")
    return both.sortWithinPartitions("task", F.col("row").asc_nulls_first()).mapInArrow(match, _FOUND)


_LEAKS = ["doc_id", "item_id", "longest", "covered", "item_words", "item_coverage", "doc_coverage"]


def find_leaks(documents: DataFrame, items: DataFrame, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_words: int = 12, shard_words: int = SHARD_WORDS, max_shipped: int = MAX_SHIPPED_WORDS) -> DataFrame:
    """Documents that share `min_words` consecutive words with an item, or a shorter item whole.

    One row (doc_id, item_id, longest, covered, item_words, item_coverage, doc_coverage) per
    row of `documents` and item: the longest common run and the words of the document in such
    runs, the latter also as a share of the item (at most 1) and of the document. An id with
    several different texts is one item: a leak of any of them counts, and item_words is the
    sum of them. Null and
    empty texts and items without words give no rows; repeated documents give repeated rows;
    other columns are ignored. The automata of up to `max_shipped` words travel with the tasks;
    beyond, every document is sent to every automaton instead, with the same result.
    """
    automata, shards, words = _automata(items, item_col, item_text_col, min_words, shard_words)
    narrow = documents.select(F.col(doc_col).cast("long").alias("row"), F.col(text_col).alias("text")).where("text is not null")
    if words > max_shipped:
        found = _at_automata(narrow, automata, shards)
    else:
        shipped = _shipped(automata)

        def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loaded = [ItemAutomaton.unpack(packed) for packed in shipped.value]
            for batch in batches:
                yield _as_batch(batch.column(0).to_pylist(), batch.column(1).to_pylist(), loaded)

        found = narrow.mapInArrow(match, _FOUND)
    return found.withColumnRenamed("row", "doc_id").select(_LEAKS)


def remove_leaks(documents: DataFrame, items: DataFrame, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_words: int = 12, max_coverage: float = 0.5, shard_words: int = SHARD_WORDS, max_shipped: int = MAX_SHIPPED_WORDS) -> DataFrame:
    """Documents without their leaked spans: (doc_id, text, removed_words, dropped).

    Spans of at least `min_words` words (or a whole shorter item) are cut out. A document of
    whose words more than `max_coverage` leaked is dropped: its text becomes null. A null text
    stays null and is not dropped; repeated documents stay; items beyond `max_shipped` words
    are matched at their automata, and all spans of a document come together before it is cut.
    """
    automata, shards, words = _automata(items, item_col, item_text_col, min_words, shard_words)
    narrow = documents.select(F.col(doc_col).alias("doc_id"), F.col(text_col).alias("text"))
    if words > max_shipped:
        rows = materialise(narrow.withColumn("row", F.monotonically_increasing_id()))
        spans = _at_automata(rows.where("text is not null").select("row", "text"), automata, shards).groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"))
        marked = rows.join(spans, "row", "left").select("doc_id", "text", F.coalesce("spans", F.array().cast("array<int>")).alias("spans"))
    else:
        shipped = _shipped(automata)

        @F.arrow_udf("array<int>")
        def spans_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            loaded = [ItemAutomaton.unpack(packed) for packed in shipped.value]
            for batch in batches:
                spans: list[list[int]] = [[] for _ in range(len(batch))]
                for text, _, _, own, _ in _found(batch.to_pylist(), loaded):
                    spans[text].extend(x for span in own for x in span)
                yield pa.array(spans, pa.list_(pa.int32()))

        marked = narrow.select("doc_id", "text", spans_of.asNondeterministic()("text").alias("spans"))

    @F.arrow_udf("struct<text:string,removed_words:int,dropped:boolean>")
    def cut(texts: pa.Array, found: pa.Array) -> pa.Array:
        rows = [_cut(t, f, max_coverage) for t, f in zip(texts.to_pylist(), found.to_pylist())]
        return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.bool_())], ["text", "removed_words", "dropped"])

    return marked.select("doc_id", cut.asNondeterministic()("text", "spans").alias("c")).select("doc_id", "c.*")


def _cut(text: str | None, spans: list[int], max_coverage: float) -> tuple[str | None, int, bool]:
    if text is None or not spans:
        return text, 0, False
    words = list(WORD.finditer(text))
    disjoint = merged(list(zip(spans[::2], spans[1::2])))
    removed = sum(b - a + 1 for a, b in disjoint)
    if removed > max_coverage * len(words):
        return None, removed, True
    at, kept = 0, []
    for a, b in disjoint:
        kept.append(text[at : words[a].start()])
        at = words[b].end()
    return "".join([*kept, text[at:]]), removed, False
