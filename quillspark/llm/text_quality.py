"""Statistics of each text, published threshold rules, and whether it is prose, a list, a table or junk.

All statistics of a batch of texts are made together by vectorized functions: characters by a
table of Unicode classes, lines, words and cells by a pattern matcher that takes linear time,
whatever the text. Each rule that a text fails is recorded as a reason.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Common words that travel with the tasks at most; of a longer list each text is joined with its own.
MAX_SHIPPED_WORDS = 500_000

# Fixed patterns.
FIGURE = r"(?:[<>=~]?[-+]?\d[\d.,]*\s?%?(?:\s?(?:±|\+/-)\s?\d[\d.,]*)?|(?i:ns|n/?a)|-|–)"
CELL_GAP = r"\s*[\t;,|:]\s*|\s+/\s+|\s{2,}"
BULLET = r"^\s*(?:[-*•‣▪–+]|\(?(?:\d{1,3}|[a-z])[.)])\s+\S"
CONTENTS = r"\.{4}\s{0,9}\d{1,6}\W{0,9}$"
REFERENCE = r"\b(?:19|20)\d\d\s{0,3};\s{0,3}\d{1,6}.{0,20}:\s{0,3}\d"
INNER_SENTENCE = r"\p{Ll}{2}\)?[.!?]\s{1,9}\p{Lu}"
FINISHED = r"[\p{Ll}\d%)]{2}[.!?](?:\s|$)"
SENTENCE_END = r"[.!?][\"')\]»”]{0,5}$"
MOJIBAKE = r"Ã.|â€|ï»¿|Â[°-¿]|�|□"
TAG = r"</?[a-zA-Z!][^<>]*>"
HEX_LINE = r"(?i)^\s*[0-9a-f]{8}\s(?:\s*[0-9a-f]{2}){4,}"
LINE_BREAK = r"\r\n|[\n\r\x{85}\x{2028}]"
SEGMENT_BREAK = r"[\n\r\x{85}\x{2028}|\t]|\s{2,}"
TOKEN_BREAK = r"[^\p{L}\p{N}'’-]+"

#: Published thresholds: the quality and repetition rules of Rae et al. 2021 (gopher) and the
#: line rules of Penedo et al. 2024 (fineweb).
PUBLISHED = {
    "gopher_words_min": 50, "gopher_words_max": 100_000, "gopher_mean_word_min": 3.0, "gopher_mean_word_max": 10.0, "gopher_symbols_max": 0.1, "gopher_bullets_max": 0.9,
    "gopher_ellipsis_max": 0.3, "gopher_alphabetic_min": 0.8, "gopher_stop_words_min": 2, "gopher_duplicates_max": 0.3, "gopher_duplicate_chars_max": 0.2,
    "fineweb_punctuation_min": 0.12, "fineweb_short_lines_max": 0.67, "fineweb_duplicate_chars_max": 0.1,
}
#: Thresholds of this module's own rules, for what the published ones cannot tell: short texts, lists, tables, encodings.
OWN = {
    "letters_min": 0.5, "mojibake_max": 0.02, "tags_max": 0.3, "hex_max": 0.5, "words_min": 8, "word_max": 60, "repeats_min": 6.0, "repeated_words_max": 12, "common_min": 0.09, "segments_min": 4, "segment_max": 9.0, "duplicates_max": 0.6,
    "table_min": 0.4, "entries_min": 0.5, "entry_common_max": 0.2, "entry_words_max": 14, "short_entry_words_max": 5, "inline_parts_min": 4, "inline_words_max": 7,
    "sentence_rate_max": 0.02, "entries_count_min": 3, "unfinished_lines_min": 4, "unfinished_words_max": 9, "list_common_max": 0.15,
}

_STATISTICS = {
    "n_chars": "long", "n_words": "long", "mean_word_len": "double", "max_word_len": "long", "symbol_share": "double", "letter_share": "double", "n_lines": "long", "end_punct_share": "double",
    "bullet_share": "double", "ellipsis_share": "double", "short_line_share": "double", "alphabetic_share": "double", "symbol_word_ratio": "double", "common_words": "long", "common_share": "double",
    "distinct_share": "double", "duplicate_share": "double", "duplicate_char_share": "double", "n_segments": "long", "mean_segment_len": "double", "table_share": "double", "entry_share": "double", "marked_share": "double", "sentence_rate": "double",
    "mojibake_share": "double", "tag_share": "double", "hex_share": "double",
}


def character_classes() -> np.ndarray:
    """Of each code point 1 for a letter, 2 for a digit or other number, 3 for white space, else 0."""
    classes = np.zeros(0x110000, np.uint8)
    classes[:0x20000] = [{"L": 1, "N": 2}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x20000)]
    classes[0x20000:0x32400] = 1  # further ideographs
    classes[[9, 10, 11, 12, 13, 32, 160]] = 3
    return classes


class _Parts:
    """The parts into which a pattern, or white space, cuts texts, without empty ones, and the text of each."""

    def __init__(self, texts: pa.Array, pattern: str | None = None):
        lists = pc.split_pattern_regex(texts, pattern) if pattern else pc.utf8_split_whitespace(texts)
        self.count, self.values = len(texts), lists.flatten()
        self.parent = np.repeat(np.arange(self.count), np.diff(np.asarray(lists.offsets)))
        self.sizes = pc.utf8_length(self.values).to_numpy()
        self.keep(self.sizes > 0)

    def keep(self, good: np.ndarray) -> None:
        self.values, self.parent, self.sizes = self.values.filter(pa.array(good)), self.parent[good], self.sizes[good]

    def per_text(self, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(self.parent, weights, self.count)

    def has(self, pattern: str) -> np.ndarray:
        return pc.match_substring_regex(self.values, pattern).to_numpy(zero_copy_only=False)

    def distinct(self) -> np.ndarray:
        """The first of each text's equal parts."""
        codes = self.values.dictionary_encode().indices.to_numpy()
        _, first = np.unique(self.parent * (int(codes.max(initial=0)) + 1) + codes, return_index=True)
        return first


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.divide(part, whole, out=np.zeros(len(whole)), where=whole > 0)


def _rows(lines: _Parts) -> np.ndarray:
    """Which lines are a label followed by two or more figures, in cells of their own."""
    rows = np.zeros(len(lines.values), bool)
    ending = lines.has(FIGURE + r"\s*\|?\s*$")
    cells = _Parts(lines.values.filter(pa.array(ending)), CELL_GAP)
    if len(cells.values):
        figures = cells.has(rf"^\s*{FIGURE}\s*$")
        last_label = np.full(cells.count, -1)
        places = np.flatnonzero(~figures)
        last_label[cells.parent[places]] = places
        behind = np.cumsum(cells.per_text()).astype(int) - 1 - last_label
        rows[ending] = (last_label >= 0) & (behind >= 2) & (behind >= cells.per_text(~figures))
    return rows


def _measure(texts: pa.Array, known, classes: np.ndarray) -> dict[str, np.ndarray]:
    """The statistics of a batch; `known` tells which tokens, of which texts, are common words."""
    count = len(texts)
    n_chars = pc.utf8_length(texts).to_numpy().astype(np.int64)
    codes = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
    kinds, owner = classes[codes], np.repeat(np.arange(count, dtype=np.int32), n_chars)
    letters, spaces = np.bincount(owner, kinds == 1, count), np.bincount(owner, kinds == 3, count)
    symbols, solid = np.bincount(owner, kinds == 0, count), n_chars - spaces

    words = _Parts(texts)
    n_words = words.per_text().astype(np.int64)
    longest = np.zeros(count, np.int64)
    if len(words.sizes):
        longest[n_words > 0] = np.maximum.reduceat(words.sizes, (np.cumsum(n_words) - n_words)[n_words > 0])

    lines = _Parts(texts, LINE_BREAK)
    lines.keep(lines.has(r"\S"))
    tokens = _Parts(pc.utf8_lower(lines.values), TOKEN_BREAK)
    line_words, line_of = tokens.per_text(), tokens.parent
    tokens.parent, tokens.count = lines.parent[line_of], count
    common = known(tokens.values, tokens.parent)
    line_common = np.bincount(line_of, common, len(lines.values))
    n_lines, n_tokens = lines.per_text(), tokens.per_text()
    lines.values = pc.utf8_rtrim(lines.values, " ")

    row, bullet, ended = _rows(lines), lines.has(BULLET), lines.has(SENTENCE_END)
    marked = bullet | lines.has(CONTENTS) | lines.has(REFERENCE)
    parts = pc.count_substring_regex(lines.values, r"[;,•|]\s").to_numpy() + 1
    short = (line_words <= OWN["entry_words_max"]) & ~ended
    bare = short & ((line_common <= OWN["entry_common_max"] * line_words) | (line_words <= OWN["short_entry_words_max"]))
    inline = (parts >= OWN["inline_parts_min"]) & (line_words <= OWN["inline_words_max"] * parts)
    inline[inline] = ~pc.match_substring_regex(lines.values.filter(pa.array(inline)), INNER_SENTENCE).to_numpy(zero_copy_only=False)
    entry = ~row & (marked | inline | ((n_lines >= OWN["entries_count_min"])[lines.parent] & bare))
    held = lines.per_text(lines.sizes)

    segments = _Parts(texts, SEGMENT_BREAK)
    segments.values = pc.utf8_trim_whitespace(segments.values)
    segments.sizes = pc.utf8_length(segments.values).to_numpy()
    segments.keep(segments.sizes > 0)
    n_segments, first = segments.per_text(), segments.distinct()
    tagged = texts if not pc.any(pc.match_substring(texts, "<")).as_py() else pc.replace_substring_regex(texts, TAG, "")
    hashes = pc.count_substring_regex(texts, r"#|\.\.\.|…").to_numpy()
    result = {
        "n_chars": n_chars,
        "n_words": n_words,
        "mean_word_len": _share(words.per_text(words.sizes), n_words),
        "max_word_len": longest,
        "symbol_share": _share(symbols, solid),
        "letter_share": _share(letters, solid),
        "n_lines": n_lines,
        "end_punct_share": _share(lines.per_text(ended), n_lines),
        "bullet_share": _share(lines.per_text(bullet), n_lines),
        "ellipsis_share": _share(lines.per_text(lines.has(r"(?:\.\.\.|…)$")), n_lines),
        "short_line_share": _share(lines.per_text(lines.sizes < 30), n_lines),
        "alphabetic_share": _share(words.per_text(words.has(r"\p{L}")), n_words),
        "symbol_word_ratio": _share(hashes, n_words),
        "common_words": np.bincount(tokens.parent, common, count),
        "common_share": _share(np.bincount(tokens.parent, common, count), n_tokens),
        "distinct_share": _share(np.bincount(tokens.parent[tokens.distinct()], minlength=count), n_tokens),
        "duplicate_share": _share(n_segments - np.bincount(segments.parent[first], minlength=count), n_segments),
        "duplicate_char_share": _share(segments.per_text(segments.sizes) - np.bincount(segments.parent[first], segments.sizes[first], count), n_chars),
        "n_segments": n_segments,
        "mean_segment_len": _share(segments.per_text(segments.sizes), n_segments),
        "table_share": _share(lines.per_text(lines.sizes * row), held),
        "entry_share": _share(lines.per_text(lines.sizes * entry), held),
        "marked_share": _share(lines.per_text(lines.sizes * marked), held),
        "sentence_rate": _share(pc.count_substring_regex(texts, FINISHED).to_numpy(), n_words),
        "mojibake_share": _share(pc.count_substring_regex(texts, MOJIBAKE).to_numpy(), solid),
        "tag_share": _share(n_chars - pc.utf8_length(tagged).to_numpy(), n_chars),
        "hex_share": _share(lines.per_text(lines.sizes * lines.has(HEX_LINE)), held),
    }
    return result


def _slices(texts: pa.Array, most_bytes: int = 1 << 23) -> Iterator[tuple[int, int]]:
    """First row and number of rows of slices that hold about so many bytes each, one text at least."""
    sizes = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most_bytes, side="right")))
        yield at, end - at
        at = end


def _as_struct(statistics: dict[str, np.ndarray]) -> pa.StructArray:
    kinds = {"long": np.int64, "double": np.float64}
    return pa.StructArray.from_arrays([pa.array(statistics[name].astype(kinds[kind])) for name, kind in _STATISTICS.items()], list(_STATISTICS))


_SQL_TYPE = "struct<" + ",".join(f"{name}:{kind}" for name, kind in _STATISTICS.items()) + ">"


def text_statistics(df: DataFrame, id_col: str, text_col: str, common_words: DataFrame, word_col: str = "word", max_shipped: int = MAX_SHIPPED_WORDS) -> DataFrame:
    """One row of statistics per text; nothing divides by zero, a null text counts as empty.

    Up to `max_shipped` common words travel with the tasks; of a longer list each text gets
    those that it holds, by a join. Both ways give the same statistics.
    """
    base = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    listed = common_words.select(F.lower(word_col).alias("word")).where("word is not null").distinct()
    shipped = [r.word for r in listed.limit(max_shipped + 1).collect()]
    if len(shipped) > max_shipped:
        return _with_joined_words(base, listed)

    @F.arrow_udf(_SQL_TYPE)
    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        classes, words = character_classes(), pa.array(shipped, pa.string())
        for batch in batches:
            parts = [_measure(batch.slice(*rows), lambda tokens, _: pc.is_in(tokens, words).to_numpy(zero_copy_only=False), classes) for rows in _slices(batch)]
            yield _as_struct({name: np.concatenate([p[name] for p in parts]) if parts else np.zeros(0) for name in _STATISTICS})

    # not deterministic in name only: else a filter on the kind would compute all of it again
    return base.select("id", measure.asNondeterministic()("text").alias("s")).select("id", "s.*")


def _with_joined_words(base: DataFrame, listed: DataFrame) -> DataFrame:
    @F.arrow_udf("array<string>")
    def tokens_of(texts: pa.Array) -> pa.Array:
        tokens = _Parts(pc.utf8_lower(texts), TOKEN_BREAK)
        kept = np.sort(tokens.distinct())
        offsets = np.r_[0, np.cumsum(np.bincount(tokens.parent[kept], minlength=len(texts)))]
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), tokens.values.take(pa.array(kept)))

    @F.arrow_udf(_SQL_TYPE)
    def measure(texts: pa.Array, words: pa.Array) -> pa.Array:
        own = pc.fill_null(words, pa.scalar([], words.type))
        pairs = {(i, w) for i, list_ in enumerate(own.to_pylist()) for w in list_}
        return _as_struct(_measure(texts, lambda tokens, parent: np.array([p in pairs for p in zip(parent.tolist(), tokens.to_pylist())], bool), character_classes()))

    texts = base.select("text").distinct().withColumn("key", F.md5("text"))
    held = texts.select("key", F.explode(tokens_of("text")).alias("word")).join(listed, "word").groupBy("key").agg(F.collect_set("word").alias("words"))
    joined = base.withColumn("key", F.md5("text")).join(held, "key", "left")
    return joined.select("id", measure.asNondeterministic()("text", "words").alias("s")).select("id", "s.*")


def published_rules() -> dict[str, Column]:
    """The published rules, each a test of a text that fails it."""
    c, limit = F.col, PUBLISHED
    return {
        "gopher_word_count": ~c("n_words").between(limit["gopher_words_min"], limit["gopher_words_max"]),
        "gopher_mean_word_length": ~c("mean_word_len").between(limit["gopher_mean_word_min"], limit["gopher_mean_word_max"]),
        "gopher_symbols": c("symbol_word_ratio") > limit["gopher_symbols_max"],
        "gopher_bullets": c("bullet_share") > limit["gopher_bullets_max"],
        "gopher_ellipsis": c("ellipsis_share") > limit["gopher_ellipsis_max"],
        "gopher_alphabetic_words": c("alphabetic_share") < limit["gopher_alphabetic_min"],
        "gopher_stop_words": c("common_words") < limit["gopher_stop_words_min"],
        "gopher_duplicates": c("duplicate_share") > limit["gopher_duplicates_max"],
        "gopher_duplicate_chars": c("duplicate_char_share") > limit["gopher_duplicate_chars_max"],
        "fineweb_line_punctuation": c("end_punct_share") <= limit["fineweb_punctuation_min"],
        "fineweb_short_lines": c("short_line_share") >= limit["fineweb_short_lines_max"],
        "fineweb_duplicate_chars": c("duplicate_char_share") >= limit["fineweb_duplicate_chars_max"],
    }


def kind_rules() -> dict[str, Column]:
    """The rules that decide a text's kind, in their order: published ones where they can tell, else own ones."""
    c, own, rule = F.col, OWN, published_rules()
    bare = (c("n_segments") >= own["segments_min"]) & (c("marked_share") < own["entries_min"])
    table, some, entries = c("table_share") >= own["table_min"], c("n_words") >= own["words_min"], c("entry_share") >= own["entries_min"]
    return {
        "junk:blank": c("n_words") == 0,
        "junk:few_letters": (c("letter_share") < own["letters_min"]) & ~table & (c("marked_share") < own["entries_min"]),
        "junk:hex": c("hex_share") > own["hex_max"],
        "junk:mojibake": c("mojibake_share") > own["mojibake_max"],
        "junk:markup": c("tag_share") > own["tags_max"],
        "junk:gopher_mean_word_length": rule["gopher_mean_word_length"] & (some | (c("mean_word_len") > own["word_max"])) & ~table & (c("marked_share") < own["entries_min"]),
        "junk:gopher_duplicates": rule["gopher_duplicates"] & (c("duplicate_share") > own["duplicates_max"]) & bare & ~table,
        "junk:fineweb_lines": rule["fineweb_duplicate_chars"] & rule["fineweb_line_punctuation"] & (c("mean_segment_len") < own["segment_max"]) & bare & ~table,
        "junk:repeated_words": (c("distinct_share") * own["repeats_min"] <= 1) & (c("distinct_share") * c("n_words") <= own["repeated_words_max"]) & ~table,
        "junk:no_common_words": (c("common_share") < own["common_min"]) & some & ~table & ~entries,
        "table:rows": table,
        "list:unfinished_lines": (c("n_lines") >= own["unfinished_lines_min"]) & (c("sentence_rate") == 0) & (c("end_punct_share") == 0) & (c("n_words") <= own["unfinished_words_max"] * c("n_lines")),
        "list:entries": entries & ((c("marked_share") >= own["entries_min"]) | (c("sentence_rate") < own["sentence_rate_max"]) | (c("common_share") < own["list_common_max"])),
    }


def _failed(rules: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]))


def text_quality(df: DataFrame, id_col: str, text_col: str, common_words: DataFrame, word_col: str = "word", max_shipped: int = MAX_SHIPPED_WORDS) -> DataFrame:
    """The statistics with `published`, the published rules failed, `reasons`, the deciding rules failed, and `kind`.

    kind is `junk`, `table` or `list` by the first of `reasons`, else `prose`. One row per
    input row, also for repeated ones; a null text is judged like an empty one (junk); texts
    of any length are read whole; other columns are ignored; an empty list of common words
    leaves every word uncommon.
    """
    judged = text_statistics(df, id_col, text_col, common_words, word_col, max_shipped)
    judged = judged.withColumn("published", _failed(published_rules())).withColumn("reasons", _failed(kind_rules()))
    return judged.withColumn("kind", F.coalesce(F.split(F.get("reasons", F.lit(0)), ":")[0], F.lit("prose")))
