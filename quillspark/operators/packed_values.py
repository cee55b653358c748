"""Several values packed in one field: one row per value, with its position.

The grammar tries its alternatives in order at the start of each value and takes the
first that ends at a separator, at a closing bracket or at the end of the field:

    field   <- blank* items
    items   <- (separator / value)*
    value   <- listed / quoted / bracket / bare
    listed  <- an entry of the vocabulary, compared without case, white space free
    quoted  <- quote (escape / doubled quote / other)* quote
    bracket <- "[" items "]"  (also round and curly)
    bare    <- everything up to the next separator

A quote or bracket that does not end there makes the parser go back and read the value
as bare text; the value is then flagged. What was found out about a place of the text (the
value that begins there, where its quote or bracket ends) is kept, so that going back does not
read it again: the time grows in proportion to the text, however malformed it is.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the grammar.
SEPARATORS = r"[;|,\t\r\n\v\f\x85  •‣▪●·；｜，、]|<\s*br\s*(?:/\s*)?>"
QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "«": "»", "`": "`"}
BRACKETS = {"[": "]", "{": "}", "(": ")"}
PLACEHOLDERS = frozenset(
    {
        "-", "--", "---", ".", "..", "...", "?", "n/a", "na", "n.a.", "n.a", "nan", "none", "null", "nil", "<na>", "<null>", "#n/a", "missing", "unknown",
        "not available", "not applicable", "not indexed", "no mesh terms",
    }
)
#: Quotes inside quotes that are resolved; what is enclosed deeper is read as bare text.
MAX_DEPTH = 32

#: Largest vocabulary, in entries that hold a separator or quote, that is sent to every task.
MAX_SHIPPED_ENTRIES = 200_000

_SEPARATOR = re.compile(SEPARATORS, re.I)
_BLANK = re.compile(r"[^\S\t\r\n\v\f\x85\u2028\u2029]*")
_GAP = re.compile(rf"(?:[^\S\t\r\n\v\f\x85\u2028\u2029]|{SEPARATORS})*", re.I)
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|(.))", re.S)
_HEAD_QUOTES = "\"\u201c\u201d"
_HEAD = re.compile(rf"(?:(?!{SEPARATORS})[^{_HEAD_QUOTES}])*", re.I)
_HEAD_END = re.compile(rf"{SEPARATORS}|[{_HEAD_QUOTES}]", re.I)
_SPECIAL = re.compile(rf"{SEPARATORS}|[\"'\u201c\u201d`\u00ab\u00bb\[\]{{}}()\\]", re.I)
_PIECE = re.compile(r"[;|,]|[^;|,]+")
_OPENING = re.compile(rf"{SEPARATORS}|[{re.escape(''.join([*QUOTES, *QUOTES.values(), *BRACKETS, *BRACKETS.values()]))}]", re.I)
_WORD = re.compile(r"\w+")
_MARK = re.compile(r"(?:[-*+–]|\(?\d{1,3}[.)])\s+")


def _tidy(text: str) -> str:
    return " ".join(text.split())


def _unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else {"n": "\n", "t": "\t", "r": "\r"}.get(m[2], m[2]), text)


class Vocabulary:
    """Entries that hold a separator or a quote and therefore could be cut by mistake."""

    def __init__(self, entries: list[str]):
        self.exact: set[str] = set()
        heads: dict[str, list[str]] = {}
        for entry in {_tidy(e) for e in entries if e}:
            if _SPECIAL.search(entry):
                self.exact.add(entry.lower())
                heads.setdefault(_tidy(_HEAD.match(entry)[0]).lower(), []).append(entry)
        self.heads = {
            head: [
                re.compile(r"\s*".join(r"\s+".join(map(re.escape, piece.split())) for piece in _PIECE.findall(entry)), re.I)
                for entry in sorted(found, key=len, reverse=True)
            ]
            for head, found in heads.items()
        }
        # a text that goes on beyond the longest head is none
        words = [head.split() for head in heads]
        longest = max((len(w) for head in words for w in head), default=0) + 4  # lower case may be longer or shorter
        self.head = re.compile(rf"\s*(?:\S{{1,{longest}}}\s*){{0,{max(map(len, words), default=0) + 1}}}")

    def match(self, text: str, at: int, head_end: int) -> int:
        """Where the longest entry that starts here ends, or -1; the head, if it is one, ends at `head_end`."""
        if not self.heads or self.head.match(text, at, head_end).end() < head_end:
            return -1
        for pattern in self.heads.get(_tidy(text[at:head_end]).lower(), ()):
            if found := pattern.match(text, at):
                return found.end()
        return -1


class _Reading:
    """A text being parsed, with what is known about its places."""

    def __init__(self, text: str, vocabulary: Vocabulary, depth: int = 0):
        self.text, self.vocabulary, self.depth = text, vocabulary, depth
        self.head_ends = [m.start() for m in _HEAD_END.finditer(text)]
        self.separators = [at for at in self.head_ends if text[at] not in _HEAD_QUOTES]
        self.places: dict[str, list[int]] = {}
        self.ending: dict[tuple[int, str], bool] = {}
        self.quotes: dict[tuple[str, str], dict[int, int]] = {}
        self.steps: dict[tuple[int, str], tuple] = {}  # by place and closing bracket: end, kind and details of the value
        self.stops: dict[tuple[int, str], int] = {}  # where reading values from there ends

    def _next(self, places: list[int], at: int) -> int:
        i = bisect_left(places, at)
        return places[i] if i < len(places) else len(self.text)

    def _all(self, pattern: str) -> list[int]:
        if pattern not in self.places:
            self.places[pattern] = [m.start() for m in re.finditer(pattern, self.text)]
        return self.places[pattern]

    def _ends(self, at: int, closing: str) -> bool:
        """Whether a value may end here."""
        key = at, closing
        if key not in self.ending:
            at = _BLANK.match(self.text, at).end()
            self.ending[key] = at == len(self.text) or self.text[at] in closing or bool(_SEPARATOR.match(self.text, at))
        return self.ending[key]

    def _skip(self, at: int) -> int:
        """The next place that is neither blank nor a separator."""
        return _GAP.match(self.text, at).end()

    def quote_end(self, at: int, closing: str) -> int:
        """Where the quote that begins here ends, or -1 if it never does at a value's end."""
        text, quote = self.text, QUOTES[self.text[at]]
        known, places = self.quotes.setdefault((quote, closing), {}), self._all(rf"[\\{quote}]")
        passed, at, end = [], self._next(places, at + 1), None
        while end is None:
            passed.append(at)
            if at in known:
                end = known[at]
            elif at == len(text):
                end = -1
            elif text[at] == "\\":
                escape = _ESCAPE.match(text, at)
                at = self._next(places, escape.end() if escape else at + 1)
            elif text[at + 1 : at + 2] == quote and not (quote == "'" and self._ends(at + 2, closing)):
                at = self._next(places, at + 2)
            elif self._ends(at + 1, closing):
                end = at + 1
            else:
                at = self._next(places, at + 1)
        known.update(dict.fromkeys(passed, end))
        return end

    def content(self, at: int, end: int) -> str:
        """What a quote encloses, doubled quotes and escapes resolved."""
        quote, inside = QUOTES[self.text[at]], self.text[at + 1 : end - 1]
        return re.sub(rf"{_ESCAPE.pattern}|({quote}){quote}", lambda m: m[3] or _unescape(m[0]), inside, flags=re.S)

    def _bare_end(self, at: int, closing: str) -> int:
        end = self._next(self.separators, at)
        if closing:
            cut = self._next(self._all(re.escape(closing)), at)
            end = max(at + 1, cut if cut < end and self._ends(cut + 1, "]})") else end)
        return end

    def _try(self, at: int, closing: str) -> tuple[int, str] | None:
        """Note the value that begins here; or tell the place from which reading must be followed first."""
        text, begin = self.text, at
        while True:
            end = self.vocabulary.match(text, at, self._next(self.head_ends, at))
            if end >= 0 and self._ends(end, closing):
                self.steps[begin, closing] = end, "listed", at, None
                return None
            mark = _MARK.match(text, at)
            if not mark or mark.end() == len(text) or _SEPARATOR.match(text, mark.end()):
                break
            at = mark.end()
        first, error = text[at], None
        if first in QUOTES:
            end = self.quote_end(at, closing) if self.depth < MAX_DEPTH else -1
            if end >= 0:
                self.steps[begin, closing] = end, "quoted", at, None
                return None
            error = "quote"
        elif first in BRACKETS:
            inner, error = BRACKETS[first], "bracket"
            if (first == "[" or not closing) and self._next(self._all(re.escape(inner)), at) < len(text):
                inside = self._skip(at + 1)
                if (stop := self.stops.get((inside, inner))) is None:
                    return inside, inner
                if stop < len(text) and self._ends(stop + 1, closing):
                    self.steps[begin, closing] = stop + 1, "bracket", inside, inner
                    return None
        self.steps[begin, closing] = self._bare_end(at, closing), "bare", at, error
        return None

    def _follow(self, at: int, closing: str) -> None:
        """Find where reading values from here ends: at the closing bracket or the end of the text."""
        waiting = [(at, closing, [])]
        while waiting:
            at, closing, passed = waiting.pop()
            inside = None
            while (at, closing) not in self.stops:
                if at >= len(self.text) or self.text[at] in closing:
                    self.stops[at, closing] = at
                    break
                if (at, closing) not in self.steps and (inside := self._try(at, closing)):
                    waiting += [(at, closing, passed), (*inside, [])]
                    break
                passed.append(at)
                at = self._skip(self.steps[at, closing][0])
            if not inside:
                self.stops.update(dict.fromkeys(((p, closing) for p in passed), self.stops[at, closing]))

    def read(self, at: int, values: list) -> int:
        """Add the values that begin at this place, outside of brackets; return where they end."""
        while (at, "") not in self.steps and (inside := self._try(at, "")):
            self._follow(*inside)
        end, kind, *inside = self.steps[at, ""]
        if kind != "bracket":
            self._add(self.steps[at, ""], "", values)
            return end
        waiting = [tuple(inside)]
        while waiting:
            at, closing = waiting.pop()
            while at < len(self.text) and self.text[at] not in closing:
                step = self.steps[at, closing]
                at = self._skip(step[0])
                if step[1] == "bracket":
                    waiting.append((at, closing))
                    at, closing = step[2:]
                else:
                    self._add(step, closing, values)
        return end

    def _add(self, step: tuple, closing: str, values: list) -> None:
        end, kind, at, error = step
        if kind == "listed":
            values.append((_tidy(self.text[at:end]), None))
        elif kind == "bare":
            self._add_bare(_tidy(self.text[at:end]), error, values)
        else:
            content = self.content(at, end)
            tidy = _tidy(content)
            if tidy and (tidy.lower() in self.vocabulary.exact or not _SEPARATOR.search(tidy)):
                values.append((tidy, None))
            elif tidy:
                _parse(content, self.vocabulary, values, self.depth + 1)

    @staticmethod
    def _add_bare(value: str, error: str | None, values: list) -> None:
        if error:
            value = _tidy(value.lstrip("".join(QUOTES)).lstrip("".join(BRACKETS)))
        if value[-1:] in QUOTES and value.count(value[-1]) % 2:
            value, error = _tidy(value[:-1]), "quote"
        elif value[-1:] and value[-1] in "]})" and {v: k for k, v in BRACKETS.items()}[value[-1]] not in value:
            value, error = _tidy(value[:-1]), "bracket"
        if value:
            values.append((value, error))


def _parse(text: str, vocabulary: Vocabulary, values: list, depth: int = 0) -> None:
    reading, at = None, 0
    while True:
        at = _GAP.match(text, at).end()
        if at >= len(text):
            return
        if text[at].isalpha():  # most values: neither enclosed nor the start of a listed entry
            found = _SEPARATOR.search(text, at)
            end = found.start() if found else len(text)
            value = _tidy(text[at:end])
            if value[-1].isalnum() and value.lower() not in vocabulary.heads:
                values.append((value, None))
                at = end
                continue
        if reading is None:
            reading = _Reading(text, vocabulary, depth)
        at = reading.read(at, values)


class Parser:
    def __init__(self, entries: list[str]):
        self.vocabulary = Vocabulary(entries)

    def parse(self, text: str | None) -> list[tuple[str, str | None]]:
        """The values of a field in order, each with an error flag or None."""
        values: list[tuple[str, str | None]] = []
        if text is not None and _tidy(text).lower() not in PLACEHOLDERS:
            _parse(text, self.vocabulary, values)
        return values


_VALUES = pa.struct([("value", pa.string()), ("error", pa.string())])
_SQL_TYPE = "array<struct<value:string,error:string>>"


def _as_lists(parsed: list[list[tuple[str, str | None]]]) -> pa.Array:
    offsets, flat = [0], []
    for values in parsed:
        flat.extend(values)
        offsets.append(len(flat))
    rows = pa.StructArray.from_arrays([pa.array([v for v, _ in flat], pa.string()), pa.array([e for _, e in flat], pa.string())], fields=list(_VALUES))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)


def _special_entries(vocabulary: DataFrame, entry_col: str) -> DataFrame:
    return vocabulary.select(F.col(entry_col).alias("entry")).where(F.col("entry").rlike(f"(?i){_SPECIAL.pattern}")).distinct()


def _key(text: str, at: int = 0) -> str:
    """The head by which the vocabulary is looked up; of an empty head, the first word behind it."""
    if head := _tidy(_HEAD.match(text, at)[0]).lower():
        return head
    word = _WORD.search(text, at)
    return '"' + word[0].casefold() if word else '"'


def _candidate_keys(text: str) -> set[str]:
    """Keys of all places of a text, and of its quoted contents, where the parser may look for an entry."""
    keys: set[str] = set()
    seen, waiting = {text}, [text]
    while waiting:
        text = waiting.pop()
        reading = _Reading(text, Vocabulary([]))
        keys.add(_key(_tidy(text)))
        closings = ["", *(BRACKETS[b] for b in BRACKETS if b in text)]
        for at in {0, *(m.end() for m in _OPENING.finditer(text))}:
            at = _BLANK.match(text, at).end()
            while at < len(text):
                keys.add(_key(text, at))
                if text[at] in QUOTES:
                    contents = {reading.content(at, end) for closing in closings if (end := reading.quote_end(at, closing)) >= 0}
                    waiting.extend(contents - seen)
                    seen |= contents
                mark = _MARK.match(text, at)
                at = mark.end() if mark else len(text)
    return keys


def parse_field(df: DataFrame, field: str, vocabulary: DataFrame | None = None, entry_col: str = "descriptor", into: str = "values", max_shipped: int = MAX_SHIPPED_ENTRIES) -> DataFrame:
    """Add the column `into`: the field's values in order, array<struct<value, error>>.

    A null, empty or placeholder field gives an empty array. Entries of the vocabulary that
    hold a separator or quote are never cut; up to `max_shipped` of them travel with the
    tasks, a larger vocabulary is joined to each record's own candidates instead.
    """
    entries: list[str] = []
    if vocabulary is not None:
        special = _special_entries(vocabulary, entry_col)
        entries = [r.entry for r in special.limit(max_shipped + 1).collect()]
        if len(entries) > max_shipped:
            return _parse_with_joined_entries(df, field, special, into)

    @F.arrow_udf(_SQL_TYPE)
    def parse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        parser = Parser(entries)
        for batch in batches:
            yield _as_lists([parser.parse(x) for x in batch.to_pylist()])

    # not deterministic in name only: else the filter that Spark infers for explode() parses a second time
    return df.withColumn(into, parse.asNondeterministic()(F.col(field)))


def _parse_with_joined_entries(df: DataFrame, field: str, special: DataFrame, into: str) -> DataFrame:
    """For a vocabulary of any size: each distinct field text meets only the entries it may hold.

    Those are the entries with the head of any place where the parser may begin a value, so
    that the result is that of a parser with the whole vocabulary.
    """
    @F.arrow_udf("string")
    def entry_key(entries: pa.Array) -> pa.Array:
        return pa.array([_key(_tidy(e)) for e in entries.to_pylist()], pa.string())

    @F.arrow_udf("array<string>")
    def candidates(texts: pa.Array) -> pa.Array:
        return pa.array([sorted(_candidate_keys(t)) for t in texts.to_pylist()], pa.list_(pa.string()))

    keyed = special.withColumn("key", entry_key("entry"))

    @F.arrow_udf(_SQL_TYPE)
    def parse(texts: pa.Array, listed: pa.Array) -> pa.Array:
        lists = [tuple(sorted(own or ())) for own in listed.to_pylist()]
        parsers = {own: Parser(list(own)) for own in set(lists)}
        return _as_lists([parsers[own].parse(text) for text, own in zip(texts.to_pylist(), lists)])

    texts = df.select(F.col(field).alias("_text")).where(F.col("_text").isNotNull()).distinct()
    listed = (
        texts.withColumn("key", F.explode(candidates("_text"))).join(keyed, "key").groupBy("_text").agg(F.collect_set("entry").alias("_listed"))
    )
    parsed = texts.join(listed, "_text", "left").select("_text", parse("_text", "_listed").alias("_parsed"))
    joined = df.join(parsed, F.col(field) == F.col("_text"), "left")
    return joined.withColumn(into, F.coalesce("_parsed", F.from_json(F.lit("[]"), _SQL_TYPE))).drop("_text", "_parsed")


def split_values(df: DataFrame, id_col: str, field: str, vocabulary: DataFrame | None = None, entry_col: str = "descriptor", max_shipped: int = MAX_SHIPPED_ENTRIES) -> DataFrame:
    """One row (id, pos, value, error) per value of a packed field.

    `pos` counts from 1 over the field's non-empty values; repeats and ties stay, and every
    input row is parsed on its own, so repeated rows give repeated values. Null, empty and
    placeholder fields give no rows; a null id is kept. Other columns, whatever their names,
    are ignored. `error` is null, `quote` or `bracket` where an enclosure never ended.
    """
    narrow = df.select(F.col(id_col).alias("id"), F.col(field).alias("packed"))
    parsed = parse_field(narrow, "packed", vocabulary, entry_col, max_shipped=max_shipped)
    values = parsed.select("id", F.posexplode("values").alias("at", "item"))
    return values.select("id", (F.col("at") + 1).alias("pos"), F.col("item.value").alias("value"), F.col("item.error").alias("error"))
