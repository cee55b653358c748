"""Oversized texts cut into overlapping pieces at natural boundaries.

A text starts as atomic segments: sentences, the words of sentences over the limit, and
stretches of words over the limit. Adjacent segments wait in a heap by the strength of the
boundary between them; the weakest boundary is merged first, as long as the two together
and the overlap fit the limit. What remains are pieces that end at the strongest boundaries.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Blanks, tabs, line breaks, no-break spaces and their like.
_STRETCH = re.compile(r"\S+")
_SENTENCE_END = re.compile(r"[.!?](?=\s)")

# Boundaries from weak to strong.
FORCED, WORD, CLAUSE, SENTENCE, PARAGRAPH = range(5)
_CUTS = ("forced", "word", "word", "sentence", "sentence")


def _segments(text: str, limit: int, overlap: int, whole: int) -> list[list[int]]:
    """Atomic segments [start, end, strength of the boundary after it], without outer white space.

    Sentences of up to `whole` code points stay whole.
    """
    bounds, at = [], 0
    for m in _SENTENCE_END.finditer(text):
        bounds.append((at, m.end()))
        at = m.end()
    bounds.append((at, len(text)))
    room = max(1, limit - overlap)
    segments: list[list[int]] = []
    for start, end in bounds:
        inner = text[start:end]
        start += len(inner) - len(inner.lstrip())
        end = start + len(inner.strip())
        if start >= end:
            continue
        if end - start <= whole:
            segments.append([start, end, SENTENCE])
        else:
            for word in _STRETCH.finditer(text, start, end):
                a, b = word.span()
                if b - a > whole:
                    segments.extend([x, min(b, x + room), FORCED] for x in range(a, b, room))
                else:
                    segments.append([a, b, 0])
                segments[-1][2] = CLAUSE if text[b - 1] in ",;:)" else WORD
            segments[-1][2] = SENTENCE
    for this, after in zip(segments, segments[1:]):
        if this[2] == SENTENCE and "\n" in text[this[1] : after[0]]:
            this[2] = PARAGRAPH
    return segments


def cut_points(text: str, limit: int, overlap: int, whole: int | None = None) -> list[tuple[int, int, str]]:
    """Cores of the pieces: (start, end, kind of the boundary at the end); text is stripped."""
    segments = _segments(text, limit, overlap, limit if whole is None else whole)
    n = len(segments)
    starts, ends, strength = ([s[i] for s in segments] for i in range(3))
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(strength[i], ends[i + 1] - starts[i], i, i + 1, ends[i + 1]) for i in range(n - 1)]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, size, left, right, end = heapq.heappop(heap)
        if not (alive[left] and right < n and alive[right]) or after[left] != right or ends[right] != end or end - starts[left] != size:
            continue  # one of the two has been merged since
        if size + overlap > limit:
            continue  # sizes only grow: this boundary stays
        ends[left], strength[left], after[left], alive[right] = end, strength[right], after[right], False
        if after[left] < n:
            to = after[left]
            before[to] = left
            heapq.heappush(heap, (strength[left], ends[to] - starts[left], left, to, ends[to]))
        if before[left] >= 0:
            back = before[left]
            heapq.heappush(heap, (strength[back], end - starts[back], back, left, end))
    return [(starts[i], ends[i], _CUTS[strength[i]]) for i in range(n) if alive[i]]


def pieces_of(text: str, limit: int, overlap: int, full_overlap: bool = False) -> list[tuple[int, int, int, str]]:
    """Pieces (start, core start, end, boundary): each repeats the end of the one before."""
    cores = cut_points(text, limit, overlap, max(1, limit - overlap) if full_overlap else limit)
    pieces = []
    for i, (start, end, kind) in enumerate(cores):
        begin = start
        if i:
            low = max(cores[i - 1][0], end - limit, start - overlap)
            begin = max(low, 0)
            if 0 < begin < start and not text[begin - 1].isspace():  # not in the middle of a word, if it can be helped
                gap = next((x for x in range(begin, start) if text[x].isspace()), start)
                begin = gap if text[gap:start].strip() else begin
            while begin < start and text[begin].isspace():
                begin += 1
        pieces.append((begin, start, end, kind if i < len(cores) - 1 else "end"))
    return pieces


_PIECE = "array<struct<piece:int,start:int,core_start:int,end:int,boundary:string,text:string>>"


def split_texts(df: DataFrame, id_col: str, text_col: str, limit: int, overlap: int, full_overlap: bool = False) -> DataFrame:
    """Pieces of every text over `limit` code points, outer white space not counted.

    Rows (id, piece, start, core_start, end, boundary, text): pieces count from 1; offsets are
    code points of the stripped text; a piece repeats text[start:core_start], at most `overlap`
    code points of the end of the piece before; it is never longer than `limit`. The parts
    text[core_start:end] cover everything but white space, in order. `boundary` tells how a
    piece ends: `sentence`, `word`, `forced` (inside a stretch without white space) or `end`.

    A sentence of more than limit - overlap code points leaves less room for the repeated text
    before it, none at all if it is as long as the limit. With `full_overlap` such sentences are
    cut between words instead, so that the overlap is only shortened to begin at a word.

    Null, empty and shorter texts give no rows, texts of any length are cut whole, repeated
    rows give repeated pieces, and other columns are ignored.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") > limit)

    @F.arrow_udf(_PIECE)
    def split(texts: pa.Array) -> pa.Array:
        offsets, rows = [0], []
        for text in texts.to_pylist():
            text = (text or "").strip()
            if len(text) > limit:
                rows.extend((k, a, b, c, kind, text[a:c]) for k, (a, b, c, kind) in enumerate(pieces_of(text, limit, overlap, full_overlap), 1))
            offsets.append(len(rows))
        columns = list(zip(*rows)) or [()] * 6
        kinds = [pa.int32()] * 4 + [pa.string()] * 2
        names = ["piece", "start", "core_start", "end", "boundary", "text"]
        flat = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)

    return narrow.select("id", F.explode(split.asNondeterministic()("text")).alias("p")).select("id", "p.*")


def cut_kinds(pieces: DataFrame, *keys: str) -> DataFrame:
    """The worst boundary that each text needed, as column `cut`: forced, else word, else sentence."""
    rank = F.when(F.col("boundary") == "forced", 2).when(F.col("boundary") == "word", 1).otherwise(0)
    worst = pieces.groupBy(*keys).agg(F.max(rank).alias("worst"))
    return worst.select(*keys, F.element_at(F.array(F.lit("sentence"), F.lit("word"), F.lit("forced")), F.col("worst") + 1).alias("cut"))
