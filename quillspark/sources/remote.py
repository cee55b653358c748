"""A remote article source: planned into chunks under a cap, read chunk by chunk as partitions.

The client is any object with count(text) -> int, ids(text, limit) -> list and
fetch(ids) -> XML text; the real one needs a network and its key comes from the environment.
"""

from __future__ import annotations

import calendar
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

from quillspark.operators.querytext import search_text

#: Rows that one query may return, ids per fetch, tries and seconds between them.
CAP, BATCH, TRIES, PAUSE = 9_999, 100, 3, 2.0
#: Seconds after every fetch, with and without a key of the source.
PAUSE_WITH_KEY, PAUSE_WITHOUT_KEY = 0.1, 0.34


@dataclass(frozen=True)
class Chunk:
    condition: str
    year: int
    text: str
    found: int
    lost: int = 0


def _narrower(when: dict) -> list[dict]:
    """The next finer time spans: months, weeks, days, six-hour slots, quarter hours."""
    if "minutes" in when:
        return []
    if "hours" in when:
        first, last = when["hours"]
        return [{**when, "hours": (h, h), "minutes": (m, m + 14)} for h in range(first, last + 1) for m in range(0, 60, 15)]
    if "day" in when:
        return [{**when, "hours": (h, h + 5)} for h in range(0, 24, 6)]
    year = when["year"]
    if "date_range" in when:
        start, end = (int(d[-2:]) for d in when["date_range"])
        month = when["of_month"]
        return [{"year": year, "month": month, "day": d} for d in range(start, end + 1)]
    if "month" in when:
        month = when["month"]
        days = calendar.monthrange(year, month)[1]
        return [{"year": year, "of_month": month, "date_range": tuple(f"{year}/{month:02}/{d:02}" for d in (s, min(s + 6, days)))} for s in range(1, days + 1, 7)]
    return [{"year": year, "month": m} for m in range(1, 13)]


def plan_chunks(condition: str, query: str, year: int, count: Callable[[str], int], cap: int = CAP) -> Iterator[Chunk]:
    """Chunks that cover a year: each the coarsest span whose count fits the cap."""
    open_spans = [{"year": year}]
    while open_spans:
        when = open_spans.pop(0)
        text = search_text(query, **{k: v for k, v in when.items() if k != "of_month"})
        found = count(text)
        finer = _narrower(when) if found > cap else []
        if finer:
            open_spans = finer + open_spans
        elif found:
            yield Chunk(condition, year, text, found, max(0, found - cap))


def fetch_chunk(client, text: str, cap: int = CAP, sleep: Callable[[float], None] = time.sleep, after: float = PAUSE_WITHOUT_KEY) -> Iterator[tuple[str | None, str | None]]:
    """(xml, error) of each batch of a chunk's ids, with a pause after each; a batch that keeps failing gives its error."""
    ids = client.ids(text, cap)
    for at in range(0, len(ids), BATCH):
        error = None
        for turn in range(TRIES):
            try:
                fetched = client.fetch(ids[at : at + BATCH])
                sleep(after)
                yield fetched, None
                break
            except Exception as failure:  # whatever the network raises
                error = str(failure)
                if turn + 1 < TRIES:
                    sleep(PAUSE)
        else:
            yield None, error


_CHUNKS = "condition string, file_year int, text string, found long, lost long, error string"
_DOCUMENTS = "condition string, file_year int, found long, xml string, error string"


def plan_documents(work: DataFrame, make_client: Callable, cap: int = CAP, parallel: int = 4) -> DataFrame:
    """The chunks of every condition and year of `work` (condition, query, file_year).

    The counts are asked for in `parallel` tasks. A condition and year whose count fails gives a
    row with the error and no text.
    """

    def plan(batches):
        import pandas as pd

        client = make_client()
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                try:
                    rows += [(c.condition, c.year, c.text, c.found, c.lost, None) for c in plan_chunks(r.condition, r.query, int(r.file_year), client.count, cap)]
                except Exception as failure:  # whatever the network raises
                    rows.append((r.condition, r.file_year, None, None, None, str(failure)))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in _CHUNKS.split(", ")]).astype({"found": "Int64", "lost": "Int64"})

    return work.select("condition", "query", "file_year").repartition(parallel, "condition", "file_year").mapInPandas(plan, _CHUNKS)


def fetch_documents(chunks: DataFrame, make_client: Callable, parallel: int = 4, after: float = PAUSE_WITHOUT_KEY) -> DataFrame:
    """XML documents of all chunks that `plan_documents` gave: (condition, file_year, found, xml, error).

    `parallel` partitions bound the number of connections and each pauses after every fetch, so
    that the source sees at most parallel / after fetches a second. Errors of the plan are kept.
    """

    def fetch(batches):
        import pandas as pd

        client = make_client()
        for batch in batches:
            for row in batch.itertuples():
                parts = fetch_chunk(client, row.text, after=after) if isinstance(row.text, str) else [(None, row.error)]
                rows = [(row.condition, row.file_year, row.found, xml, error) for xml, error in parts]
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in _DOCUMENTS.split(", ")])

    return chunks.repartition(parallel).mapInPandas(fetch, _DOCUMENTS)
