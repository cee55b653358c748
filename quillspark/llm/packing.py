"""Texts assigned to model inputs of fixed capacity, with as little unused space as possible.

Texts are measured in tokens. One over the capacity is divided into full inputs and a rest;
everything else stays whole. The items are dealt to groups of bounded size, and each group
fills its inputs by minimum bin slack: a bitset holds every sum that the remaining lengths
can reach, the sum nearest to the capacity is taken and traced back to how many items of
each length make it, and that filling is repeated as often as the items allow.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import materialise

#: Most items that are packed together.
GROUP_ITEMS = 65_536
#: Folder of the public tokenizers' vocabulary files, and the byte-level vocabulary used.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"

# Fixed value: how the byte-level vocabulary's own tokenizer splits a text into words.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def token_counter(ranks: bytes | None = None):
    """A function that counts the tokens of many texts; `ranks` is the content of a vocabulary file."""
    import tiktoken

    lines = map(bytes.split, (ranks or (Path(TOKENIZERS) / VOCABULARY).read_bytes()).splitlines())
    encoding = tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks={base64.b64decode(a): int(b) for a, b in lines}, special_tokens={})

    def count_all(texts: list[str | None]) -> list[int]:
        return [len(encoding.encode_ordinary(text)) if text else 0 for text in texts]

    return count_all


def best_filling(counts: list[int], capacity: int) -> dict[int, int]:
    """How many items of each length fill a container closest to its capacity."""
    within = (1 << (capacity + 1)) - 1
    reached, steps = 1, []  # steps: (length, copies taken together, sums reachable before)
    for length in range(capacity, 0, -1):
        left, step = min(counts[length], capacity // length), 1
        while left and not reached >> capacity & 1:
            take = min(step, left)
            steps.append((length, take, reached))
            reached |= (reached << (length * take)) & within
            left, step = left - take, step * 2
        if reached >> capacity & 1:
            break
    total = reached.bit_length() - 1
    filling: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:  # not reachable without this step
            filling[length] = filling.get(length, 0) + take
            total -= length * take
    return filling


def minimum_bin_slack(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item; every length must be between 1 and the capacity."""
    order = np.argsort(-lengths, kind="stable")
    at = np.searchsorted(-lengths[order], -np.arange(capacity + 1), side="left")  # where each length's items begin
    counts = np.bincount(lengths, minlength=capacity + 1).tolist()
    containers = np.empty(len(lengths), np.int64)
    used = 0
    left = len(lengths)
    while left:
        filling = best_filling(counts, capacity)
        times = min(counts[length] // n for length, n in filling.items())
        for length, n in filling.items():
            items = order[at[length] : at[length] + n * times]
            containers[items] = used + np.arange(n * times) % times
            at[length] += n * times
            counts[length] -= n * times
            left -= n * times
        used += times
    return containers


def count_tokens(df: DataFrame, id_col: str, text_col: str, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(row, id, tokens) of each text, `row` a number of its own; a null or empty text has none.

    The driver reads the vocabulary (about a megabyte, fixed) and sends it with the tasks.
    """
    ranks = df.sparkSession.sparkContext.broadcast((Path(folder) / vocabulary).read_bytes())

    @F.arrow_udf("int")
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count = token_counter(ranks.value)
        for batch in batches:
            yield pa.array(count(batch.to_pylist()), pa.int32())

    return df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), tokens.asNondeterministic()(F.col(text_col)).alias("tokens"))


def pack_texts(df: DataFrame, id_col: str, text_col: str, capacity: int = 512, group_items: int = GROUP_ITEMS, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """Where each text goes: (id, piece, first_token, tokens, container, place, filled).

    A text within the capacity is one piece. A longer one is cut into pieces of `capacity`
    tokens and a rest: tokens [first_token, first_token + tokens) of the text. `container`
    names the model input, `place` counts a container's pieces from 1, and `filled` is the
    number of tokens in the container, never over the capacity.

    Null and empty texts have no tokens and give no rows; repeated rows are packed each for
    itself; ties go by id; other columns are ignored; an empty table gives no rows.
    """
    counted = materialise(count_tokens(df, id_col, text_col, folder, vocabulary).where("tokens > 0"))
    groups = max(1, -(-counted.count() // group_items))
    whole = counted.where(F.col("tokens") >= capacity).select("row", "id", F.explode(F.sequence(F.lit(1), F.floor(F.col("tokens") / capacity).cast("int"))).alias("piece"))
    name = F.concat_ws("-", F.lit("full"), "row", "piece")
    full = whole.select("id", "piece", ((F.col("piece") - 1) * capacity).alias("first_token"), F.lit(capacity).alias("tokens"), name.alias("container"), F.lit(1).alias("place"), F.lit(capacity).alias("filled"))

    rests = counted.where(F.col("tokens") % capacity > 0).select("row", "id", (F.floor(F.col("tokens") / capacity) + 1).cast("int").alias("piece"), (F.col("tokens") % capacity).alias("length"))
    dealt = rests.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")).drop("row")

    def pack(key: tuple, items: pa.Table) -> pa.Table:
        items = items.sort_by([("id", "ascending"), ("piece", "ascending"), ("length", "ascending")])
        lengths = items["length"].to_numpy().astype(np.int64)
        containers = minimum_bin_slack(lengths, capacity)
        order = np.argsort(containers, kind="stable")
        first = np.r_[0, np.flatnonzero(np.diff(containers[order])) + 1]
        sizes = np.diff(np.r_[first, len(order)])
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order)) - np.repeat(first, sizes) + 1
        filled = np.bincount(containers, lengths).astype(np.int32)[containers]
        piece = items["piece"].to_numpy()
        names = [f"{key[0].as_py()}-{c}" for c in containers]
        return pa.table({"id": items["id"], "piece": items["piece"], "first_token": pa.array(((piece - 1) * capacity).astype(np.int32)), "tokens": pa.array(lengths.astype(np.int32)), "container": pa.array(names), "place": pa.array(place), "filled": pa.array(filled)})

    kind = dict(counted.dtypes)["id"]
    packed = dealt.groupBy("part").applyInArrow(pack, f"id {kind}, piece int, first_token int, tokens int, container string, place int, filled int")
    return full.unionByName(packed)
