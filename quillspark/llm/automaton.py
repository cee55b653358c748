"""A generalised suffix automaton over the words of test items, built with little memory and kept as flat arrays."""

from __future__ import annotations

import pickle
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A longest run of letters and digits.
WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return [w.casefold() for w in WORD.findall(text or "")]


class _Builder:
    """States of the automaton; the first step out of a state lies in arrays, further ones in a dict of the state."""

    def __init__(self):
        self.label, self.target, self.link, self.length = array("i", [-1]), array("i", [0]), array("i", [-1]), array("i", [0])
        self.more: dict[int, dict[int, int]] = {}

    def step(self, state: int, word: int) -> int:
        if self.label[state] == word:
            return self.target[state]
        more = self.more.get(state)
        return more.get(word, -1) if more else -1

    def _set(self, state: int, word: int, to: int) -> None:
        if self.label[state] in (-1, word):
            self.label[state], self.target[state] = word, to
        else:
            self.more.setdefault(state, {})[word] = to

    def _state(self, length: int) -> int:
        for part, value in ((self.label, -1), (self.target, 0), (self.link, 0), (self.length, length)):
            part.append(value)
        return len(self.length) - 1

    def _split(self, at: int, word: int, known: int) -> int:
        """Give the shorter runs of state `known` a state of their own."""
        own = self._state(self.length[at] + 1)
        self.label[own], self.target[own] = self.label[known], self.target[known]
        if known in self.more:
            self.more[own] = dict(self.more[known])
        self.link[own], self.link[known] = self.link[known], own
        while at >= 0 and self.step(at, word) == known:
            self._set(at, word, own)
            at = self.link[at]
        return own

    def extend(self, sequence: np.ndarray) -> None:
        last = 0
        for word in sequence.tolist():
            known = self.step(last, word)
            if known >= 0:  # the run so far is already there
                last = known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
                continue
            new, at, last = self._state(self.length[last] + 1), last, None
            while at >= 0 and self.step(at, word) < 0:
                self._set(at, word, new)
                at = self.link[at]
            if at >= 0:
                known = self.step(at, word)
                self.link[new] = known if self.length[known] == self.length[at] + 1 else self._split(at, word, known)
            last = new

    def steps(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each state's steps begin, and their words and states, by state and word."""
        label, target = np.asarray(self.label), np.asarray(self.target)
        state = np.flatnonzero(label >= 0)
        extra = np.array([(s, w, t) for s, steps in self.more.items() for w, t in steps.items()], np.int32).reshape(-1, 3)
        state, word, to = np.r_[state, extra[:, 0]], np.r_[label[state], extra[:, 1]], np.r_[target[state], extra[:, 2]]
        order = np.lexsort((word, state))
        first = np.searchsorted(state[order], np.arange(len(label) + 1)).astype(np.int32)
        return first, word[order].astype(np.int32), to[order].astype(np.int32)


class ItemAutomaton:
    """The automaton of a set of items: an id with several texts is one item that all of them belong to.

    Texts of one word are looked up by their word alone. Others are only looked for where two
    words follow each other that do so in some item.
    """

    def __init__(self, state: dict):
        self.state = state
        self.words = pa.StringArray.from_buffers(len(state["word_ends"]) - 1, pa.py_buffer(state["word_ends"]), pa.py_buffer(state["word_bytes"]))
        self.owners, self.sizes = state["owners"].tolist(), dict(zip(state["ids"].tolist(), state["sizes"].tolist()))
        views = ("first", "label", "target", "link", "length", "bearer", "item_first", "items", "least")
        self.views = [memoryview(np.ascontiguousarray(state[name])) for name in views]
        self.single: dict[int, list[int]] = {}
        for own, code in zip(state["single_texts"].tolist(), state["single_codes"].tolist()):
            self.single.setdefault(code, []).append(own)

    @classmethod
    def build(cls, items: list[tuple[int, str]], min_words: int) -> ItemAutomaton:
        codes: dict[str, int] = {}
        texts = dict.fromkeys((item, tuple(codes.setdefault(w, len(codes)) for w in words_of(text))) for item, text in items)
        owners, sequences = [item for item, _ in texts], [np.array(sequence, np.int32) for _, sequence in texts]
        del texts
        builder, lengths = _Builder(), np.array([len(s) for s in sequences], np.int64)
        for sequence in sequences:
            if len(sequence) > 1:
                builder.extend(sequence)
        least = np.minimum(lengths, min_words).astype(np.int32)
        pairs = cls._pairs(builder, sequences, least)
        first, label, target = builder.steps()
        states = len(builder.length)
        item_first = np.searchsorted(pairs[:, 0], np.arange(states + 1)).astype(np.int32)
        link, length = np.asarray(builder.link), np.asarray(builder.length)
        bearer = np.where(np.diff(item_first) > 0, np.arange(states), -1)  # the nearest state up the links that bears items
        for state in np.argsort(length, kind="stable").tolist():
            if bearer[state] < 0 and state:
                bearer[state] = bearer[link[state]]
        sizes: dict[int, int] = {}
        for owner, size in zip(owners, lengths.tolist()):
            sizes[owner] = sizes.get(owner, 0) + size
        encoded = [w.encode() for w in codes]
        follow = [s[:-1].astype(np.int64) * len(codes) + s[1:] for s in sequences if len(s) > 1]
        single = np.flatnonzero(lengths == 1)
        return cls(
            {
                "word_ends": np.cumsum([0, *map(len, encoded)]).astype(np.int32), "word_bytes": b"".join(encoded), "owners": np.array(owners, np.int64), "ids": np.array(list(sizes), np.int64),
                "sizes": np.array(list(sizes.values()), np.int64), "first": first, "label": label, "target": target, "link": link.astype(np.int32), "length": length.astype(np.int32),
                "bearer": bearer.astype(np.int32), "item_first": item_first, "items": pairs[:, 1].astype(np.int32), "least": least, "follow": np.unique(np.concatenate([np.zeros(0, np.int64), *follow])),
                "shortest": int(least[lengths > 1].min(initial=1 << 30)), "single_texts": single, "single_codes": np.array([sequences[i][0] for i in single], np.int64),
            }
        )

    @staticmethod
    def _pairs(builder: _Builder, sequences: list[np.ndarray], least: np.ndarray) -> np.ndarray:
        """(state, text) for all states of each text's runs that count: long ones, or the whole short text."""
        out = array("i")
        for own, sequence in enumerate(sequences):
            if len(sequence) < 2:
                continue
            at, enough, seen = 0, int(least[own]), set()
            for word in sequence.tolist():
                at = builder.step(at, word)
                up = at
                while builder.length[up] >= enough and up not in seen:
                    seen.add(up)
                    out.extend((up, own))
                    up = builder.link[up]
        pairs = np.asarray(out, np.int32).reshape(-1, 2)
        return pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]

    def pack(self) -> bytes:
        return pickle.dumps(self.state, protocol=5)

    @classmethod
    def unpack(cls, packed: bytes) -> ItemAutomaton:
        return cls(pickle.loads(packed))

    def _walk(self, codes: list[int], begin: int, found: dict[int, list[tuple[int, int]]]) -> None:
        """Add the spans of the runs that count within words that follow each other in items."""
        first, label, target, link, length, bearer, item_first, items, least = self.views
        at = run = 0
        for i, code in enumerate(codes, begin):
            while True:
                low, high = first[at], first[at + 1]
                place = low if high - low == 1 else bisect_left(label, code, low, high)
                if place < high and label[place] == code:
                    at, run = target[place], run + 1
                    break
                if not at:
                    run = 0
                    break
                at = link[at]
                run = length[at]
            up = bearer[at] if at else -1
            while up > 0:
                size = run if up == at else length[up]
                for own in items[item_first[up] : item_first[up + 1]]:
                    if size >= least[own]:
                        spans, start = found.setdefault(own, []), i - size + 1
                        while spans and spans[-1][0] >= start:
                            spans.pop()
                        if not spans or spans[-1][1] < i:
                            spans.append((start, i))
                up = bearer[link[up]]

    def leaks(self, tokens: Tokens) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
        """(text, item, spans [first, last] of words) of the runs that count, by text."""
        codes = pc.fill_null(pc.index_in(tokens.distinct, value_set=self.words), -1).to_numpy(zero_copy_only=False)[tokens.indices]
        known, follow = codes >= 0, self.state["follow"]
        pair = known[:-1] & known[1:]
        pair[tokens.starts[(tokens.starts > 0) & (tokens.starts < len(codes))] - 1] = False  # the last word of a text and the first of the next
        at = np.flatnonzero(pair)
        if len(follow):
            keys = codes[at].astype(np.int64) * len(self.words) + codes[at + 1]
            at = at[follow[np.minimum(np.searchsorted(follow, keys), len(follow) - 1)] == keys]
        else:
            at = at[:0]
        breaks = np.flatnonzero(np.diff(at) > 1)
        begins, ends = at[np.r_[0, breaks + 1]] if len(at) else at, at[np.r_[breaks, len(at) - 1]] + 2 if len(at) else at
        long = ends - begins >= self.state["shortest"]
        begins, ends = begins[long], ends[long]
        found: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for text, begin, end in zip(tokens.text_of(begins).tolist(), begins.tolist(), ends.tolist()):
            own: dict[int, list[tuple[int, int]]] = {}
            self._walk(codes[begin:end].tolist(), begin - int(tokens.starts[text]), own)
            for number, spans in own.items():
                found.setdefault(text, {}).setdefault(number, []).extend(spans)
        if self.single:
            places = np.flatnonzero(np.isin(codes, np.array(list(self.single))))
            for text, place in zip(tokens.text_of(places).tolist(), places.tolist()):
                for own in self.single[int(codes[place])]:
                    found.setdefault(text, {}).setdefault(own, []).append((place - int(tokens.starts[text]),) * 2)
        for text in sorted(found):
            by_item: dict[int, list[tuple[int, int]]] = {}
            for own, spans in found[text].items():
                by_item.setdefault(self.owners[own], []).extend(spans)
            for item, spans in by_item.items():
                yield text, item, spans


class Tokens:
    """The words of many texts, each distinct one once."""

    def __init__(self, texts: list[str | None]):
        lists = [WORD.findall(text or "") for text in texts]
        self.counts = np.array([len(words) for words in lists], np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        encoded = pa.array([w for words in lists for w in words], pa.string()).dictionary_encode()
        folded = pa.array([w.casefold() for w in encoded.dictionary.to_pylist()], pa.string())
        self.distinct, self.indices = folded, encoded.indices.to_numpy()

    def text_of(self, places: np.ndarray) -> np.ndarray:
        filled = np.flatnonzero(self.counts)
        return filled[np.searchsorted(self.starts[filled], places, side="right") - 1] if len(filled) else filled
