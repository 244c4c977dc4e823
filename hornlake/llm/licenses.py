"""License scans with a generalised suffix automaton over the words of licence passages.

The automaton holds every run of words of every passage.  A text's words are streamed through it; after each word its
state is the longest run that ends there and occurs in some passage: the matching statistics.  Runs of `min_match`
words and more are places in passages; places in one passage that go forward in both text and passage, with gaps of
at most `max_gap` words, are chained, each to its best predecessor, and a chain covers a span of the text.  A chain that covers `min_cover` of its
passage names the passage's label; the score is the largest such share, or 1 where a base phrase stands.

Words outside the passages' vocabulary cannot be part of a run, so only stretches of vocabulary words, found by
their hashes, are streamed, whatever the length of the text.  A stretch shorter than `min_match` has no long run.
The automaton's size follows the passages, a parameter, and not the data.

Base places: each occurrence of a phrase's words in a row.  Defined results: null and empty texts have no words, no
places, empty labels and score 0.  The operator's columns replace columns of the same names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hornlake.llm.license_templates import PHRASES, TEMPLATES
from hornlake.llm.shared import prepare
from hornlake.llm.words import ALNUM, Words, slices, text_arrays, words_of


class SuffixAutomaton:
    """Of several sequences: transitions, suffix links, longest lengths, and where each state's runs end."""

    def __init__(self, sequences: list[list[int]]):
        self.step: list[dict[int, int]] = [{}]
        self.link, self.longest = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for number, sequence in enumerate(sequences):
            last = 0
            for place, symbol in enumerate(sequence):
                last = self._extend(last, symbol)
                self.ends[last].add((number, place + 1))
        for state in sorted(range(1, len(self.step)), key=lambda s: -self.longest[s]):
            self.ends[self.link[state]] |= self.ends[state]

    def _state(self, step: dict[int, int], link: int, longest: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.longest.append(longest)
        self.ends.append(set())
        return len(self.step) - 1

    def _split(self, before: int, symbol: int) -> int:
        """The state that holds exactly before's longest run and `symbol`, made by cloning if needed."""
        there = self.step[before][symbol]
        if self.longest[there] == self.longest[before] + 1:
            return there
        clone = self._state(dict(self.step[there]), self.link[there], self.longest[before] + 1)
        self.link[there] = clone
        while before != -1 and self.step[before].get(symbol) == there:
            self.step[before][symbol] = clone
            before = self.link[before]
        return clone

    def _extend(self, last: int, symbol: int) -> int:
        if symbol in self.step[last]:
            return self._split(last, symbol)
        new = self._state({}, 0, self.longest[last] + 1)
        while last != -1 and symbol not in self.step[last]:
            self.step[last][symbol] = new
            last = self.link[last]
        if last != -1:
            self.link[new] = self._split(last, symbol)
        return new

    def statistics(self, symbols: list[int]) -> Iterator[tuple[int, int]]:
        """After each symbol: the state and the length of the longest run that ends there."""
        state = length = 0
        for symbol in symbols:
            while state and symbol not in self.step[state]:
                state = self.link[state]
                length = self.longest[state]
            if symbol in self.step[state]:
                state, length = self.step[state][symbol], length + 1
            yield state, length


class Scanner:
    def __init__(self, phrases: tuple, templates: tuple, min_match: int, max_gap: int, min_cover: float):
        self.min_match, self.max_gap, self.min_cover = min_match, max_gap, min_cover
        texts = [text for _, text in templates]
        w = Words(*text_arrays(pa.array([*texts, *(p for p, _ in phrases)], pa.string())), ALNUM, lower=True)
        self.vocabulary = np.unique(w.hash)
        ids = np.searchsorted(self.vocabulary, w.hash)
        runs = [ids[a:b].tolist() for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        self.labels, self.sizes = [label for label, _ in templates], [len(r) for r in runs[: len(texts)]]
        self.automaton = SuffixAutomaton(runs[: len(texts)])
        self.phrases = [(np.array(run), label) for run, (_, label) in zip(runs[len(texts) :], phrases, strict=True)]
        self.seen = np.zeros(1 << 20, dtype=bool)
        self.seen[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True

    def ids(self, w: Words) -> np.ndarray:
        """Vocabulary numbers of words, -1 for others."""
        out = np.full(len(w.hash), -1, dtype=np.int64)
        at = np.flatnonzero(self.seen[(w.hash >> np.uint64(44)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.vocabulary, w.hash[at]), len(self.vocabulary) - 1)
        same = self.vocabulary[k] == w.hash[at]
        out[at[same]] = k[same]
        return out

    def base(self, w: Words, ids: np.ndarray) -> Iterator[tuple[int, str]]:
        """First word and label of each place of a phrase."""
        last = np.repeat(w.first[1:], w.counts)
        for run, label in self.phrases:
            at = np.flatnonzero(ids == run[0])
            at = at[at + len(run) <= last[at]]
            for j, x in enumerate(run[1:].tolist(), 1):
                at = at[ids[at + j] == x]
            for a in at.tolist():
                yield a, label

    def stretches(self, w: Words, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Runs of at least min_match vocabulary words, none across texts."""
        if not len(ids):
            return
        known = ids >= 0
        begins = known.copy()
        begins[1:] &= ~known[:-1]
        first = w.first[(w.first < len(ids))]
        begins[first] = known[first]
        a = np.flatnonzero(begins)
        stop = np.flatnonzero(~known)
        end = np.append(stop, len(ids))[np.searchsorted(stop, a)]
        end = np.minimum(end, np.repeat(w.first[1:], w.counts)[a])
        for x, y in zip(a[end - a >= self.min_match].tolist(), end[end - a >= self.min_match].tolist(), strict=True):
            yield x, y

    def places(self, ids: list[int], at: int) -> Iterator[tuple[int, int, int, int]]:
        """Passage, text end, passage end and length of each long run that cannot go on to the right."""
        auto = self.automaton
        found = list(auto.statistics(ids))
        for i, (state, length) in enumerate(found):
            if length < self.min_match:
                continue
            after = {(p, e) for p, e in auto.ends[found[i + 1][0]]} if i + 1 < len(found) and found[i + 1][1] > length else set()
            for passage, end in sorted(auto.ends[state]):
                if (passage, end + 1) not in after:
                    yield passage, at + i + 1, end, length

    def chains(self, places: list[tuple[int, int, int, int]]) -> Iterator[tuple[int, int, int, float]]:
        """Passage, first and end word, and covered share of the passage, of the best chains of places.

        Each place takes the predecessor by which most of the passage is covered; chains are read off from the best
        end on, and places of the same stretch of the text that are left over make no chain of their own.
        """
        by_passage: dict[int, list[tuple[int, int, int]]] = {}
        for passage, end, there, length in places:
            by_passage.setdefault(passage, []).append((end, there, length))
        for passage, runs in sorted(by_passage.items()):
            runs.sort()
            reach = self.max_gap + max(length for *_, length in runs)
            covered, first = [length for *_, length in runs], [end - length for end, _, length in runs]
            for i, (end, there, length) in enumerate(runs):
                for j in range(i - 1, -1, -1):
                    end_j, there_j, _ = runs[j]
                    if end - end_j > reach:
                        break
                    if there > there_j and 0 < end - end_j <= length + self.max_gap:
                        n = covered[j] + min(length, there - there_j, end - end_j)
                        if n > covered[i]:
                            covered[i], first[i] = n, first[j]
            taken: list[tuple[int, int]] = []
            for i in sorted(range(len(runs)), key=lambda i: (-covered[i], runs[i])):
                a, b = first[i], runs[i][0]
                k = bisect_left(taken, (a, b))
                if (k == 0 or taken[k - 1][1] <= a) and (k == len(taken) or b <= taken[k][0]):
                    taken.insert(k, (a, b))
                    yield passage, a, b, covered[i] / self.sizes[passage]


@lru_cache(4)
def _scanner(*parameters) -> Scanner:
    return Scanner(*parameters)


_FOUND = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("first", T.LongType()), T.StructField("end", T.LongType()), T.StructField("share", T.DoubleType())]))
_FOUND_ARROW = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))
ADDED = {"n_words": T.LongType(), "n_base": T.LongType(), "first_word": T.LongType(), "last_word": T.LongType(), "base_labels": T.StringType(), "labels": T.StringType(), "score": T.DoubleType(), "spans": _FOUND}


def scan(docs: DataFrame, *, text_col: str = "text", phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, min_match: int = 4, max_gap: int = 8, min_cover: float = 0.7) -> DataFrame:
    """All columns of `docs`, then the columns of ADDED; `spans` are the chains that name a label."""
    prepare(docs.sparkSession)
    docs = docs.drop(*ADDED)
    parameters = (tuple(phrases.items()), tuple(templates), min_match, max_gap, min_cover)
    names = docs.columns

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hornlake.llm.licenses import _scanner

        scanner = _scanner(*parameters)
        for part in slices(batches, text_col):
            w = words_of(part, text_col, ALNUM, lower=True)
            ids, n = scanner.ids(w), part.num_rows
            text_of = w.text_of_word()
            base: list[list[tuple[int, str]]] = [[] for _ in range(n)]
            places: list[list[tuple[int, int, int, int]]] = [[] for _ in range(n)]
            for at, label in scanner.base(w, ids):
                i = int(text_of[at])
                base[i].append((at - int(w.first[i]), label))
            for a, b in scanner.stretches(w, ids):
                i = int(text_of[a])
                places[i] += scanner.places(ids[a:b].tolist(), a - int(w.first[i]))
            rows = []
            for own, runs in zip(base, places, strict=True):
                chains = [(scanner.labels[p], first, end, share) for p, first, end, share in scanner.chains(runs) if share >= min_cover]
                labels = {label for _, label in own}
                starts = [at for at, _ in own]
                rows.append((len(own), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {c[0] for c in chains})), 1.0 if own else max((min(1.0, c[3]) for c in chains), default=0.0), [dict(zip(("label", "first", "end", "share"), c, strict=True)) for c in chains]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), _FOUND_ARROW]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(w.counts.astype(np.int64)), *columns], names=[*names, *ADDED])

    return docs.mapInArrow(scanned, T.StructType([*docs.schema.fields, *(T.StructField(k, v) for k, v in ADDED.items())]))
