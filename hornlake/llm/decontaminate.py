"""Benchmark decontamination by a prefix-filtered set join.

A window is `size` consecutive words of a benchmark item, or a shorter item whole.  Its shingles are runs of up to
three words.  All shingles are ordered by rarity, their number of occurrences in all documents; a window that is
contained whole must contain its rarest shingle, so the necessary prefix is that one shingle.  Documents are joined
to windows on it; a pair survives if the window, aligned there, lies inside the document (length and positional
bounds) and every word of it agrees.

The index of the windows is broadcast in blocks of items: the items' bytes are summed first, and items are dealt
into as many blocks as keep each under `block_bytes`.  Rarity is counted for the shingles of all blocks in one pass over
the documents; then documents pass the blocks one after another without moving.

Defined results: null and empty texts have no words and no hits; an item without words has no window; equal windows
of several items count for each; an item whose id is null hits words but is not named; the operator's columns
replace columns of the same names, and all other columns stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hornlake.llm.shared import prepare, unused
from hornlake.llm.words import ALNUM, SLICE, Words, slices, text_arrays, words_of

SHINGLE = 3


class Windows:
    """The distinct windows of some items, with their shingles."""

    def __init__(self, ids: list[str | None], texts: list[str | None], size: int):
        self.size, self.ids = size, ids
        w = Words(*text_arrays(pa.array(texts, pa.string())), ALNUM, lower=True)
        found: dict[tuple[int, ...], set[int]] = {}
        for i, (a, b) in enumerate(zip(w.first[:-1], w.first[1:], strict=True)):
            words = w.hash[a:b].tolist()
            for k in range(max(1, len(words) - size + 1) if words else 0):
                found.setdefault(tuple(words[k : k + size]), set()).add(i)
        self.length = np.array([len(x) for x in found], dtype=np.int64)
        self.words = np.zeros((len(found), size), dtype=np.uint64)
        for row, x in zip(self.words, found, strict=True):
            row[: len(x)] = x
        self.items = [sorted(x) for x in found.values()]

    def shingles(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """n, offset, and the hash of each window's n-word shingle there (0 where it has none)."""
        from hornlake.llm.words import spans_hash

        rows = len(self.words)
        flat = self.words.ravel()
        for n in range(1, SHINGLE + 1):
            for at in range(self.size - n + 1):
                start = np.arange(rows) * self.size + at
                fits = (np.minimum(self.length, SHINGLE) == n) & (at + n <= self.length)
                yield n, at, np.where(fits, spans_hash(flat, start, start + n, "word") if rows else 0, 0).astype(np.uint64)


def _lookup(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """A table of which upper bits occur among sorted keys, to pass over most others quickly."""
    bits = max(16, min(22, int(len(keys)).bit_length() + 4))
    seen = np.zeros(1 << bits, dtype=bool)
    seen[(keys >> np.uint64(64 - bits)).astype(np.int64)] = True
    return seen, 64 - bits


def _occurrences(w: Words, n: int, keys: np.ndarray, seen: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Word positions whose n-word shingle is one of the sorted keys, and which key."""
    grams, inside = w.grams(n)
    at = np.flatnonzero(seen[(grams >> np.uint64(shift)).astype(np.int64)] & inside)
    k = np.searchsorted(keys, grams[at])
    k[k == len(keys)] = 0
    same = keys[k] == grams[at]
    return at[same], k[same]


def rarity(texts: DataFrame, shingles: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """How often each of the sorted shingles, by their length, occurs in all documents."""
    broadcast = texts.sparkSession.sparkContext.broadcast({n: (keys, *_lookup(keys)) for n, keys in shingles.items() if len(keys)})

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {n: np.zeros(len(keys), np.int64) for n, (keys, *_) in broadcast.value.items()}
        for part in slices(batches, "text", SLICE):
            w = words_of(part, "text", ALNUM, lower=True)
            for n, (keys, seen, shift) in broadcast.value.items():
                total[n] += np.bincount(_occurrences(w, n, keys, seen, shift)[1], minlength=len(keys))
        for n, counts in total.items():
            k = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), n, np.int64)), pa.array(k), pa.array(counts[k])], names=["n", "k", "count"])

    out = {n: np.zeros(len(keys), np.int64) for n, keys in shingles.items()}
    for row in texts.mapInArrow(counted, "n long, k long, count long").groupBy("n", "k").agg(F.sum("count").alias("count")).toLocalIterator():
        out[row["n"]][row["k"]] = row["count"]
    return out


class Index:
    """Windows by their rarest shingle."""

    def __init__(self, windows: Windows, keys: dict[int, np.ndarray], counts: dict[int, np.ndarray]):
        rows = len(windows.words)
        best, self.size = np.full(rows, np.iinfo(np.int64).max), windows.size
        n_of, at_of, key_of = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.uint64)
        for n, at, h in windows.shingles():
            if not (h != 0).any():
                continue
            k = np.minimum(np.searchsorted(keys[n], h), len(keys[n]) - 1)
            c = np.where(h != 0, counts[n][k], np.iinfo(np.int64).max)
            better = c < best
            best[better], n_of[better], at_of[better], key_of[better] = c[better], n, at, h[better]
        self.words, self.length, self.items, self.ids = windows.words, windows.length, windows.items, windows.ids
        self.at = at_of
        self.by_n = {}
        for n in range(1, SHINGLE + 1):
            mine = np.flatnonzero(n_of == n)
            if len(mine):
                mine = mine[np.argsort(key_of[mine], kind="stable")]
                keys_n, first = np.unique(key_of[mine], return_index=True)
                self.by_n[n] = (keys_n, np.append(first, len(mine)), mine, *_lookup(keys_n))

    def matches(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """First words and windows of all occurrences."""
        starts, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        text_of = w.text_of_word()
        for n, (keys, first, rows, seen, shift) in self.by_n.items():
            at, k = _occurrences(w, n, keys, seen, shift)
            many = first[k + 1] - first[k]
            window = rows[np.repeat(first[k] - np.cumsum(many) + many, many) + np.arange(many.sum())]
            text = np.repeat(text_of[at], many) if len(at) else np.zeros(0, np.int64)
            start = np.repeat(at, many) - self.at[window]
            fits = (start >= w.first[text]) & (start + self.length[window] <= w.first[text + 1]) if len(at) else np.zeros(0, bool)
            start, window = start[fits], window[fits]
            same = np.ones(len(start), bool)
            for j in range(self.size):
                has = j < self.length[window]
                same &= ~has | (w.hash[np.where(has, start + j, 0)] == self.words[window, j]) if len(start) else same
            starts.append(start[same])
            found.append(window[same])
        return np.concatenate(starts), np.concatenate(found)


SPANS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))


def _pass(docs: DataFrame, index: Index) -> DataFrame:
    """Adds what one block of items hits to the last four columns: text, number of words, spans and items."""
    broadcast = docs.sparkSession.sparkContext.broadcast(index)
    names = docs.columns
    at_text, at_words, at_spans, at_items = range(len(names) - 4, len(names))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = broadcast.value
        for part in slices(batches, names[at_text], SLICE):
            w = words_of(part, names[at_text], ALNUM, lower=True)
            start, window = index.matches(w)
            columns = list(part.columns)
            spans, items = columns[at_spans].to_pylist(), columns[at_items].to_pylist()
            if len(start):
                text = w.text_of_word()[start]
                for i in np.unique(text).tolist():
                    mine = text == i
                    first = start[mine] - w.first[i]
                    ends = first + index.length[window[mine]]
                    spans[i] = spans[i] + [{"first": int(a), "end": int(b)} for a, b in sorted({*zip(first.tolist(), ends.tolist(), strict=True)})]
                    items[i] = items[i] + sorted({index.ids[x] for y in set(window[mine].tolist()) for x in index.items[y]} - {None})
            columns[at_spans], columns[at_items] = pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))
            columns[at_words] = pa.array(w.counts.astype(np.int64))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(joined, docs.schema)


def contamination(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", size: int = 10, block_bytes: int = 8 << 20) -> DataFrame:
    """All columns of `docs`, then n_words, hit_spans (merged, in words, end exclusive), n_hit and items (sorted ids as text)."""
    prepare(docs.sparkSession)
    docs = docs.drop("n_words", "hit_spans", "n_hit", "items")
    items = benchmark.select(F.col(item_id_col).cast("string").alias("id"), F.col(item_text_col).alias("text")).filter("text is not null")
    # Each item in a block is bounded too: an index holds the words of its block's items, at most block_bytes and one item.
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes) * (2 if total > block_bytes else 1))
    texts = docs.select(F.col(text_col).alias("text"))
    text_, words_, spans_, items_ = unused(docs, 4)
    out = docs.withColumns({text_: F.col(text_col), words_: F.lit(0).cast("long"), spans_: F.array().cast(SPANS), items_: F.array().cast("array<string>")})
    windows, keys = [], []
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).distinct().orderBy("id", "text").collect()
        windows.append(Windows([r["id"] for r in rows], [r["text"] for r in rows], size))
        found: dict[int, list[np.ndarray]] = {}
        for n, _, h in windows[-1].shingles():
            found.setdefault(n, []).append(h[h != 0])
        keys.append({n: np.unique(np.concatenate(h)) for n, h in found.items()})
    all_keys = {n: np.unique(np.concatenate([k[n] for k in keys])) for n in keys[0]}
    counts = rarity(texts, {n: k for n, k in all_keys.items() if len(k)}) if any(map(len, all_keys.values())) else {}
    for own, key in zip(windows, keys, strict=True):
        out = _pass(out, Index(own, key, {n: counts[n][np.searchsorted(all_keys[n], k)] for n, k in key.items() if len(k)}))
    merged = F.expr(f"""aggregate(array_sort({spans_}), cast(array() as array<struct<first:bigint,end:bigint>>), (m, s) ->
        if(size(m) > 0 and element_at(m, -1).end >= s.first,
           concat(slice(m, 1, size(m) - 1), array(named_struct('first', element_at(m, -1).first, 'end', greatest(element_at(m, -1).end, s.end)))),
           concat(m, array(s))))""")
    return (
        out.withColumn("hit_spans", F.when(F.size(spans_) == 0, F.array().cast(SPANS)).otherwise(merged))
        .withColumn("n_words", F.col(words_))
        .withColumn("n_hit", F.expr("aggregate(hit_spans, 0L, (n, s) -> n + s.end - s.first)"))
        .withColumn("items", F.array_sort(F.array_distinct(items_)))
        .select(*docs.columns, "n_words", "hit_spans", "n_hit", "items")
    )
