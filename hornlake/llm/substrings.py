"""Substring de-duplication by relative Lempel-Ziv parsing of documents against routed reference blocks.

What is to be found are words covered by a window of `size` words that also starts earlier.  Parsing every document
against every block of a cut corpus takes blocks squared steps, so documents are routed to the blocks that can hold
a match.  Each window has an anchor, the first of its runs of `anchor` words with the least hash; equal windows have equal
anchors.  A run of consecutive windows with their anchor at one place is a segment (so its windows all differ), and a
reference block holds all segments of its anchors.

1. Anchors that occur more than once are counted, with partial sums; a filter of fixed size over them travels to the
   workers, so that only segments which may have a match go on.
2. Of equal segments a task sends one, its earliest, with its words.  A block gathers the segments of its anchors,
   equal ones once, and indexes their words by a suffix array; words are compared as such, not by hashes.  Each
   segment is factored greedily: the longest run that the block also has earlier is a factor, and where there is none
   of `size` words the parse goes on by a word.  Windows across factor boundaries are looked up one by one.
3. An anchor with more than `block_segments` different segments is not gathered: its segments are cut into single
   windows, which are spread by their own hashes and compared word by word with the earliest of each.  So no task grows
   with one anchor, and copies of one window are dropped before they are sent.
4. Every segment takes the factors of its class: the earliest those found, each later copy the whole of itself.
   Factors overlap where a passage goes across segments; per document they are merged into duplicate spans.  Only
   documents that may have factors are shuffled, again by a filter of fixed size.

Segments that have 128 bits of hashes (anchor and words) in common are taken to be copies.

Defined results: ids are of an integer type (another one is refused).  Rows are in order of (id, start); rows with
equal ids count as one document, and those without an id as one document after all others.  A row's factors are kept
under its id and a 64-bit hash of its text.  Null and empty texts have no words; the digest is that of no bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hornlake.llm.shared import Marks, discard, marks, prepare, settled, small_batches
from hornlake.llm.words import SLICE, SPACED, Words, mix, slices, spans_hash, words_of

_LAST = 2**63 - 1
#: Windows that a task remembers to have sent.
REMEMBERED = 100_000


def _identity(id_col: str, text_col: str) -> list[Column]:
    """A place in the order of documents, and a hash of the text to tell rows with equal ids apart."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("id"), F.xxhash64(F.col(text_col)).alias("h")]


def _least_of(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n values in a row."""
    width, out = 1, x
    while 2 * width <= n:
        out = np.minimum(out[: len(out) - width], out[width:])
        width *= 2
    if width < n:
        out = np.minimum(out[: len(x) - n + 1], out[n - width : n - width + len(x) - n + 1])
    return out


# Segments


class Segments:
    """The segments of some texts: anchor, hash of the words, text, first word in it, number of windows."""

    def __init__(self, w: Words, size: int, anchor: int):
        total = len(w.hash)
        at = np.arange(max(0, total - size + 1))
        text_of = w.text_of_word()
        valid = np.flatnonzero(at + size <= w.first[text_of[at] + 1]) if len(at) else at
        self.words, self.size = w, size
        if not len(valid):
            self.key = self.mark = np.zeros(0, np.uint64)
            self.text = self.word = self.start = self.n = np.zeros(0, np.int64)
            return
        grams = w.grams(anchor)[0]
        keys = _least_of(grams, size - anchor + 1)[valid]
        text = text_of[valid]
        # A window that begins with its anchor is the last to have it there, even if the next one has an equal one.
        cut = np.flatnonzero((keys[1:] != keys[:-1]) | (text[1:] != text[:-1]) | (grams[valid[:-1]] == keys[:-1])) + 1
        first = np.concatenate([[0], cut])
        self.n = np.diff(np.append(first, len(valid)))
        self.word = valid[first]
        self.key, self.text = keys[first], text[first]
        self.start = self.word - w.first[self.text]
        self.mark = mix(spans_hash(w.hash, self.word, self.word + self.n + size - 1, "word") ^ self.n.astype(np.uint64))

    def spelled(self, which: np.ndarray) -> list[bytes]:
        """The words of segments, joined by spaces."""
        w = self.words
        length = w.end - w.start
        inside = np.repeat(np.arange(len(length)), length)
        spaced = np.full(int(length.sum()) + len(length), 0x20, np.uint8)
        bytes_at = np.arange(len(inside)) + np.repeat(w.start - np.concatenate([[0], np.cumsum(length)[:-1]]), length)
        spaced[np.arange(len(inside)) + inside] = w.data[bytes_at]
        offset = np.concatenate([[0], np.cumsum(length + 1)])
        raw = spaced.tobytes()
        a, b = offset[self.word[which]], offset[self.word[which] + self.n[which] + self.size - 1] - 1
        return [raw[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _anchors(size: int, anchor: int):
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            found, n = np.unique(Segments(words_of(part, "text", SPACED, lower=False), size, anchor).key, return_counts=True)
            yield pa.RecordBatch.from_arrays([_signed(found), pa.array(n)], names=["key", "n"])

    return anchors


def _members(size: int, anchor: int, filtered):
    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, h, text) -> the segments that may have a match."""
        keep = filtered.value
        for part in slices(batches, "text", SLICE):
            s = Segments(words_of(part, "text", SPACED, lower=False), size, anchor)
            at = np.flatnonzero(keep.has(s.key))
            text = s.text[at]
            own = [pa.array(part.column(k).to_numpy()[text]) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([_signed(s.key[at]), _signed(s.mark[at]), *own, pa.array(s.start[at]), pa.array(s.n[at])], names=["key", "mark", "id", "h", "start", "n"])

    return members


class Sent:
    """The earliest place sent of each class (key, mark), in a table of fixed size (8 MB): a class that another one's place has taken is sent again."""

    def __init__(self, log2: int = 18):
        self.shift = np.uint64(64 - log2)
        self.key, self.mark = (np.zeros(1 << log2, np.uint64) for _ in range(2))
        self.id, self.start = (np.full(1 << log2, _LAST, np.int64) for _ in range(2))

    def fresh(self, key: np.ndarray, mark: np.ndarray, ids: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Which are the earliest of their class here and earlier than what was sent of it, in rising order; they are sent now."""
        order = np.lexsort((start, ids, mark, key))
        new = np.append(True, (key[order][1:] != key[order][:-1]) | (mark[order][1:] != mark[order][:-1]))[: len(order)]
        first = np.sort(order[new])
        slot = (mix(key[first] ^ mark[first]) >> self.shift).astype(np.int64)
        late = (self.id[slot] < ids[first]) | (self.id[slot] == ids[first]) & (self.start[slot] <= start[first])
        late &= (self.key[slot] == key[first]) & (self.mark[slot] == mark[first])
        first, (slot, of) = first[~late], np.unique(slot[~late], return_index=True)
        for kept, values in ((self.key, key), (self.mark, mark), (self.id, ids), (self.start, start)):
            kept[slot] = values[first[of]]
        return first


def _classes(size: int, anchor: int, filtered):
    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, h, text) -> segments that may have a match, with their words; a copy only if it is earlier than one sent."""
        keep = filtered.value
        sent = Sent()
        for part in slices(batches, "text", SLICE):
            s = Segments(words_of(part, "text", SPACED, lower=False), size, anchor)
            at = np.flatnonzero(keep.has(s.key))
            ids = part.column(0).to_numpy()[s.text[at]]
            pick = sent.fresh(s.key[at], s.mark[at], ids, s.start[at])
            at = at[pick]
            yield pa.RecordBatch.from_arrays([_signed(s.key[at]), _signed(s.mark[at]), pa.array(ids[pick]), pa.array(s.start[at]), pa.array(s.n[at]), pa.array(s.spelled(at), pa.binary())], names=["key", "mark", "id", "start", "n", "words"])

    return classes


# Parsing


class Index:
    """A suffix array of runs of words: `ids`, one run ending where the next one begins.

    ranks[k][p] numbers the run of 2**k words at p, in order, cut at its run's end; so two places agree for as long as
    their ranks say, and sorting by the last ranks sorts the suffixes.
    """

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        self.ends = np.repeat(np.cumsum(lengths), lengths)
        self.first = np.cumsum(lengths) - lengths
        self.ranks = [ids.astype(np.int64) + 1]
        width = 1
        while width < (lengths.max() if len(lengths) else 0):
            now = self.ranks[-1]
            after = np.zeros_like(now)
            at = np.flatnonzero(np.arange(len(now)) + width < self.ends)
            after[at] = now[at + width]
            self.ranks.append(np.unique(now * (now.max() + 1) + after, return_inverse=True)[1] + 1)
            width *= 2

    def common(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """How many words agree from p and from q on."""
        room = np.minimum(self.ends[p] - p, self.ends[q] - q)
        out = np.zeros(len(p), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            fits = out + (1 << k) <= room
            at = np.where(fits, out, 0)
            out += (fits & (self.ranks[k][p + at] == self.ranks[k][q + at])) << k
        return out

    def earlier(self, order: np.ndarray, size: int) -> np.ndarray:
        """For each place the longest run from there, of `size` words at least, that begins at a place of lower order; else 0.

        The best such place is the nearest of lower order in the suffix array, on one side or the other.
        """
        places = np.flatnonzero(np.arange(len(order)) + size <= self.ends)
        out = np.zeros(len(order), np.int64)
        if len(places) < 2:
            return out
        array = places[np.lexsort((order[places], self.ranks[-1][places]))]
        joined = self.common(array[1:], array[:-1]) >= size
        alone = ~(np.append(False, joined) | np.append(joined, False))
        joined = np.append(False, joined)[~alone]
        array = array[~alone]
        if not len(array):
            return out
        for direction in (1, -1):
            line, linked = (array, joined) if direction == 1 else (array[::-1], np.append(False, joined[1:][::-1]))
            least = order[line]
            near = np.where(linked, np.arange(len(line)) - 1, -1)
            while True:  # between a place and `near` all are of no lower order, so what is near that one comes next
                late = np.flatnonzero((near >= 0) & (least[near] >= least))
                if not len(late):
                    break
                near[late] = near[near[late]]
            has = np.flatnonzero(near >= 0)
            out[line[has]] = np.maximum(out[line[has]], self.common(line[has], line[near[has]]))
        return out


def parse(index: Index, longest: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The greedy factors (place, words) of all runs, then those of windows across factor boundaries that occur earlier."""
    at = index.first
    places, lengths = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    stop = index.ends[at] - size if len(at) else at
    while len(at):
        going = at <= stop
        at, stop = at[going], stop[going]
        n = longest[at]
        places.append(at[n > 0])
        lengths.append(n[n > 0])
        at = at + np.maximum(n, 1)
    place, length = np.concatenate(places), np.concatenate(lengths)
    inside = np.zeros(len(longest) + 1, np.int64)
    np.add.at(inside, place, 1)
    np.add.at(inside, place + length - size + 1, -1)
    across = np.flatnonzero((longest > 0) & (np.cumsum(inside[:-1]) == 0))
    return np.concatenate([place, across]), np.concatenate([length, longest[across]])


def word_numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words of spelled segments as numbers, equal for equal words only, and how many each segment has."""
    lists = pc.split_pattern(column.cast(pa.large_string()), " ")
    numbers = lists.flatten().dictionary_encode().indices.to_numpy()
    return numbers, pc.list_value_length(lists).to_numpy().astype(np.int64)


def _dense(ids: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The rank of each (id, start); ties share one."""
    order = np.lexsort((start, ids))
    new = np.append(True, (ids[order][1:] != ids[order][:-1]) | (start[order][1:] != start[order][:-1]))[: len(order)]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


_FACTORS = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())]))
_FOUND = "key long, mark long, id long, start long, words binary, factors array<struct<at:bigint,n:bigint>>"
_NAMES = ["key", "mark", "id", "start", "words", "factors"]


def _factored(rows: pa.Table, size: int) -> pa.RecordBatch:
    """Classes of whole anchors, sorted by anchor -> their factors, in windows."""
    key = rows.column("key").to_numpy()
    shared = np.zeros(len(key), bool)
    same = key[1:] == key[:-1]
    shared[1:] |= same
    shared[:-1] |= same
    own = np.flatnonzero(shared)
    out: list[list[dict[str, int]]] = [[] for _ in range(len(key))]
    if len(own):
        numbers, lengths = word_numbers(rows.column("words").take(pa.array(own)).combine_chunks())
        index = Index(numbers, lengths)
        run = np.repeat(np.arange(len(own)), lengths)
        offset = np.arange(len(run)) - index.first[run]
        ids, start = (rows.column(c).to_numpy()[own] for c in ("id", "start"))
        place, words = parse(index, index.earlier(_dense(ids[run], start[run] + offset), size), size)
        for r, a, n in zip(own[run[place]].tolist(), offset[place].tolist(), (words - size + 1).tolist(), strict=True):
            out[r].append({"at": a, "n": n})
    n = rows.num_rows
    plain = [rows.column(c).combine_chunks() for c in ("key", "mark", "id", "start")]
    return pa.RecordBatch.from_arrays([*plain, pa.nulls(n, pa.binary()), pa.array(out, _FACTORS)], names=_NAMES)


def _blocks(size: int, most: int):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by key, mark, id and start -> each class once, with its factors, or with its words if its anchor is too common."""

        def spread(rows: pa.Table) -> pa.RecordBatch:
            plain = [rows.column(c).combine_chunks() for c in ("key", "mark", "id", "start", "words")]
            return pa.RecordBatch.from_arrays([*plain, pa.array([[]] * rows.num_rows, _FACTORS)], names=_NAMES)

        held: pa.Table | None = None
        last, common = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, mark = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (mark[1:] != mark[:-1])
            new[0] = last != (key[0], mark[0])
            last = key[-1], mark[-1]
            rows = pa.Table.from_batches([batch]).filter(pa.array(new))
            if common is not None:
                more = int((rows.column("key").to_numpy() == common).sum())
                if more:
                    yield spread(rows.slice(0, more))
                rows = rows.slice(more)
                if not rows.num_rows:
                    continue
                common = None
            held = rows if held is None else pa.concat_tables([held, rows])
            keys = held.column("key").to_numpy()
            done = int(np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))[-1]) if len(keys) else 0
            if done:
                yield _factored(held.slice(0, done), size)
                held = held.slice(done)
            if held.num_rows > most:
                yield spread(held)
                common, held = keys[-1], None
        if held is not None and held.num_rows:
            yield _factored(held, size)

    return blocks


_WINDOW = "hash long, key long, mark long, id long, start long, at long, words binary"


def _windows(size: int):
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments -> their windows; one that an earlier one sent by this task makes a copy comes without words."""
        names = [f.split()[0] for f in _WINDOW.split(", ")]

        def told(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:6]), pa.array(columns[6], pa.binary())], names=names)

        sent: dict[bytes, tuple[int, int]] = {}
        rows: list[tuple] = []
        for batch in batches:
            for part in (batch.slice(k, 500) for k in range(0, batch.num_rows, 500)):
                for key, mark, i, start, words in zip(*(part.column(k).to_pylist() for k in range(5)), strict=True):
                    spelled = words.split(b" ")
                    for at in range(len(spelled) - size + 1):
                        window = b" ".join(spelled[at : at + size])
                        known = sent.get(window)
                        if known is not None and known < (i, start + at):
                            rows.append((0, key, mark, i, start + at, at, None))
                        else:
                            sent[window] = i, start + at
                            digest = int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "little", signed=True)
                            rows.append((digest, key, mark, i, start + at, at, window))
                        if len(rows) == 20_000:
                            yield told(rows)
                            rows = []
                    if len(sent) > REMEMBERED:
                        sent.clear()
        if rows:
            yield told(rows)

    return windows


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows sorted by hash, words, id and start -> a factor of one window for each but the earliest."""
    last = (None, None, None)
    for batch in batches:
        out = []
        for key, mark, i, start, at, words in zip(*(batch.column(k).to_pylist() for k in range(1, 7)), strict=True):
            if words != last[0]:
                last = words, i, start
            elif (i, start) > last[1:]:
                out.append((key, mark, [{"at": at, "n": 1}]))
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], _FACTORS)], names=["key", "mark", "factors"])


# Cleaning


def _touched(filtered, wanted: bool):
    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows whose last column may be (or is not) among the hashes of documents with factors."""
        for batch in batches:
            has = filtered.value.has(batch.column(batch.num_columns - 1).to_numpy().copy()) if batch.num_rows else np.zeros(0, bool)
            yield batch.filter(pa.array(has == wanted))

    return touched


def _cleaned(size: int):
    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """doc_id, text, factors -> the words that stay."""
        for batch in slices(batches, "text", SLICE):
            out = []
            for text, factors in zip(batch.column(1), batch.column(2), strict=True):
                words = (text.as_py() or "").encode().split()
                if factors.as_py():
                    edge = np.zeros(len(words) + 1, np.int64)
                    for f in factors.as_py():
                        edge[f["start"]] += 1
                        edge[f["start"] + f["n"] + size - 1] -= 1
                    stays = np.cumsum(edge[:-1]) == 0
                    left = list(compress(words, stays.tolist()))
                else:
                    left = words
                kept = b" ".join(left)
                out.append((len(words), len(words) - len(left), hashlib.sha256(kept).hexdigest(), kept.decode()))
            columns = [pa.array([x[k] for x in out], kind) for k, kind in enumerate([pa.int64(), pa.int64(), pa.string(), pa.string()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return cleaned


def _untouched(size: int, filtered):
    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """doc_id, text, hash -> the words of rows that can have no factors: told apart and cleaned by one worker."""
        rows = _touched(filtered, False)(batches)
        return _cleaned(size)(pa.RecordBatch.from_arrays([*b.columns[:2], pa.nulls(b.num_rows)], names=["doc_id", "text", "factors"]) for b in rows)

    return untouched


def duplicate_spans(texts: DataFrame, *, size: int, anchor: int, block_segments: int) -> DataFrame:
    """(id, h, text) -> (id, h, start, n): n windows from word `start` on also start earlier.  Spans may overlap."""
    spark = texts.sparkSession
    counts = texts.select("text").mapInArrow(_anchors(size, anchor), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    repeated = settled(counts.filter("n > 1").select("key"), "anchors")
    filtered = spark.sparkContext.broadcast(marks(repeated, "key"))
    discard(repeated)
    classes = texts.mapInArrow(_classes(size, anchor, filtered), "key long, mark long, id long, start long, n long, words binary")
    blocks = classes.repartition("key").sortWithinPartitions("key", "mark", "id", "start")
    found = settled(blocks.mapInArrow(_blocks(size, block_segments), _FOUND), "blocks")
    common = found.filter("words is not null").select("key", "mark", "id", "start", "words")
    windows = settled(common.mapInArrow(_windows(size), _WINDOW), "windows")
    spread = windows.filter("words is not null").repartition("hash").sortWithinPartitions("hash", "words", "id", "start")
    one = F.array(F.struct("at", F.lit(1).cast("long").alias("n")))
    singles = spread.mapInArrow(_later, "key long, mark long, factors array<struct<at:bigint,n:bigint>>").union(windows.filter("words is null").select("key", "mark", one))
    singles = singles.groupBy("key", "mark").agg(F.flatten(F.collect_list("factors")).alias("more"))
    placed = found.select("key", "mark", F.col("id").alias("id_"), F.col("start").alias("start_"), "factors").join(singles, ["key", "mark"], "left")
    members = texts.mapInArrow(_members(size, anchor, filtered), "key long, mark long, id long, h long, start long, n long")
    first = (F.col("id") == F.col("id_")) & (F.col("start") == F.col("start_"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("at"), F.col("n")))
    factors = F.when(first, F.concat("factors", F.coalesce("more", F.array().cast("array<struct<at:bigint,n:bigint>>")))).otherwise(whole)
    out = members.join(placed, ["key", "mark"]).select("id", "h", "start", F.explode(factors).alias("f"))
    out = settled(out.select("id", "h", (F.col("start") + F.col("f.at")).alias("start"), F.col("f.n").alias("n")), "factors")
    discard(found, windows)
    return out


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 20, anchor: int = 8, block_segments: int = 4096) -> DataFrame:
    """id, n_words, n_removed, kept_sha256 and kept (the words that stay, joined by spaces) of every row."""
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be of an integer type")
    spark = docs.sparkSession
    prepare(spark)
    small_batches(spark)
    texts = docs.filter(F.col(text_col).isNotNull()).select(*_identity(id_col, text_col), F.col(text_col).alias("text"))
    factors = duplicate_spans(texts, size=size, anchor=anchor, block_segments=block_segments)
    per_doc = factors.groupBy("id", "h").agg(F.collect_list(F.struct("start", "n")).alias("factors"))
    touched = spark.sparkContext.broadcast(marks(factors.select(F.xxhash64("id", "h").alias("ih")), "ih"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *_identity(id_col, text_col)).withColumn("ih", F.xxhash64("id", "h"))
    joined = rows.mapInArrow(_touched(touched, True), rows.schema).join(per_doc, ["id", "h"], "left").select("doc_id", "text", "factors")
    kind = docs.schema[id_col].dataType.simpleString()
    cleaned = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept string"
    out = joined.mapInArrow(_cleaned(size), cleaned).union(rows.select("doc_id", "text", "ih").mapInArrow(_untouched(size, touched), cleaned))
    return out.withColumnRenamed("doc_id", id_col)
