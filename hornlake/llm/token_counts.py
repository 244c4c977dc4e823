"""Token counts: a broadcast table of frequent pre-tokens' lengths first, worker caches for what it lacks.

The counts are those of the tokenizer's own library.  A byte-level BPE never merges across pre-tokens, so a text
has as many tokens as its pre-tokens have together.  Tier one is a compact table, sent to every worker, of the
lengths of the pre-tokens that are most frequent in the texts.  They are found by a first pass: each task counts
its pre-tokens in a sketch of bounded size and returns those that are frequent in it, and the `table_entries` most
frequent of all are encoded once.  The table's size is bounded by that parameter, never by the data, and it decides on
speed only.  Tier two is a bounded dictionary in each worker; what neither holds is encoded by the library, once,
where it occurs.  Neither texts nor pre-tokens are shuffled; only the tasks' short lists are.

Defined results: a null or empty text has 0 bytes and 0 tokens; a special string inside a text is one token, as by
the library's default; other columns of the input pass through untouched by name.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter as Counts
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornlake.llm.shared import prepare

#: The pre-token pattern of byte-level BPE, with Unicode classes and for ASCII.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
#: Characters whose classes have not changed between Unicode versions; other texts go to the library whole.
STABLE = r"[^\u0000-\u052f\u2010-\u205e\u20a0-\u20bf\u3000-\u9fff\uac00-\ud7a3]"


class Counter:
    """Counts tokens of texts; one per worker process."""

    def __init__(self, path: str, table: dict[str, int], cache_entries: int, longest: int = 64):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.table, self.cache, self.cache_entries, self.longest = table, {}, cache_entries, longest
        self.ascii, self.wide, self.unstable = re.compile(ASCII_PATTERN).findall, regex.compile(PATTERN).findall, re.compile(STABLE).search
        self.specials = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]

    def encoded(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def count(self, text: str) -> int:
        if any(s in text for s in self.specials):
            parts = re.split("|".join(map(re.escape, self.specials)), text)
            return len(parts) - 1 + sum(map(self.count, parts))
        if text.isascii():
            found = self.ascii(text)
        elif self.unstable(text):
            return self.encoded(text)
        else:
            found = self.wide(text)
        lengths = list(map(self.table.get, found))
        if None not in lengths:
            return sum(lengths)
        total, cache = 0, self.cache
        for token, n in zip(found, lengths, strict=True):
            if n is None and (n := cache.get(token)) is None:
                n = self.encoded(token)
                if len(token) <= self.longest:
                    if len(cache) >= self.cache_entries:
                        cache.clear()
                    cache[token] = n
            total += n
        return total


class Sketch:
    """Counts of frequent items in bounded space: beyond `entries` the rarest go, and their count off all others."""

    def __init__(self, entries: int):
        self.entries, self.counts, self.total = entries, Counts(), 0

    def add(self, items: list[str]) -> None:
        self.counts.update(items)
        self.total += len(items)
        if len(self.counts) > 2 * self.entries:
            ranked = self.counts.most_common(self.entries + 1)
            least = ranked.pop()[1]
            self.counts = Counts({item: n - least for item, n in ranked if n > least})

    def frequent(self, share: float, least: int) -> list[tuple[str, int]]:
        return sorted((item, n) for item, n in self.counts.items() if n >= max(least, share * self.total))


def frequent_lengths(docs: DataFrame, path: str, *, text_col: str = "text", table_entries: int = 50_000, sketch_entries: int = 100_000, share: float = 1e-5, least: int = 16, longest: int = 64) -> dict[str, int]:
    """The most frequent pre-tokens of all texts, with their numbers of tokens.

    One that is `share` of a task's pre-tokens, and occurs `least` times there, is frequent in it; so few of a small task are.
    """
    from tokenizers import Tokenizer

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, sketch = pre_tokens(), Sketch(sketch_entries)
        for batch in batches:
            for text in batch.column(0):
                sketch.add(split(text.as_py() or ""))
        found = [(t, n) for t, n in sketch.frequent(share, least) if len(t) <= longest]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.int64()))], names=["token", "n"])

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(sketched, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    tokens = [r["token"] for r in found.orderBy(F.desc("n"), "token").limit(table_entries).collect()]
    encoded = Tokenizer.from_file(path).encode_batch(tokens, add_special_tokens=False)
    return {t: len(e.ids) for t, e in zip(tokens, encoded, strict=True)}


def pre_tokens():
    """A function from a text to its pre-tokens."""
    simple, wide = re.compile(ASCII_PATTERN).findall, regex.compile(PATTERN).findall
    return lambda text: simple(text) if text.isascii() else wide(text)


def packed(table: dict[str, int]) -> tuple[pa.Array, pa.Array]:
    """The table as two arrays: the pre-tokens' bytes end to end, and lengths of two bytes each."""
    return pa.array(list(table), pa.string()), pa.array([min(n, 65535) for n in table.values()], pa.uint16())


def unpacked(table: tuple[pa.Array, pa.Array]) -> dict[str, int]:
    return dict(zip(table[0].to_pylist(), table[1].to_pylist(), strict=True))


@lru_cache(2)
def _worker(path: str, cache_entries: int, table: str) -> Counter:
    return Counter(path, {}, cache_entries)


def token_counts(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, cache_entries: int = 200_000, table_entries: int = 50_000) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row.

    `tokenizer_path` must be readable where the workers run, as an installed package's files are.
    """
    spark = docs.sparkSession
    prepare(spark)
    broadcast = spark.sparkContext.broadcast(packed(frequent_lengths(docs, tokenizer_path, text_col=text_col, table_entries=table_entries)))
    name = uuid.uuid4().hex

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hornlake.llm import token_counts as here

        counter = here._worker(tokenizer_path, cache_entries, name)
        if not counter.table:
            counter.table = here.unpacked(broadcast.value)
        for batch in batches:
            n = [counter.count(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"))
    out = plain.mapInArrow(counted, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
