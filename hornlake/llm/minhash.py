"""Near-duplicate documents: MinHash signatures joined by multi-index Hamming search, links confirmed on full sets.

A document's set holds the hashes of its distinct word shingles.  Its signature has `HASHES` positions of 16 bits,
the low bits of as many minimum hashes; two sets of similarity s differ at each position with probability about 1 - s.
Pairs whose signatures differ at up to `allowed(percent)` positions are found without exception: the positions are
split into chunks, so many that by the pigeonhole principle one of them has at most one error, and each chunk is
entered once for each position that may be wrong, under the hash of the others.

Whole classes of equal sets are represented by one document throughout, named by a hash of its id and text, so that
rows which share an id stay apart; only the final join goes back to all rows.
Within a bucket, candidates are first its document of smallest id against each other (linear); links confirmed on
full sets give components.  The smallest id is the same in most buckets of a family, and often that of the text which
the others were copied from, so that one round connects most of them; which one is taken changes no result.
Buckets whose documents are not yet in one component then compare all their pairs across components by signature, in
blocks of bounded size; what leaves a task is a forest of the near ones.  Its trees are families.  A family's
documents, with their texts, are dealt into blocks of bounded number and bytes, and each pair of blocks is confirmed on
full sets in one task, which again returns a forest.  So every pair within the distance is
either connected or confirmed or refuted, and a large group of near copies never makes all its pairs.

The allowed distance is 4.75 deviations above the mean at the least similarity (24 of 64 positions at 0.85), which
about one pair in a million at that similarity exceeds, and fewer above it.

Defined results: null text and text without words has an empty set, linked with nothing; fewer words than a shingle
make one shingle of all.  Rows with a null id are kept, with themselves (null) as component.  Rows with equal ids are
each judged by their own text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hornlake.llm.components import components, forest
from hornlake.llm.shared import BATCH, discard, prepare, rows_with, settings, settled
from hornlake.llm.streams import whole_groups
from hornlake.llm.words import SLICE, SPACED, Words, mix, slices, words_of

HASHES = 64
BLOCK = 2048
#: Documents and bytes of text in a block of a family; columns of a product.
FAMILY, FAMILY_BYTES, COLUMNS = 768, 4 << 20, 8192
#: Documents in a task that makes keys.
DEALT = 8192

_RNG = np.random.default_rng(77)
_MUL = (_RNG.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_ADD = _RNG.integers(0, 2**32, HASHES, dtype=np.uint32)[:, None]


def allowed(percent: int) -> int:
    """The signature distance up to which pairs are found: the mean at the least similarity and 4.75 deviations more."""
    p = 1 - percent / 100
    return math.ceil(HASHES * p + 4.75 * math.sqrt(HASHES * p * (1 - p)))


def chunks(distance: int) -> list[np.ndarray]:
    """The fewest chunks of which one must have at most one error."""
    return np.array_split(np.arange(HASHES), distance // 2 + 1)


def shingle_sets(w: Words, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    grams, _ = w.grams(n)
    whole = w.whole()
    for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        else:
            yield whole[i : i + 1] if b > a else whole[:0]


def signature(items: np.ndarray) -> np.ndarray:
    x = (items >> np.uint64(32)).astype(np.uint32)[None, :]
    out = np.full(HASHES, 2**32 - 1, dtype=np.uint32)
    for i in range(0, x.shape[1], 4096):
        v = x[:, i : i + 4096] * _MUL
        v += _ADD
        np.minimum(out, v.min(axis=1), out=out)
    return out.astype(np.uint16)


def _sketched(n: int):
    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            counts, one, two, signs = [], [], [], []
            for items in shingle_sets(words_of(part, "text", SPACED, lower=True), n):
                counts.append(len(items))
                one.append(items.sum(dtype=np.uint64))
                two.append(np.bitwise_xor.reduce(mix(items)) if len(items) else np.uint64(0))
                signs.append(signature(items).tobytes() if len(items) else None)
            longs = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (one, two)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(counts, pa.int64()), *longs, pa.array(signs, pa.binary())], names=["id", "row", "th", "n", "h1", "h2", "sig"])

    return sketched


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, HASHES)


def _keys(distance: int):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each chunk and each position of it that may be wrong; columns but the signature go along."""
        for batch in batches:
            for lo in range(0, batch.num_rows, 20_000):
                rows = batch.slice(lo, 20_000)
                s = _signatures(rows.column(rows.schema.get_field_index("sig"))).astype(np.uint64)
                rest = [rows.column(k) for k, name in enumerate(rows.schema.names) if name != "sig"]
                names = [name for name in rows.schema.names if name != "sig"]
                for chunk, part in enumerate(chunks(distance)):
                    for hole in range(len(part)):
                        key = np.full(len(s), chunk * 64 + hole + 1, dtype=np.uint64)
                        for p in np.delete(part, hole):
                            key = mix(key ^ (s[:, p] + np.uint64(0x9E3779B97F4A7C15)))
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *rest], names=["key", *names])

    return keys


def _near(distance: int):
    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs (a, b, sig_a, sig_b) whose signatures are near."""
        for batch in batches:
            if batch.num_rows:
                close = (_signatures(batch.column(2)) != _signatures(batch.column(3))).sum(axis=1) <= distance
                yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(close)) for k in (0, 1)], names=["a", "b"])

    return near


def _across(ids: np.ndarray, comps: np.ndarray, sides: np.ndarray, signs: np.ndarray, same_block: bool, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs of one unit across components; of two blocks only pairs from both."""
    n = len(ids)
    columns = [np.ascontiguousarray(p) for p in signs.T] if n > 48 else []
    step = max(1, (1 << 18) // max(1, n))
    for i in range(0, n, step):
        rows = slice(i, i + step)
        ok = (comps[rows, None] != comps[None, :]) & (ids[rows, None] < ids[None, :])  # each pair once
        if not same_block:
            ok &= sides[rows, None] != sides[None, :]
        if n > 48:  # position by position over the whole block
            errors = np.zeros(ok.shape, np.uint8)
            for p in columns:
                errors += p[rows, None] != p[None, :]
            x, y = np.nonzero(ok & (errors <= distance))
            yield ids[x + i], ids[y]
        else:
            x, y = np.nonzero(ok)
            near = (signs[x + i] != signs[y]).sum(axis=1) <= distance
            yield ids[x[near] + i], ids[y[near]]


def _units(distance: int):
    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A forest of the near pairs of each unit; rows (key, lo, hi, side, id, c, sig) come sorted by unit."""
        for rows, bounds in whole_groups(batches, 3):
            _, lo, hi, side, ids, comps = (rows.column(k).to_numpy() for k in range(6))
            signs = _signatures(rows.column(6))
            out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for a, b in bounds:
                if b - a > 1:
                    pairs = _across(ids[a:b], comps[a:b], side[a:b], signs[a:b], lo[a] == hi[a], distance)
                    out += [forest(*p) for p in pairs] if b - a > 48 else pairs  # a piece's pairs are as many as its cells
            x, y = forest(*(np.concatenate([p[k] for p in out]) for k in (0, 1)))
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    return units


def _similar(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, comps: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The links among the pairs (i, j) of sets, leaving out such as others connect."""
    size = np.array([len(x) for x in sets])
    fits = 100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j])
    i, j = i[fits], j[fits]
    if not len(i):
        return i, j
    one_by_one = 5e-8 * float((size[i] + size[j]).sum()) + 1e-5 * len(i)
    by_product = float(size.sum()) / COLUMNS * 2 * len(sets) ** 2 * COLUMNS / 2e10
    if one_by_one > by_product:
        _, column = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(len(sets)), size)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        common = np.zeros((len(sets), len(sets)), np.float32)
        for first in range(0, int(column[-1]) + 1, COLUMNS):
            part = slice(*np.searchsorted(column, [first, first + COLUMNS]))
            has = np.zeros((len(sets), COLUMNS), np.float32)
            has[row[part], column[part] - first] = 1
            common += has @ has.T
        both = common[i, j].astype(np.int64)
        ok = 100 * both >= percent * (size[i] + size[j] - both)
        return i[ok], j[ok]
    parent = {c: c for c in comps.tolist()}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    found = []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        a, b = root(int(comps[x])), root(int(comps[y]))
        if a != b:
            both = size[x] + size[y] - len(np.union1d(sets[x], sets[y]))
            if 100 * both >= percent * (size[x] + size[y] - both):
                parent[a] = b
                found.append((x, y))
    pairs = np.array(found, dtype=np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _families(n: int, percent: int, distance: int):
    def families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A forest of each unit's links; rows (fam, lo, hi, side, id, c, sig, text) come sorted by unit."""
        for rows, bounds in whole_groups(batches, 3):
            _, lo, hi, side, ids, comps = (rows.column(k).to_numpy() for k in range(6))
            signs = _signatures(rows.column(6))
            out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for a, b in bounds:
                own, comp = ids[a:b], comps[a:b]
                pairs = list(_across(np.arange(b - a), comp, side[a:b], signs[a:b], lo[a] == hi[a], distance))
                i, j = (np.concatenate([np.zeros(0, np.int64), *(p[k] for p in pairs)]) for k in (0, 1))
                if len(i):
                    parts = slices(iter(rows.slice(a, b - a).to_batches()), "text", SLICE)
                    sets = [items for part in parts for items in shingle_sets(words_of(part, "text", SPACED, lower=True), n)]
                    i, j = _similar(sets, i, j, comp, percent)
                    out.append((own[i], own[j]))
            x, y = forest(*(np.concatenate([p[k] for p in out]) for k in (0, 1)))
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    return families


def _confirmed(n: int, percent: int):
    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of pairs (a, b, text_a, text_b) those whose full sets are similar enough."""
        for whole in batches:
            for part in slices(iter([whole]), "text_a", SLICE):
                keep, last, set_b = [], None, None
                for i, set_a in enumerate(shingle_sets(words_of(part, "text_a", SPACED, lower=True), n)):
                    text = part.column(3)[i].as_py()
                    if text != last:
                        one = pa.RecordBatch.from_arrays([pa.array([text])], names=["t"])
                        last, set_b = text, next(shingle_sets(words_of(one, "t", SPACED, lower=True), n))
                    both = len(set_a) + len(set_b)
                    common = both - len(np.union1d(set_a, set_b))
                    keep.append(common > 0 and 100 * common >= percent * (both - common))
                yield pa.RecordBatch.from_arrays([part.column(k).filter(pa.array(keep)) for k in (0, 1)], names=["a", "b"])

    return confirmed


def _links(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are links; texts are read for the documents in them only."""
    texts = rows_with(docs, pairs.select(F.col("a").alias("id")).union(pairs.select("b")), "id", "texts")
    one = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    two = one.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    out = settled(two.mapInArrow(_confirmed(n, percent), "a long, b long").distinct(), "confirmed")
    discard(texts)
    return out


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """id, n_shingles, component_id (smallest id reachable by links), kept (id = component_id) and text_hash (xxhash64) of every row.

    Links join documents whose sets' similarity is at least `percent` / 100.  Ids are of an integer type (another one is refused).
    """
    with settings(docs.sparkSession, spark__sql__execution__arrow__maxBytesPerBatch=str(BATCH)):
        return _near_duplicates(docs, id_col, text_col, shingle, percent)


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    prepare(docs.sparkSession)
    distance = allowed(percent)
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be of an integer type")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("long"), text_col).alias("row"), F.xxhash64(text_col).alias("th"))
    sketch = settled(docs.mapInArrow(_sketched(shingle), "id long, row long, th long, n long, h1 long, h2 long, sig binary"), "sketch")
    first_row = F.min(F.struct("id", "row"))
    classes = sketch.filter("id is not null and n > 0").groupBy("h1", "h2", "n").agg(first_row.alias("top"), F.first("sig").alias("sig"))
    classes = settled(classes.select("h1", "h2", "n", F.col("top.id").alias("least"), F.col("top.row").alias("rep"), "sig"), "classes")
    signs = classes.select(F.col("rep").alias("id"), "least", "sig")
    docs = docs.select(F.col("row").alias("id"), "text")
    tasks = max(1, math.ceil(classes.count() / DEALT))  # hardly a key comes twice in a task, so its sums grow with its keys

    keys = signs.repartition(tasks).mapInArrow(_keys(distance), "key long, id long, least long")
    center = keys.groupBy("key").agg(F.min_by("id", "least").alias("c"), F.count("*").alias("n")).filter("n > 1").select("key", "c")
    star = keys.join(center, "key").filter("id <> c").select(F.col("id").alias("a"), F.col("c").alias("b")).distinct()
    sig_a, sig_b = (signs.select(F.col("id").alias(x), F.col("sig").alias(f"sig_{x}")) for x in "ab")
    tested = settled(star.join(sig_a, "a").join(sig_b, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(_near(distance), "a long, b long"), "star")
    first = _links(tested, docs, shingle, percent)
    comps = components(first)

    signed = settled(signs.join(comps, signs["id"] == comps["node"], "left").select("id", F.coalesce("component", "id").alias("c"), "sig"), "signed")
    keys = signed.repartition(tasks).mapInArrow(_keys(distance), "key long, id long, c long")
    mixed = keys.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("n")).filter("c0 < c1")
    mixed = settled(mixed.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "mixed")
    members = keys.join(mixed, "key").withColumn("side", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select("key", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "id", "c")
    units = members.join(signed.select("id", "sig"), "id").select("key", "lo", "hi", "side", "id", "c", "sig")
    units = units.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "id")
    near = settled(units.mapInArrow(_units(distance), "a long, b long").distinct(), "near")
    final, links = comps, first
    if not near.isEmpty():
        trees = components(near)
        families = settled(trees.select(F.col("node").alias("id"), F.col("component").alias("fam")).union(trees.select("component", "component").distinct()), "families")
        texts = rows_with(docs, families, "id", "texts")
        members = settled(families.join(signed, "id").join(texts, "id").withColumn("bytes", F.octet_length("text")), "members")
        sizes = members.groupBy("fam").agg(F.greatest(F.ceil(F.count("*") / FAMILY), F.ceil(F.sum("bytes") / FAMILY_BYTES)).cast("int").alias("blocks"))
        dealt = members.join(settled(sizes, "sizes"), "fam").withColumn("side", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select("fam", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "id", "c", "sig", "text")
        dealt = dealt.repartition("fam", "lo", "hi").sortWithinPartitions("fam", "lo", "hi", "id")
        links = first.union(dealt.mapInArrow(_families(shingle, percent, distance), "a long, b long"))
        final = components(links)
        discard(members, families, texts)
    group = F.coalesce("component", "rep").alias("group")
    placed = settled(classes.select("h1", "h2", "n", "least", "rep").join(final, classes["rep"] == final["node"], "left").select("h1", "h2", "n", "least", group), "placed")
    smallest = placed.groupBy("group").agg(F.min("least").alias("component_id"))
    placed = settled(placed.join(smallest, "group").select("h1", "h2", "n", "component_id"), "named")
    discard(classes, signed, mixed, tested, near, first)
    named = placed.select(*(F.col(x).alias(f"{x}_") for x in ("h1", "h2", "n")), "component_id")
    rows = sketch.select("id", "th", "n", "h1", "h2").join(named, (F.col("h1") == F.col("h1_")) & (F.col("h2") == F.col("h2_")) & (F.col("n") == F.col("n_")) & F.col("id").isNotNull(), "left")
    component = F.coalesce("component_id", "id")
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), F.col("th").alias("text_hash"))
