"""Near-duplicate embeddings by spherical-cap filters.

A filter is a direction and the cap of vectors whose product with it exceeds a threshold.  There are `BOOKS` codebooks,
each of 2**bits directions: a random rotation, then a structured product code, whose directions are one choice of a few
random unit vectors from each half of the dimensions.  The threshold is one for all vectors; a random vector exceeds
it for `MEAN` directions of a codebook on average.  Each vector is list-decoded, half by half, to all directions that
it exceeds the threshold for, and to its nearest one.  Vectors that share a filter are compared in double precision.

A vector looks up some ten of the BOOKS * 2**bits directions, whatever the number of vectors; bits grow with its
logarithm, so that a bucket of unlike vectors stays small.  Recall of pairs at cosine 0.98, the least, is 0.99 or more up to
2**20 directions (measured in the tests), and higher above that cosine.

Buckets are counted first, by narrow rows; a filter of fixed size over those with two vectors or more travels to the
workers, and only vectors in them are shuffled.  A bucket of more than `BLOCK` vectors is dealt into blocks, of which each
pair is one task's.  A pair is counted in the least filter that both vectors share, so it counts once.  Equal vectors of
a label are one class with a weight.  Only counts of links and a forest of links leave a task.

Defined results: vectors that are null, zero or have null or non-finite components, and rows without label or id,
link with nothing; a row without id has a null component and is kept.  Vectors of different dimensions never link.
Ids and labels are of integer types (others are refused).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hornlake.llm.components import components, forest
from hornlake.llm.shared import discard, marks, prepare, settled
from hornlake.llm.streams import whole_groups
from hornlake.llm.words import mix

BLOCK = 2048
BOOKS, MEAN = 8, 0.5
#: Buckets up to this size are compared pair by pair, larger ones by matrix products.
SMALL = 48


@lru_cache(32)
def codebook(dim: int, bits: int, book: int, seed: int = 11) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], float]:
    """A rotation, for each half its dimensions and its unit vectors, and the threshold."""
    halves = min(dim, 2)
    each = 2 ** max(1, round(bits / halves))
    rng = np.random.default_rng([seed, dim, bits, book])
    rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    parts = []
    # How the product with a random vector is distributed: a convolution of the halves' distributions.
    grid, density = np.linspace(-1, 1, 4001), np.ones(1)
    for dims in np.array_split(np.arange(dim), halves):
        c = rng.normal(size=(each, len(dims)))
        parts.append((dims, c / np.linalg.norm(c, axis=1, keepdims=True) / math.sqrt(halves)))
        one = np.isclose(np.abs(grid), 1).astype(float) if len(dims) == 1 else np.maximum(1 - grid**2, 1e-12) ** ((len(dims) - 3) / 2)
        density = np.convolve(density, one / one.sum())
    above = np.cumsum(density[::-1])[::-1]
    at = np.searchsorted(-above, -MEAN / each**halves)
    return rotation, parts, float(np.linspace(-1, 1, len(above))[min(at, len(above) - 1)])


def unit_vectors(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def list_decode(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and filters, in order: all whose product with the row exceeds the threshold, and each codebook's nearest."""
    rows, codes = [], []
    for book in range(BOOKS):
        rotation, parts, threshold = codebook(x.shape[1], bits, book)
        y = x @ rotation
        scores = [y[:, dims] @ c.T for dims, c in parts]
        best = [s.max(axis=1) for s in scores]
        least = np.minimum(threshold, sum(best)) - 1e-12
        row, code, got = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
        for k, s in enumerate(scores):  # a beginning is dropped if the best end cannot lift it over the threshold
            rest = sum(best[k + 1 :], np.zeros(len(x)))
            sums = got[:, None] + s[row]
            i, j = np.nonzero(sums >= (least - rest)[row][:, None])
            row, code, got = row[i], code[i] * s.shape[1] + j, sums[i, j]
        rows.append(row)
        codes.append(code * BOOKS + book)
    row, code = np.concatenate(rows), np.concatenate(codes)
    order = np.lexsort((code, row))
    return row[order], code[order]


def _decoded(batch: pa.RecordBatch, bits: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of (ck, k2, rep, cnt, label, dim, v) of one dimension, with rows, filters and buckets."""
    dims = batch.column(5).to_numpy()
    for dim in np.unique(dims).tolist():
        mine = batch.filter(pa.array(dims == dim))
        for lo in range(0, mine.num_rows, 500):
            rows = mine.slice(lo, 500)
            row, code = list_decode(unit_vectors(rows.column(6), dim), bits)
            label = rows.column(4).to_numpy()[row].view(np.uint64)
            yield rows, row, code, mix(mix(mix(label) ^ np.uint64(dim)) + code.astype(np.uint64))


def _buckets(bits: int):
    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, bucket in _decoded(batch, bits):
                found, n = np.unique(bucket, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["bucket", "n"])

    return buckets


_ROW = "bucket long, label long, dim long, code long, ck long, k2 long, rep long, cnt long, codes array<bigint>, v "


def _entries(bits: int, shared):
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each vector and each filter that it may share."""
        for batch in batches:
            for rows, row, code, bucket in _decoded(batch, bits):
                offsets = np.searchsorted(row, np.arange(rows.num_rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(code))
                at = np.flatnonzero(shared.value.has(bucket))
                take = pa.array(row[at])
                head = [pa.array(bucket[at].view(np.int64)), rows.column(4).take(take), rows.column(5).take(take), pa.array(code[at])]
                yield pa.RecordBatch.from_arrays([*head, *(rows.column(k).take(take) for k in range(4)), lists.take(take), rows.column(6).take(take)], names=[f.split()[0] for f in _ROW.split(", ")])

    return entries


def _first_shared(codes: np.ndarray, i: np.ndarray, j: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Whether `own` is the least filter that rows i and j share; codes are padded with negative numbers, unlike ones in each row."""
    out = np.zeros(len(i), bool)
    for lo in range(0, len(i), 8192):
        a, b = codes[i[lo : lo + 8192]], codes[j[lo : lo + 8192]]
        both = (a[:, :, None] == b[:, None, :]).any(axis=2) & (a >= 0)
        out[lo : lo + 8192] = np.where(both, a, np.iinfo(np.int64).max).min(axis=1) == own[lo : lo + 8192]
    return out


def near_pairs(x: np.ndarray, codes: np.ndarray, own: np.ndarray, bounds: list[tuple[int, int]], cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one bucket, rows from `bounds`, that are near and share no lesser filter."""
    sizes = np.array([b - a for a, b in bounds])
    starts = np.array([a for a, _ in bounds])
    for n in np.unique(sizes[(sizes > 1) & (sizes <= SMALL)]).tolist():
        p, q = np.triu_indices(n, 1)
        per = max(1, 100_000 // len(p))
        mine = starts[sizes == n]
        for lo in range(0, len(mine), per):
            i, j = ((mine[lo : lo + per, None] + side[None, :]).ravel() for side in (p, q))
            near = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
            i, j = i[near], j[near]
            first = _first_shared(codes, i, j, own[i])
            yield i[first], j[first]
    for a, b in [bounds[k] for k in np.flatnonzero(sizes > SMALL)]:
        lesser = codes[a:b]
        row, _ = np.nonzero((lesser >= 0) & (lesser < own[a]))
        value, column, n = np.unique(lesser[(lesser >= 0) & (lesser < own[a])], return_inverse=True, return_counts=True)
        several = n[column] > 1
        row, column = row[several], np.unique(column[several], return_inverse=True)[1]
        has = np.zeros((b - a, int(column.max()) + 1 if len(column) else 1), np.float32)
        has[row, column] = 1
        for lo in range(a, b, 256):
            hi = min(b, lo + 256)
            near = (x[lo:hi] @ x[a:b].T >= cosine) & (has[lo - a : hi - a] @ has.T < 0.5)
            i, j = np.nonzero(near)
            keep = i + lo < j + a
            yield i[keep] + lo, j[keep] + a


def _linked(cosine: float):
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (bucket, lo, hi, label, dim, side, code, ck, k2, rep, cnt, codes, v), sorted by the first five -> (ck, k2, n) and links (a, b)."""
        for rows, bounds in whole_groups(batches, 5):
            dims, sides, codes_at = rows.column("dim").to_numpy(), rows.column("side").to_numpy(), rows.column("code").to_numpy()
            ck, k2, rep, cnt = (rows.column(c).to_numpy() for c in ("ck", "k2", "rep", "cnt"))
            whole = rows.column("lo").to_numpy() == rows.column("hi").to_numpy()
            links, counts = [], []
            for dim in np.unique(dims[[a for a, _ in bounds]]).tolist():
                own = [(a, b) for a, b in bounds if dims[a] == dim and b - a > 1]
                at = np.concatenate([np.zeros(0, np.int64), *(np.arange(a, b) for a, b in own)])
                if not len(at):
                    continue
                mine = rows.take(pa.array(at))
                ends = np.cumsum([b - a for a, b in own])
                x = unit_vectors(mine.column("v").combine_chunks(), dim)
                lists = mine.column("codes").combine_chunks()
                n = pc.list_value_length(lists).to_numpy()
                codes = -1 - np.arange(len(at))[:, None] - len(at) * np.arange(n.max())[None, :]
                codes[np.repeat(np.arange(len(at)), n), np.concatenate([np.arange(k) for k in n.tolist()])] = lists.flatten().to_numpy()
                for i, j in near_pairs(x, codes, codes_at[at], list(zip((ends - [b - a for a, b in own]).tolist(), ends.tolist(), strict=True)), cosine):
                    i, j = at[i], at[j]
                    across = whole[i] | (sides[i] != sides[j])
                    i, j = i[across], j[across]
                    if len(i):
                        links.append(forest(rep[i], rep[j]))
                        counts += [(i, cnt[j]), (j, cnt[i])]
            if links:
                a, b = forest(*(np.concatenate([x[k] for x in links]) for k in (0, 1)))
                none = pa.nulls(len(a), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, pa.array(a), pa.array(b)], names=["ck", "k2", "n", "a", "b"])
                which, place = np.unique(np.concatenate([x for x, _ in counts]), return_inverse=True)
                n = np.bincount(place, weights=np.concatenate([w for _, w in counts])).astype(np.int64)
                none = pa.nulls(len(which), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(ck[which]), pa.array(k2[which]), pa.array(n), none, none], names=["ck", "k2", "n", "a", "b"])

    return linked


def filter_bits(vectors: int) -> int:
    """A codebook has about a quarter as many directions as there are vectors, from 2**6 to 2**24."""
    return min(24, max(6, vectors.bit_length() - 2))


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98) -> DataFrame:
    """id, n_links, component_id (smallest id reachable by links) and kept of every row."""
    for c in (id_col, label_col):
        if not isinstance(vectors.schema[c].dataType, T.IntegralType):
            raise TypeError(f"{c} must be of an integer type")
    spark = vectors.sparkSession
    prepare(spark)
    v = F.col(vector_col)
    fine = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), v.alias("v"), F.coalesce(fine, F.lit(False)).alias("fine"))
    # Two hashes, 128 bits, tell classes of equal vectors apart.
    rows = rows.withColumn("ck", F.when(F.col("fine"), F.xxhash64("label", "v"))).withColumn("k2", F.when(F.col("fine"), F.xxhash64(F.lit(7), "v", "label")))
    classes = rows.filter("fine").groupBy("ck", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("cnt"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = settled(classes.select("ck", "k2", "rep", "cnt", "label", F.size("v").cast("long").alias("dim"), "v"), "vectors")
    bits = filter_bits(classes.count())
    counted = classes.mapInArrow(_buckets(bits), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    buckets = settled(counted.filter("n > 1"), "buckets")
    shared = spark.sparkContext.broadcast(marks(buckets, "bucket"))
    entries = classes.mapInArrow(_entries(bits, shared), _ROW + classes.schema["v"].dataType.simpleString())
    large = settled(buckets.filter(F.col("n") > BLOCK).select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "large")
    dealt = entries.join(large, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("side", F.pmod("ck", "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    units = dealt.select("bucket", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "label", "dim", "side", "code", "ck", "k2", "rep", "cnt", "codes", "v")
    units = units.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "label", "dim")
    found = settled(units.mapInArrow(_linked(cosine), "ck long, k2 long, n long, a long, b long"), "found")

    comps = components(found.filter("a is not null").select("a", "b").distinct())
    counts = found.filter("ck is not null").groupBy("ck", "k2").agg(F.sum("n").alias("n"))
    placed = classes.select("ck", "k2", "rep", "cnt").join(counts, ["ck", "k2"], "left").join(comps, F.col("rep") == F.col("node"), "left")
    placed = settled(placed.select(F.col("ck").alias("ck_"), F.col("k2").alias("k2_"), (F.col("cnt") - 1 + F.coalesce("n", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component")), "placed")
    discard(classes, buckets, large, found, comps)
    out = rows.select("id", "ck", "k2").join(placed, (F.col("ck") == F.col("ck_")) & (F.col("k2") == F.col("k2_")), "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
