"""Draws as a table: draw, s, o of an ordered or shuffled list of pairs, and whether the rule holds there."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterable
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hornlake.plans import compile as plan
from hornlake.plans.rule import Rule
from hornlake.sources.folders import rows_of


def dense_index(df: DataFrame, order: list[str], buckets: int = 64) -> DataFrame:
    """Adds `idx`, the place from 0 in the order of the given columns, without sorting in one task.

    The first column's quantiles cut the rows into ranges; a row's place is its range's start and its place in it.
    """
    first = order[0]
    cuts = sorted(set(df.approxQuantile(first, [k / buckets for k in range(1, buckets)], 0.001)))
    bounds = F.array(*(F.lit(c) for c in cuts)) if cuts else F.array().cast("array<double>")
    ranged = df.withColumn("range_", F.size(F.filter(bounds, lambda b: b < F.col(first).cast("double"))))
    counts = ranged.groupBy("range_").agg(F.count("*").alias("n_"))
    starts = counts.select("range_", (F.sum("n_").over(Window.orderBy("range_")) - F.col("n_")).alias("start_"))  # one row a range
    inside = ranged.withColumn("in_", F.row_number().over(Window.partitionBy("range_").orderBy(*order)) - 1)
    return inside.join(starts, "range_").withColumn("idx", (F.col("start_") + F.col("in_")).cast("long")).drop("range_", "in_", "start_")


def shuffled(df: DataFrame, columns: list[str], seed: int) -> DataFrame:
    """Adds `idx`, the place in an order by a hash of the columns: the same on every run and partitioning."""
    keyed = df.withColumn("key_", F.xxhash64(F.lit(seed), *columns))
    return dense_index(keyed, ["key_", *columns]).drop("key_")


def at_places(values: DataFrame, seed: int, places: Callable[[int], Iterable[int]]) -> tuple[int, dict[int, int]]:
    """How many `values` (distinct longs) there are, and those at the places that are asked for of that number, in the order of `shuffled`.

    Values are counted by the first bits of their hashes, and only those beside a place that is asked for are ordered.
    """
    keyed = values.toDF("value").withColumn("key_", F.xxhash64(F.lit(seed), "value")).withColumn("range_", F.shiftright("key_", 48))
    counts = sorted((r["range_"], r["n"]) for r in rows_of(keyed.groupBy("range_").agg(F.count("*").alias("n"))))
    starts = [0, *accumulate(n for _, n in counts)]
    wanted = sorted(set(places(starts[-1])))
    ranges = {place: bisect_right(starts, place) - 1 for place in wanted}
    if not wanted:
        return starts[-1], {}
    listed = values.sparkSession.createDataFrame([(counts[k][0],) for k in set(ranges.values())], "range_ long")
    near: dict[int, list[tuple[int, int]]] = {}
    for r in rows_of(keyed.withColumn("range_", F.col("range_").cast("long")).join(F.broadcast(listed), "range_")):
        near.setdefault(r["range_"], []).append((r["key_"], r["value"]))
    for own in near.values():
        own.sort()
    return starts[-1], {place: near[counts[k][0]][place - starts[k]][1] for place, k in ranges.items()}


def draw_with(n: int, total: int, seed: int, df: DataFrame) -> DataFrame:
    """Draws 1 to n, each an index from 0 to total - 1, any of them again and again."""
    hashed = F.xxhash64(F.lit(seed), F.col("draw"))
    return df.sparkSession.range(1, n + 1).select(F.col("id").alias("draw"), F.pmod(hashed, F.lit(max(1, total))).alias("idx"))


def draw_without(n: int, total: int, df: DataFrame) -> DataFrame:
    """Draws 1 to n in the order of a shuffled index, from its start again after its end."""
    return df.sparkSession.range(1, n + 1).select(F.col("id").alias("draw"), F.pmod(F.col("id") - 1, F.lit(max(1, total))).alias("idx"))


def known_with(indexed: DataFrame, n: int, total: int, seed: int) -> DataFrame:
    """A sample of known size with replacement: n uniform draws."""
    return draw_with(n, total, seed, indexed).join(indexed, "idx")


def known_without(df: DataFrame, columns: list[str], n: int, seed: int) -> DataFrame:
    """A sample of known size without replacement: the n rows lowest in a seeded hash."""
    return df.orderBy(F.xxhash64(F.lit(seed), *columns), *columns).limit(n)


def support_draws(kg: DataFrame, r: Rule, n: int, *, replacement: bool, seed: int, run: int = 0, **options) -> DataFrame:
    """draw, s, o, success: head pairs drawn for the rule; an empty head gives no draws.  Each run has its own order.

    The body is matched from the drawn pairs on, so an estimate costs what its draws do.
    """
    head = kg.filter(F.col("p") == r.head.p).select("s", "o").distinct()
    own = seed * 1_000_003 + run
    indexed = shuffled(head, ["s", "o"], own)
    total = head.count()
    if total == 0:
        return head.select(F.lit(0).cast("long").alias("draw"), "s", "o", F.lit(False).alias("success"))
    index = draw_with(n, total, own, kg) if replacement else draw_without(n, total, kg)
    drawn = index.join(indexed, "idx").select("draw", "s", "o")
    held = plan.supported_pairs(kg, r, among=drawn.select("s", "o"), **options).withColumn("success", F.lit(True))
    return drawn.join(held, ["s", "o"], "left").select("draw", "s", "o", F.coalesce("success", F.lit(False)).alias("success"))


def pair_draws(kg: DataFrame, r: Rule, corrupt: str, n: int, *, seed: int, **options) -> DataFrame:
    """draw, s, o, success: x and y drawn independently from their candidates; success if they are a contradiction."""
    from hornlake.operators.metrics import variable_candidates

    atoms = r.corrupted(corrupt)
    values, totals = [], []
    for k, v in enumerate((r.head.s, r.head.o)):
        found = shuffled(variable_candidates(kg, atoms, v), ["value"], seed + k)
        values.append(found)
        totals.append(found.count())
    if not all(totals):
        return kg.limit(0).select(F.lit(0).cast("long").alias("draw"), "s", "o", F.lit(False).alias("success"))
    x, y = (draw_with(n, total, 7 * seed + k, kg).join(found, "idx").select("draw", F.col("value").alias(end)) for k, (total, found, end) in enumerate(zip(totals, values, "so", strict=True)))
    drawn = x.join(y, "draw")
    held = plan.pca_pairs(kg, r, corrupt, among=drawn.select("s", "o"), **options).withColumn("success", F.lit(True))
    return drawn.join(held, ["s", "o"], "left").select("draw", "s", "o", F.coalesce("success", F.lit(False)).alias("success"))


def seed_side(selection: str, size_x: int, size_y: int, corrupt: str, draw: Column, seed: int) -> Column:
    """Which head variable a beam starts from: 'x' or 'y', by draw where the selection is random."""
    least = "x" if size_x <= size_y else "y"
    other = {"x": "y", "y": "x"}
    fixed = {"Minimum": least, "Maximum": other[least], "Corrupt": corrupt, "NonCorrupt": other[corrupt]}
    if selection in fixed:
        return F.lit(fixed[selection])
    if selection != "Random":
        raise ValueError(f"no selection {selection!r}")
    return F.when(F.xxhash64(F.lit(seed), draw, F.lit("side")) % 2 == 0, "x").otherwise("y")
