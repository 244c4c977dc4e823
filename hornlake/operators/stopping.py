"""Stopping rules over an ordered table of draws.

Two have a fixed bound and need no draws (functions/numeric.py).  The others are running windows: the first draw at
which the condition holds, or the last one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hornlake.functions.numeric import chernoff_bound, clt_bound, stop_at, student_quantile

#: The defaults of the heuristic of consecutive repeats.
MAX_REPEATED, MAX_NEW, MAX_DRAWS = 5, 1000, 10_000


def fixed_stops(df: DataFrame, limit: str, total: int, grid: list[tuple[float, float]], min_samples: int) -> DataFrame:
    """accuracy, confidence, bound and stop_n of a rule with a fixed bound; `confidence` is the error probability."""
    bound = {"Chernoff": chernoff_bound, "CLT": clt_bound}[limit]
    rows = [(e, a, float(bound(e, a)), stop_at(bound(e, a), total, min_samples)) for e, a in grid]
    return df.sparkSession.createDataFrame(rows, "accuracy double, confidence double, bound double, stop_n long")


def running(draws: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Adds n, k (successes), repeated (consecutive repeated successes since the last new pair), in draw order.

    A stream is short: its length is bounded by the largest fixed bound or draw limit.
    """
    keys = by or []
    order = Window.partitionBy(*keys).orderBy("draw").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = Window.partitionBy(*keys, "s", "o", "success").orderBy("draw")
    out = draws.withColumn("new_", F.col("success") & (F.row_number().over(seen) == 1))
    out = out.withColumns({"n": F.count("*").over(order), "k": F.count_if("success").over(order), "news": F.count_if("new_").over(order)})
    since = Window.partitionBy(*keys, "news").orderBy("draw")
    return out.withColumn("repeated", F.when(F.col("news") == 0, F.lit(0)).otherwise(F.col("k") - F.min("k").over(since))).drop("new_")


def variance(n: Column, k: Column, total: Column) -> Column:
    """Of the mean, with the correction for a finite population; 0 for a single draw or a total of one."""
    p = k / n
    return F.when((n == 1) | (total == 1), F.lit(0.0)).otherwise(p * (1 - p) / (n - 1) * (total - n) / (total - 1))


def margin(t: Column, variance: Column, n: Column, ci: str = "reference") -> Column:
    """Half the confidence interval.  'reference' divides by the root of n once more, as the rule to be matched does."""
    return t * F.sqrt(variance) / F.sqrt(n) if ci == "reference" else t * F.sqrt(variance)


def student_table(df: DataFrame, upto: int, alphas: list[float], least: int = 1) -> DataFrame:
    """n, confidence, t for all prefixes of `least` to `upto` draws: a bounded table."""
    rows = [(n, a, student_quantile(1 - a / 2, n - 1) if n > 1 else 0.0) for n in range(max(1, least), upto + 1) for a in alphas]
    return df.sparkSession.createDataFrame(rows, "n long, confidence double, t double")


def interval_stops(draws: DataFrame, total: int, grid: list[tuple[float, float]], min_samples: int, longest: int, ci: str = "reference") -> DataFrame:
    """accuracy, confidence, stop_n: the first n at which the margin is at most accuracy times the mean, or `total`."""
    spark = draws.sparkSession
    # No rule stops before the minimum, so quantiles are needed from there on.
    table = student_table(draws, min(longest, total), sorted({a for _, a in grid}), min(min_samples, total, longest))
    configs = spark.createDataFrame(grid, "accuracy double, confidence double")
    run = running(draws).filter(F.col("n") <= total).select("n", "k")
    rows = run.join(F.broadcast(table), "n").join(F.broadcast(configs), "confidence")  # both are parameter tables
    n, k = F.col("n"), F.col("k")
    half = margin(F.col("t"), variance(n, k, F.lit(total)), n, ci)
    stops = (n >= min(min_samples, total)) & ((half <= F.col("accuracy") * (k / n)) | (n == total))
    return rows.groupBy("accuracy", "confidence").agg(F.coalesce(F.min(F.when(stops, n)), F.max("n")).cast("long").alias("stop_n"))


def repeat_stop(draws: DataFrame, total: int, min_samples: int = 0, max_repeated: int = MAX_REPEATED, max_new: int = MAX_NEW, max_draws: int = MAX_DRAWS) -> DataFrame:
    """One row, stop_n, estimation: of the heuristic that stops after too many repeats, new pairs or draws."""
    run = running(draws)
    full = (F.col("n") >= min(min_samples, total)) & ((F.col("repeated") >= max_repeated) | (F.col("k") - F.col("repeated") >= max_new) | (F.col("n") >= max_draws))
    stop = run.agg(F.coalesce(F.min(F.when(full, F.col("n"))), F.max("n")).alias("stop_n"))
    at = run.join(F.broadcast(stop), F.col("n") == F.col("stop_n"))
    return at.select("stop_n", (F.col("k") - F.col("repeated")).alias("estimation"))


def longest_stops(stops: DataFrame, by: list[str]) -> DataFrame:
    """by, stop_n: where a stream of draws ends, when every one of its listeners has stopped."""
    return stops.groupBy(*by).agg(F.max("stop_n").alias("stop_n"))


def block_size(grid: list[tuple[float, float]]) -> int:
    """Draws to make at first: twice the largest fixed bound, to be doubled while a listener goes on."""
    return 2 * math.ceil(max(chernoff_bound(e, a) for e, a in grid))
