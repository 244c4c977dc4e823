"""Estimators of counts from prefixes of draws.

All configurations share one table of draws; a configuration is a row with an estimator's name and its stop_n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hornlake.operators.stopping import margin, running, variance

#: Estimators by kind of draws.
WITH = ["Binomial", "Chao2", "Coverage", "HansenHurwitz", "HorvitzThompsonWith", "Poisson"]
WITHOUT = ["Hypergeometric", "HorvitzThompsonWithout"]
ALL = [*WITH, *WITHOUT, "Chao1", "Jackknife", "HajekWith", "HajekWithout", "AnyBURL"]


def _safe(a: Column, b: Column, otherwise: float = 0.0) -> Column:
    return F.when(b == 0, F.lit(otherwise)).otherwise(a / b)


def formulas() -> dict[str, Column]:
    """By columns n, k, total, t_ (total of the histogram), f1 to f5, sum_q, sum_pi and repeated."""
    c = F.col
    n, k, total, t = c("n"), c("k"), c("total"), c("t_")
    f1, f2 = c("f1"), c("f2")
    some = lambda e: F.when(k == 0, F.lit(0.0)).otherwise(e)
    chao = f1 * f1 / (2 * (f2 + 1))
    seen = 1 - f1 / n
    zero = 1 - F.exp(-2 * f1 / (f2 + 1))
    jackknife = t + 5 * f1 - 10 * c("f2") + 10 * c("f3") - 5 * c("f4") + c("f5")
    ht = c("sum_pi")
    return {
        "Binomial": k / n * total,
        "Hypergeometric": k / n * (total - 1),
        "Chao1": some(t + chao),
        "Chao2": some(t + (n - 1) / n * chao),
        "Coverage": some(t / F.when(seen == 0, F.lit(1.0)).otherwise(seen)),
        "Jackknife": some(jackknife),
        "Poisson": some(_safe(t, zero)),
        "HansenHurwitz": c("sum_q") / n,
        "HorvitzThompsonWith": ht,
        "HorvitzThompsonWithout": ht,
        "HajekWith": ht,
        "HajekWithout": ht,
        "AnyBURL": (k - c("repeated")).cast("double"),
    }


def inclusion(q: Column, n: Column) -> Column:
    """1 / (1 - (1 - 1/q)^n), 0 where that has no value."""
    return _safe(F.lit(1.0), 1 - F.pow(1 - 1 / q, n))


def estimates(draws: DataFrame, configs: DataFrame, total: int, histogram: str = "reference") -> DataFrame:
    """A row for each row of `configs` (config, estimator, stop_n): estimation, n, successes, failures, total, mean and histogram.

    Draws have draw, s, o, success and, for estimators that weigh by it, inv_prob.  The 'reference' histogram sums
    frequencies, so f2 counts each pair seen twice two times and its total is the number of successes; 'textbook'
    counts pairs.
    """
    if "inv_prob" not in draws.columns:
        draws = draws.withColumn("inv_prob", F.lit(None).cast("double"))
    prefixes = configs.select("stop_n").distinct()
    rows = running(draws).join(F.broadcast(prefixes), F.col("draw") <= F.col("stop_n"))  # a parameter table
    wins = rows.filter("success")
    seen = wins.groupBy("stop_n", "s", "o").agg(F.count("*").alias("f"))
    weight = F.col("f") if histogram == "reference" else F.lit(1).cast("long")
    hist = seen.groupBy("stop_n").agg(F.sum(weight).alias("t_"), *(F.coalesce(F.sum(F.when(F.col("f") == i, weight)), F.lit(0)).alias(f"f{i}") for i in range(1, 6)))
    n_of = F.least(F.col("stop_n"), F.col("last_"))
    counts = rows.groupBy("stop_n").agg(F.max("n").alias("last_"), F.count_if("success").alias("k"), F.max_by("repeated", "draw").alias("repeated"))
    counts = counts.withColumn("n", n_of)
    weighed = wins.join(F.broadcast(counts.select("stop_n", F.col("n").alias("n_"))), "stop_n")
    prob = weighed.groupBy("stop_n").agg(F.sum("inv_prob").alias("sum_q"), F.sum(inclusion(F.col("inv_prob"), F.col("n_"))).alias("sum_pi"))
    stats = counts.join(hist, "stop_n", "left").join(prob, "stop_n", "left").withColumn("total", F.lit(total).cast("long"))
    stats = stats.fillna(0, ["t_", "f1", "f2", "f3", "f4", "f5"]).fillna(0.0, ["sum_q", "sum_pi"])
    value = F.lit(None).cast("double")
    for name, formula in formulas().items():
        value = F.when(F.col("estimator") == name, formula.cast("double")).otherwise(value)
    return configs.join(stats, "stop_n").select(
        *configs.columns, value.alias("estimation"), "n", F.col("k").alias("successes"), (F.col("n") - F.col("k")).alias("failures"), "total", (F.col("k") / F.col("n")).alias("mean"), "f1", "f2", "f3", "f4", "f5"
    )


def with_interval(estimates: DataFrame, t: Column, ci: str = "reference") -> DataFrame:
    """Adds variance, margin, ci_lower and ci_upper of the mean."""
    n, k = F.col("n"), F.col("successes")
    out = estimates.withColumn("variance", variance(n, k, F.col("total")))
    out = out.withColumn("margin", margin(t, F.col("variance"), n, ci))
    return out.withColumns({"ci_lower": F.col("mean") - F.col("margin"), "ci_upper": F.col("mean") + F.col("margin")})


def summary(df: DataFrame, value: str) -> DataFrame:
    """Sum, mean and population variance of a column, from its distinct values and their numbers."""
    counted = df.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    n, total = F.sum("c"), F.sum(F.col("v") * F.col("c"))
    return counted.agg(total.alias("sum"), (total / n).alias("mean"), (F.sum(F.col("v") * F.col("v") * F.col("c")) / n - F.pow(total / n, 2)).alias("variance"))
