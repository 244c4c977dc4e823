"""How good estimates are: q-errors, speed-ups, confidence errors, and the grids and names of techniques."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The grid of accuracies and error probabilities, the limits, and the selections of start variables.
ACCURACIES, CONFIDENCES = [0.05, 0.1, 0.15], [0.01, 0.05, 0.1]
LIMITS, SELECTIONS, RUNS = ["CI", "Chernoff"], ["Minimum", "Random", "NonCorrupt"], 5


def q_error(truth: Column, estimate: Column) -> Column:
    """How many times off, less one; negative where the estimate is below the truth.  Values below 1 count as 1."""
    a, b = F.greatest(F.lit(1.0), truth), F.greatest(F.lit(1.0), estimate)
    off = F.greatest(a / b, b / a) - 1
    return F.when(estimate < truth, -off).otherwise(off) + 0.0  # no negative zero


def speedup(truth_ns: Column, estimate_ns: Column) -> Column:
    return (truth_ns / 1e9) / (estimate_ns / 1e9)


def confidence_error(truth: Column, estimate: Column) -> Column:
    """Signed."""
    return estimate - truth


def support_name(estimator: str, limit: str, accuracy: float, confidence: float) -> str:
    return f"Support_{estimator}_{limit}_Acc{accuracy}_Conf{confidence}"


def pca_name(estimator: str, limit: str, selection: str, accuracy: float, confidence: float) -> str:
    return f"PCA_{estimator}_{limit}_{selection}_Acc{accuracy}_Conf{confidence}"


def heuristic_name(selection: str) -> str:
    return f"PCA_AnyBURL__{selection}"


def support_grid(estimators: list[str]) -> Iterator[str]:
    for limit, e, a, name in product(LIMITS, ACCURACIES, CONFIDENCES, estimators):
        yield support_name(name, limit, e, a)


def pca_grid(estimators: list[str], replacement: bool) -> Iterator[str]:
    for selection in SELECTIONS:
        for limit, e, a, name in product(LIMITS, ACCURACIES, CONFIDENCES, estimators):
            yield pca_name(name, limit, selection, e, a)
        if replacement:
            yield heuristic_name(selection)


def suffix(technique: Column) -> Column:
    """The hyper-parameters at a technique's end: the last four parts for PCA, the last three otherwise."""
    parts = F.split(technique, "_")
    return F.concat_ws("_", F.when(technique.startswith("PCA"), F.slice(parts, -4, 4)).otherwise(F.slice(parts, -3, 3)))


def spread_heuristic(series: DataFrame) -> DataFrame:
    """Rows (technique, value) of the heuristic again for every suffix with its selection; others as they are."""
    named = series.withColumn("heuristic", F.col("technique").startswith("PCA_AnyBURL"))
    others = named.filter("not heuristic")
    suffixes = others.select(suffix(F.col("technique")).alias("suffix")).distinct()
    own = named.filter("heuristic").withColumn("selection", F.element_at(F.split("technique", "_"), -1))
    spread = own.join(F.broadcast(suffixes), F.array_contains(F.split("suffix", "_"), F.col("selection")))  # a parameter table
    return others.select("technique", "value").union(spread.select(F.concat_ws("_", F.lit("PCA_AnyBURL"), "suffix").alias("technique"), "value"))


def technique_summary(rows: DataFrame, value: str = "value") -> DataFrame:
    """technique -> n, mean, deviation, least, quartiles and greatest of its values."""
    v = F.col(value)
    return rows.groupBy("technique").agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("stddev"),
        F.min(v).alias("least"),
        *(F.percentile(v, q).alias(f"p{round(100 * q)}") for q in (0.25, 0.5, 0.75)),
        F.max(v).alias("greatest"),
    )


def letter_values(rows: DataFrame, value: str = "value", depth: int = 6) -> DataFrame:
    """technique, letter, lower, upper: what a boxen plot draws, the halves, quarters, eighths and so on."""
    cuts = [2.0**-k for k in range(1, depth + 1)]
    found = rows.groupBy("technique").agg(F.percentile(value, F.array(*(F.lit(c) for c in cuts))).alias("lower"), F.percentile(value, F.array(*(F.lit(1 - c) for c in cuts))).alias("upper"))
    return found.select("technique", F.posexplode(F.arrays_zip("lower", "upper")).alias("letter", "z")).select("technique", "letter", "z.lower", "z.upper")


def plot_rows(series: DataFrame, suffixes: list[str], names: dict[str, str], skip: tuple[str, ...] = ("Hetionet",)) -> DataFrame:
    """dataset, metric, technique, value: series (dataset, metric, technique, values) of the wanted suffixes, renamed and exploded."""
    kept = series.filter(~F.col("dataset").isin(*skip) & suffix(F.col("technique")).isin(*suffixes))
    name = F.col("dataset")
    for old, new in names.items():
        name = F.when(F.col("dataset") == old, new).otherwise(name)
    return kept.select(name.alias("dataset"), "metric", "technique", F.explode("values").alias("value"))
