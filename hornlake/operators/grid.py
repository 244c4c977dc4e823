"""All estimates of one rule: every technique of the grid, in both kinds of draws, for several runs.

One table of draws a run serves all configurations: a configuration is a row with its estimator and where its rule
stops.  Draws are made in a block of twice the largest fixed bound; interval rules that go on get a block twice as
long, until all have stopped or the total is reached.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornlake.functions.numeric import clt_bound
from hornlake.operators import estimators as E
from hornlake.operators import evaluate as V
from hornlake.operators import metrics as M
from hornlake.operators import sampling, stopping
from hornlake.operators.probability import inverse_probability
from hornlake.operators.walks import beam
from hornlake.plans.compile import matchings, pca_pairs
from hornlake.plans.rule import Rule, render

GRID = [(e, a) for e in V.ACCURACIES for a in V.CONFIDENCES]


def _configs(draw: Callable[[int], DataFrame], total: int, estimators: list[str], min_samples: int, name: Callable[..., str]) -> tuple[DataFrame, DataFrame]:
    """The draws and a row (technique, estimator, accuracy, confidence, stop_n) for each configuration."""
    n = min(total, stopping.block_size(GRID))
    while True:
        draws = draw(n).cache()
        fixed = stopping.fixed_stops(draws, "Chernoff", total, GRID, min_samples)
        stops = [("Chernoff", r) for r in fixed.collect()] + [("CI", r) for r in stopping.interval_stops(draws, total, GRID, min_samples, n).collect()]  # the grid's rows
        if n >= total or all(r["stop_n"] < n for _, r in stops):
            break
        draws.unpersist()
        n = min(total, 2 * n)
    rows = [(name(x, limit, r["accuracy"], r["confidence"]), x, r["accuracy"], r["confidence"], int(r["stop_n"])) for limit, r in stops for x in estimators]
    return draws, draws.sparkSession.createDataFrame(rows, "technique string, estimator string, accuracy double, confidence double, stop_n long")


def _weighed(kg: DataFrame, r: Rule, draws: DataFrame) -> DataFrame:
    """Support draws with the inverse probability of the first matching of each success."""
    found = matchings(kg, r.body, frozenset((r.head.s, r.head.o)), start=draws.filter("success").select(F.col("s").alias(f"v{r.head.s}"), F.col("o").alias(f"v{r.head.o}")).distinct())
    pair = [f"v{r.head.s}", f"v{r.head.o}"]
    others = [c for c in found.columns if c not in pair]
    one = found.groupBy(*pair).agg(F.min(F.struct(*others)).alias("m")).select(*pair, *(F.col(f"m.{c}") for c in others)) if others else found.distinct()
    held = inverse_probability(kg, one, r.body).select(F.col(pair[0]).alias("s"), F.col(pair[1]).alias("o"), "inv_prob")
    return draws.join(held, ["s", "o"], "left")


def support_estimates(kg: DataFrame, r: Rule, *, runs: int = V.RUNS, min_samples: int = 50, seed: int = 0, weigh: bool = True) -> DataFrame:
    """rule, run, technique, estimation, n, successes, truth and q_error of every support technique."""
    total = kg.filter(F.col("p") == r.head.p).select("s", "o").distinct().count()
    truth = M.support(kg, r).first()["support"]
    out = []
    for run in range(runs):
        for replacement, names in ((True, E.WITH), (False, E.WITHOUT)):
            draws, configs = _configs(lambda n, rep=replacement, k=run: sampling.support_draws(kg, r, n, replacement=rep, seed=seed, run=k), total, names, min_samples, V.support_name)
            rows = E.estimates(_weighed(kg, r, draws) if weigh else draws, configs, total)
            out.append(rows.select(F.lit(render(r)).alias("rule"), F.lit(run).alias("run"), "technique", "estimation", "n", "successes"))
    return _judged(reduce(DataFrame.union, out), truth)


def _judged(rows: DataFrame, truth: float) -> DataFrame:
    t = F.lit(float(truth))
    return rows.withColumn("truth", t).withColumn("q_error", V.q_error(t, F.col("estimation")))


def pca_estimates(kg: DataFrame, r: Rule, corrupt: str, *, runs: int = V.RUNS, min_samples: int = 50, seed: int = 0, selections: list[str] | None = None) -> DataFrame:
    """rule, run, technique, estimation, n, successes, truth and q_error of every PCA technique, the heuristic included."""
    atoms = r.corrupted(corrupt)
    x, y = (M.variable_candidates(kg, atoms, v).count() for v in (r.head.s, r.head.o))
    truth = M.pca_contradictions(kg, r, corrupt).first()["pca"]
    total, given = x * y, {"Corrupt": corrupt, "NonCorrupt": "yx"["xy".index(corrupt)], "Minimum": "x" if x <= y else "y"}
    out = []
    for run in range(runs):
        for selection in selections or V.SELECTIONS:

            def draw(n: int, sel=selection, k=run) -> DataFrame:
                walks = beam(kg, r, corrupt, n, seed=1_000_003 * seed + k, selection=sel)
                side = given.get(sel)
                start = {"x": r.head.s, "y": r.head.o}.get(side) if side else None
                return inverse_probability(kg, walks, atoms, given=start).select("draw", "s", "o", "success", "inv_prob")

            draws, configs = _configs(draw, total, E.WITH, min_samples, lambda e, lim, a, c, sel=selection: V.pca_name(e, lim, sel, a, c))
            rows = E.estimates(draws, configs, total).select("technique", "estimation", "n", "successes")
            stop = stopping.repeat_stop(draws, total, min_samples).select(F.lit(V.heuristic_name(selection)).alias("technique"), F.col("estimation").cast("double"), F.col("stop_n").alias("n"), F.lit(None).cast("long").alias("successes"))
            out.append(rows.unionByName(stop).select(F.lit(render(r)).alias("rule"), F.lit(run).alias("run"), "technique", "estimation", "n", "successes"))
    return _judged(reduce(DataFrame.union, out), truth)


def pca_count(kg: DataFrame, r: Rule, corrupt: str, *, method: str = "exact", accuracy: float = 0.005, confidence: float = 0.0005, seed: int = 0) -> DataFrame:
    """One row: pca and method.  'clt' draws pairs up to the CLT bound; 'auto' does where there are at least as many candidate pairs."""
    if method not in ("exact", "clt", "auto"):
        raise ValueError("method is 'exact', 'clt' or 'auto'")
    if method != "exact":
        atoms, bound = r.corrupted(corrupt), clt_bound(accuracy, confidence)
        x, y = (M.variable_candidates(kg, atoms, v).count() for v in (r.head.s, r.head.o))
        if method == "clt" or x * y >= bound:
            n = min(bound, max(1, x * y))
            draws = sampling.pair_draws(kg, r, corrupt, n, seed=seed)
            return draws.agg((F.coalesce(F.count_if("success"), F.lit(0)) / F.lit(n) * F.lit(x * y)).alias("pca")).withColumn("method", F.lit("clt"))
    return pca_pairs(kg, r, corrupt).agg(F.count("*").cast("double").alias("pca")).withColumn("method", F.lit("exact"))
