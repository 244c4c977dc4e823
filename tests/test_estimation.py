"""Quantiles, draws, stopping rules and estimators against direct computations."""

from __future__ import annotations

import math
import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hornlake.functions.numeric import chernoff_bound, clt_bound, normal_quantile, stop_at, student_quantile
from hornlake.operators import estimators as E
from hornlake.operators import sampling, stopping
from hornlake.plans.rule import rule

DRAWS = "draw long, s long, o long, success boolean, inv_prob double"


def make(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 1)], DRAWS)


def test_quantiles_and_bounds():
    assert normal_quantile(0.975) == pytest.approx(1.959964, abs=1e-6)
    for p, df, value in ((0.975, 1, 12.7062), (0.975, 10, 2.228139), (0.95, 30, 1.697261), (0.995, 5, 4.032143), (0.975, 1000, 1.962339)):
        assert student_quantile(p, df) == pytest.approx(value, abs=1e-5 * max(1, value))
    assert student_quantile(0.975, 10**6) == pytest.approx(normal_quantile(0.975))
    values = {(0.05, 0.01): 4344.62, (0.05, 0.10): 2456.50, (0.10, 0.05): 774.66, (0.15, 0.10): 286.26}
    for (e, a), v in values.items():
        assert chernoff_bound(e, a) == pytest.approx(v, abs=0.01)
    assert [clt_bound(0.005, 0.0005), clt_bound(0.001, 0.0001), clt_bound(0.005, 0.0001)] == [121_157, 3_784_177, 151_368]
    assert stop_at(774.66, 10_000, 50) == 775 and stop_at(774.66, 300, 50) == 300 and stop_at(3, 40, 50) == 40


@pytest.fixture(scope="module")
def stream():
    rng = random.Random(8)
    out = []
    for _ in range(120):
        s, o = rng.randrange(6), rng.randrange(6)
        out.append((s, o, (s * o) % 3 == 1, float(2 + s + o)))
    return out


def sequential(rows):
    seen, k, repeated, out = set(), 0, 0, []
    for n, (s, o, ok, _) in enumerate(rows, 1):
        if ok:
            k += 1
            if (s, o) in seen:
                repeated += 1
            else:
                seen.add((s, o))
                repeated = 0
        out.append((n, k, repeated))
    return out


def test_running_windows(spark, stream):
    found = [(r["n"], r["k"], r["repeated"]) for r in stopping.running(make(spark, stream)).orderBy("draw").collect()]
    assert found == sequential(stream)
    stop, estimate = next(((n, k - r) for n, k, r in sequential(stream) if r >= 5), (len(stream), None))
    row = stopping.repeat_stop(make(spark, stream), 1000).first()
    assert (row["stop_n"], row["estimation"]) == (stop, estimate)


def test_interval_stop(spark, stream):
    total, grid, least = 500, [(0.3, 0.05), (0.6, 0.1)], 20
    for ci in ("reference", "textbook"):
        found = {(r["accuracy"], r["confidence"]): r["stop_n"] for r in stopping.interval_stops(make(spark, stream), total, grid, least, len(stream), ci).collect()}
        for e, a in grid:
            expected = len(stream)
            for n, k, _ in sequential(stream):
                p = k / n
                var = p * (1 - p) / (n - 1) * (total - n) / (total - 1) if n > 1 else 0.0
                half = student_quantile(1 - a / 2, n - 1) * math.sqrt(var) / (math.sqrt(n) if ci == "reference" else 1) if n > 1 else 0.0
                if n >= least and half <= e * p:
                    expected = n
                    break
            assert found[e, a] == expected


def test_estimators(spark, stream):
    total = 500
    names = [(x, n) for x in E.ALL for n in (7, 60, 120)]
    configs = spark.createDataFrame(names, "estimator string, stop_n long")
    for kind in ("reference", "textbook"):
        found = {(r["estimator"], r["stop_n"]): r["estimation"] for r in E.estimates(make(spark, stream), configs, total, kind).collect()}
        for n in (7, 60, 120):
            prefix = [r for r in stream[:n] if r[2]]
            k, counts = len(prefix), Counter((s, o) for s, o, _, _ in prefix)
            hist = Counter()
            for f in counts.values():
                hist[f] += f if kind == "reference" else 1
            t, f1, f2 = sum(hist.values()), hist[1], hist[2]
            q = [x for *_, x in prefix]
            ht = sum(1 / (1 - (1 - 1 / x) ** n) for x in q)
            expected = {
                "Binomial": k / n * total,
                "Hypergeometric": k / n * (total - 1),
                "Chao1": t + f1**2 / (2 * (f2 + 1)),
                "Chao2": t + (n - 1) / n * f1**2 / (2 * (f2 + 1)),
                "Coverage": t / ((1 - f1 / n) or 1),
                "Jackknife": t + sum((-1) ** (i + 1) * math.comb(5, i) * hist[i] for i in range(1, 6)),
                "Poisson": t / (1 - math.exp(-2 * f1 / (f2 + 1))) if f1 else 0,
                "HansenHurwitz": sum(q) / n,
                "HorvitzThompsonWith": ht,
                "HorvitzThompsonWithout": ht,
                "HajekWith": ht,
                "HajekWithout": ht,
                "AnyBURL": k - sequential(stream)[n - 1][2],
            }
            for name, value in expected.items():
                assert found[name, n] == pytest.approx(value, rel=1e-9), (kind, name, n)


def test_no_success(spark):
    draws = make(spark, [(1, 2, False, 3.0)] * 5)
    configs = spark.createDataFrame([(x, 5) for x in E.ALL], "estimator string, stop_n long")
    assert {r["estimation"] for r in E.estimates(draws, configs, 10).collect()} == {0.0}


def test_dense_index_and_draws(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("s"), (F.col("id") % 3).alias("o")).repartition(7)
    found = [(r["s"], r["o"]) for r in sampling.dense_index(df, ["s", "o"]).orderBy("idx").collect()]
    assert found == sorted(found) and [r["idx"] for r in sampling.dense_index(df, ["s", "o"]).select("idx").orderBy("idx").collect()] == list(range(1000))
    a = sampling.shuffled(df, ["s", "o"], 5).orderBy("idx").collect()
    b = sampling.shuffled(df.repartition(3), ["s", "o"], 5).orderBy("idx").collect()
    assert a == b and a != sampling.shuffled(df, ["s", "o"], 6).orderBy("idx").collect()
    without = [r["idx"] for r in sampling.draw_without(12, 5, df).orderBy("draw").collect()]
    assert without == [i % 5 for i in range(12)]
    drawn = [r["idx"] for r in sampling.draw_with(5000, 10, 3, df).collect()]
    assert set(drawn) == set(range(10)) and max(Counter(drawn).values()) < 620
    assert sampling.known_without(df, ["s", "o"], 17, 1).distinct().count() == 17


def test_support_estimate_is_near(spark):
    rng = random.Random(2)
    rows = {(rng.randrange(60), "a", 100 + rng.randrange(60)) for _ in range(600)}
    rows |= {(s, "b", o) for s, _, o in rows if (s + o) % 3}
    kg = spark.createDataFrame([(*r, 0) for r in rows], "s long, p string, o long, split int").cache()
    r = rule("a(x,y)", "b(x,y)")
    truth = sum((s + o) % 3 > 0 for s, p, o in rows if p == "a")
    total = sum(p == "a" for _, p, _ in rows)
    values = []
    for run in range(3):
        draws = sampling.support_draws(kg, r, 400, replacement=True, seed=1, run=run)
        k = draws.filter("success").count()
        values.append(k / 400 * total)
    assert statistics.mean(values) == pytest.approx(truth, rel=0.1) and len(set(values)) > 1
    none = sampling.support_draws(kg, rule("zz(x,y)", "b(x,y)"), 10, replacement=True, seed=1)
    assert none.count() == 0
