"""The inverse probability of a draw: a greedy product of branch sizes along the matching that it found."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornlake.functions.stats import degrees
from hornlake.operators.metrics import refined_sizes, variable_candidates
from hornlake.plans.compile import column
from hornlake.plans.rule import Atom


def greedy_product(atoms: list[tuple[int, int]], edges: list[float], sizes: dict[int, float], outs: list[float], ins: list[float]) -> float:
    """The product of the costs of atoms (s, o), always the cheapest pending one next.

    The first costs min(edges, sizes[s] * out, sizes[o] * in).  An atom with a bound end costs its degree there, 1 if
    both are bound; others keep their first cost.
    """
    pending, bound, product = set(range(len(atoms))), set(), 1.0
    first = [min(edges[k], sizes[s] * outs[k], sizes[o] * ins[k]) for k, (s, o) in enumerate(atoms)]

    def cost(k: int) -> float:
        s, o = atoms[k]
        if s in bound and o in bound:
            return 1.0
        if s in bound:
            return outs[k]
        return ins[k] if o in bound else first[k]

    while pending:
        k = min(sorted(pending), key=cost)
        product *= cost(k)
        pending.remove(k)
        bound |= set(atoms[k])
    return product


def inverse_probability(kg: DataFrame, draws: DataFrame, atoms: tuple[Atom, ...], given: int | None = None) -> DataFrame:
    """`draws` (draw and a column for each variable) with inv_prob, null where a variable is.

    Degrees come from joins with the degree table; the greedy part runs on Arrow batches.  `given` is a selected
    variable, by whose number of candidates the product is divided.
    """
    variables = sorted({v for a in atoms for v in a.ends})
    edges = [float(r["size"]) for r in refined_sizes(kg, atoms).orderBy("atom").collect()]  # one row an atom
    counted = [variable_candidates(kg, atoms, v).agg(F.count("*").alias("n")).select(F.lit(v).alias("v"), "n") for v in variables]
    sizes = {r["v"]: float(r["n"]) for r in reduce(DataFrame.union, counted).collect()}  # one row a variable
    degree = degrees(kg)
    out = draws
    for k, a in enumerate(atoms):
        own = degree.filter(F.col("p") == a.p)
        out = out.join(own.select(F.col("entity").alias(column(a.s)), F.col("out").cast("double").alias(f"out{k}")), column(a.s), "left")
        out = out.join(own.select(F.col("entity").alias(column(a.o)), F.col("inn").cast("double").alias(f"in{k}")), column(a.o), "left")
    ends = [(a.s, a.o) for a in atoms]
    share = sizes[given] if given is not None else 1.0

    @F.pandas_udf("double")
    def product(degrees_: pd.DataFrame) -> pd.Series:
        n = len(ends)
        return pd.Series([None if any(x != x for x in row) else greedy_product(ends, edges, sizes, list(row[:n]), list(row[n:])) / share for row in degrees_.itertuples(index=False)], dtype="float64")

    made = out.withColumn("inv_prob", product(F.struct(*(F.col(f"out{k}") for k in range(len(ends))), *(F.col(f"in{k}") for k in range(len(ends))))))
    return made.drop(*(f"out{k}" for k in range(len(ends))), *(f"in{k}" for k in range(len(ends))))
