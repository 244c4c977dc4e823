"""Exact quality metrics of rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hornlake.plans import compile as plan
from hornlake.plans.compile import connected_body
from hornlake.plans.rule import Atom, Rule, degrees
from hornlake.sources.folders import rows_of


def support(kg: DataFrame, r: Rule, **options) -> DataFrame:
    """One row: support, the number of the head's pairs for which the body has a matching."""
    return plan.supported_pairs(kg, r, **options).agg(F.count("*").alias("support"))


def pca_contradictions(kg: DataFrame, r: Rule, corrupt: str, **options) -> DataFrame:
    """One row: pca, the number of predicted pairs that the partial completeness assumption counts as false."""
    return plan.pca_pairs(kg, r, corrupt, **options).agg(F.count("*").alias("pca"))


def body_size(kg: DataFrame, r: Rule, **options) -> DataFrame:
    """One row: body, the number of predicted pairs."""
    return plan.body_pairs(kg, r, **options).agg(F.count("*").alias("body"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def pca_confidence(support: Column, pca: Column) -> Column:
    return ratio(support, support + pca)


def judged_counts(kg: DataFrame, r: Rule, **options) -> DataFrame:
    """One row: support, pca_x, pca_y and body, counts of distinct pairs, which add up over the pieces of x's values."""
    against = [F.count_if(F.col(f"against_{c}") & ~F.col("held")).alias(f"pca_{c}") for c in "xy"]
    return plan.judged_pairs(kg, r, **options).agg(F.count_if("held").alias("support"), *against, F.count("*").alias("body"))


#: Matchings of a body that one job makes, about: a larger body is matched in pieces, each of which leaves no files.
MATCHINGS = 2**24


def pieces_of(r: Rule, sizes: dict[str, int], ways: dict) -> list[tuple[int, int]]:
    """The pieces (k of n) of x's values for MATCHINGS of the body each, if they are as many as its atoms' meetings say."""
    end = lambda a, v: (a.p, "s" if a.s == v else "o")
    known: dict[int, Atom] = {}
    rows = 1.0
    for a in plan.join_order(r.body, sizes):
        if not known:
            rows = float(sizes.get(a.p, 0))
        elif not a.ends <= known.keys():
            (v,) = a.ends & known.keys()
            rows *= (ways.get((end(known[v], v), end(a, v))) or 0.0) / max(1, sizes.get(known[v].p, 0))
        for v in a.ends:
            known.setdefault(v, a)
    n = max(1, -int(-rows // MATCHINGS))
    return [(k, n) for k in range(n)]


def support_jobs(r: Rule, sizes: dict[str, int], ways: dict) -> list[dict]:
    """Options of `support` whose results add up to a rule's support, about MATCHINGS each.

    A triangle starts at the variable where its two atoms meet in the fewest ways: the body's own one, or from the head's
    pairs one of the head's.
    """
    if not is_triangle(r):
        return [{"piece": piece} for piece in pieces_of(r, sizes, ways)]
    end = lambda a, v: (a.p, "s" if a.s == v else "o")
    at = [(ways.get((end(r.head, v), end(a, v))) or 0.0, k, a) for v in (r.head.s, r.head.o) for k, a in enumerate(r.body) if v in a.ends]
    (z,) = r.body[0].ends & r.body[1].ends
    rows, _, first = min(at)
    if (ways.get((end(r.body[0], z), end(r.body[1], z))) or 0.0) <= rows:
        return [{"piece": piece} for piece in pieces_of(r, sizes, ways)]
    n = max(1, -int(-rows // MATCHINGS))
    return [{"piece": (k, n), "first": first} for k in range(n)]


def is_triangle(r: Rule) -> bool:
    """Whether the body's two atoms join each head variable with the one more."""
    return len(r.body) == 2 and len(r.variables) == 3 and connected_body(r) and all(n == 2 for n in degrees(r.atoms).values())


#: Rows of one job of `triangle_counts`, about.  They are narrow: two values and two flags.
ROWS = 2**26

#: A triangle's pairs are told from pairs of values of z if these are fewer than the matchings by this factor.
FEWER = 4


def triangle_counts(kg: DataFrame, r: Rule, support: int, ways: dict, loops: set[str]) -> dict[str, int]:
    """The counts of `judged_counts` of a triangle over distinct triples, from its support, with no more rows than must be made.

    Let z be the body's variable and f a triple of the body at y.  A pair (x, y) that the head has not is contradicted by y
    if for some z of it the head has a pair at y with another entity than y and z.  So f tells it by itself: the pairs with
    such an f count, less those that the head has.  Those are all its supported pairs, as x is such an entity unless it is y.
    At x it is the same.

    Pairs are the matchings, a sum over z, less those with another z before.  Where few entities share two values of z, the
    latter come from these pairs of values, (m - 1 of the m (m - 1) / 2 that a pair of m matchings has), and no matching is made.
    """
    h = r.head
    (z,) = set(r.variables) - {h.s, h.o}
    heads = kg.filter((F.col("p") == h.p) & F.expr("s <> o"))
    sides, labels, own = {}, {}, {}
    for v, end, other in ((h.s, "s", "o"), (h.o, "o", "s")):
        (a,) = (a for a in r.body if v in a.ends)
        near, far = ("s", "o") if a.s == v else ("o", "s")
        edges = kg.filter((F.col("p") == a.p) & F.expr("s <> o")).select(F.col(near).alias("v"), F.col(far).alias("z"))
        few = heads.groupBy(F.col(end).alias("v")).agg(F.count("*").alias("n"), F.min(other).alias("one"))
        sides[end] = edges.join(few, "v", "left").select("v", "z", F.coalesce(F.expr("n > 1 or one <> z"), F.lit(False)).alias("other"))
        labels[end], own[end] = (a.p, far), (a.p, near)

    def named(end: str, k: str) -> DataFrame:
        return sides[end].select(F.col("v").alias(end), F.col("z").alias(f"z{k}"), F.col("other").alias(f"other_{end}{k}"))

    # Contradicted by y (which keeps y and frees x) is pca_x.
    wedges = {end: ways.get((own[end], own[end]), 0.0) / 2 for end in "so"}
    rows = ways.get((labels["s"], labels["o"]), 0.0)
    if rows <= MATCHINGS or min(wedges.values()) and FEWER * sum(wedges.values()) > rows:
        total = dict.fromkeys(("body", "x", "y"), 0)
        n = max(1, -int(-rows // ROWS))
        for k in range(n):
            matched = named("s", "").filter(in_piece("s", (k, n))).join(named("o", ""), "z")
            pairs = matched.groupBy("s", "o").agg(F.bool_or("other_o").alias("x"), F.bool_or("other_s").alias("y"))
            total = _added(total, pairs.agg(F.count("*").alias("body"), F.count_if("x").alias("x"), F.count_if("y").alias("y")))
    else:
        degree = {end: sides[end].groupBy("z").agg(F.count("*").alias(f"n_{end}"), F.count_if("other").alias(f"k_{end}")) for end in "so"}
        sums = [F.coalesce(F.sum(F.expr(e)), F.lit(0)).alias(c) for c, e in (("body", "n_s * n_o"), ("x", "n_s * k_o"), ("y", "k_s * n_o"))]
        total = rows_of(degree["s"].join(degree["o"], "z").agg(*sums))[0].asDict()
        n = -int(-sum(wedges.values()) // ROWS) if min(wedges.values()) else 0
        for k in range(n):
            both = {end: named(end, "1").join(named(end, "2"), end).filter("z1 < z2").select("z1", "z2", end, F.expr(f"other_{end}1 and other_{end}2").alias(f"other_{end}")) for end in "so"}
            cycles = both["s"].filter(in_piece("s", (k, n))).join(both["o"], ["z1", "z2"])
            pairs = cycles.groupBy("s", "o").agg(F.count("*").alias("body"), F.count_if("other_o").alias("x"), F.count_if("other_s").alias("y"))
            again = [F.coalesce(F.sum(F.expr(f"-cast(round((sqrt(8 * {c} + 1) - 1) / 2) as long)")), F.lit(0)).alias(c) for c in ("body", "x", "y")]
            total = _added(total, pairs.agg(*again))
    held = {"x": support, "y": support}
    if h.p in loops:
        at = kg.filter((F.col("p") == h.p) & F.expr("s = o")).select("s", "o").join(named("s", ""), "s").join(named("o", ""), ["o", "z"])
        found = rows_of(at.groupBy("s").agg(F.bool_or("other_o").alias("x"), F.bool_or("other_s").alias("y")).agg(F.count_if(~F.col("x")).alias("x"), F.count_if(~F.col("y")).alias("y")))[0]
        held = {c: support - found[c] for c in "xy"}
    return {"support": support, "pca_x": total["x"] - held["x"], "pca_y": total["y"] - held["y"], "body": total["body"]}


def in_piece(by: str, piece: tuple[int, int]) -> Column:
    return F.pmod(F.xxhash64(F.lit(7), by), F.lit(piece[1])) == piece[0]


def _added(total: dict[str, int], one_row: DataFrame) -> dict[str, int]:
    row = rows_of(one_row)[0]
    return {c: n + row[c] for c, n in total.items()}


def metrics(kg: DataFrame, r: Rule, name: str, **options) -> DataFrame:
    """One row: rule, predicate_size, support, head_coverage, pca_x, pca_y, body, and the confidences by each.

    The body is matched once, whatever is asked of its pairs; it must join both head variables.
    """
    size = kg.filter(F.col("p") == r.head.p).agg(F.count("*").alias("predicate_size"))
    row = size.crossJoin(judged_counts(kg, r, **options))  # each has a single row
    s = F.col("support")
    return row.select(
        F.lit(name).alias("rule"),
        "predicate_size",
        "support",
        ratio(s, F.col("predicate_size")).alias("head_coverage"),
        "pca_x",
        "pca_y",
        "body",
        pca_confidence(s, F.col("pca_x")).alias("pca_confidence_x"),
        pca_confidence(s, F.col("pca_y")).alias("pca_confidence_y"),
        ratio(s, F.col("body")).alias("standard_confidence"),
    )


def positive_pairs(kg: DataFrame, r: Rule, drawn: DataFrame) -> DataFrame:
    """Distinct drawn pairs (s, o) that the head has: the successes that tell of support, of one run only."""
    return drawn.select("s", "o").distinct().join(kg.filter(F.col("p") == r.head.p).select("s", "o"), ["s", "o"], "left_semi")


def variable_candidates(kg: DataFrame, atoms: tuple[Atom, ...], v: int) -> DataFrame:
    """The values that variable v can take: those that every atom at v has at that end."""
    ends = [kg.filter(F.col("p") == a.p).select(F.col("s" if a.s == v else "o").alias("value")) for a in atoms if v in a.ends]
    return reduce(lambda a, b: a.intersect(b), ends[1:], ends[0].distinct())


def conditional_candidates(kg: DataFrame, atoms: tuple[Atom, ...], v: int, bound: DataFrame) -> DataFrame:
    """For each row of `bound` (an id and columns of other variables) the number of values of v that fit them."""
    known = {int(c[1:]) for c in bound.columns if c != "id"}
    out = bound
    found = False
    for a in [a for a in atoms if v in a.ends]:
        other = a.o if a.s == v else a.s
        if other not in known:
            continue
        side = kg.filter(F.col("p") == a.p).select(F.col("s" if a.s == v else "o").alias("value"), F.col("s" if a.s == other else "o").alias(plan.column(other)))
        out = out.join(side, [plan.column(other), *(["value"] if found else [])])
        found = True
    if not found:
        raise ValueError("no atom joins the variable to a bound one")
    return out.groupBy("id").agg(F.count_distinct("value").alias("candidates"))


def refined_pairs(kg: DataFrame, atoms: tuple[Atom, ...], at: int) -> DataFrame:
    """Pairs of atom `at` whose ends occur in every touching atom in the right role."""
    a = atoms[at]
    out = kg.filter(F.col("p") == a.p).select("s", "o").distinct()
    for k, b in enumerate(atoms):
        if k == at or not a.ends & b.ends:
            continue
        side = kg.filter(F.col("p") == b.p)
        if a.ends == b.ends:
            swapped = b.s != a.s
            out = out.join(side.select(F.col("o" if swapped else "s").alias("s"), F.col("s" if swapped else "o").alias("o")), ["s", "o"], "left_semi")
        else:
            (v,) = a.ends & b.ends
            own, theirs = ("s" if a.s == v else "o"), ("s" if b.s == v else "o")
            out = out.join(side.select(F.col(theirs).alias(own)), own, "left_semi")
    return out.select("s", "o")


def refined_sizes(kg: DataFrame, atoms: tuple[Atom, ...]) -> DataFrame:
    """atom (its number), size of its refined pairs."""
    rows = [refined_pairs(kg, atoms, k).agg(F.count("*").alias("size")).select(F.lit(k).alias("atom"), "size") for k in range(len(atoms))]
    return reduce(DataFrame.union, rows)
