"""Compiled plans against a backtracking matcher on random graphs, and fixed values of the lifted graph."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hornlake.operators import metrics as M
from hornlake.operators.shapes import SHAPES, meetings, shape_of, shape_support, supports, triangle_patterns
from hornlake.plans import compile as plan
from hornlake.plans.rule import rule
from hornlake.queries import RULES
from hornlake.sources.lift import lift

RULE_SET = [
    rule("a(x,y)", "a(y,x)"),
    rule("a(x,y)", "b(x,y)"),
    rule("a(x,y)", "b(x,z)", "c(z,y)"),
    rule("a(x,y)", "b(z,x)", "c(z,y)"),
    rule("a(x,y)", "b(x,z)", "b(y,z)"),
    rule("a(x,y)", "b(x,z)", "c(z,w)", "a(w,y)"),
    rule("a(x,y)", "a(z,x)", "a(z,y)"),
    rule("a(x,y)", "b(x,y)", "c(y,z)"),
    rule("a(x,y)", "b(x,z)", "b(x,w)", "c(x,y)"),
]


def matches(atoms, facts, bound, free_pair):
    """Whether the atoms have an injective matching that extends `bound`; the two of free_pair may be equal."""
    if not atoms:
        return True
    a, rest = atoms[0], atoms[1:]
    for s, o in facts[a.p]:
        new = dict(bound)
        good = True
        for v, value in ((a.s, s), (a.o, o)):
            if v in new:
                good &= new[v] == value
            else:
                good &= all(value != x for w, x in new.items() if {v, w} != free_pair)
                new[v] = value
        if good and matches(rest, facts, new, free_pair):
            return True
    return False


def brute(r, triples, corrupt=None, head_injective=False):
    facts = {p: sorted({(s, o) for s, q, o in triples if q == p}) for p in "abc"}
    h, pair = r.head, set() if head_injective else {r.head.s, r.head.o}
    entities = sorted({v for s, _, o in triples for v in (s, o)})
    if corrupt is None:
        pairs = [x for x in facts[h.p] if not head_injective or x[0] != x[1]]
        atoms = list(r.body)
    else:
        pairs = [(x, y) for x in entities for y in entities if (x, y) not in set(facts[h.p]) and (not head_injective or x != y)]
        atoms = list(r.corrupted(corrupt))
    return sum(matches(atoms, facts, {h.s: x, h.o: y}, pair) for x, y in pairs)


@pytest.fixture(scope="module")
def graphs():
    rng = random.Random(17)
    return [[(rng.randrange(8), rng.choice("abc"), rng.randrange(8)) for _ in range(30)] for _ in range(25)]


@pytest.fixture(scope="module")
def kg(spark, graphs):
    rows = [(100 * g + s, p, 100 * g + o, 0) for g, triples in enumerate(graphs) for s, p, o in triples]
    return spark.createDataFrame(rows, "s long, p string, o long, split int").distinct().cache()


@pytest.mark.parametrize("r", RULE_SET, ids=str)
def test_metrics_equal_backtracking(kg, graphs, r):
    def by_graph(df):
        return {row["g"]: row["n"] for row in df.groupBy(F.floor(F.col("s") / 100).alias("g")).agg(F.count("*").alias("n")).collect()}

    for found, corrupt in ((plan.supported_pairs(kg, r), None), (plan.pca_pairs(kg, r, "x"), "x"), (plan.pca_pairs(kg, r, "y"), "y")):
        expected = {g: n for g, t in enumerate(graphs) if (n := brute(r, t, corrupt))}
        if corrupt is None or plan.connected_body(r):
            assert by_graph(found) == expected


def test_head_injective(kg, graphs):
    r = RULE_SET[4]
    assert M.support(kg, r, head_injective=True).first()["support"] == sum(brute(r, t, None, True) for t in graphs)


def test_shapes_equal_single_rules(kg):
    found = supports(kg, RULE_SET)
    for r in RULE_SET:
        assert found[r] == M.support(kg, r).first()["support"], shape_of(r)


def test_refinement_and_candidates(kg, graphs):
    r = RULE_SET[2]
    atoms = r.corrupted("y")
    rows = {row["atom"]: row["size"] for row in M.refined_sizes(kg, atoms).collect()}
    total = Counter()
    for triples in graphs:
        facts = {p: {(s, o) for s, q, o in triples if q == p} for p in "abc"}
        total[0] += sum(any(o == s2 for s2, _ in facts["c"]) and any(s == s2 for s2, _ in facts["a"]) for s, o in facts["b"])
        total[1] += sum(any(s == o2 for _, o2 in facts["b"]) for s, _ in facts["c"])
        total[2] += sum(any(s == s2 for s2, _ in facts["b"]) for s, _ in facts["a"])
    assert rows == dict(total)


def test_unconnected_body_is_an_error(kg):
    with pytest.raises(ValueError, match="not connected"):
        plan.body_pairs(kg, rule("a(x,y)", "b(x,z)", "c(y,w)"))


def test_fixed_values(spark):
    kg = lift(spark, "/root/testdata/sf0.001").cache()
    assert kg.count() == 15_868
    expected = {"r1": (10, 0, 0), "r2": (841, 619, 619), "r3": (952, 1038, 1048), "r4": (35, 806, 806), "r5": (1285, 4072, 4097), "r6": (0, 0, 0), "r7": (0, 0, 0)}
    for name, r in RULES.items():
        found = (M.support(kg, r).first()[0], M.pca_contradictions(kg, r, "x").first()[0], M.pca_contradictions(kg, r, "y").first()[0])
        assert found == expected[name], name
    kg.unpersist()


def test_triangles_are_made_at_the_vertex_with_fewest_pairs(spark):
    # Thirty subjects all point at one hub by a and b; only c closes one triangle, and one head has equal variables.
    rows = [(n, p, 0) for n in range(1, 31) for p in "ab"] + [(1, "c", 2), (3, "d", 3)]
    hub = spark.createDataFrame(rows, "s long, p string, o long")
    for ends in (((0, 2), (1, 2)), ((1, 2), (0, 2))):
        found = {tuple(r)[:3]: r["support"] for r in shape_support(hub, ends).collect()}
        assert found == {("c", "a", "b"): 1, ("c", "b", "a"): 1, ("c", "a", "a"): 1, ("c", "b", "b"): 1, **{("d", p, q): 1 for p in "ab" for q in "ab"}}
    ways = meetings(hub)
    assert ways[("a", "o"), ("b", "o")] == 900 and ways[("a", "s"), ("c", "s")] == 1
    arms, patterns, uses = triangle_patterns([rule("c(x,y)", "a(x,z)", "b(y,z)"), rule("a(x,y)", "c(x,z)", "b(z,y)")], ways)
    assert [ways[labels] for labels in arms] == [1] and len(patterns) == 1 and len(uses) == 2  # not the 900 at the hub, and shared


def test_triangles_of_all_shapes_equal_brute_force(spark):
    rng = random.Random(8)
    rows = sorted({(rng.randrange(9), rng.choice("ab"), rng.randrange(9)) for _ in range(60)})
    kg = spark.createDataFrame(rows * 2, "s long, p string, o long").cache()  # each triple twice
    for name in ("triangle_out", "triangle_path", "triangle_in", "triangle_back"):
        ends = SHAPES[name]
        for injective in (False, True):
            pairs = {}
            for x, p0, y in rows:
                for s1, p1, o1 in rows:
                    for s2, p2, o2 in rows:
                        at = {0: x, 1: y}
                        fits = not (injective and x == y)
                        for (u, v), s, o in ((ends[0], s1, o1), (ends[1], s2, o2)):
                            fits = fits and at.setdefault(u, s) == s and at.setdefault(v, o) == o
                        if fits and at[2] not in (x, y):
                            pairs.setdefault((p0, p1, p2), set()).add((x, y))
            found = {tuple(r)[:3]: r["support"] for r in shape_support(kg, ends, head_injective=injective).collect()}
            assert found == {k: len(v) for k, v in pairs.items()}
