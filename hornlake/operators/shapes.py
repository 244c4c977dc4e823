"""Many rules of one shape in one job: the predicates stay columns.

A shape is a rule whose predicates are the places '0' (head), '1', '2' ...  One plan joins the triples without fixing
predicates and counts, for each tuple of predicates, the head's pairs with a matching.  A list of candidate rules
restricts each join to the predicates that it still needs.

Triangles have a plan of their own (see triangle_support): from the vertex where their predicates make the fewest pairs
of edges, whatever the shape, so that no vertex with very many edges is where pairs are made if another will do.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornlake.plans.compile import column, join_order, leaves, some_of
from hornlake.plans.rule import Atom, Rule
from hornlake.sources.folders import rows_of

#: Body shapes over the head (x, y) with at most one more variable.
SHAPES = {
    "parallel": ((0, 1),),
    "reverse": ((1, 0),),
    "fork": ((0, 2),),
    "path": ((1, 2),),
    "in_path": ((2, 0),),
    "in_fork": ((2, 1),),
    "triangle_out": ((0, 2), (1, 2)),
    "triangle_path": ((0, 2), (2, 1)),
    "triangle_in": ((2, 0), (2, 1)),
    "triangle_back": ((2, 0), (1, 2)),
}


def shape_of(r: Rule) -> tuple[tuple[tuple[int, int], ...], tuple[str, ...]]:
    """The body's ends, in order, and the predicates, the head's first."""
    return tuple((a.s, a.o) for a in r.body), (r.head.p, *(a.p for a in r.body))


def is_triangle(ends: tuple[tuple[int, int], ...]) -> bool:
    """Whether the body joins each head variable with the one more."""
    return sorted(sorted(e) for e in ends) == [[0, 2], [1, 2]]


def meetings(kg: DataFrame) -> dict[tuple[tuple[str, str], tuple[str, str]], float]:
    """((p, end), (q, end)) -> in how many ways an edge of p and another one of q meet at those ends (0 if it is one edge); a row for each, so few."""
    edges = kg.filter("s <> o")
    ends = edges.select(F.col("s").alias("v"), "p", F.lit("s").alias("e")).union(edges.select("o", "p", F.lit("o")))
    n = ends.groupBy("v", "p", "e").agg(F.count("*").cast("double").alias("n"))
    own = n.groupBy("v").agg(F.collect_list(F.struct("p", "e", "n")).alias("own"))  # a vertex has as many as predicates, not edges
    both = own.select(F.explode("own").alias("a"), "own").select("a", F.explode("own").alias("b"))
    ways = F.col("a.n") * F.when((F.col("a.p") == F.col("b.p")) & (F.col("a.e") == F.col("b.e")), F.col("b.n") - 1).otherwise(F.col("b.n"))
    found = both.groupBy(F.col("a.p").alias("p"), F.col("a.e").alias("e"), F.col("b.p").alias("q"), F.col("b.e").alias("f")).agg(F.sum(ways).alias("ways"))
    return {((r["p"], r["e"]), (r["q"], r["f"])): r["ways"] for r in found.toLocalIterator()}


@dataclass(frozen=True)
class Meeting:
    """Of edges of p and of q that share an entity at an end of each: the ways to meet as `meetings` has them (None if only a loop meets), p's triples at
    entities that have an edge of q to another entity, and of those entities how many have one only."""

    ways: float | None
    heads: int
    single: int


def met(kg: DataFrame, among: Iterable[Rule] | None = None) -> dict[tuple[tuple[str, str], tuple[str, str]], Meeting]:
    """((p, end), (q, end)) -> what distinct triples have in common there; one pass over the graph, a row for each, so few.

    With `among` only of the predicates of these rules, and if none is open, only the ways and only at variables that they share.
    """
    if among is not None:
        labels = sorted({(a.p, e) for r in among for a in r.atoms for e in "so"})
        if 0 < len(labels) <= COLUMNS and not any(is_open(shape_of(r)[0]) for r in among):
            return _met_at_variables(kg, list(among), labels)
        kg = kg.filter(F.col("p").isin(sorted({a.p for r in among for a in r.atoms})))
    ends = kg.select(F.col("s").alias("v"), "p", F.lit("s").alias("e"), F.expr("s = o").alias("loop")).union(kg.select("o", "p", F.lit("o"), F.expr("s = o")))
    n = ends.groupBy("v", "p", "e").agg(F.count_if(~F.col("loop")).alias("n"), F.count("*").alias("heads"))
    own = n.groupBy("v").agg(F.collect_list(F.struct("p", "e", "n", "heads")).alias("own"))  # a vertex has as many as predicates, not edges
    both = own.select(F.explode("own").alias("a"), "own").select("a", F.explode("own").alias("b"))
    same = (F.col("a.p") == F.col("b.p")) & (F.col("a.e") == F.col("b.e"))
    ways = F.when((F.col("a.n") > 0) & (F.col("b.n") > 0), F.col("a.n").cast("double") * (F.col("b.n") - F.when(same, 1).otherwise(0)))
    found = both.groupBy(F.col("a.p").alias("p"), F.col("a.e").alias("e"), F.col("b.p").alias("q"), F.col("b.e").alias("f")).agg(
        F.sum(ways).alias("ways"), F.sum(F.when(F.col("b.n") > 0, F.col("a.heads")).otherwise(0)).alias("heads"), F.count_if(F.col("b.n") == 1).alias("single")
    )
    return {((r["p"], r["e"]), (r["q"], r["f"])): Meeting(r["ways"], r["heads"], r["single"]) for r in rows_of(found)}


#: Ends of predicates that are counted in a column each.
COLUMNS = 24


def _met_at_variables(kg: DataFrame, rules: list[Rule], labels: list[tuple[str, str]]) -> dict[tuple[tuple[str, str], tuple[str, str]], Meeting]:
    """The ways to meet at variables of the rules: an entity is one row with a count for each label, so it moves once."""
    place = {label: k for k, label in enumerate(labels)}
    at: set[tuple[int, int]] = set()
    for r in rules:
        for v in r.variables:
            own = [place[a.p, e] for a in r.atoms for e, w in (("s", a.s), ("o", a.o)) if w == v]
            at |= {(i, j) for i in own for j in own}
    edges = kg.filter(F.col("p").isin(sorted({p for p, _ in labels})) & F.expr("s <> o"))
    ends = edges.select(F.col("s").alias("v"), "p", F.lit("s").alias("e")).union(edges.select("o", "p", F.lit("o")))
    counts = ends.groupBy("v").agg(*(F.count_if((F.col("p") == p) & (F.col("e") == e)).alias(f"n{k}") for (p, e), k in place.items()))
    ways = [F.sum(F.expr(f"if(n{i} > 0 and n{j} > 0, cast(n{i} as double) * (n{j} - {int(i == j)}), null)")).alias(f"w{i}_{j}") for i, j in sorted(at)]
    (row,) = rows_of(counts.agg(*ways))
    return {(labels[i], labels[j]): Meeting(row[f"w{i}_{j}"], 0, 0) for i, j in sorted(at) if row[f"w{i}_{j}"] is not None}


def is_open(ends: tuple[tuple[int, int], ...]) -> bool:
    """Whether the body is one atom that joins a head variable with one of its own."""
    return len(ends) == 1 and 2 in ends[0]


def open_supports(kg: DataFrame, rules: list[Rule], meets: dict) -> dict[Rule, int]:
    """The supports of rules whose body is one atom to a new variable, over distinct triples, without matching any head pair with its body.

    At an entity v a head pair (v, w) has no matching if v has no edge of the body to another entity, or a single one and
    that goes to w.  So the head's triples at entities with an edge count, but for those that run along a single one: all
    single ones if both atoms are the same, and else those found by a join, if the atoms' ends meet on either side at all.
    """
    other = {"s": "o", "o": "s"}
    out, along = {}, []
    for k, r in enumerate(rules):
        (a,) = r.body
        v = next(iter(a.ends - {2}))
        head, body = (r.head.p, "s" if r.head.s == v else "o"), (a.p, "s" if a.s == v else "o")
        here = meets.get((head, body))
        out[r] = here.heads if here else 0
        if head == body:
            out[r] -= here.single if here else 0
        elif here and ((head[0], other[head[1]]), (body[0], other[body[1]])) in meets:
            along.append((k, *head, *body))
    if along:
        listed = kg.sparkSession.createDataFrame(along, "rule int, p string, e string, q string, f string")
        edges = kg.filter("s <> o")
        half = edges.select(F.col("s").alias("v"), "p", F.lit("s").alias("e"), F.col("o").alias("far")).union(edges.select("o", "p", F.lit("o"), "s"))
        heads = half.join(F.broadcast(listed.select("p", "e").distinct()), ["p", "e"])
        bodies = half.select("v", F.col("p").alias("q"), F.col("e").alias("f"), "far").join(F.broadcast(listed.select("q", "f").distinct()), ["q", "f"])
        single = bodies.groupBy("v", "q", "f").agg(F.count("*").alias("n"), F.min("far").alias("far")).filter("n = 1").drop("n")
        lost = heads.join(single, ["v", "far"]).join(F.broadcast(listed), ["p", "e", "q", "f"]).groupBy("rule").agg(F.count("*").alias("lost"))
        for row in rows_of(lost):
            out[rules[row["rule"]]] -= row["lost"]
    return out


#: A filter over 64-bit hashes has 2**MARKS words of as many bits: 8 MB, however many values there are.
MARKS = 20


def _word(by: str) -> str:
    return f"shiftrightunsigned({by}, {64 - MARKS})"


def _bit(by: str) -> str:
    return f"cast(shiftrightunsigned({by}, {58 - MARKS}) & 63 as int)"


def _possible(rows: DataFrame, by: str, values: DataFrame) -> DataFrame:
    """The rows whose hash `by` may be among the `values` (a column of that name): no other row is moved by a join that follows."""
    words = values.groupBy(F.expr(_word(by)).alias("word_")).agg(F.expr(f"bit_or(shiftleft(1L, {_bit(by)}))").alias("bits_"))
    at = rows.withColumn("word_", F.expr(_word(by))).join(F.broadcast(words), "word_")
    return at.filter(F.expr(f"shiftrightunsigned(bits_, {_bit(by)}) & 1L") == 1).drop("word_", "bits_")


def looped_heads(kg: DataFrame) -> set[str]:
    """Predicates with a triple from an entity to itself."""
    return {r["p"] for r in kg.filter("s = o").select("p").distinct().toLocalIterator()}


def _corners(atoms: tuple[Atom, ...]) -> list[list[tuple[str, str, int, int]]]:
    """For each variable of a triangle its two atoms: predicate, end, the variable at the other end, place."""
    return [sorted((a.p, "s" if a.s == v else "o", next(iter(a.ends - {v})), k) for k, a in enumerate(atoms) if v in a.ends) for v in (0, 1, 2)]


def triangle_patterns(rules: list[Rule], ways: dict) -> tuple[dict[tuple, int], dict[tuple, int], list[tuple[int, int, str, str]]]:
    """Numbered pairs of (predicate, end) that meet at a vertex a; numbered (pair, predicate, whether it goes from b to c) of the third
    edges; and for each rule that can hold its pattern, its place, and which of a and the third edge's s and o are x and y.

    A rule's pair is that with the fewest `ways` to meet, so rules of the same three edges share a pattern, wherever their heads are.
    """
    arms: dict[tuple, int] = {}
    patterns: dict[tuple, int] = {}
    uses = []
    for number, r in enumerate(rules):
        corners = [(ways.get((two[0][:2], two[1][:2]), 0.0), [x[:2] for x in two], v, two) for v, two in enumerate(_corners(r.atoms))]
        if all(c[0] for c in corners):
            _, labels, v, two = min(corners)
            close = r.atoms[3 - two[0][3] - two[1][3]]
            arm = arms.setdefault(tuple(labels), len(arms))
            at = {v: "a", close.s: "s", close.o: "o"}
            uses.append((patterns.setdefault((arm, close.p, close.s == two[0][2]), len(patterns)), number, at[0], at[1]))
    return arms, patterns, uses


def triangle_support(kg: DataFrame, rules: list[Rule], ways: dict, loops: set[str]) -> DataFrame:
    """rule (its place in the list) and support of those rules that have any; all are triangles over the head (0, 1).

    A pattern's pairs of edges are made at the vertex that makes the fewest; those that a third edge may close are joined with it.
    `ways` are the graph's meetings; heads with equal variables count for the predicates in `loops`.
    """
    spark = kg.sparkSession
    arms, patterns, uses = triangle_patterns(rules, ways)
    looped = []
    for number, r in enumerate(rules):
        if r.head.p in loops:
            looped.append((number, r.head.p, *(x for a in sorted(r.body, key=lambda a: 0 not in a.ends) for x in (a.p, "o" if a.s == 2 else "s"))))
    found = spark.createDataFrame([], "rule int, x long, y long")
    if uses:
        edges = kg.filter("s <> o")
        half = edges.select(F.col("s").alias("a"), "p", F.lit("s").alias("e"), F.col("o").alias("far")).union(edges.select("o", "p", F.lit("o"), "s"))
        sides = []
        for k, far in ((0, "b"), (1, "c")):
            listed = F.broadcast(spark.createDataFrame([(n, *labels[k]) for labels, n in arms.items()], "arm int, p string, e string"))
            sides.append(half.join(listed, ["p", "e"]).select("a", "arm", F.col("far").alias(far)))
        number = {p: k for k, p in enumerate(sorted({key[1] for key in patterns}))}
        closes = F.broadcast(spark.createDataFrame([(n, arm, number[p], forth) for (arm, p, forth), n in patterns.items()], "pattern int, arm int, k int, forth boolean"))
        third = edges.join(F.broadcast(spark.createDataFrame([(p, k) for p, k in number.items()], "p string, k int")), "p").select("k", "s", "o")
        open_ = sides[0].join(sides[1], ["a", "arm"]).filter("b <> c").join(closes, "arm")
        open_ = open_.select("pattern", "k", "a", F.expr("if(forth, b, c)").alias("s"), F.expr("if(forth, c, b)").alias("o")).withColumn("h_", F.xxhash64("k", "s", "o"))
        # Not a semi-join: Spark would move that one below the filter, and with it all pairs.  Rows that double go at the end.
        closed = _possible(open_, "h_", third.select(F.xxhash64("k", "s", "o").alias("h_"))).drop("h_").join(third, ["k", "s", "o"])
        listed = F.broadcast(spark.createDataFrame(uses, "pattern int, rule int, x string, y string"))

        def corner(of: str):
            return F.expr(f"case {of} when 'a' then a when 's' then s else o end").alias(of)

        found = closed.join(listed, "pattern").select("rule", corner("x"), corner("y"))
    if looped:
        listed = F.broadcast(spark.createDataFrame(looped, "rule int, p string, p1 string, e1 string, p2 string, e2 string"))
        own = kg.filter("s = o").select("p", F.col("s").alias("x")).join(listed, "p").drop("p")
        few = own.select(F.xxhash64("x").alias("h_"))
        edges = kg.filter("s <> o")
        for k in "12":
            half = edges.select(F.col("s").alias("x"), F.col("p").alias(f"p{k}"), F.lit("s").alias(f"e{k}"), F.col("o").alias("z")).union(edges.select("o", "p", F.lit("o"), "s"))
            half = _possible(half.withColumn("h_", F.xxhash64("x")), "h_", few).drop("h_")
            own = own.join(half, ["x", f"p{k}", f"e{k}", *(["z"] if k == "2" else [])])
        found = found.union(own.select("rule", "x", F.col("x").alias("y")))
    return found.distinct().groupBy("rule").agg(F.count("*").alias("support"))


def _triangles(kg: DataFrame, ends: tuple[tuple[int, int], ...], candidates: DataFrame | None, head_injective: bool) -> DataFrame:
    """shape_support of a triangle; the tuples of predicates that can meet, or candidates, are listed on the driver."""
    ways, loops = meetings(kg), set() if head_injective else looped_heads(kg)
    if candidates is None:
        # The ends of the atom between 0 and 2, and of that between 1 and 2.
        (x, z), (y, w) = (("s", "o") if e[1] == 2 else ("o", "s") for e in sorted(ends, key=lambda e: 0 not in e))
        beside: dict[str, list[str]] = {}
        for (q, e), (r, f) in ways:
            if (e, f) == (z, w):
                beside.setdefault(q, []).append(r)
        met = {(p, q, r) for (p, e), (q, f) in ways if (e, f) == ("s", x) for r in beside.get(q, []) if ((p, "o"), (r, y)) in ways}
        met |= {(p, q, r) for p in loops for (q, e), (r, f) in ways if (e, f) == (x, y)}
        listed = sorted(met if 0 in ends[0] else {(p, r, q) for p, q, r in met})
    else:
        listed = [tuple(r) for r in candidates.select("p0", "p1", "p2").distinct().toLocalIterator()]
    rules = [Rule(Atom(0, t[0], 1), tuple(Atom(s, p, o) for (s, o), p in zip(ends, t[1:], strict=True))) for t in listed]
    names = kg.sparkSession.createDataFrame([(k, *t) for k, t in enumerate(listed)], "rule int, p0 string, p1 string, p2 string")
    return triangle_support(kg, rules, ways, loops).join(F.broadcast(names), "rule").select("p0", "p1", "p2", "support")


def shape_support(kg: DataFrame, ends: tuple[tuple[int, int], ...], candidates: DataFrame | None = None, head_injective: bool = False) -> DataFrame:
    """p0 (head), p1, ... and support of all rules of the shape with support, or of those in `candidates` (p0, p1, ...)."""
    if is_triangle(ends):
        return _triangles(kg.select("s", "p", "o"), ends, candidates, head_injective)
    atoms = [Atom(s, str(k), o) for k, (s, o) in enumerate(ends, 1)]
    triples = kg.select("s", "p", "o")
    out = triples.select(F.col("s").alias("v0"), F.col("p").alias("p0"), F.col("o").alias("v1")).distinct()
    if candidates is not None:
        out = out.join(F.broadcast(candidates.select("p0").distinct()), "p0", "left_semi")  # rules of one level, a bounded list
    if head_injective:
        out = out.filter("v0 <> v1")
    known, places = {0, 1}, ["p0"]
    spare, enough = leaves(atoms, known), len({v for e in ends for v in e} | known)
    for a in join_order(atoms, bound=known):
        p = f"p{a.p}"
        side = triples.select(F.col("s").alias(column(a.s)), F.col("p").alias(p), F.col("o").alias(column(a.o)))
        places.append(p)
        wanted = None if candidates is None else candidates.select(*places).distinct()
        if wanted is not None:
            side = side.join(F.broadcast(wanted.select(p).distinct()), p, "left_semi")
        shared = [column(v) for v in (a.s, a.o) if v in known]
        if a.ends & spare:  # of a variable's only atom a few values for each neighbour are enough (see plans/compile.py)
            (leaf,) = a.ends & spare
            side = some_of(side, [p, *shared], column(leaf), enough)
        out = out.join(side, shared)
        for v in sorted(a.ends - known):
            for w in known:
                out = out.filter(F.col(column(v)) != F.col(column(w)))
        known |= a.ends
        if wanted is not None:
            out = out.join(F.broadcast(wanted), places, "left_semi")
    names = ["p0", *(f"p{k}" for k in range(1, len(ends) + 1))]
    return out.select(*names, "v0", "v1").distinct().groupBy(*names).agg(F.count("*").alias("support"))


#: Pairs of edges that one job makes of triangles, if they are not all of one pattern's vertex.
PAIRS = 2**24


def _by_pairs(rules: list[Rule], meets: dict) -> Iterator[list[Rule]]:
    """Triangles in lists whose pairs of edges are at most PAIRS, or from one corner; rules that share their pairs are in one."""
    ways = ways_of(meets)
    arms, patterns, uses = triangle_patterns(rules, ways)
    arm_of = {n: key[0] for key, n in patterns.items()}
    of_rule = {number: arm_of[pattern] for pattern, number, _, _ in uses}
    size = {n: ways.get(labels, 0.0) for labels, n in arms.items()}
    groups: list[tuple[float, set[int | None]]] = []
    for n in sorted(size, key=size.__getitem__):
        if groups and groups[-1][0] + size[n] <= PAIRS:
            groups[-1] = groups[-1][0] + size[n], groups[-1][1] | {n}
        else:
            groups.append((size[n], {n}))
    if not groups:
        groups.append((0.0, set()))
    groups[0][1].add(None)  # those that only heads with equal variables can support
    for _, own in groups:
        if found := [r for k, r in enumerate(rules) if of_rule.get(k) in own]:
            yield found


def ways_of(meets: dict) -> dict[tuple[tuple[str, str], tuple[str, str]], float]:
    """The `meetings` among what was `met`."""
    return {k: m.ways for k, m in meets.items() if m.ways is not None}


def supports(kg: DataFrame, rules: list[Rule], meets: dict | None = None) -> dict[Rule, int]:
    """The support of each rule; rules are a level of a miner.  With `meets`, what was `met`, the triples are distinct.

    Open rules of two atoms are counted from what `met`, triangles of all shapes share their pairs of edges, and other
    shapes have one job each.  A job's shuffles are deleted when it has run.
    """
    by_shape: dict[tuple, list[Rule]] = {}
    for r in rules:
        by_shape.setdefault(shape_of(r)[0], []).append(r)
    out = dict.fromkeys(rules, 0)
    plain = {ends: own for ends, own in by_shape.items() if not is_open(ends) and not is_triangle(ends)}
    if len(plain) < len(by_shape):
        if meets is None:
            kg = kg.select("s", "p", "o").distinct()
            meets = met(kg)
        out |= open_supports(kg, [r for ends, own in by_shape.items() if is_open(ends) for r in own], meets)
        triangles = [r for ends, own in by_shape.items() if is_triangle(ends) for r in own]
        loops = looped_heads(kg) if triangles else set()
        for own in _by_pairs(triangles, meets):
            for row in rows_of(triangle_support(kg, own, ways_of(meets), loops)):
                out[own[row["rule"]]] = row["support"]
    for ends, own in plain.items():
        names = [f"p{k}" for k in range(len(ends) + 1)]
        candidates = kg.sparkSession.createDataFrame([shape_of(r)[1] for r in own], ", ".join(f"{n} string" for n in names))
        found = {tuple(row)[:-1]: row["support"] for row in rows_of(shape_support(kg, ends, candidates))}
        for r in own:
            out[r] = found.get(shape_of(r)[1], 0)
    return out
