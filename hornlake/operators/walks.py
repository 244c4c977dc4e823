"""Walks on the graph, many at once: one row a walk, one join a step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hornlake.functions.stats import entities_of, entity_words
from hornlake.operators.sampling import at_places, draw_with, seed_side, shuffled
from hornlake.plans.compile import column, join_order
from hornlake.plans.rule import Atom, Rule
from hornlake.sources.folders import rows_of


def _one_of(df: DataFrame, by: str, seed: int, *more: str) -> DataFrame:
    """A uniformly random row for each value of `by`: the one lowest in a seeded hash of the row."""
    rest = [c for c in df.columns if c != by]
    key = F.xxhash64(F.lit(seed), F.col(by), *(F.col(c) for c in (more or rest)))
    return df.groupBy(by).agg(F.min_by(F.struct(*rest), F.struct(key, *rest)).alias("one_")).select(by, "one_.*")


def beam(kg: DataFrame, r: Rule, corrupt: str, n: int, *, seed: int, selection: str = "Random", sizes: dict[str, int] | None = None) -> DataFrame:
    """draw, s, o, success and the variables: a beam's walk through the PCA query, without going back.

    Only the selected head variable is seeded.  At each atom one of the neighbours that no variable has yet is taken,
    each alike.  A draw succeeds if it gets through and its pair is not in the head; failed draws have null pairs.
    """
    from hornlake.operators.metrics import variable_candidates

    atoms = r.corrupted(corrupt)
    starts, totals = {}, {}
    for end, v in (("x", r.head.s), ("y", r.head.o)):
        found = shuffled(variable_candidates(kg, atoms, v), ["value"], seed + v).select("idx", "value")
        starts[end], totals[end] = found, found.count()
    if not all(totals.values()):
        return kg.limit(0).select(F.lit(0).cast("long").alias("draw"), "s", "o", F.lit(False).alias("success"))
    done = None
    for end, v in (("x", r.head.s), ("y", r.head.o)):
        draws = draw_with(n, totals[end], 3 * seed + v, kg).filter(seed_side(selection, totals["x"], totals["y"], corrupt, F.col("draw"), seed) == end)
        walk = draws.join(starts[end], "idx").select("draw", F.col("value").alias(column(v)))
        known = {v}
        for step, a in enumerate(join_order(atoms, sizes, known)):
            side = kg.filter(F.col("p") == a.p).select(F.col("s").alias(column(a.s)), F.col("o").alias(column(a.o))).distinct()
            new = a.ends - known
            shared = [column(w) for w in (a.s, a.o) if w in known]
            if not new:
                walk = walk.join(side, shared, "left_semi")
                continue
            name = column(next(iter(new)))
            walk = walk.join(side, shared)
            for w in known:
                walk = walk.filter(F.col(name) != F.col(column(w)))
            walk = _one_of(walk, "draw", seed + 31 * step, name)
            known |= a.ends
        walk = walk.select("draw", *(column(w) for w in sorted(known)))
        done = walk if done is None else done.unionByName(walk)
    head = kg.filter(F.col("p") == r.head.p).select(F.col("s").alias("hs"), F.col("o").alias("ho"), F.lit(True).alias("held")).distinct()
    x, y = column(r.head.s), column(r.head.o)
    ended = done.join(head, (F.col(x) == F.col("hs")) & (F.col(y) == F.col("ho")), "left").drop("hs", "ho")
    all_draws = kg.sparkSession.range(1, n + 1).select(F.col("id").alias("draw"))
    out = all_draws.join(ended, "draw", "left")
    success = F.col(x).isNotNull() & F.col("held").isNull()
    return out.select("draw", F.col(x).alias("s"), F.col(y).alias("o"), success.alias("success"), *(c for c in done.columns if c != "draw"))


def _neighbour(kg: DataFrame, walks: DataFrame, at: str, seed: int) -> DataFrame:
    """walk -> p, out, far: from the entity `at`, a uniform (side, predicate) that it has, then a uniform triple of it."""
    ends = kg.select(F.col("s").alias(at), "p", F.lit(True).alias("out"), F.col("o").alias("far")).union(kg.select("o", "p", F.lit(False), "s"))
    near = F.broadcast(walks.select("walk", at)).join(ends.filter(F.col(at) != F.col("far")), at)
    kind = near.groupBy("walk", "p", "out").agg(F.min_by("far", F.struct(F.xxhash64(F.lit(seed), "walk", "p", "out", "far"), "far")).alias("far"))
    return _one_of(kind, "walk", seed + 1, "p", "out")


def _held(walks: DataFrame) -> DataFrame:
    """The rows of a step, one a try at most, without the plan and the shuffles that made them."""
    return walks.sparkSession.createDataFrame(rows_of(walks), walks.schema)


def random_walks(kg: DataFrame, n: int, length: int, *, seed: int, head: str | None = None, max_variables: int | None = None, max_predicates: int | None = None, close: bool = True, words: DataFrame | None = None) -> DataFrame:
    """walk, atoms: the walks among n tries that have exactly `length` distinct atoms and meet the caps.

    Tries are a parameter, few beside the graph, so they travel to it and no step moves its triples.
    A try that fails is left out instead of begun again: what remains follows the same law.  The first atom is a
    uniform triple of `head`, or of any predicate.  Each next atom starts from a uniform vertex of the walk and goes to
    a neighbour.  With `close` the last atom joins open ends: of two, one to the other in either direction; of one, to
    a vertex of the walk; of none, any two vertices; a uniform predicate, then a uniform pair.  `words` are the
    `entity_words` of the triples between different entities, if they are at hand.
    """
    spark = kg.sparkSession
    kg = kg.select("s", "p", "o").filter("s <> o")  # the lowest hash is taken of all rows, so a triple that is there twice changes nothing
    first = kg.filter(F.col("p") == head) if head else kg
    if words is None and head is None:
        words = entity_words(kg)
    # A uniform side, then a uniform entity of it, then a uniform triple there.
    chosen = None
    for side, far in (("s", "o"), ("o", "s")):
        drawn: list[tuple[int, int]] = []

        def places(total: int) -> list[int]:
            drawn[:] = [(r["draw"], r["idx"]) for r in rows_of(draw_with(n if total else 0, total, seed + 5, kg)) if r["draw"] % 2 == int(side == "s")]
            return [place for _, place in drawn]

        total, at = at_places(entities_of(words, side) if head is None else first.select(side).distinct(), seed + len(side), places)
        if not total:
            return spark.createDataFrame([], "walk long, atoms array<struct<s:long,p:string,o:long>>")
        draws = spark.createDataFrame([(draw, at[place]) for draw, place in drawn], f"walk long, {side} long")
        one = _one_of(F.broadcast(draws).join(first, side).select("walk", "s", "p", "o"), "walk", seed + 9)
        one = _held(one)
        chosen = one if chosen is None else chosen.unionByName(one)
    atom = F.struct(F.col("s"), F.col("p"), F.col("o"))
    walks = chosen.select("walk", F.array(atom).alias("atoms"))  # a row a try, as after each step, read twice by the next one
    ends = F.array_distinct(F.flatten(F.transform("atoms", lambda a: F.array(a["s"], a["o"]))))
    for step in range(1, length):
        walks = walks.withColumn("vertices", ends)
        if close and step == length - 1:
            walks = _held(_closed(kg, walks, seed + 1000 * step))
            continue
        pick = F.pmod(F.xxhash64(F.lit(seed + 100 * step), F.col("walk")), F.size("vertices")) + 1
        walks = walks.withColumn("at", F.element_at("vertices", pick.cast("int")))
        found = _neighbour(kg, walks, "at", seed + 1000 * step)
        new = F.when(F.col("out"), F.struct(F.col("at").alias("s"), F.col("p"), F.col("far").alias("o"))).otherwise(F.struct(F.col("far").alias("s"), F.col("p"), F.col("at").alias("o")))
        walks = walks.join(found, "walk").withColumn("new", new).filter(~F.array_contains("atoms", F.col("new"))).select("walk", F.concat("atoms", F.array("new")).alias("atoms"))
        walks = _held(walks)
    walks = walks.filter(F.size("atoms") == length)
    if max_variables is not None:
        walks = walks.filter(F.size(ends) <= max_variables)
    if max_predicates is not None:
        walks = walks.filter(F.size(F.array_distinct(F.transform("atoms", lambda a: a["p"]))) <= max_predicates)
    return walks.select("walk", "atoms")


def _closed(kg: DataFrame, walks: DataFrame, seed: int) -> DataFrame:
    flat = F.flatten(F.transform("atoms", lambda a: F.array(a["s"], a["o"])))
    walks = walks.withColumn("flat", flat).withColumn("open", F.expr("filter(vertices, v -> size(filter(flat, x -> x = v)) = 1)"))
    walks = walks.filter(F.size("open") <= 2)
    u, v = F.explode("vertices"), F.explode("vertices")
    pairs = walks.select("walk", "atoms", "open", "vertices", u.alias("s")).select("walk", "atoms", "open", "s", v.alias("o")).filter("s <> o")
    joins_open = F.expr("forall(open, v -> v = s or v = o)")
    found = F.broadcast(pairs.filter(joins_open)).join(kg, ["s", "o"]).filter(~F.array_contains("atoms", F.struct("s", "p", "o")))
    by_kind = found.groupBy("walk", "p").agg(F.min_by(F.struct("s", "o"), F.struct(F.xxhash64(F.lit(seed), "walk", "s", "o"), "s", "o")).alias("so"))
    one = _one_of(by_kind.select("walk", "p", "so.s", "so.o"), "walk", seed + 1, "p")
    new = one.select("walk", F.struct("s", "p", "o").alias("new"))
    return walks.select("walk", "atoms").join(new, "walk").select("walk", F.concat("atoms", F.array("new")).alias("atoms"))


def walk_rule(atoms: list) -> Rule:
    """The rule of a walk: entities become variables, the first atom is the head."""
    names: dict[int, int] = {}
    made = [Atom(names.setdefault(a["s"], len(names)), a["p"], names.setdefault(a["o"], len(names))) for a in atoms]
    return Rule(made[0], tuple(made[1:]))


def eligible(walks: Column) -> Column:
    """How many distinct entities a walk has."""
    return F.size(F.array_distinct(F.flatten(F.transform(walks, lambda a: F.array(a["s"], a["o"])))))
