"""A rule's atoms as one join plan.

Atoms are joined left to right in a connected order, each on the variables that it shares; one whose variables are
both bound becomes a semi-join.  All variables take different values except the head's two, which may be equal
unless `head_injective` is set.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hornlake.plans.rule import Atom, Rule, degrees


def column(v: int) -> str:
    return "free" if v < 0 else f"v{v}"


def join_order(atoms: Iterable[Atom], sizes: dict[str, int] | None = None, bound: Iterable[int] = ()) -> list[Atom]:
    """Bound atoms first, then the smallest that touches a bound variable; ties in the given order."""
    left, known, out = list(atoms), set(bound), []
    sizes = sizes or {}
    while left:
        near = [a for a in left if not known or a.ends & known]
        if not near:
            raise ValueError(f"the atoms are not connected: {left} share no variable with {out or sorted(known)}")
        best = min(near, key=lambda a: (not a.ends <= known, sizes.get(a.p, 0)))
        left.remove(best)
        known |= best.ends
        out.append(best)
    return out


def _atom(kg: DataFrame, a: Atom) -> DataFrame:
    return kg.filter(F.col("p") == a.p).select(F.col("s").alias(column(a.s)), F.col("o").alias(column(a.o)))


def some_of(side: DataFrame, by: list[str], value: str, n: int) -> DataFrame:
    """The n least values of a column for each value of the others: a limit that Spark applies before the shuffle."""
    side = side.distinct()
    ranked = side.withColumn("rank_", F.row_number().over(Window.partitionBy(*by).orderBy(value)))
    return ranked.filter(F.col("rank_") <= n).drop("rank_")


def _in_piece(side: DataFrame, v: int, piece: tuple[int, int] | None) -> DataFrame:
    """The rows whose value of a variable is in piece k of n, by a hash; all without a piece or the variable."""
    if piece is None or column(v) not in side.columns:
        return side
    return side.filter(F.pmod(F.xxhash64(F.lit(7), column(v)), F.lit(piece[1])) == piece[0])


def leaves(atoms: Iterable[Atom], keep: Iterable[int] = ()) -> set[int]:
    """Variables of a single atom end, but for those to keep."""
    return {v for v, n in degrees(atoms).items() if n == 1} - set(keep)


def matchings(kg: DataFrame, atoms: Iterable[Atom], may_equal: frozenset[int] = frozenset(), sizes: dict[str, int] | None = None, start: DataFrame | None = None, exists: Iterable[int] | None = None, others: int = 0, pieces: dict[int, tuple[int, int]] | None = None) -> DataFrame:
    """All injective matchings, one column for each variable; `start` holds values of some variables already.

    The two variables of `may_equal` are not compared with each other.  With `exists`, only which values of those
    variables have a matching matters.  A leaf, another variable of one atom, then needs no more of its values than
    there are variables (and `others` that come later) to differ from: one that is taken can give way to another.
    So an entity with very many neighbours adds a few rows for a leaf.  `pieces` has for a variable the piece (k of n) of
    its values that are matched.
    """
    atoms = list(atoms)
    spare = leaves(atoms, exists) if exists is not None else set()
    enough = len({v for a in atoms for v in a.ends}) + others
    out = start
    known = {int(c[1:]) if c[0] == "v" else -1 for c in start.columns} if start is not None else set()
    for a in join_order(atoms, sizes, known):
        side = _atom(kg, a)
        for v, piece in (pieces or {}).items():
            side = _in_piece(side, v, piece)
        shared = [column(v) for v in (a.s, a.o) if v in known]
        new = a.ends - known
        if len(new & spare) == 1 and len(new) == 1:
            (leaf,) = new
            side = some_of(side, shared, column(leaf), enough)
        if out is None:
            out = side
        elif not new:
            out = out.join(side, shared, "left_semi")
        else:
            out = out.join(side, shared)
        before = set(known)
        known |= a.ends
        for v in sorted(new):
            for w in sorted((before | new) - {v}):
                if {v, w} != may_equal and (w in before or v < w):
                    out = out.filter(F.col(column(v)) != F.col(column(w)))
    assert out is not None
    return out


def _head_pair(r: Rule, head_injective: bool) -> frozenset[int]:
    return frozenset() if head_injective else frozenset((r.head.s, r.head.o))


def _xy(df: DataFrame, r: Rule) -> DataFrame:
    return df.select(F.col(column(r.head.s)).alias("s"), F.col(column(r.head.o)).alias("o")).distinct()


def _named(pairs: DataFrame, r: Rule) -> DataFrame:
    return pairs.select(F.col("s").alias(column(r.head.s)), F.col("o").alias(column(r.head.o))).distinct()


def judged_pairs(kg: DataFrame, r: Rule, sizes: dict[str, int] | None = None, head_injective: bool = False, piece: tuple[int, int] | None = None) -> DataFrame:
    """The distinct pairs (s, o) of a connected body, matched once, and whether each is held, and contradicted by either end.

    Of an end's head pairs as many others are kept as a matching has values, and one more: one of these then differs
    from all of them if any does.  A `piece` k of n has the pairs of a part of the values of x; together they are all.
    """
    h = r.head
    pair = _head_pair(r, head_injective)
    body = matchings(kg, r.body, pair, sizes, exists=(h.s, h.o), others=1, pieces=None if piece is None else {h.s: piece})
    x, y = column(h.s), column(h.o)
    heads = kg.filter(F.col("p") == h.p).select(F.col("s").alias(x), F.col("o").alias(y)).distinct()
    enough = len(body.columns) + 1
    values = F.array(*(F.col(c) for c in body.columns))
    for end, other, name in ((y, x, "x"), (x, y, "y")):
        few = some_of(heads, [end], other, enough).groupBy(end).agg(F.collect_list(other).alias(f"others_{name}"))
        body = body.join(few, end, "left")
    differs = [F.coalesce(F.size(F.array_except(f"others_{name}", values)) > 0, F.lit(False)).alias(f"against_{name}") for name in "xy"]
    pairs = body.select(x, y, *differs).groupBy(x, y).agg(F.bool_or("against_x").alias("against_x"), F.bool_or("against_y").alias("against_y"))
    held = pairs.join(_in_piece(heads, h.s, piece).withColumn("held", F.lit(True)), [x, y], "left")
    return held.select(F.col(x).alias("s"), F.col(y).alias("o"), F.coalesce("held", F.lit(False)).alias("held"), "against_x", "against_y")


def body_pairs(kg: DataFrame, r: Rule, sizes: dict[str, int] | None = None, head_injective: bool = False) -> DataFrame:
    """Distinct pairs (s, o) for which the body has a matching, in the head or not."""
    return _xy(matchings(kg, r.body, _head_pair(r, head_injective), sizes, exists=(r.head.s, r.head.o)), r)


def supported_pairs(kg: DataFrame, r: Rule, sizes: dict[str, int] | None = None, head_injective: bool = False, among: DataFrame | None = None, piece: tuple[int, int] | None = None, first: Atom | None = None) -> DataFrame:
    """Pairs of the head, or of those `among` them (s, o), for which the body has a matching; of a piece of x's values, if given.

    With an atom `first` the head's pairs are joined with it, then with the others.  If not, a body that joins both variables is matched on its own and the head semi-joined with it: joining a head's pairs
    with one atom first would repeat a subject's edges for each of its pairs.  Other bodies start at the head's pairs.
    """
    pair, ends = _head_pair(r, head_injective), (r.head.s, r.head.o)
    head = _in_piece(_atom(kg, r.head).distinct() if among is None else _named(among, r), r.head.s, piece)
    if head_injective:
        head = head.filter(F.col(column(r.head.s)) != F.col(column(r.head.o)))
    if first is not None:
        rest = [a for a in r.body if a != first]
        return _xy(matchings(kg, [first, *rest], pair, sizes, head, exists=ends, pieces=None if piece is None else {r.head.s: piece}), r)
    if connected_body(r) and among is None:
        names = [column(v) for v in ends]
        body = matchings(kg, r.body, pair, sizes, exists=ends, pieces=None if piece is None else {r.head.s: piece}).select(*names)
        return head.join(body, names, "left_semi").select(F.col(names[0]).alias("s"), F.col(names[1]).alias("o"))
    return _xy(matchings(kg, r.body, pair, sizes, head, exists=ends), r)


def pca_pairs(kg: DataFrame, r: Rule, corrupt: str, sizes: dict[str, int] | None = None, head_injective: bool = False, among: DataFrame | None = None) -> DataFrame:
    """Distinct pairs (s, o), of those `among` if given, with a matching of the body, not in the head, whose kept variable has another head pair.

    The other value is a variable like any: it differs from all values of the matching.  It is only asked to exist.
    """
    h = r.head
    body = matchings(kg, r.body, _head_pair(r, head_injective), sizes, None if among is None else _named(among, r), exists=(h.s, h.o), others=1)
    kept, other = (h.o, "s") if corrupt == "x" else (h.s, "o")
    if corrupt not in ("x", "y"):
        raise ValueError("corrupt is 'x' or 'y'")
    heads = kg.filter(F.col("p") == h.p).select("s", "o")
    facts = heads.select(F.col("o" if corrupt == "x" else "s").alias("kept_"), F.col(other).alias("free_"))
    holds = F.col(column(kept)) == F.col("kept_")
    for c in body.columns:
        holds &= F.col(c) != F.col("free_")
    return _xy(body.join(facts, holds, "left_semi"), r).join(heads, ["s", "o"], "left_anti")


def connected_body(r: Rule) -> bool:
    """Whether the PCA query has one plan: its body joins both head variables."""
    try:
        join_order(r.body)
    except ValueError:
        return False
    return {r.head.s, r.head.o} <= {v for a in r.body for v in a.ends}
