"""Walks, beams, miners, the catalog, policies and diversity."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hornlake.operators import catalog as C
from hornlake.operators import diversity, metrics, policy, shapes
from hornlake.operators.metrics import support
from hornlake.operators.mine_levels import expand, mine, possible, report, seeds
from hornlake.operators.mine_walks import Settings
from hornlake.operators.mine_walks import mine as mine_walks
from hornlake.operators.probability import greedy_product, inverse_probability
from hornlake.operators.walks import beam, random_walks, walk_rule
from hornlake.plans.compile import pca_pairs
from hornlake.plans.rule import Rule, canonical, is_closed, is_minimal, key, rule


@pytest.fixture(scope="module")
def kg(spark):
    rng = random.Random(5)
    rows = {(rng.randrange(25), rng.choice("abc"), rng.randrange(25)) for _ in range(260)}
    return spark.createDataFrame([(*r, 0) for r in rows], "s long, p string, o long, split int").cache()


def test_level_miner_finds_every_rule(kg):
    found = {key(m.rule): m.support for m in mine(kg, max_length=3, min_head_coverage=0.2)}
    assert found
    candidates: dict[str, Rule] = {}
    for two in seeds(["a", "b", "c"]):
        for r in [two, *expand(two, ["a", "b", "c"], dangling=False)]:
            if is_closed(r):
                candidates[key(r)] = r
    sizes = {r["p"]: r["count"] for r in kg.groupBy("p").count().collect()}
    rng = random.Random(4)
    for k in rng.sample(sorted(candidates), 12):
        n = support(kg, candidates[k]).first()["support"]
        assert found.get(k) == (n if n / sizes[candidates[k].head.p] >= 0.2 else None)


def files_of_shuffles(spark) -> int:
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(k).getName().startswith("shuffle_") for k in range(files.size()))


def test_level_miner_leaves_no_shuffles(spark, kg):
    kg.count()
    before = files_of_shuffles(spark)
    assert mine(kg, max_length=3, min_head_coverage=0.2)
    assert files_of_shuffles(spark) <= before


def test_open_rules_are_counted_without_pairs(spark):
    """Against the plan that matches pairs, on a graph with loops, doubled triples, hubs and entities of one edge."""
    rng = random.Random(11)
    rows = [(rng.randrange(30), rng.choice("aab"), rng.randrange(30)) for _ in range(70)] + [(0, "c", k) for k in range(20)] + [(k, "c", k) for k in range(5)]
    kg = spark.createDataFrame(rows * 2, "s long, p string, o long").cache()
    rules = [r for r in seeds(["a", "b", "c"]) if shapes.is_open(shapes.shape_of(r)[0])]
    found = shapes.supports(kg, rules)
    for ends in {shapes.shape_of(r)[0] for r in rules}:
        matched = {tuple(x)[:2]: x["support"] for x in shapes.shape_support(kg, ends).collect()}
        assert matched and {shapes.shape_of(r)[1]: found[r] for r in rules if shapes.shape_of(r)[0] == ends and found[r]} == matched
    kg.unpersist()


def test_triangle_pairs_are_filtered_before_they_move(kg, monkeypatch):
    rules = [rule("a(x,y)", "b(x,z)", "c(z,y)"), rule("b(x,y)", "a(x,z)", "c(y,z)"), rule("c(x,y)", "a(z,x)", "a(z,y)")]
    plan = shapes.triangle_support(kg, rules, shapes.meetings(kg), set())._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan  # Spark moves a semi-join below the join with the filter
    together = shapes.supports(kg, rules)
    monkeypatch.setattr(shapes, "PAIRS", 0)  # each corner on its own
    assert shapes.supports(kg, rules) == together == {r: support(kg, r).first()["support"] for r in rules}


def test_report_and_bounds(kg):
    mined = mine(kg, max_length=2, min_head_coverage=0.05)
    rows = report(kg, mined, pca=True).collect()
    assert len(rows) == len(mined) and {"pca_x", "pca_y", "head_coverage"} <= set(rows[0].asDict())
    assert all(is_minimal(r) for r in seeds(["a", "b"]))
    assert not possible(rule("a(x,y)", "b(y,x)"), set())
    assert len(seeds(["a", "b"], reference=True)) < len(seeds(["a", "b"]))


def test_walks(kg):
    triples = {(r["s"], r["p"], r["o"]) for r in kg.collect()}
    for length, close in ((2, True), (3, True), (3, False)):
        walks = random_walks(kg, 60, length, seed=2, close=close, max_variables=3).collect()
        assert walks
        for w in walks:
            atoms = [(a["s"], a["p"], a["o"]) for a in w["atoms"]]
            assert len(set(atoms)) == length and set(atoms) <= triples and all(s != o for s, _, o in atoms)
            assert len({v for s, _, o in atoms for v in (s, o)}) <= 3
            if close:
                assert is_closed(walk_rule(w["atoms"]))
    headed = random_walks(kg, 30, 2, seed=1, head="b").collect()
    assert {w["atoms"][0]["p"] for w in headed} == {"b"}
    again = random_walks(kg, 30, 2, seed=1, head="b").collect()
    assert headed == again
    assert random_walks(kg, 5, 2, seed=1, head="none").count() == 0


def test_walks_read_each_step_once(kg):
    for close in (True, False):
        found = random_walks(kg, 20, 3, seed=2, close=close)
        assert found._jdf.queryExecution().optimizedPlan().collectLeaves().length() == 1  # the last step, kept; not all steps over and over
    assert random_walks(kg.union(kg), 20, 3, seed=2).collect() == random_walks(kg, 20, 3, seed=2).collect()


def test_beam_finds_contradictions(kg):
    r = rule("a(x,y)", "b(x,z)", "c(z,y)")
    held = {(x["s"], x["o"]) for x in pca_pairs(kg, r, "y").collect()}
    for selection in ("Random", "NonCorrupt", "Minimum"):
        rows = beam(kg, r, "y", 80, seed=3, selection=selection).collect()
        assert sorted(x["draw"] for x in rows) == list(range(1, 81))
        wins = {(x["s"], x["o"]) for x in rows if x["success"] and x["s"] != x["o"]}
        assert wins and wins <= held
    with pytest.raises(ValueError):
        beam(kg, r, "y", 5, seed=3, selection="None")


def test_inverse_probability(kg):
    assert greedy_product([(0, 1), (1, 2)], [10.0, 20.0], {0: 5, 1: 4, 2: 9}, [2.0, 3.0], [1.0, 7.0]) == 4.0 * 3.0
    r = rule("a(x,y)", "b(x,z)", "c(z,y)")
    draws = beam(kg, r, "y", 40, seed=3, selection="NonCorrupt")
    rows = inverse_probability(kg, draws, r.corrupted("y"), given=0).collect()
    assert len(rows) == 40 and all((x["inv_prob"] is not None) == (x["s"] is not None) for x in rows)
    assert all(x["inv_prob"] > 0 for x in rows if x["success"])


def test_walk_miner(kg):
    seen = []
    out = mine_walks(kg, Settings(budget=24, batch=12, max_length=3, features=frozenset(), seed=1), lambda *a: seen.append(a)).collect()
    assert len(out) == len(seen) and len({r["key"] for r in out}) == len(out)
    for rule_id, r, row in seen:
        assert row["support"] == support(kg, r).first()["support"] and rule_id >= 1
    assert mine_walks(kg, Settings(budget=8, batch=4, max_length=2, features=frozenset({"Head"}), reward="Effort", all_heads=True, seed=2)).count() >= 0


def test_bodies_in_pieces_add_up(kg, monkeypatch):
    sizes, ways = {x["p"]: x["count"] for x in kg.groupBy("p").count().collect()}, shapes.meetings(kg)
    monkeypatch.setattr(metrics, "MATCHINGS", 250)
    for r in (rule("a(x,y)", "b(x,z)", "c(z,y)"), rule("b(x,y)", "a(y,x)"), rule("c(x,y)", "c(z,x)", "b(z,y)")):
        pieces = metrics.pieces_of(r, sizes, ways)
        assert len(pieces) == (1 if r.length == 2 else -(-round(ways[("b", "o"), ("c", "s")] if r.head.p == "a" else ways[("c", "s"), ("b", "s")]) // 250))
        whole = metrics.judged_counts(kg, r).first().asDict()
        parts = [metrics.judged_counts(kg, r, piece=x).first().asDict() for x in pieces]
        assert {c: sum(x[c] for x in parts) for c in whole} == whole and whole["body"]
        assert sum(support(kg, r, piece=x).first()["support"] for x in pieces) == whole["support"]


@pytest.mark.parametrize("way", ["matched", "in pieces", "from pairs of values"])
def test_triangles_are_judged_without_all_matchings(spark, monkeypatch, way):
    """Against the plan that judges every matching: on hubs, loops of heads, and ends with one or two other head pairs."""
    rng = random.Random(8)
    rows = {(rng.randrange(14), rng.choice("abc"), rng.randrange(14)) for _ in range(150)} | {(k, "a", k) for k in range(5)} | {(k, "d", (k * 5) % 14) for k in range(14)} | {(k, "e", 0) for k in range(14)}
    kg = spark.createDataFrame(sorted(rows), "s long, p string, o long").cache()
    if way != "matched":
        monkeypatch.setattr(metrics, "MATCHINGS", 0)
        monkeypatch.setattr(metrics, "ROWS", 200)
        monkeypatch.setattr(metrics, "FEWER", 0 if way == "from pairs of values" else 10**9)
    rules = [rule(f"{p}(x,y)", f"{q}(x,z)", f"{t}(z,y)") for p, q, t in ("abc", "dab", "ade")]
    rules += [rule("d(x,y)", "b(z,x)", "b(z,y)"), rule("a(x,y)", "b(z,x)", "a(y,z)"), rule("e(x,y)", "a(x,z)", "a(y,z)")]
    meets = shapes.met(kg, rules)
    assert shapes.ways_of(meets).items() <= shapes.ways_of(shapes.met(kg)).items()
    ways, counted, loops = shapes.ways_of(meets), shapes.supports(kg, rules, meets), shapes.looped_heads(kg)
    for r in rules:
        assert metrics.is_triangle(r)
        assert metrics.triangle_counts(kg, r, counted[r], ways, loops) == metrics.judged_counts(kg, r).first().asDict()
    kg.unpersist()


def test_triangle_supports_start_where_fewest_meet(kg, monkeypatch):
    sizes = {x["p"]: x["count"] for x in kg.groupBy("p").count().collect()}
    rules = [rule("a(x,y)", "b(x,z)", "c(z,y)"), rule("b(x,y)", "c(z,x)", "c(z,y)"), rule("c(x,y)", "a(y,x)"), rule("a(x,y)", "a(z,x)", "b(y,z)")]
    ways = shapes.ways_of(shapes.met(kg, rules))
    monkeypatch.setattr(metrics, "MATCHINGS", 800)
    for r in rules:
        for few in (*r.body, None):  # each variable in turn is where the fewest meet
            own = {k: n / 10 if few and r.length == 3 and {k[0][0], k[1][0]} == {r.head.p, few.p} else n for k, n in ways.items()}
            jobs = metrics.support_jobs(r, sizes, own)
            assert sum(support(kg, r, **job).first()["support"] for job in jobs) == support(kg, r).first()["support"]
            assert few is None or r.length == 2 or r.head.p in r.body_predicates or "first" in jobs[0]
    assert not metrics.is_triangle(rules[2])


def test_entities_are_drawn_as_from_the_shuffled_list(kg):
    from hornlake.functions.stats import entities_of, entity_words
    from hornlake.operators.sampling import at_places, shuffled

    more = kg.union(kg.selectExpr("-s * 1000003", "p", "o + 9000000000", "split"))
    words = entity_words(more)
    for side in "so":
        values = more.select(F.col(side).alias("value")).distinct()
        assert sorted(entities_of(words, side).collect()) == sorted(values.collect())
        listed = {r["idx"]: r["value"] for r in shuffled(values, ["value"], 4).collect()}
        assert at_places(entities_of(words, side), 4, lambda n: range(0, n, 3)) == (len(listed), {k: listed[k] for k in range(0, len(listed), 3)})
    assert at_places(values.limit(0), 4, lambda n: []) == (0, {})


def test_lifted_triples_are_the_same_in_blocks(spark):
    from hornlake.sources.lift import lift

    plain, blocks = (lift(spark, "/root/testdata/sf0.001", blocks=b) for b in (False, True))
    assert plain.schema == blocks.schema and sorted(plain.collect()) == sorted(blocks.collect())
    settings = Settings(budget=12, batch=6, max_length=3, features=frozenset(), seed=5)
    assert sorted(mine_walks(plain, settings).collect()) == sorted(mine_walks(blocks, settings, distinct=True).collect())


def test_walk_miner_leaves_no_shuffles(spark, kg):
    kg.count()
    before = files_of_shuffles(spark)
    assert mine_walks(kg, Settings(budget=8, batch=4, max_length=3, features=frozenset(), seed=1)).count()
    assert files_of_shuffles(spark) <= before


def test_catalog(spark):
    a, b, c = (canonical(rule(*x)) for x in (("p(x,y)", "q(x,y)"), ("q(x,y)", "p(x,y)"), ("p(x,y)", "q(y,x)")))
    cat = C.insert(C.empty(spark), C.rows(spark, [a, b, a]))
    cat = C.insert(cat, C.rows(spark, [b, c])).cache()
    assert sorted(r["rule_id"] for r in C.ids(cat).collect()) == [1, 2, 3]
    assert C.read(cat, C.find(cat, c).first()["rule_id"]) == c
    assert C.insert(C.empty(spark), C.rows(spark, [a, b], marked=False)).count() == 1
    first = C.next_pending(cat)
    busy = C.with_status(cat, first, C.PROCESSING)
    assert C.count_pending(busy).first()[0] == 2 and C.next_pending(busy).first()[0] == 2
    assert C.count_pending(C.resume(busy)).first()[0] == 3
    assert C.count_pending(C.with_status(cat, cat, C.DONE)).first()[0] == 0 and C.next_pending(C.with_status(cat, cat, C.DONE)).first()[0] is None


def test_policies():
    profiles = policy.profile_grid({"Length", "Head"}, 3, ["a", "b"])
    assert len(profiles) == 4
    assert len(policy.profile_grid({"NumberOfVariables"}, 3, ["a"])) == 3
    value = {p: i for i, p in enumerate(profiles)}.get
    best = policy.MaxPolicy(profiles, 0.0, 1)
    assert {best.next(value) for _ in range(20)} == {profiles[-1]}
    picks = Counter(policy.ProbabilityPolicy(profiles, 0.0, 1).next(value) for _ in range(1) for _ in range(1))
    assert set(picks) <= set(profiles)
    static = policy.StaticProbabilityPolicy(profiles, 0.0, 1, switch=5)
    runs = [static.next(value) for _ in range(20)]
    assert all(len(set(runs[i : i + 5])) == 1 for i in range(0, 20, 5))
    static.report_rule(profiles[0])
    static.report_failure(profiles[0])
    assert sum(r[1] + r[2] for r in static.report()) == 1
    with pytest.raises(ValueError):
        policy.MaxPolicy([], 0.1, 1)
    assert policy.rule_reward("SupportConfLength", 10, 0.5, 0.5, 3, 7) == 2.5
    assert policy.rule_reward("F1", 0, 0, 0, 0, 0) == 0 and policy.rule_reward("F1", 0, 0, 0, 0, 0, reference=True) == 100
    assert policy.rule_reward("ConfLengthPredSize", 3, 0.5, 0.5, 3, 8) == 2 and policy.rule_reward("ConfLengthPredSize", 3, 0.5, 0.5, 3, 8, reference=True) == 4
    reward = policy.MetricReward("Support", 2)
    for v in (1.0, 2.0, 4.0):
        reward.add(profiles[0], v)
    assert reward.reward(profiles[0]) == 3.0 and reward.reward(profiles[1]) == 0.0
    grid = list(policy.experiment_grid("WN18"))
    assert len(policy.single_runs()) == 13 and len(grid) == 2 * (4 * 3 + 1) * 2 * (6 * 3 + 1) * 3


def test_diversity_on_driver_and_spark(spark):
    rng = random.Random(3)
    counts = Counter(int(rng.expovariate(0.2)) for _ in range(60))
    rows = spark.createDataFrame([("p", k) for k, n in counts.items() for _ in range(n)], "profile string, rule_id long")
    row = diversity.diversity(rows, ["profile"], "rule_id").first()
    assert row["species"] == len(counts) and row["n"] == 60
    assert row["effort"] == pytest.approx(diversity.effort(counts, 0.95))
    assert diversity.abundance(rows, ["profile"], "rule_id").agg(F.sum("species")).first()[0] == len(counts)
    assert diversity.effort(Counter(), 0.95) == 0.0


def test_estimation_grid(kg):
    from hornlake.operators.grid import pca_count, pca_estimates, support_estimates

    r = rule("a(x,y)", "b(x,z)", "c(z,y)")
    rows = support_estimates(kg, r, runs=1).collect()
    assert len(rows) == len({x["technique"] for x in rows}) == 144
    exact = [x for x in rows if x["technique"].startswith("Support_Hypergeometric_Chernoff")]
    assert all(abs(x["q_error"]) < 0.2 for x in exact) and all(x["n"] >= 50 for x in rows)
    rows = pca_estimates(kg, r, "y", runs=1, selections=["NonCorrupt"]).collect()
    assert len(rows) == 109 and sum(x["technique"] == "PCA_AnyBURL__NonCorrupt" for x in rows) == 1
    truth = pca_pairs(kg, r, "y").count()
    assert pca_count(kg, r, "y", method="auto").first()["pca"] == truth
    assert pca_count(kg, r, "y", method="clt", accuracy=0.02, confidence=0.05).first()["pca"] == pytest.approx(truth, rel=0.3)
    with pytest.raises(ValueError):
        pca_count(kg, r, "y", method="guess")


def test_exact_or_clt_switches_by_candidate_pairs(spark):
    """The registered query against the candidate pairs and contradictions counted apart from it."""
    from hornlake.estimation_queries import RULES, pca_exact_or_clt
    from hornlake.functions.numeric import clt_bound
    from hornlake.operators import metrics as M
    from hornlake.sources.lift import lift

    r, methods = RULES["r4"], set()
    for sf in ("sf0.001", "sf0.1"):
        kg = lift(spark, f"/root/testdata/{sf}")
        pairs = M.variable_candidates(kg, r.corrupted("x"), r.head.s).count() * M.variable_candidates(kg, r.corrupted("x"), r.head.o).count()
        truth = M.pca_contradictions(kg, r, "x").first()["pca"]
        row = pca_exact_or_clt(spark, f"/root/testdata/{sf}").first()
        assert row["method"] == ("clt" if pairs >= clt_bound(0.005, 0.0005) else "exact")
        assert abs(row["pca"] - truth) <= (0.005 * pairs if row["method"] == "clt" else 0)
        methods.add(row["method"])
    assert methods == {"exact", "clt"}
