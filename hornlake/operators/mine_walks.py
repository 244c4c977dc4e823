"""Mining by random walks: micro-batches of walks, guided by a policy over profiles.

Rewards are sequential by nature; a batch delays them by its length, and batches of one walk restore the order.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from hornlake.functions.stats import entity_words, kept, kept_as_is, predicate_sizes
from hornlake.operators.metrics import is_triangle, judged_counts, pieces_of, triangle_counts
from hornlake.operators.policy import POLICIES, EffortReward, MetricReward, Profile, profile_grid, rule_reward
from hornlake.operators.shapes import looped_heads, met, supports, ways_of
from hornlake.operators.walks import random_walks, walk_rule
from hornlake.plans.compile import connected_body
from hornlake.plans.rule import Rule, body_connected, canonical, check, heads, is_closed, key, render
from hornlake.sources.folders import delete_stored, rows_of, stored


@dataclass
class Settings:
    budget: int = 1000
    batch: int = 100
    max_length: int = 4
    min_head_coverage: float = 0.05
    epsilon: float = 0.1
    policy: str = "Probability"
    reward: str = "SupportConfLength"
    window: int = 5
    features: frozenset[str] = frozenset({"Head"})
    closing: bool = True
    all_heads: bool = False
    seed: int = 0
    biases: list[Callable[[Rule], bool]] = field(default_factory=lambda: [is_closed, body_connected])


def mine(kg: DataFrame, settings: Settings, process: Callable[[int, Rule, dict], None] | None = None, distinct: bool = False) -> DataFrame:
    """rule_id, rule, key, support, head_coverage, pca_x, pca_y of the rules found; `process` is called for each.

    Triples that are known to be `distinct` do not move for it.
    """
    kg = kept(kg) if not distinct else kept_as_is(kg)
    try:
        return mine_kept(kg, settings, process)
    finally:
        delete_stored(kg)


def mine_kept(kg: DataFrame, settings: Settings, process: Callable[[int, Rule, dict], None] | None = None) -> DataFrame:
    """The same over triples that are distinct and cheap to read again and again."""
    between = entity_words(kg.filter("s <> o"))
    words = stored(between.repartition(kg.sparkSession.sparkContext.defaultParallelism), "entities")
    try:
        return _mine(kg, words, settings, process)
    finally:
        delete_stored(words)


def _mine(kg: DataFrame, words: DataFrame, settings: Settings, process: Callable[[int, Rule, dict], None] | None) -> DataFrame:
    sizes = {r["p"]: r["size"] for r in rows_of(predicate_sizes(kg))}
    rng = random.Random(settings.seed)
    profiles = profile_grid(set(settings.features), settings.max_length, sorted(sizes))
    extra = (settings.window,) if settings.policy == "StaticProbability" else ()
    policy = POLICIES[settings.policy](profiles, settings.epsilon, settings.seed, *extra)
    reward = EffortReward() if settings.reward == "Effort" else MetricReward(settings.reward, settings.window)
    known: dict[str, int] = {}
    found: list[tuple] = []
    for begin in range(0, settings.budget, settings.batch):
        profile = policy.next(reward.reward)
        n = min(settings.batch, settings.budget - begin)
        walks = random_walks(kg, n, seed=settings.seed * 7919 + begin, close=settings.closing, words=words, **profile.walk(rng, settings.max_length))
        rules = [walk_rule(row["atoms"]) for row in rows_of(walks.orderBy("walk"))]
        for _ in range(n - len(rules)):
            _failed(policy, reward, profile)
        new: dict[str, Rule] = {}
        for r in [h for r in rules for h in (heads(r) if settings.all_heads else [r])]:
            r = canonical(r)
            if not check(r, settings.biases):
                _failed(policy, reward, profile)
            elif key(r) in known or key(r) in new:
                policy.report_repeated(profile)
                if isinstance(reward, EffortReward) and key(r) in known:
                    reward.add(profile, known[key(r)])
            else:
                new[key(r)] = r
        evaluated = _evaluated(kg, new, sizes, settings.min_head_coverage)
        for k, r in sorted(new.items()):
            known[k] = len(known) + 1
            row = evaluated[k]
            policy.report_rule(profile)
            confidence = max(row["pca_confidence_x"] or 0.0, row["pca_confidence_y"] or 0.0)
            value = known[k] if isinstance(reward, EffortReward) else rule_reward(settings.reward, row["support"], row["head_coverage"], confidence, r.length, row["predicate_size"])
            reward.add(profile, value)
            found.append((known[k], render(r), k, row["support"], row["head_coverage"], row["pca_x"], row["pca_y"]))
            if process:
                process(known[k], r, row)
    return kg.sparkSession.createDataFrame(found, "rule_id long, rule string, key string, support long, head_coverage double, pca_x long, pca_y long")


def _evaluated(kg: DataFrame, new: dict[str, Rule], sizes: dict[str, int], min_head_coverage: float) -> dict[str, dict]:
    """Metrics of a batch's rules: supports together, the rest only for rules with enough head coverage, large bodies in pieces."""
    if not new:
        return {}
    meets = met(kg, new.values())
    ways = ways_of(meets)
    counted = supports(kg, list(new.values()), meets)
    loops = looped_heads(kg) if any(map(is_triangle, new.values())) else set()
    out = {}
    for k, r in new.items():
        size = sizes.get(r.head.p, 0)
        out[k] = {"predicate_size": size, "support": counted[r], "head_coverage": counted[r] / size if size else 0.0, "pca_x": None, "pca_y": None, "pca_confidence_x": None, "pca_confidence_y": None}
    for k, r in new.items():
        if out[k]["head_coverage"] >= min_head_coverage and connected_body(r):
            if is_triangle(r):
                total = triangle_counts(kg, r, counted[r], ways, loops)
            else:
                parts = [rows_of(judged_counts(kg, r, sizes=sizes, piece=piece))[0].asDict() for piece in pieces_of(r, sizes, ways)]
                total = {c: sum(part[c] for part in parts) for c in parts[0]}
            n = total["support"]
            out[k] |= total | {f"pca_confidence_{c}": n / (n + total[f"pca_{c}"]) if n + total[f"pca_{c}"] else 0.0 for c in "xy"}
            out[k] |= {"rule": k, "standard_confidence": n / total["body"] if total["body"] else 0.0}
    return out


def _failed(policy, reward: MetricReward | EffortReward, profile: Profile) -> None:
    """A failure is worth nothing; for the effort it is a species of its own."""
    policy.report_failure(profile)
    reward.add(profile, -1 if isinstance(reward, EffortReward) else 0.0)
