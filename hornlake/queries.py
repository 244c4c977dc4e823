"""The registered queries of the rule engine and the SQL that they equal.

All run on a knowledge graph lifted from the star-schema tables (sources/lift.py), over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornlake.functions import stats
from hornlake.operators import metrics as M
from hornlake.plans.rule import FREE, Rule, rule
from hornlake.sources.lift import KG_SQL, lift

RULES: dict[str, Rule] = {
    "r1": rule("supplier_region(x,y)", "supplier_nation(x,z)", "nation_region(z,y)"),
    "r2": rule("bought_from(x,y)", "bought(x,z)", "supplies(y,z)"),
    "r3": rule("supplies(x,y)", "order_supplier(z,x)", "order_part(z,y)"),
    "r4": rule("customer_nation(x,y)", "bought_from(x,z)", "supplier_nation(z,y)"),
    "r5": rule("bought(x,y)", "order_customer(z,x)", "order_part(z,y)"),
    "r6": rule("trades_with(x,y)", "trades_with(y,x)"),
    "r7": rule("trades_with(x,y)", "trades_with(z,x)", "trades_with(z,y)"),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# Triples and their statistics

_SPLIT = "CASE WHEN (s % 10 + o % 10) % 10 = 8 THEN 1 WHEN (s % 10 + o % 10) % 10 = 9 THEN 2 ELSE 0 END"


@query("kg_triples", f"{KG_SQL} SELECT s, p, o, split::INTEGER AS split FROM kg")
def kg_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lift(spark, sf_dir)


@query("predicate_sizes", f"{KG_SQL} SELECT p, count(*) AS size FROM kg GROUP BY p")
def predicate_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.predicate_sizes(lift(spark, sf_dir))


@query(
    "degrees",
    f"""{KG_SQL} SELECT p, entity, sum(a)::BIGINT AS out, sum(b)::BIGINT AS inn FROM (
        SELECT p, s AS entity, count(DISTINCT o) AS a, 0 AS b FROM kg GROUP BY ALL
        UNION ALL SELECT p, o, 0, count(DISTINCT s) FROM kg GROUP BY p, o) GROUP BY p, entity""",
)
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.degrees(lift(spark, sf_dir))


@query("predicate_domain_range", f"{KG_SQL} SELECT p, count(DISTINCT s) AS subjects, count(DISTINCT o) AS objects FROM kg GROUP BY p")
def predicate_domain_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.predicate_domain_range(lift(spark, sf_dir))


@query("entity_count", f"{KG_SQL} SELECT count(*) AS entities FROM (SELECT s FROM kg UNION SELECT o FROM kg)")
def entity_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.entity_count(lift(spark, sf_dir))


@query("split_filter", f"{KG_SQL}, sp AS (SELECT p, {_SPLIT} AS split FROM kg) SELECT p, count(*) AS size FROM sp WHERE split <= 1 GROUP BY p")
def split_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.predicate_sizes(stats.in_splits(lift(spark, sf_dir, by_split=True), 1))


@query("lookup_by_subject", f"{KG_SQL} SELECT s, o FROM kg WHERE p = 'bought' AND s IN (SELECT s FROM kg WHERE p = 'bought_from')")
def lookup_by_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    kg = lift(spark, sf_dir)
    return stats.by_subject(kg, "bought", stats.subjects(kg, "bought_from"))


@query("lookup_by_object", """
    WITH bought AS (SELECT DISTINCT l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity >= 40)
    SELECT DISTINCT 6000000000 + l_orderkey AS s, 5000000000 + l_partkey AS o FROM lineitem JOIN bought USING (l_partkey)""")
def lookup_by_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    kg = lift(spark, sf_dir)
    return stats.by_object(kg, "order_part", stats.objects(kg, "bought"))


# Exact metrics


def _conditions(r: Rule, free: str | None) -> tuple[str, str]:
    """FROM items and conditions of the body (and the head with one variable free) given x = h.s and y = h.o of an outer row."""
    atoms = list(r.body) if free is None else list(r.corrupted(free))
    at: dict[int, str] = {r.head.s: "c.s", r.head.o: "c.o"}
    where = []
    for k, a in enumerate(atoms):
        where.append(f"t{k}.p = '{a.p}'")
        for v, end in ((a.s, "s"), (a.o, "o")):
            if v in at:
                where.append(f"t{k}.{end} = {at[v]}")
            else:
                at[v] = f"t{k}.{end}"
    names = sorted(at)
    where += [f"{at[v]} <> {at[w]}" for v in names for w in names if v < w and {v, w} != {r.head.s, r.head.o}]
    return ", ".join(f"kg t{k}" for k in range(len(atoms))), " AND ".join(where)


def support_sql(r: Rule) -> str:
    tables, where = _conditions(r, None)
    return f"SELECT count(*) AS n FROM kg c WHERE c.p = '{r.head.p}' AND EXISTS (SELECT 1 FROM {tables} WHERE {where})"


def _candidates_sql(r: Rule, free: str | None) -> str:
    """Distinct (s, o) of matchings, all atoms joined at once."""
    atoms = list(r.body) if free is None else list(r.corrupted(free))
    at: dict[int, str] = {}
    where = []
    for k, a in enumerate(atoms):
        where.append(f"t{k}.p = '{a.p}'")
        for v, end in ((a.s, "s"), (a.o, "o")):
            if v in at:
                where.append(f"t{k}.{end} = {at[v]}")
            else:
                at[v] = f"t{k}.{end}"
    names = sorted(at)
    where += [f"{at[v]} <> {at[w]}" for v in names for w in names if v < w and {v, w} != {r.head.s, r.head.o}]
    return f"SELECT DISTINCT {at[r.head.s]} AS s, {at[r.head.o]} AS o FROM {', '.join(f'kg t{k}' for k in range(len(atoms)))} WHERE {' AND '.join(where)}"


def pca_sql(r: Rule, free: str) -> str:
    return f"SELECT count(*) AS n FROM ({_candidates_sql(r, free)}) c WHERE NOT EXISTS (SELECT 1 FROM kg h WHERE h.p = '{r.head.p}' AND h.s = c.s AND h.o = c.o)"


def body_sql(r: Rule) -> str:
    return f"SELECT count(*) AS n FROM ({_candidates_sql(r, None)})"


def _metrics_sql() -> str:
    rows = [
        f"SELECT '{name}' AS rule, (SELECT count(*) FROM kg WHERE p = '{r.head.p}') AS predicate_size, ({support_sql(r)}) AS support, "
        f"({pca_sql(r, 'x')}) AS pca_x, ({pca_sql(r, 'y')}) AS pca_y, ({body_sql(r)}) AS body"
        for name, r in RULES.items()
    ]
    return f"""{KG_SQL}, m AS ({" UNION ALL ".join(rows)})
        SELECT rule, predicate_size, support, CASE WHEN predicate_size = 0 THEN 0.0::DOUBLE ELSE support / predicate_size END AS head_coverage, pca_x, pca_y, body,
               CASE WHEN support + pca_x = 0 THEN 0.0::DOUBLE ELSE support / (support + pca_x) END AS pca_confidence_x,
               CASE WHEN support + pca_y = 0 THEN 0.0::DOUBLE ELSE support / (support + pca_y) END AS pca_confidence_y,
               CASE WHEN body = 0 THEN 0.0::DOUBLE ELSE support / body END AS standard_confidence
        FROM m"""


@query("rule_metrics", _metrics_sql())
def rule_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    kg = stats.laid_out(lift(spark, sf_dir))  # read by some forty joins
    sizes = stats.sizes(kg)
    return reduce(DataFrame.union, [M.metrics(kg, r, name, sizes=sizes) for name, r in RULES.items()])


for _name, _rule in RULES.items():
    query(f"support_{_name}", f"{KG_SQL} SELECT n AS support FROM ({support_sql(_rule)})")(lambda spark, sf_dir, r=_rule: M.support(lift(spark, sf_dir), r))
    for _end in "xy":
        query(f"pca_{_end}_{_name}", f"{KG_SQL} SELECT n AS pca FROM ({pca_sql(_rule, _end)})")(lambda spark, sf_dir, r=_rule, e=_end: M.pca_contradictions(lift(spark, sf_dir), r, e))
    query(f"body_pairs_{_name}", f"{KG_SQL} SELECT n AS body FROM ({body_sql(_rule)})")(lambda spark, sf_dir, r=_rule: M.body_size(lift(spark, sf_dir), r))
