"""Queries of draws, stopping rules, estimators, shapes, miners and evaluation, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornlake.functions import stats
from hornlake.operators import diversity as D
from hornlake.operators import estimators as E
from hornlake.operators import evaluate as V
from hornlake.operators import metrics as M
from hornlake.operators import sampling, shapes, stopping
from hornlake.plans import compile as plan
from hornlake.plans.rule import FREE
from hornlake.queries import RULES, _candidates_sql, pca_sql, query, support_sql
from hornlake.sources.lift import KG_SQL, lift
from hornlake.sources.triples import deduplicated

DRAWS, RULE = 400, RULES["r4"]
GRID = [(e, a) for e in V.ACCURACIES for a in V.CONFIDENCES]

# Draws: draw i takes the row (31 i i + 7919 i) mod N of the head in order, so that some come more than once.

_DRAWS_SQL = f"""{KG_SQL},
    head AS (SELECT s, o, row_number() OVER (ORDER BY s, o) - 1 AS idx, count(*) OVER () AS total FROM kg WHERE p = '{RULE.head.p}'),
    held AS (SELECT c.s, c.o FROM kg c WHERE c.p = '{RULE.head.p}' AND {support_sql(RULE).partition(f"c.p = '{RULE.head.p}' AND ")[2]}),
    draws AS (
      SELECT i AS draw, h.s, h.o, held.s IS NOT NULL AS success, (h.total * (1 + h.o % 3))::DOUBLE AS inv_prob, h.total
      FROM (SELECT unnest(generate_series(1, {DRAWS}))::BIGINT AS i) JOIN head h ON h.idx = (31 * i * i + 7919 * i) % h.total
      LEFT JOIN held ON h.s = held.s AND h.o = held.o)"""


def fixed_draws(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """The draws and the head's size; inverse probabilities are made up from the object."""
    kg = lift(spark, sf_dir)
    head = kg.filter(F.col("p") == RULE.head.p).select("s", "o")
    total = head.count()
    i = F.col("id")
    index = spark.range(1, DRAWS + 1).select(i.alias("draw"), F.pmod(31 * i * i + 7919 * i, F.lit(max(1, total))).alias("idx"))
    held = plan.supported_pairs(kg, RULE).withColumn("held", F.lit(True))
    rows = index.join(sampling.dense_index(head, ["s", "o"]), "idx").join(held, ["s", "o"], "left")
    return rows.select("draw", "s", "o", F.coalesce("held", F.lit(False)).alias("success"), (F.lit(total) * (1 + F.col("o") % 3)).cast("double").alias("inv_prob")), total


@query("head_draws", f"{_DRAWS_SQL} SELECT draw, s, o, success, inv_prob FROM draws")
def head_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed_draws(spark, sf_dir)[0]


@query("dense_index", f"{KG_SQL} SELECT s, o, (row_number() OVER (ORDER BY s, o) - 1)::BIGINT AS idx FROM kg WHERE p = 'order_part'")
def dense_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.dense_index(stats.pairs(lift(spark, sf_dir), "order_part"), ["s", "o"])


_STATS_SQL = f"""{_DRAWS_SQL},
    seen AS (SELECT s, o, count(*) AS f FROM draws WHERE success GROUP BY s, o),
    w AS (SELECT *, success AND row_number() OVER (PARTITION BY s, o, success ORDER BY draw) = 1 AS new FROM draws),
    r AS (SELECT *, sum(success::INT) OVER (ORDER BY draw) AS k, sum(new::INT) OVER (ORDER BY draw) AS g, row_number() OVER (ORDER BY draw) AS n FROM w),
    rep AS (SELECT draw, n, k, CASE WHEN g = 0 THEN 0 ELSE k - min(k) OVER (PARTITION BY g ORDER BY draw) END AS repeated FROM r),
    st AS (
      SELECT {DRAWS}::DOUBLE AS n, (SELECT count(*) FROM draws WHERE success)::DOUBLE AS k, (SELECT max(total) FROM draws)::DOUBLE AS total,
             (SELECT coalesce(sum(f), 0) FROM seen)::DOUBLE AS t, {", ".join(f"(SELECT coalesce(sum(f), 0) FROM seen WHERE f = {i})::DOUBLE AS f{i}" for i in range(1, 6))},
             (SELECT coalesce(sum(inv_prob), 0) FROM draws WHERE success) AS sum_q,
             (SELECT coalesce(sum(1 / (1 - pow(1 - 1 / inv_prob, {DRAWS}))), 0) FROM draws WHERE success) AS sum_pi,
             (SELECT repeated FROM rep WHERE n = {DRAWS})::DOUBLE AS repeated)"""

_FORMULA_SQL = {
    "Binomial": "k / n * total",
    "Hypergeometric": "k / n * (total - 1)",
    "Chao1": "t + f1 * f1 / (2 * (f2 + 1))",
    "Chao2": "t + (n - 1) / n * f1 * f1 / (2 * (f2 + 1))",
    "Coverage": "t / (CASE WHEN f1 = n THEN 1 ELSE 1 - f1 / n END)",
    "Jackknife": "t + 5 * f1 - 10 * f2 + 10 * f3 - 5 * f4 + f5",
    "Poisson": "CASE WHEN f1 = 0 THEN 0 ELSE t / (1 - exp(-2 * f1 / (f2 + 1))) END",
    "HansenHurwitz": "sum_q / n",
    "HorvitzThompsonWith": "sum_pi",
    "HorvitzThompsonWithout": "sum_pi",
    "HajekWith": "sum_pi",
    "HajekWithout": "sum_pi",
    "AnyBURL": "k - repeated",
}


def _estimate(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    draws, total = fixed_draws(spark, sf_dir)
    configs = spark.createDataFrame([(n, DRAWS) for n in names], "estimator string, stop_n long")
    return E.estimates(draws, configs, total).select("estimator", F.round("estimation", 6).alias("estimation"), "n", "successes", "failures", "total")


for _name in E.ALL:
    query(
        f"estimate_{_name.lower()}",
        f"""{_STATS_SQL} SELECT '{_name}' AS estimator, round(CASE WHEN k = 0 THEN 0 ELSE {_FORMULA_SQL[_name]} END, 6) AS estimation,
            n::BIGINT AS n, k::BIGINT AS successes, (n - k)::BIGINT AS failures, total::BIGINT AS total FROM st""",
    )(lambda spark, sf_dir, name=_name: _estimate(spark, sf_dir, [name]))


# Stopping rules


#: Two-sided points of the normal distribution, as tables have them, by error probability.
Z = {0.01: 2.575829303548901, 0.05: 1.959963984540054, 0.1: 1.6448536269514722}
#: The Student point from the normal one, by the expansion of Fisher and Cornish; from 49 degrees of freedom good to eight digits.
_STUDENT = (
    "z + (pow(z, 3) + z) / 4 / d + (5 * pow(z, 5) + 16 * pow(z, 3) + 3 * z) / 96 / pow(d, 2) + (3 * pow(z, 7) + 19 * pow(z, 5) + 17 * pow(z, 3) - 15 * z) / 384 / pow(d, 3)"
    " + (79 * pow(z, 9) + 776 * pow(z, 7) + 1482 * pow(z, 5) - 1920 * pow(z, 3) - 945 * z) / 92160 / pow(d, 4)"
)


def _fixed_sql(limit: str) -> str:
    closed = "(e + 2) * ln(2 / a) / (e * e)" if limit == "Chernoff" else "ceil(z * z / 4 / (e * e))"
    rows = ", ".join(f"({e}::DOUBLE, {a}::DOUBLE, {Z[a]}::DOUBLE)" for e, a in GRID)
    return f"""{KG_SQL}, t AS (SELECT count(*) AS total FROM kg WHERE p = '{RULE.head.p}')
        SELECT e AS accuracy, a AS confidence, round({closed}, 6) AS bound, least(total, greatest(least(50, total), ceil({closed})))::BIGINT AS stop_n
        FROM (VALUES {rows}) v(e, a, z), t"""


for _limit in ("Chernoff", "CLT"):
    query(f"stop_{_limit.lower()}", _fixed_sql(_limit))(
        lambda spark, sf_dir, limit=_limit: stopping.fixed_stops(lift(spark, sf_dir), limit, stats.pairs(lift(spark, sf_dir), RULE.head.p).count(), GRID, 50).withColumn("bound", F.round("bound", 6))
    )

_T = f"SELECT d + 1 AS n, a, {_STUDENT} AS t FROM (SELECT unnest(range(49, {DRAWS})) AS d), (VALUES {', '.join(f'({a}::DOUBLE, {z}::DOUBLE)' for a, z in Z.items())}) z(a, z)"


@query(
    "stop_ci",
    f"""{_DRAWS_SQL},
        run AS (SELECT row_number() OVER w AS n, sum(success::INT) OVER w AS k, total FROM draws WINDOW w AS (ORDER BY draw)),
        m AS (
          SELECT n, k, total, e, a, t * sqrt(CASE WHEN n = 1 OR total = 1 THEN 0 ELSE (k / n) * (1 - k / n) / (n - 1) * (total - n) / (total - 1) END) / sqrt(n) AS half
          FROM run JOIN ({_T}) t USING (n) CROSS JOIN (VALUES {", ".join(f"({e}::DOUBLE)" for e in V.ACCURACIES)}) g(e) WHERE n <= total)
        SELECT e AS accuracy, a AS confidence, coalesce(min(n) FILTER (n >= least(50, total) AND (half <= e * (k / n) OR n = total)), max(n))::BIGINT AS stop_n
        FROM m GROUP BY e, a""",
)
def stop_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    draws, total = fixed_draws(spark, sf_dir)
    return stopping.interval_stops(draws, total, GRID, 50, DRAWS)


@query("stop_anyburl", f"""{_STATS_SQL},
        s AS (SELECT coalesce(min(n) FILTER (repeated >= 5 OR k - repeated >= 1000 OR n >= 10000), max(n)) AS stop_n FROM rep)
        SELECT stop_n::BIGINT AS stop_n, (k - repeated)::BIGINT AS estimation FROM rep JOIN s ON n = stop_n""")
def stop_anyburl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stopping.repeat_stop(*fixed_draws(spark, sf_dir))


# Candidates and refinement

PCA_ATOMS = RULES["r3"].corrupted("y")


@query(
    "variable_candidates",
    f"""{KG_SQL} SELECT 0 AS variable, s AS value FROM (SELECT o AS s FROM kg WHERE p = 'order_supplier' INTERSECT SELECT s FROM kg WHERE p = 'supplies')
        UNION ALL SELECT 1, o FROM (SELECT DISTINCT o FROM kg WHERE p = 'order_part')
        UNION ALL SELECT 2, s FROM (SELECT s FROM kg WHERE p = 'order_supplier' INTERSECT SELECT s FROM kg WHERE p = 'order_part')
        UNION ALL SELECT -1, o FROM (SELECT DISTINCT o FROM kg WHERE p = 'supplies')""",
)
def variable_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kg = lift(spark, sf_dir)
    return reduce(DataFrame.union, [M.variable_candidates(kg, PCA_ATOMS, v).select(F.lit(v).alias("variable"), "value") for v in (0, 1, 2, FREE)])


@query(
    "refined_edge_sizes",
    f"""{KG_SQL}
        SELECT 0 AS atom, count(*) AS size FROM kg a WHERE p = 'order_supplier' AND EXISTS (SELECT 1 FROM kg b WHERE b.p = 'order_part' AND b.s = a.s) AND EXISTS (SELECT 1 FROM kg b WHERE b.p = 'supplies' AND b.s = a.o)
        UNION ALL SELECT 1, count(*) FROM kg a WHERE p = 'order_part' AND EXISTS (SELECT 1 FROM kg b WHERE b.p = 'order_supplier' AND b.s = a.s)
        UNION ALL SELECT 2, count(*) FROM kg a WHERE p = 'supplies' AND EXISTS (SELECT 1 FROM kg b WHERE b.p = 'order_supplier' AND b.o = a.s)""",
)
def refined_edge_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.refined_sizes(lift(spark, sf_dir), PCA_ATOMS)


@query(
    "conditional_candidates",
    f"""{KG_SQL} SELECT b.s AS id, count(DISTINCT z.o) AS candidates FROM kg b JOIN kg z ON z.p = 'bought' AND z.s = b.s JOIN kg w ON w.p = 'supplies' AND w.s = b.o AND w.o = z.o
        WHERE b.p = 'bought_from' GROUP BY b.s""",
)
def conditional_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kg = lift(spark, sf_dir)
    bound = stats.pairs(kg, "bought_from").select(F.col("s").alias("id"), F.col("s").alias("v0"), F.col("o").alias("v1"))
    return M.conditional_candidates(kg, RULES["r2"].body, 2, bound)


# Shapes


def _shape_sql(ends: tuple[tuple[int, int], ...]) -> str:
    at = {0: "h.s", 1: "h.o"}
    where = []
    for k, (s, o) in enumerate(ends, 1):
        for v, end in ((s, "s"), (o, "o")):
            if v in at:
                where.append(f"t{k}.{end} = {at[v]}")
            else:
                at[v] = f"t{k}.{end}"
    where += [f"{at[v]} <> {at[w]}" for v in at for w in at if v < w and (v, w) != (0, 1)]
    names = ", ".join(f"p{k}" for k in range(len(ends) + 1))
    cols = ", ".join(f"t{k}.p AS p{k}" for k in range(1, len(ends) + 1))
    return f"""{KG_SQL} SELECT {names}, count(*) AS support FROM (
        SELECT DISTINCT h.p AS p0, {cols}, h.s, h.o FROM kg h, {", ".join(f"kg t{k}" for k in range(1, len(ends) + 1))} WHERE {" AND ".join(where)}) GROUP BY {names}"""


def _read_again(kg: DataFrame, ends: tuple[tuple[int, int], ...]) -> DataFrame:
    """Triangles read the graph several times."""
    return stats.laid_out(kg.select("s", "p", "o")) if shapes.is_triangle(ends) else kg


for _name, _ends in shapes.SHAPES.items():
    query(f"support_by_shape_{_name}", _shape_sql(_ends))(lambda spark, sf_dir, ends=_ends: shapes.shape_support(_read_again(lift(spark, sf_dir), ends), ends))


# Mining: closed rules of two atoms by SQL; longer ones and walks have none


@query(
    "mine_levels_2",
    f"""{KG_SQL}, size AS (SELECT p, count(*) AS n FROM kg GROUP BY p),
        two AS (
          SELECT h.p AS p0, 'r' AS k, t.p AS p1, count(*) AS support FROM kg h JOIN kg t ON t.s = h.o AND t.o = h.s GROUP BY ALL
          UNION ALL SELECT h.p, 'p', t.p, count(*) FROM kg h JOIN kg t ON t.s = h.s AND t.o = h.o AND t.p <> h.p GROUP BY ALL)
        SELECT p0 || CASE k WHEN 'r' THEN '(a, b) <= ' || p1 || '(b, a)' ELSE '(a, b) <= ' || p1 || '(a, b)' END AS rule, n AS predicate_size, support, support / n AS head_coverage
        FROM two JOIN size ON p = p0 WHERE support / n >= 0.01""",
)
def mine_levels_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hornlake.operators.mine_levels import mine, report

    kg = lift(spark, sf_dir)
    return report(kg, mine(kg, max_length=2, min_head_coverage=0.01)).drop("key")


@query("mine_levels_3")
def mine_levels_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hornlake.operators.mine_levels import mine, report

    kg = lift(spark, sf_dir)
    return report(kg, mine(kg, max_length=3, min_head_coverage=0.5))


@query("random_walks")
def random_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hornlake.operators.walks import random_walks as walks

    return walks(lift(spark, sf_dir), 200, 3, seed=3)


@query("mine_walks")
def mine_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hornlake.operators.mine_walks import Settings, mine

    return mine(lift(spark, sf_dir, blocks=True), Settings(budget=40, batch=20, max_length=3, features=frozenset(), seed=5), distinct=True)


@query("beam_search_pca")
def beam_search_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hornlake.operators.walks import beam

    return beam(lift(spark, sf_dir), RULES["r4"], "y", 500, seed=4)


@query("inverse_probability")
def inverse_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hornlake.operators.probability import inverse_probability as weigh
    from hornlake.operators.walks import beam

    kg = stats.laid_out(lift(spark, sf_dir))
    draws = beam(kg, RULES["r4"], "y", 200, seed=4, selection="NonCorrupt")
    return weigh(kg, draws, RULES["r4"].corrupted("y"), given=RULES["r4"].head.s)


# Evaluation

_DIVERSITY = """
    richness AS (SELECT *, s + CASE WHEN f2 = 0 THEN f1 * (f1 - 1) / 2 ELSE f1 * f1 / (2 * f2) END AS r FROM g)
    SELECT {by} s::BIGINT AS species, n::BIGINT AS n, round(r, 6) AS richness, round(CASE WHEN q = 0 THEN 0 ELSE n * (n - 1) / q END, 6) AS dominance,
           round(s / r, 6) AS completeness,
           round(CASE WHEN (n - 1) * f1 + 2 * f2 = 0 THEN 0 ELSE 1 - f1 / n * ((n - 1) * f1 / ((n - 1) * f1 + 2 * f2)) END, 6) AS coverage,
           round(CASE WHEN f2 = 0 OR (r - s) / (0.05 * r) < 1 THEN 0 ELSE n * f1 / (2 * f2) * ln((r - s) / (0.05 * r)) END, 6) AS effort
    FROM richness"""


def _diversity_sql(by: str) -> str:
    comma = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""WITH c AS (SELECT {comma}user_id, count(*) AS c FROM events GROUP BY ALL),
        g AS (SELECT {comma}count(*)::DOUBLE AS s, sum(c)::DOUBLE AS n, (count(*) FILTER (c = 1))::DOUBLE AS f1, (count(*) FILTER (c = 2))::DOUBLE AS f2, sum(c * (c - 1))::DOUBLE AS q FROM c {group}),
        {_DIVERSITY.format(by=comma)}"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c, kind in df.dtypes if kind == "double"})


@query("diversity_report", _diversity_sql("event_type"))
def diversity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(D.diversity(spark.read.parquet(f"{sf_dir}/events.parquet"), ["event_type"], "user_id"))


@query("diversity_pooled", _diversity_sql(""))
def diversity_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(D.diversity(spark.read.parquet(f"{sf_dir}/events.parquet"), [], "user_id"))


@query("abundance", "SELECT event_type, f, count(*) AS species FROM (SELECT event_type, user_id, count(*) AS f FROM events GROUP BY ALL) GROUP BY ALL")
def abundance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.abundance(spark.read.parquet(f"{sf_dir}/events.parquet"), ["event_type"], "user_id")


@query(
    "reward_window",
    """SELECT event_id, event_type, user_id, round(avg(value) OVER (PARTITION BY event_type, user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 4) AS reward FROM events""",
)
def reward_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hornlake.operators.policy import reward_windows

    rows = reward_windows(spark.read.parquet(f"{sf_dir}/events.parquet"), ["event_type", "user_id"], "event_id", "value", 5)
    return rows.select("event_id", "event_type", "user_id", F.round("reward", 4).alias("reward"))


_ESTIMATES_SQL = f"""{KG_SQL}, d AS (SELECT p, s, count(*) AS truth, sum(o % 7)::DOUBLE AS est FROM kg GROUP BY p, s),
    q AS (SELECT p AS technique, CASE WHEN est < truth THEN -1 ELSE 1 END * (greatest(greatest(1, truth) / greatest(1, est), greatest(1, est) / greatest(1, truth)) - 1) + 0.0 AS value FROM d)"""


def _q_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A made-up estimate of each subject's out-degree, held against it; predicates stand for techniques."""
    d = lift(spark, sf_dir).groupBy("p", "s").agg(F.count("*").cast("double").alias("truth"), F.sum(F.col("o") % 7).cast("double").alias("est"))
    return d.select(F.col("p").alias("technique"), V.q_error(F.col("truth"), F.col("est")).alias("value"))


@query(
    "qerror_summary",
    f"""{_ESTIMATES_SQL} SELECT technique, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS stddev, round(min(value), 6) AS least,
        round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, round(max(value), 6) AS greatest FROM q GROUP BY technique""",
)
def qerror_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(V.technique_summary(_q_errors(spark, sf_dir)))


@query(
    "letter_values",
    f"{_ESTIMATES_SQL} " + " UNION ALL ".join(f"SELECT technique, {k} AS letter, round(quantile_cont(value, {2.0**-(k + 1)}), 6) AS lower, round(quantile_cont(value, {1 - 2.0**-(k + 1)}), 6) AS upper FROM q GROUP BY technique" for k in range(6)),
)
def letter_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(V.letter_values(_q_errors(spark, sf_dir)))


@query(
    "pair_frequencies",
    f"{_DRAWS_SQL} SELECT s, o, count(*) AS f FROM draws WHERE success GROUP BY s, o",
)
def pair_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed_draws(spark, sf_dir)[0].filter("success").groupBy("s", "o").agg(F.count("*").alias("f"))


@query(
    "draw_summary",
    f"{_DRAWS_SQL} SELECT sum(inv_prob) AS sum, round(avg(inv_prob), 6) AS mean, round(var_pop(inv_prob), 4) AS variance FROM draws",
)
def draw_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.summary(fixed_draws(spark, sf_dir)[0], "inv_prob")
    return out.withColumns({"mean": F.round("mean", 6), "variance": F.round("variance", 4)})


@query(
    "positive_pairs",
    f"{KG_SQL} SELECT DISTINCT s, o FROM ({_candidates_sql(RULES['r4'], 'y')}) c WHERE EXISTS (SELECT 1 FROM kg h WHERE h.p = 'customer_nation' AND h.s = c.s AND h.o = c.o)",
)
def positive_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kg = lift(spark, sf_dir)
    found = plan.matchings(kg, RULES["r4"].corrupted("y"), frozenset((0, 1))).select(F.col("v0").alias("s"), F.col("v1").alias("o"))
    return M.positive_pairs(kg, RULES["r4"], found)


@query(
    "deduplicated_triples",
    "SELECT l_suppkey AS s, 'ships' AS p, l_partkey AS o, 0 AS split, min(l_orderkey * 10 + l_linenumber) AS tid FROM lineitem GROUP BY l_suppkey, l_partkey",
)
def deduplicated_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return deduplicated(item.select(F.col("l_suppkey").alias("s"), F.lit("ships").alias("p"), F.col("l_partkey").alias("o"), F.lit(0).alias("split"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("tid")))


@query("pca_exact", f"{KG_SQL} SELECT n::DOUBLE AS pca, 'exact' AS method FROM ({pca_sql(RULES['r4'], 'x')})")
def pca_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hornlake.operators.grid import pca_count

    return pca_count(lift(spark, sf_dir), RULES["r4"], "x", method="exact")


@query("pca_exact_or_clt")
def pca_exact_or_clt(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hornlake.operators.grid import pca_count

    return pca_count(lift(spark, sf_dir), RULES["r4"], "x", method="auto")


@query("pca_clt")
def pca_clt(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hornlake.operators.grid import pca_count

    return pca_count(lift(spark, sf_dir), RULES["r4"], "y", method="clt", accuracy=0.01, confidence=0.01)


@query("support_estimation_grid")
def support_estimation_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hornlake.operators.grid import support_estimates

    kg = stats.laid_out(lift(spark, sf_dir))
    return support_estimates(kg, RULES["r4"], runs=1)


@query("pca_estimation_grid")
def pca_estimation_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hornlake.operators.grid import pca_estimates

    kg = stats.laid_out(lift(spark, sf_dir))
    return pca_estimates(kg, RULES["r4"], "y", runs=1, selections=["NonCorrupt"])
