"""Queries of files, logs, rules, canonical forms, profiles, policies, rewards, catalogs, draws and walks, with their SQL.

Where an operator is random by nature, its query returns what must hold of every result (how many rows break it), or asks
for so many draws that all rows must come.
"""

from __future__ import annotations

import io
import zipfile
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hornlake.estimation_queries import _STATS_SQL, DRAWS, RULE, Z, fixed_draws
from hornlake.functions import stats
from hornlake.operators import catalog as C
from hornlake.operators import estimators as E
from hornlake.operators import evaluate as V
from hornlake.operators import metrics as M
from hornlake.operators import policy as P
from hornlake.operators import sampling, shapes, stopping, walks
from hornlake.plans import compile as plan
from hornlake.plans import rule as R
from hornlake.plans.dfs_code import min_code
from hornlake.plans.rule import Atom, rule
from hornlake.queries import _SPLIT, RULES, _candidates_sql, pca_sql, query, support_sql
from hornlake.sources import results, triples
from hornlake.sources.folders import delete_stored, rows_of, working_folder, write_bytes
from hornlake.sources.lift import KG_SQL, lift


def _values(columns: str, rows: list[str]) -> str:
    return f"SELECT * FROM (VALUES {', '.join(rows)}) v({columns})"


# Files

_FILES = {
    "ids": ("FB15K", {"train2id.txt": "3\n1 2 p\n2 3 p\na line of five fields\n1 2 p\n", "valid2id.txt": "1\n3 1 q\n", "notes.txt": "8 8 p\n"}),
    "wiki": ("Codex_L", {"train2id.txt": "1\nQ5\tP17\tQ7\n", "test2id.txt": "1\nQ7\tP31\tQ9\n"}),
}


@query("triple_files", _values("kind, s, p, o, split, n", ["('ids', 1::BIGINT, 'p', 2::BIGINT, 0, 2::BIGINT)", "('ids', 2, 'p', 3, 0, 1)", "('ids', 3, 'q', 1, 1, 1)", "('wiki', 5, 'P17', 7, 0, 1)", "('wiki', 7, 'P31', 9, 2, 1)"]))
def triple_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of both formats, unpacked and read, with split tags; other lines and files are passed over."""
    out = []
    for kind, (dataset, files) in _FILES.items():
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            for name, text in files.items():
                z.writestr(f"{dataset}/{name}", text)
        archive = write_bytes(spark, working_folder(spark, "archive") + ".zip", data.getvalue())
        folder = triples.unpack(spark, archive, working_folder(spark, "files"))
        rows = triples.read(spark, folder, triples.DATASETS[dataset])
        out.append(rows.groupBy("s", "p", "o", "split").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "s", "p", "o", "split", "n"))
    return reduce(DataFrame.union, out)


_TAB = ["BioKG", "Codex_L", "FB13", "Hetionet", "SNOMED", "Wikidata5M", "WN11"]
_SPACE = ["FB15K", "FB15K237", "NELL_995", "WN18", "WN18RR", "YAGO3_10"]


@query("dataset_registry", _values("dataset, kind, tab", [f"('{d}', '{'wiki' if d in ('Codex_L', 'Wikidata5M') else 'ids'}', {'true' if d in _TAB else 'false'})" for d in (*_TAB, *_SPACE)]))
def dataset_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(d, f.kind, f.separator == "\t") for d, f in triples.DATASETS.items()], "dataset string, kind string, tab boolean")


@query("written_graph", f"{KG_SQL}, sp AS (SELECT p, {_SPLIT} AS split FROM kg) SELECT p, split::INTEGER AS split, count(*) AS size FROM sp WHERE split <= 1 GROUP BY ALL")
def written_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph as a table by predicate, loaded up to a split."""
    path = triples.paths(working_folder(spark, "base"), "lifted")["graph"]
    triples.write(lift(spark, sf_dir, by_split=True).withColumn("tid", F.xxhash64("s", "p", "o")), path)
    return triples.load(spark, path, 1).groupBy("p", "split").agg(F.count("*").alias("size"))


@query(
    "head_membership",
    f"{KG_SQL}, b AS ({_candidates_sql(RULES['r4'], None)}) SELECT EXISTS (SELECT 1 FROM kg h WHERE h.p = 'customer_nation' AND h.s = b.s AND h.o = b.o) AS present, count(*) AS pairs FROM b GROUP BY ALL",
)
def head_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    kg = lift(spark, sf_dir)
    body = plan.body_pairs(kg, RULES["r4"])
    sides = [stats.in_predicate(kg, "customer_nation", body, present).select(F.lit(present).alias("present")) for present in (True, False)]
    return sides[0].union(sides[1]).groupBy("present").agg(F.count("*").alias("pairs"))


@query(
    "result_log",
    f"{KG_SQL} SELECT count(*) % 97 AS rule_id, 'Support_' || p AS technique, count(*)::DOUBLE AS value, count(*) * 1000 / 1e9 AS cpu_seconds, CASE WHEN count(*) % 2 = 0 THEN count(*) / 8 END AS confidence_error FROM kg GROUP BY p",
)
def result_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements written as log lines beside the rules' lines, and read again."""
    n = F.col("size")
    rows = stats.predicate_sizes(lift(spark, sf_dir)).select(
        (n % 97).alias("RuleId"), F.concat(F.lit("Support_"), "p").alias("Technique"), n.cast("double").alias("Valuex"), (n * 1000).alias("CPU"), F.when(n % 2 == 0, n / 8).alias("AbsoluteError")
    )
    path = working_folder(spark, "log")
    spark.createDataFrame([(R.render(r, k),) for k, r in enumerate(RULES.values())], "value string").write.text(path)
    results.write_log(rows, path)
    return results.measurements(results.read_log(spark, path))


@query("result_series", "SELECT CASE WHEN c_nationkey % 2 = 0 THEN 'Support_Value' ELSE 'PCA_Value' END AS metric, 'T_' || c_mktsegment AS technique, c_acctbal AS value FROM customer")
def result_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    metric = F.when(F.col("c_nationkey") % 2 == 0, "Support_Value").otherwise("PCA_Value")
    path = working_folder(spark, "series")
    results.write_series(rows.select(metric.alias("metric"), F.concat(F.lit("T_"), "c_mktsegment").alias("technique"), F.col("c_acctbal").alias("value")), path)
    return results.read_series(spark, path)


# Rules

_RULES = {
    "parallel": rule("p(x,y)", "q(x,y)"),
    "path": rule("p(x,y)", "q(x,z)", "r(z,y)"),
    "open": rule("p(x,y)", "q(x,z)"),
    "apart": rule("p(x,y)", "q(z,w)"),
    "cycle": rule("p(x,y)", "q(x,z)", "q(z,y)", "r(y,x)"),
    "dangling": rule("p(x,y)", "q(x,y)", "r(y,z)"),
}


@query(
    "rule_forms",
    _values(
        "name, text, numbers, atoms, variables, predicates, closed, one_open, connected, open",
        [
            "('parallel', 'p(a, b) <= q(a, b)', 'p(0, 1) <= q(0, 1)', 2::BIGINT, 2::BIGINT, 'q', true, true, true, 0::BIGINT)",
            "('path', 'p(a, b) <= q(a, c), r(c, b)', 'p(0, 1) <= q(0, 2), r(2, 1)', 3, 3, 'q,r', true, true, true, 0)",
            "('open', 'p(a, b) <= q(a, c)', 'p(0, 1) <= q(0, 2)', 2, 3, 'q', false, false, false, 2)",
            "('apart', 'p(a, b) <= q(c, d)', 'p(0, 1) <= q(2, 3)', 2, 4, 'q', false, false, false, 4)",
            "('cycle', 'p(a, b) <= q(a, c), q(c, b), r(b, a)', 'p(0, 1) <= q(0, 2), q(2, 1), r(1, 0)', 4, 3, 'q,r', true, true, true, 0)",
            "('dangling', 'p(a, b) <= q(a, b), r(b, c)', 'p(0, 1) <= q(0, 1), r(1, 2)', 3, 3, 'q,r', false, true, true, 1)",
        ],
    ),
)
def rule_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printing, sizes and language bias."""
    rows = [
        (name, R.render(r), R.render_numbers(R.parse(R.render(r))[1]), r.length, len(r.variables), ",".join(r.body_predicates), R.check(r, [R.is_closed]), R.at_most_one_open(r), R.check(r, [R.body_connected, R.no_isolated_variable]), len(R.open_variables(r)))
        for name, r in _RULES.items()
    ]
    return spark.createDataFrame(rows, "name string, text string, numbers string, atoms long, variables long, predicates string, closed boolean, one_open boolean, connected boolean, open long")


@query(
    "canonical_forms",
    _values(
        "name, key, unmarked, minimal, head_idx, heads",
        [
            "('path', '0,p,1;0,q,2;2,r,1|0', '0,p,1;0,q,2;2,r,1', true, 0::BIGINT, 3::BIGINT)",
            "('path renamed', '0,p,1;0,q,2;2,r,1|0', '0,p,1;0,q,2;2,r,1', true, 0, 3)",
            "('parallel', '0,p,1;0,q,1|0', '0,p,1;0,q,1', true, 0, 2)",
            "('parallel, other head', '0,p,1;0,q,1|1', '0,p,1;0,q,1', true, 1, 2)",
            "('long path', '0,p,1;0,q,2;2,q,3;3,r,1|0', '0,p,1;0,q,2;2,q,3;3,r,1', true, 0, 4)",
            "('long path backwards', '0,p,1;0,q,2;2,q,3;3,r,1|0', '0,p,1;0,q,2;2,q,3;3,r,1', false, 0, 4)",
        ],
    ),
)
def canonical_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures, the test for the least one, and the place and choices of the head."""
    rules = {
        "path": _RULES["path"],
        "path renamed": rule("p(u,v)", "r(w,v)", "q(u,w)"),
        "parallel": _RULES["parallel"],
        "parallel, other head": rule("q(x,y)", "p(x,y)"),
        "long path": rule("p(x,y)", "q(x,w)", "q(w,z)", "r(z,y)"),
        "long path backwards": rule("p(x,y)", "r(z,y)", "q(w,z)", "q(x,w)"),
    }
    rows = [(name, R.key(R.canonical(r)), R.key(r, marked=False), R.is_minimal(r), R.head_index(r), len({R.key(h) for h in R.heads(r)})) for name, r in rules.items()]
    return spark.createDataFrame(rows, "name string, key string, unmarked string, minimal boolean, head_idx long, heads long")


@query("graph_counts", _values("predicates, atoms, graphs, codes", ["(1::BIGINT, 1::BIGINT, 1::BIGINT, 1::BIGINT)", "(1, 2, 4, 4)", "(2, 1, 2, 2)", "(2, 2, 14, 14)"]))
def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected graphs by atoms and predicates, each found once, and as many minimum codes."""
    rows = []
    for n in (1, 2):
        for k, level in enumerate(R.enumerate_graphs(["p", "q"][:n], 2), 1):
            rows.append((n, k, len(level), len({min_code(g) for g in level})))
    return spark.createDataFrame(rows, "predicates long, atoms long, graphs long, codes long")


@query(
    "dfs_codes",
    _values("name, code", ["('path', '0,1,out,p;1,2,out,q')", "('fork', '0,1,out,p;0,2,out,q')", "('reverse', '0,1,out,p;1,0,out,q')", "('cycle', '0,1,out,p;1,2,out,p;2,0,out,p')", "('in', '0,1,out,p')"]),
)
def dfs_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    graphs = {"path": [Atom(7, "q", 3), Atom(5, "p", 7)], "fork": [Atom(4, "q", 1), Atom(4, "p", 9)], "reverse": [Atom(2, "q", 1), Atom(1, "p", 2)], "cycle": [Atom(3, "p", 1), Atom(1, "p", 2), Atom(2, "p", 3)], "in": [Atom(6, "p", 5)]}
    rows = [(name, ";".join(f"{i},{j},{'out' if out else 'in'},{p}" for i, j, out, p in min_code(g))) for name, g in graphs.items()]
    return spark.createDataFrame(rows, "name string, code string")


@query(
    "catalog_states",
    _values(
        "step, rule_id, key, status",
        ["('inserted', 1::BIGINT, '0,p,1;0,q,1|0', 'pending')", "('inserted', 2, '0,p,1;0,q,2;2,r,1|0', 'pending')", "('again', 3, '0,p,1;0,q,1|1', 'pending')", "('next', 1, '0,p,1;0,q,1|0', 'pending')", "('after', 2, '0,p,1;0,q,2;2,r,1|0', 'pending')", "('done', 1, '0,p,1;0,q,1|0', 'done')", "('resumed', 2, '0,p,1;0,q,2;2,r,1|0', 'pending')", "('left', 2, NULL, NULL)"],
    ),
)
def catalog_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog and its work queue: new keys are numbered on, known ones are not inserted again; a stop puts work back."""
    first = C.insert(C.empty(spark), C.rows(spark, [_RULES["path"], _RULES["parallel"], rule("p(u,v)", "r(w,v)", "q(u,w)")]))
    second = C.insert(first, C.rows(spark, [_RULES["parallel"], rule("q(x,y)", "p(x,y)")]))
    shown = ["rule_id", "key", "status"]
    step = lambda name, df: df.select(F.lit(name).alias("step"), *shown)
    out = [step("inserted", first), step("again", second.join(C.ids(first), "rule_id", "left_anti"))]
    at = C.next_pending(second)
    out.append(step("next", second.join(at, "rule_id")))
    working = C.with_status(C.with_status(second, at, C.DONE), spark.createDataFrame([(2,)], "rule_id long"), C.PROCESSING)
    stopped = C.resume(working)
    out.append(step("after", stopped.join(C.next_pending(stopped), "rule_id")))
    out.append(step("done", C.find(stopped, C.read(stopped, 1))))
    out.append(step("resumed", C.find(stopped, _RULES["path"])))
    out.append(C.count_pending(stopped).select(F.lit("left"), F.col("pending"), F.lit(None).cast("string"), F.lit(None).cast("string")))
    return reduce(DataFrame.union, out)


# Profiles, rewards, policies


@query(
    "walk_profiles",
    """SELECT 'length=' || n || ',head=' || h AS profile FROM (VALUES (2), (3), (4)) l(n), (SELECT DISTINCT n_name AS h FROM nation)
        UNION ALL SELECT 'length=' || n || ',variables=' || v || ',predicates=' || k FROM range(2, 5) l(n), range(2, 6) m(v), range(1, 5) o(k) WHERE v <= n + 1 AND k <= n""",
)
def walk_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [r["n_name"] for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_name").distinct().orderBy("n_name").collect()]  # 25 rows
    grid = [*P.profile_grid({"Length", "Head"}, 4, names), *P.profile_grid({"Length", "NumberOfVariables", "NumberOfPredicates"}, 4, names)]
    return spark.createDataFrame([(p.name,) for p in grid], "profile string")


@query(
    "rule_rewards",
    """WITH v AS (SELECT * FROM (VALUES ('Support'), ('SupportConf'), ('SupportConfLength'), ('ConfLengthPredSize'), ('F1'), ('F1Length'), ('Effort')) k(kind),
            (VALUES (0.0::DOUBLE), (10.0)) s(support), (VALUES (0.0::DOUBLE), (0.5)) c(confidence), range(2, 5) l(length))
        SELECT kind, support, confidence, length::INTEGER AS length, round(CASE kind
            WHEN 'Support' THEN support WHEN 'SupportConf' THEN support * confidence WHEN 'SupportConfLength' THEN support * confidence / pow(2, length - 2)
            WHEN 'ConfLengthPredSize' THEN confidence / pow(2, length - 2) * 40 WHEN 'F1' THEN 200 * (support / 40 + 1) * (confidence + 1) / (support / 40 + confidence + 2)
            WHEN 'F1Length' THEN 200 * (support / 40 + 1) * (confidence + 1) / (support / 40 + confidence + 2) / pow(2, length - 2) ELSE 1 END, 9) AS reward FROM v""",
)
def rule_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(k, s, c, n, round(float(P.rule_reward(k, s, s / 40, c, n, 40)), 9)) for k in P.REWARDS for s in (0.0, 10.0) for c in (0.0, 0.5) for n in (2, 3, 4)]
    return spark.createDataFrame(rows, "kind string, support double, confidence double, length int, reward double")


@query(
    "effort_rewards",
    """WITH c AS (SELECT n_regionkey AS r, n_nationkey % 3 AS x, count(*) AS c FROM nation GROUP BY ALL),
        g AS (SELECT r, count(*)::DOUBLE AS s, sum(c)::DOUBLE AS n, (count(*) FILTER (c = 1))::DOUBLE AS f1, (count(*) FILTER (c = 2))::DOUBLE AS f2 FROM c GROUP BY r),
        a AS (SELECT *, f1 * f1 / (2 * f2) AS u FROM g)
        SELECT r AS region, round(CASE WHEN f2 = 0 OR u / (0.05 * (s + u)) < 1 THEN 0 ELSE n * f1 / (2 * f2) * ln(u / (0.05 * (s + u))) END, 6) AS effort FROM a""",
)
def effort_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The effort left for each region, whose nations stand for reports of three rules."""
    reward = P.EffortReward()
    for row in spark.read.parquet(f"{sf_dir}/nation.parquet").collect():  # 25 rows
        reward.add(P.Profile(length=row["n_regionkey"]), row["n_nationkey"] % 3)
    return spark.createDataFrame([(p.length, round(reward.reward(p), 6)) for p in reward.seen], "region int, effort double")


@query("policy_choices", _values("policy, what, holds", ["('Maximum', 'takes the greatest', true)", "('Probability', 'goes by weight', true)", "('Probability', 'cumulative', true)", "('StaticProbability', 'keeps a choice', true)", "('StaticProbability', 'changes', true)", "('any', 'epsilon', true)"]))
def policy_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = [P.Profile(length=n) for n in (2, 3, 4)]
    worth = dict(zip(profiles, (1.0, 3.0, 2.0), strict=True)).get
    top = P.MaxPolicy(profiles, 0.0, 1)
    wheel, static, anything = P.ProbabilityPolicy(profiles, 0.0, 2), P.StaticProbabilityPolicy(profiles, 0.0, 3, 5), P.MaxPolicy(profiles, 1.0, 4)
    picks = [wheel.next(worth) for _ in range(6000)]
    only = [P.ProbabilityPolicy(profiles, 0.0, s).next(lambda p: 1e9 if p == profiles[2] else 0.0) for s in range(50)]
    kept = [static.next(worth) for _ in range(200)]
    blocks = [set(kept[k : k + 5]) for k in range(0, 200, 5)]
    rows = [
        ("Maximum", "takes the greatest", all(top.next(worth) == profiles[1] for _ in range(50))),
        ("Probability", "goes by weight", all(abs(picks.count(p) / 6000 - w / 6) < 0.03 for p, w in zip(profiles, (1, 3, 2), strict=True))),
        ("Probability", "cumulative", all(p == profiles[2] for p in only)),
        ("StaticProbability", "keeps a choice", all(len(b) == 1 for b in blocks)),
        ("StaticProbability", "changes", len(set(kept)) == 3),
        ("any", "epsilon", {anything.next(worth) for _ in range(200)} == set(profiles)),
    ]
    return spark.createDataFrame(rows, "policy string, what string, holds boolean")


@query("profile_report", _values("profile, rules, repetitions, failures", ["('head=p', 2::BIGINT, 0::BIGINT, 1::BIGINT)", "('head=q', 0, 3, 0)", "('any', 0, 0, 0)"]))
def profile_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = P.MaxPolicy([P.Profile(head="q"), P.Profile(), P.Profile(head="p")], 0.0, 0)
    p, q = P.Profile(head="p"), P.Profile(head="q")
    for report, profile, n in ((policy.report_rule, p, 2), (policy.report_failure, p, 1), (policy.report_repeated, q, 3)):
        for _ in range(n):
            report(profile)
    return spark.createDataFrame(list(policy.report()), "profile string, rules long, repetitions long, failures long")


@query(
    "experiment_runs",
    """SELECT policy, metric, reward, count(*) AS runs FROM (VALUES (false), (true)) a(closing), (VALUES (0.05), (0.1), (0.25), (0.5), (1.0)) b(epsilon),
        (VALUES ('Maximum'), ('Probability'), ('StaticProbability')) c(policy), (VALUES ('AnyBURL'), ('HyperPlusHH')) d(metric),
        (VALUES ('Support'), ('SupportConf'), ('SupportConfLength'), ('ConfLengthPredSize'), ('F1'), ('F1Length'), ('Effort')) e(reward), (VALUES (0), (5), (10), (15)) f(win), (VALUES (1), (2), (3)) g(profile)
        WHERE (epsilon < 1 OR policy = 'Maximum') AND (win = 0) = (reward = 'Effort') GROUP BY ALL
        UNION ALL SELECT 'Probability', 'single', 'SupportConfLength', 13""",
)
def experiment_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(e["policy"], e["metric"], e["reward"]) for e in P.experiment_grid("WN18")] + [(e["policy"], "single", e["reward"]) for e in P.single_runs()]
    return spark.createDataFrame(rows, "policy string, metric string, reward string").groupBy("policy", "metric", "reward").agg(F.count("*").alias("runs"))


# Techniques and evaluation

_LIST = lambda xs: "(VALUES " + ", ".join(f"('{x}')" for x in xs) + ")"
_ACC = f"{_LIST(['0.05', '0.1', '0.15'])} e(acc), {_LIST(['0.01', '0.05', '0.1'])} f(conf), {_LIST(['CI', 'Chernoff'])} l(lim)"


@query(
    "technique_names",
    f"""SELECT 'Support_' || est || '_' || lim || '_Acc' || acc || '_Conf' || conf AS technique FROM {_LIST([*E.WITH, *E.WITHOUT])} x(est), {_ACC}
        UNION ALL SELECT 'PCA_' || est || '_' || lim || '_' || sel || '_Acc' || acc || '_Conf' || conf FROM {_LIST([*E.WITH, *E.WITHOUT])} x(est), {_ACC}, {_LIST(['Minimum', 'Random', 'NonCorrupt'])} s(sel)
        UNION ALL SELECT 'PCA_AnyBURL__' || sel FROM {_LIST(['Minimum', 'Random', 'NonCorrupt'])} s(sel)""",
)
def technique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [*V.support_grid(E.WITH), *V.support_grid(E.WITHOUT), *V.pca_grid(E.WITH, True), *V.pca_grid(E.WITHOUT, False)]
    return spark.createDataFrame([(n,) for n in names], "technique string")


_SERIES = [("PCA_Binomial_CI_Minimum_Acc0.05_Conf0.1", 1.0), ("PCA_Chao2_Chernoff_Random_Acc0.1_Conf0.05", 2.0), ("PCA_Chao2_CI_Minimum_Acc0.05_Conf0.1", 3.0), ("PCA_AnyBURL__Minimum", 7.0), ("Support_Poisson_CI_Acc0.1_Conf0.1", 4.0)]


@query(
    "technique_suffixes",
    _values(
        "technique, value, suffix",
        [
            "('PCA_Binomial_CI_Minimum_Acc0.05_Conf0.1', 1.0::DOUBLE, 'CI_Minimum_Acc0.05_Conf0.1')",
            "('PCA_Chao2_Chernoff_Random_Acc0.1_Conf0.05', 2.0, 'Chernoff_Random_Acc0.1_Conf0.05')",
            "('PCA_Chao2_CI_Minimum_Acc0.05_Conf0.1', 3.0, 'CI_Minimum_Acc0.05_Conf0.1')",
            "('PCA_AnyBURL_CI_Minimum_Acc0.05_Conf0.1', 7.0, 'CI_Minimum_Acc0.05_Conf0.1')",
            "('Support_Poisson_CI_Acc0.1_Conf0.1', 4.0, 'CI_Acc0.1_Conf0.1')",
        ],
    ),
)
def technique_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread = V.spread_heuristic(spark.createDataFrame(_SERIES, "technique string, value double"))
    return spread.withColumn("suffix", V.suffix(F.col("technique")))


@query("plot_rows", _values("dataset, metric, technique, value", ["('Freebase', 'PCA_Value', 'PCA_Chao2_CI_Minimum_Acc0.05_Conf0.1', 1.5::DOUBLE)", "('Freebase', 'PCA_Value', 'PCA_Chao2_CI_Minimum_Acc0.05_Conf0.1', 2.5)", "('WN18', 'Support_Value', 'Support_Poisson_CI_Acc0.1_Conf0.1', 3.0)"]))
def plot_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("FB15K", "PCA_Value", _SERIES[2][0], [1.5, 2.5]), ("WN18", "Support_Value", _SERIES[4][0], [3.0]), ("Hetionet", "PCA_Value", _SERIES[2][0], [9.0]), ("WN18", "PCA_Value", _SERIES[1][0], [8.0])]
    series = spark.createDataFrame(rows, "dataset string, metric string, technique string, values array<double>")
    return V.plot_rows(series, ["CI_Minimum_Acc0.05_Conf0.1", "CI_Acc0.1_Conf0.1"], {"FB15K": "Freebase"})


@query("speedups", f"{KG_SQL}, n AS (SELECT p, count(*) AS n FROM kg GROUP BY p) SELECT p, n * 3 / (n + 1) AS speedup, 0.25 - n / (n + 4) AS confidence_error FROM n")
def speedups(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("size")
    return stats.predicate_sizes(lift(spark, sf_dir)).select("p", V.speedup(n * 3, n + 1).alias("speedup"), V.confidence_error(n / (n + 4), F.lit(0.25)).alias("confidence_error"))


# Draws

_HEAD = f"SELECT s, o FROM kg WHERE p = '{RULE.head.p}'"


def _head(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    head = stats.pairs(lift(spark, sf_dir), RULE.head.p)
    return head, head.count()


@query("draws_without_replacement", f"{KG_SQL} {_HEAD}")
def draws_without_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many draws as pairs: each comes once."""
    head, total = _head(spark, sf_dir)
    return sampling.draw_without(total, total, head).join(sampling.shuffled(head, ["s", "o"], 5), "idx").select("s", "o")


@query("shuffled_index", f"{KG_SQL} SELECT (row_number() OVER () - 1)::BIGINT AS idx, 1::BIGINT AS pairs FROM ({_HEAD})")
def shuffled_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.shuffled(_head(spark, sf_dir)[0], ["s", "o"], 6).groupBy("idx").agg(F.count_distinct("s", "o").alias("pairs"))


@query("draws_with_replacement", f"{KG_SQL} SELECT kind, n::BIGINT AS draws, true AS in_head, true AS repeats FROM (VALUES ('unknown', 5000), ('known', 4000)) v(kind, n)")
def draws_with_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every draw is a pair of the head, and more draws than pairs bring some again."""
    head, total = _head(spark, sf_dir)
    indexed = sampling.shuffled(head, ["s", "o"], 7)
    out = []
    for kind, n, drawn in (("unknown", 5000, sampling.draw_with(5000, total, 8, head).join(indexed, "idx")), ("known", 4000, sampling.known_with(indexed, 4000, total, 9))):
        hit = stats.in_predicate(lift(spark, sf_dir), RULE.head.p, drawn)
        out.append(hit.agg(F.lit(kind).alias("kind"), F.count("*").alias("draws"), (F.count("*") == n).alias("in_head"), (F.count_distinct("s", "o") < F.count("*")).alias("repeats")))
    return out[0].union(out[1])


@query("known_sample", f"{KG_SQL} SELECT 'all' AS kind, s, o FROM ({_HEAD}) UNION ALL SELECT 'ten', 10, 10")
def known_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample without replacement of more pairs than there are is all of them; of ten, ten different ones of the head."""
    head, total = _head(spark, sf_dir)
    ten = stats.in_predicate(lift(spark, sf_dir), RULE.head.p, sampling.known_without(head, ["s", "o"], 10, 3))
    counted = ten.agg(F.count("*").alias("s"), F.count_distinct("s", "o").alias("o"))
    return sampling.known_without(head, ["s", "o"], total + 5, 2).select(F.lit("all").alias("kind"), "s", "o").union(counted.select(F.lit("ten"), "s", "o"))


_HELD = support_sql(RULE).partition(f"c.p = '{RULE.head.p}' AND ")[2]


@query("support_draws", f"{KG_SQL} SELECT c.s, c.o, {_HELD} AS success FROM kg c WHERE c.p = '{RULE.head.p}'")
def support_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many draws without replacement as the head has pairs: each pair and whether the rule holds there."""
    kg = lift(spark, sf_dir)
    total = stats.pairs(kg, RULE.head.p).count()
    return sampling.support_draws(kg, RULE, total, replacement=False, seed=3).select("s", "o", "success")


@query("pair_draws", _values("corrupt, draws, failures_that_hold, successes_that_do_not", ["('x', 3000::BIGINT, 0::BIGINT, 0::BIGINT)", "('y', 3000, 0, 0)"]))
def pair_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs drawn from the candidates, judged from the draws on, against all contradictions."""
    kg = lift(spark, sf_dir)
    out = []
    for corrupt in "xy":
        drawn = sampling.pair_draws(kg, RULE, corrupt, 3000, seed=4)
        known = plan.pca_pairs(kg, RULE, corrupt).withColumn("holds", F.lit(True))
        judged = drawn.join(known, ["s", "o"], "left").withColumn("holds", F.coalesce("holds", F.lit(False)))
        out.append(judged.agg(F.lit(corrupt).alias("corrupt"), F.count("*").alias("draws"), F.count_if(F.expr("holds and not success")).alias("failures_that_hold"), F.count_if(F.expr("success and not holds")).alias("successes_that_do_not")))
    return out[0].union(out[1])


@query("beam_checks", _values("selection, draws, outside, found", ["('Random', 400::BIGINT, 0::BIGINT, true)", "('NonCorrupt', 400, 0, true)"]))
def beam_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every success of a beam is a contradiction of the exact count."""
    kg = lift(spark, sf_dir)
    known = plan.pca_pairs(kg, RULE, "y").withColumn("holds", F.lit(True))
    out = []
    for selection in ("Random", "NonCorrupt"):
        drawn = walks.beam(kg, RULE, "y", 400, seed=4, selection=selection).join(known, ["s", "o"], "left")
        out.append(drawn.agg(F.lit(selection).alias("selection"), F.count("*").alias("draws"), F.count_if(F.expr("success and holds is null")).alias("outside"), (F.count_if("success") > 0).alias("found")))
    return out[0].union(out[1])


@query("beam_sides", _values("selection, corrupt, side", [f"('{s}', '{c}', '{x}')" for s, c, x in (("Minimum", "x", "y"), ("Minimum", "y", "y"), ("Maximum", "x", "x"), ("Maximum", "y", "x"), ("Corrupt", "x", "x"), ("Corrupt", "y", "y"), ("NonCorrupt", "x", "y"), ("NonCorrupt", "y", "x"))]))
def beam_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a beam starts, of 9 candidates for x and 4 for y."""
    one = spark.range(1).withColumn("draw", F.col("id"))
    rows = [one.select(F.lit(s).alias("selection"), F.lit(c).alias("corrupt"), sampling.seed_side(s, 9, 4, c, F.col("draw"), 1).alias("side")) for s in ("Minimum", "Maximum", "Corrupt", "NonCorrupt") for c in "xy"]
    return reduce(DataFrame.union, rows)


@query(
    "inverse_probabilities",
    f"""{KG_SQL}, a AS (SELECT s, o FROM kg WHERE p = 'bought_from'), b AS (SELECT s, o FROM kg WHERE p = 'supplier_nation'),
        x AS (SELECT s, count(*)::DOUBLE AS n FROM a GROUP BY s), z1 AS (SELECT o, count(*)::DOUBLE AS n FROM a GROUP BY o), z2 AS (SELECT s, count(*)::DOUBLE AS n FROM b GROUP BY s), y AS (SELECT o, count(*)::DOUBLE AS n FROM b GROUP BY o),
        z AS (SELECT o FROM a INTERSECT SELECT s FROM b),
        k AS (SELECT (SELECT count(*) FROM a WHERE o IN (SELECT s FROM b)) AS e0, (SELECT count(*) FROM b WHERE s IN (SELECT o FROM a)) AS e1, (SELECT count(*) FROM x) AS nx, (SELECT count(*) FROM z) AS nz, (SELECT count(*) FROM y) AS ny),
        m AS (SELECT a.s AS v0, b.o AS v1, a.o AS v2 FROM a JOIN b ON a.o = b.s WHERE a.s <> a.o AND a.o <> b.o),
        f AS (SELECT m.*, x.n AS out0, z1.n AS in0, z2.n AS out1, y.n AS in1, least(e0, nx * x.n, nz * z1.n) AS f0, least(e1, nz * z2.n, ny * y.n) AS f1
              FROM m JOIN x ON x.s = v0 JOIN z1 ON z1.o = v2 JOIN z2 ON z2.s = v2 JOIN y ON y.o = v1, k)
        SELECT v0, v1, v2, CASE WHEN f0 <= f1 THEN f0 * out1 ELSE f1 * in0 END AS inv_prob FROM f""",
)
def inverse_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all matchings of a body."""
    from hornlake.operators.probability import inverse_probability

    kg = lift(spark, sf_dir)
    found = plan.matchings(kg, RULES["r4"].body, frozenset((0, 1)))
    return inverse_probability(kg, found, RULES["r4"].body).select("v0", "v1", "v2", "inv_prob")


# Stops, intervals, switches


@query(
    "longest_stops",
    f"""{KG_SQL}, t AS (SELECT count(*) AS total FROM kg WHERE p = '{RULE.head.p}'), b AS (
        SELECT 'Chernoff' AS rule, (e + 2) * ln(2 / a) / (e * e) AS bound FROM (VALUES (0.05::DOUBLE), (0.1), (0.15)) e(e), (VALUES (0.01::DOUBLE), (0.05), (0.1)) a(a)
        UNION ALL SELECT 'CLT', z * z / 4 / (e * e) FROM (VALUES (0.05::DOUBLE), (0.1), (0.15)) e(e), (VALUES {", ".join(f"({z}::DOUBLE)" for z in Z.values())}) z(z))
        SELECT rule, max(least(total, greatest(least(50, total), ceil(bound))))::BIGINT AS stop_n FROM b, t GROUP BY rule""",
)
def longest_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a stream that all listeners of a rule share ends."""
    head, total = _head(spark, sf_dir)
    grid = [(e, a) for e in V.ACCURACIES for a in V.CONFIDENCES]
    rows = [stopping.fixed_stops(head, name, total, grid, 50).withColumn("rule", F.lit(name)) for name in ("Chernoff", "CLT")]
    return stopping.longest_stops(rows[0].union(rows[1]), ["rule"])


@query(
    "estimate_interval",
    f"""{_STATS_SQL} SELECT k / n AS mean, k / n * (1 - k / n) / (n - 1) * (total - n) / (total - 1) AS variance,
        round(k / n - 2 * sqrt(k / n * (1 - k / n) / (n - 1) * (total - n) / (total - 1)) / sqrt(n), 9) AS ci_lower, round(k / n + 2 * sqrt(k / n * (1 - k / n) / (n - 1) * (total - n) / (total - 1)) / sqrt(n), 9) AS ci_upper FROM st""",
)
def estimate_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    draws, total = fixed_draws(spark, sf_dir)
    rows = E.estimates(draws, spark.createDataFrame([("Binomial", DRAWS)], "estimator string, stop_n long"), total)
    found = E.with_interval(rows, F.lit(2.0))
    return found.select("mean", "variance", F.round("ci_lower", 9).alias("ci_lower"), F.round("ci_upper", 9).alias("ci_upper"))


@query("pca_auto_exact", f"{KG_SQL} SELECT n::DOUBLE AS pca, 'exact' AS method FROM ({pca_sql(RULE, 'x')})")
def pca_auto_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The switch with a bound above the number of candidate pairs."""
    from hornlake.operators.grid import pca_count

    return pca_count(lift(spark, sf_dir), RULE, "x", method="auto", accuracy=1e-7, confidence=0.0005)


@query("pca_auto_clt", f"{KG_SQL} SELECT 'clt' AS method, true AS near FROM ({pca_sql(RULE, 'x')})")
def pca_auto_clt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The switch with a bound below it: the estimate lies within the accuracy of all candidate pairs."""
    from hornlake.operators.grid import pca_count

    kg = lift(spark, sf_dir)
    total = 1
    for v in (RULE.head.s, RULE.head.o):
        total *= M.variable_candidates(kg, RULE.corrupted("x"), v).count()
    exact = M.pca_contradictions(kg, RULE, "x").withColumnRenamed("pca", "exact")
    found = pca_count(kg, RULE, "x", method="auto", accuracy=0.05, confidence=0.0005)
    return found.crossJoin(exact).select("method", (F.abs(F.col("pca") - F.col("exact")) <= 0.05 * total).alias("near"))  # a row each


_BOTH = (Atom(0, "trades_with", 1), Atom(1, "trades_with", 0), Atom(0, "trades_with", 2))


@query(
    "refined_reverse_sizes",
    f"""{KG_SQL}, t AS (SELECT s, o FROM kg WHERE p = 'trades_with'), r AS (SELECT s, o FROM t WHERE EXISTS (SELECT 1 FROM t u WHERE u.s = t.o AND u.o = t.s))
        SELECT 0 AS atom, count(*) AS size FROM r WHERE s IN (SELECT s FROM t) UNION ALL SELECT 1, count(*) FROM r WHERE o IN (SELECT s FROM t) UNION ALL SELECT 2, count(*) FROM t WHERE s IN (SELECT s FROM t) AND s IN (SELECT o FROM t)""",
)
def refined_reverse_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms that run against each other keep the pairs that run both ways."""
    return M.refined_sizes(lift(spark, sf_dir), _BOTH)


# Walks and miners


@query("walk_checks", _values("closing, found, not_in_graph, repeated, open", ["(true, true, 0::BIGINT, 0::BIGINT, 0::BIGINT)", "(false, true, 0, 0, NULL)"]))
def walk_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms of walks are triples, each once; with closing no entity has a single atom end."""
    kg = stats.laid_out(lift(spark, sf_dir).select("s", "p", "o"))
    out = []
    for closing in (True, False):
        found = walks.random_walks(kg, 120, 3, seed=3, close=closing)
        atoms = found.select("walk", F.explode("atoms").alias("a")).select("walk", "a.*")
        outside = atoms.join(kg, ["s", "p", "o"], "left_anti").agg(F.count("*").alias("not_in_graph"))
        again = atoms.groupBy("walk", "s", "p", "o").agg(F.count("*").alias("n")).agg(F.count_if(F.expr("n > 1")).alias("repeated"), (F.count("*") > 0).alias("found"))
        ends = atoms.select("walk", F.explode(F.array("s", "o")).alias("v")).groupBy("walk", "v").agg(F.count("*").alias("n"))
        single = ends.agg((F.count_if(F.expr("n = 1")) if closing else F.lit(None).cast("long")).alias("open"))
        out.append(outside.crossJoin(again).crossJoin(single).select(F.lit(closing).alias("closing"), "found", "not_in_graph", "repeated", "open"))  # a row each
    return out[0].union(out[1])


@query("walk_miner_checks", _values("found, wrong_support, ungated", ["(true, 0::BIGINT, 0::BIGINT)"]))
def walk_miner_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules found by walks, their supports against rule-wise ones, and no PCA count below the least head coverage."""
    from hornlake.operators.mine_walks import Settings, mine_kept

    kg = stats.kept_as_is(lift(spark, sf_dir, blocks=True))
    try:
        found = mine_kept(kg, Settings(budget=24, batch=12, max_length=3, features=frozenset(), seed=5)).collect()  # at most one rule a walk
        rules = [R.parse(r["rule"])[1] for r in found]
        sizes, ways = stats.sizes(kg), shapes.ways_of(shapes.met(kg, rules))
        exact = [sum(rows_of(M.support(kg, r, **job))[0]["support"] for job in M.support_jobs(r, sizes, ways)) for r in rules]
    finally:
        delete_stored(kg)
    rows = [(r["rule_id"], r["support"], r["head_coverage"] < 0.05 and r["pca_x"] is not None, n) for r, n in zip(found, exact, strict=True)]
    joined = spark.createDataFrame(rows, "rule_id long, support long, ungated boolean, exact long")
    return joined.agg((F.count("*") == max(1, len(found))).alias("found"), F.count_if(F.expr("support <> exact")).alias("wrong_support"), F.count_if("ungated").alias("ungated"))


@query(
    "mine_levels_2_pca",
    f"""{KG_SQL}, size AS (SELECT p, count(*) AS n FROM kg GROUP BY p),
        b AS (SELECT p AS p1, 'r' AS k, o AS s, s AS o FROM kg UNION ALL SELECT p, 'p', s, o FROM kg),
        two AS (SELECT h.p AS p0, k, p1, count(*) AS support FROM kg h JOIN b ON b.s = h.s AND b.o = h.o WHERE k = 'r' OR h.p <> p1 GROUP BY ALL),
        kept AS (SELECT two.*, n FROM two JOIN size ON p = p0 WHERE support / n >= 0.01),
        j AS (SELECT kept.p0, kept.k, kept.p1,
                     EXISTS (SELECT 1 FROM kg h WHERE h.p = p0 AND h.o = b.o AND h.s <> b.s AND h.s <> b.o) AS ax, EXISTS (SELECT 1 FROM kg h WHERE h.p = p0 AND h.s = b.s AND h.o <> b.o AND h.o <> b.s) AS ay
              FROM kept JOIN b ON b.p1 = kept.p1 AND b.k = kept.k WHERE NOT EXISTS (SELECT 1 FROM kg h WHERE h.p = p0 AND h.s = b.s AND h.o = b.o))
        SELECT p0 || '(a, b) <= ' || p1 || CASE k WHEN 'r' THEN '(b, a)' ELSE '(a, b)' END AS rule, support, (SELECT count(*) FROM j WHERE j.p0 = kept.p0 AND j.k = kept.k AND j.p1 = kept.p1 AND ax) AS pca_x,
               (SELECT count(*) FROM j WHERE j.p0 = kept.p0 AND j.k = kept.k AND j.p1 = kept.p1 AND ay) AS pca_y FROM kept""",
)
def mine_levels_2_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hornlake.operators.mine_levels import mine, report

    kg = stats.laid_out(lift(spark, sf_dir).select("s", "p", "o"))
    return report(kg, mine(kg, max_length=2, min_head_coverage=0.01), pca=True).select("rule", "support", "pca_x", "pca_y")
