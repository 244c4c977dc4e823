"""Triple files, results, evaluation and streams."""

from __future__ import annotations

import zipfile

import pytest
from pyspark.sql import functions as F

from hornlake.functions import stats
from hornlake.operators import evaluate as V
from hornlake.sources import results, triples
from hornlake.streaming import ingest

FILES = {"train2id.txt": "3\n1 2 p\n1 2 p\n2 3 q\n", "valid2id.txt": "1 2 p\n4 5 p\n", "test2id.txt": "7 8 q\nbad line\n"}


@pytest.fixture
def folder(spark, tmp_path):
    archive = tmp_path / "WN18.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for name, text in FILES.items():
            z.writestr(f"WN18/{name}", text)
        z.writestr("WN18/readme.md", "other")
    (tmp_path / "files").mkdir()
    return triples.unpack(spark, str(archive), str(tmp_path / "files"))


def test_read_write_load(spark, folder, tmp_path):
    read = triples.read(spark, folder, triples.DATASETS["WN18"])
    assert read.count() == 6
    once = triples.deduplicated(read)
    rows = sorted((r["s"], r["p"], r["o"], r["split"]) for r in once.collect())
    assert rows == [(1, "p", 2, 0), (2, "q", 3, 0), (4, "p", 5, 1), (7, "q", 8, 2)]
    path = str(tmp_path / "graph")
    triples.write(once, path)
    kg = triples.load(spark, path, upto=1)
    assert stats.sizes(kg) == {"p": 2, "q": 1} and triples.load(spark, path).count() == 4
    assert stats.entity_count(triples.load(spark, path)).first()[0] == 7
    plan = kg.filter("p = 'p'").select("s")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(p" in plan


def test_wiki_format(spark, tmp_path):
    (tmp_path / "train2id.txt").write_text("Q12\tP17\tQ3\n")
    row = triples.read(spark, str(tmp_path), triples.DATASETS["Codex_L"]).first()
    assert (row["s"], row["p"], row["o"], row["split"]) == (12, "P17", 3, 0)
    assert triples.paths("/x", "WN18", 2)["graph"] == "/x/graph/WN18_2" and len(triples.DATASETS) == 13


def test_stream(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    for _ in range(2):
        ingest.write(ingest.read(spark, folder, triples.DATASETS["WN18"]), out, str(tmp_path / "cp")).awaitTermination()
        assert triples.load(spark, out).count() == 4


def test_log_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "PCA_Binomial_CI_Random_Acc0.1_Conf0.05", 4.0, 2_000_000_000, None), (2, "Support_Binomial_CI_Acc0.1_Conf0.05", 3.0, 1_000_000_000, 0.25)], "RuleId long, Technique string, Value double, CPU long, AbsoluteError double")
    path = str(tmp_path / "log")
    results.write_log(rows, path)
    spark.createDataFrame([("Rule 1: p(a, b) <= q(a, b)",)], "value string").write.mode("append").text(path)
    found = {r["rule_id"]: r for r in results.measurements(results.read_log(spark, path)).collect()}
    assert len(found) == 2 and found[1]["cpu_seconds"] == 2.0 and found[1]["confidence_error"] is None and found[2]["confidence_error"] == 0.25
    results.append(rows, str(tmp_path / "table"))
    results.append(rows, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 4


def test_series_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("Support_Value", "T:1", 1.5), ("Support_Value", "T:1", 2.0), ("PCA_CPU", "U", 3.0)], "metric string, technique string, value double")
    results.write_series(rows, str(tmp_path / "series"))
    assert sorted(results.read_series(spark, str(tmp_path / "series")).collect()) == sorted(rows.collect())


def test_evaluation(spark):
    df = spark.createDataFrame([(10.0, 5.0), (5.0, 10.0), (0.0, 0.5), (3.0, 3.0)], "t double, e double")
    assert [r[0] for r in df.select(V.q_error(F.col("t"), F.col("e"))).collect()] == [-1.0, 1.0, 0.0, 0.0]
    one = df.limit(1)
    assert one.select(V.speedup(F.lit(4e9), F.lit(2e9))).first()[0] == 2.0 and one.select(V.confidence_error(F.lit(0.5), F.lit(0.25))).first()[0] == -0.25
    names = spark.createDataFrame([(x,) for x in (V.pca_name("Binomial", "CI", "Random", 0.1, 0.05), V.support_name("Chao2", "Chernoff", 0.05, 0.01), V.heuristic_name("Random"))], "technique string")
    assert [r[0] for r in names.limit(2).select(V.suffix(F.col("technique"))).collect()] == ["CI_Random_Acc0.1_Conf0.05", "Chernoff_Acc0.05_Conf0.01"]
    series = names.withColumn("value", F.lit(1.0))
    spread = {r["technique"] for r in V.spread_heuristic(series).collect()}
    assert "PCA_AnyBURL_CI_Random_Acc0.1_Conf0.05" in spread and len(spread) == 3
    assert len(list(V.support_grid(["A", "B"]))) == 36 and len(list(V.pca_grid(["A", "B"], False))) == 108 and len(list(V.pca_grid(["A"] * 6, True))) == 3 * 109
    plots = spark.createDataFrame([("WN18", "m", V.support_name("Chao2", "CI", 0.1, 0.05), [1.0, 2.0]), ("Hetionet", "m", V.support_name("Chao2", "CI", 0.1, 0.05), [1.0])], "dataset string, metric string, technique string, values array<double>")
    assert [r["dataset"] for r in V.plot_rows(plots, ["CI_Acc0.1_Conf0.05"], {"WN18": "WordNet"}).collect()] == ["WordNet"] * 2
    letters = V.letter_values(spark.range(1, 102).select(F.lit("t").alias("technique"), F.col("id").cast("double").alias("value")), depth=2).orderBy("letter").collect()
    assert [(r["lower"], r["upper"]) for r in letters] == [(51.0, 51.0), (26.0, 76.0)]
