"""Results: a typed table, the text log of rules and measurements, and aggregated series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def append(results: DataFrame, path: str) -> None:
    results.write.mode("append").parquet(path)


def log_line(df: DataFrame) -> Column:
    """A row as {k=v, k=v} with sorted names; null columns are left out."""
    parts = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in sorted(df.columns)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def write_log(results: DataFrame, path: str) -> None:
    results.select(log_line(results).alias("value")).write.mode("append").text(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """fields (map) of each measurement line; other lines, as those of rules, are skipped."""
    lines = spark.read.text(path).filter(F.col("value").startswith("{"))
    body = F.expr("substring(value, 2, length(value) - 2)")
    return lines.select(F.str_to_map(body, F.lit(", "), F.lit("=")).alias("fields"))


def measurements(log: DataFrame) -> DataFrame:
    """rule_id, technique, value, cpu_seconds and confidence error of log rows; one-sided values are tried in turn."""
    f = F.col("fields")
    return log.select(
        f["RuleId"].cast("long").alias("rule_id"),
        f["Technique"].alias("technique"),
        F.coalesce(f["Value"], f["Valuex"], f["Valuey"]).cast("double").alias("value"),
        (f["CPU"].cast("double") / 1e9).alias("cpu_seconds"),
        f["AbsoluteError"].cast("double").alias("confidence_error"),
    )


def write_series(rows: DataFrame, path: str) -> None:
    """Rows (metric, technique, value) as lines 'Metric: m' and 'Technique: t:v1,v2', a file for each metric.

    A technique's values make one line; they are a sample of rules and runs, not a corpus.
    """
    lines = rows.groupBy("metric", "technique").agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list("value")), lambda v: v.cast("string"))).alias("vs"))
    per_metric = lines.groupBy("metric").agg(F.sort_array(F.collect_list(F.concat(F.lit("Technique: "), F.col("technique"), F.lit(":"), F.col("vs")))).alias("ts"))
    per_metric.select(F.concat_ws("\n", F.concat(F.lit("Metric: "), F.col("metric")), F.concat_ws("\n", "ts")).alias("value")).write.mode("overwrite").text(path)


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """metric, technique, value of written series: a technique belongs to the last metric above it in its file."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("place"))
    above = Window.partitionBy("file").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = lines.withColumn("metric", F.last(F.when(F.col("value").startswith("Metric: "), F.expr("substring(value, 9)")), ignorenulls=True).over(above))
    named = marked.filter(F.col("value").startswith("Technique: ")).select("metric", F.regexp_extract("value", r"^Technique: (.*):([^:]*)$", 1).alias("technique"), F.regexp_extract("value", r"^Technique: (.*):([^:]*)$", 2).alias("vs"))
    return named.select("metric", "technique", F.explode(F.split("vs", ",")).alias("v")).filter("v <> ''").select("metric", "technique", F.col("v").cast("double").alias("value"))
