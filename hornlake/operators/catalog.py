"""The catalog of rules found so far, keyed by canonical form, and its work queue; both are tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hornlake.plans.rule import Atom, Rule, canonical, head_index, key, signature
from hornlake.schema import RULES

PENDING, PROCESSING, DONE = "pending", "processing", "done"


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], RULES).withColumn("status", F.lit(PENDING))


def rows(spark: SparkSession, rules: list[Rule], marked: bool = True) -> DataFrame:
    """Rules as rows without ids; `marked` keeps rules apart whose heads are parallel atoms."""
    data = [(None, key(r, marked), [(a.s, a.p, a.o) for a in signature(r)], head_index(r)) for r in rules]
    return spark.createDataFrame(data, RULES)


def insert(catalog: DataFrame, found: DataFrame) -> DataFrame:
    """The catalog with those of `found` whose keys are new, numbered on from its largest id."""
    last = catalog.agg(F.coalesce(F.max("rule_id"), F.lit(0)).alias("last"))
    new = found.dropDuplicates(["key"]).join(catalog, "key", "left_anti")
    # Rules of one batch of a miner: few enough to be numbered in one order.
    numbered = new.crossJoin(F.broadcast(last)).withColumn("rule_id", F.col("last") + F.row_number().over(Window.orderBy("key")))
    return catalog.unionByName(numbered.select("rule_id", "key", "atoms", "head_idx", F.lit(PENDING).alias("status")))


def find(catalog: DataFrame, r: Rule, marked: bool = True) -> DataFrame:
    return catalog.filter(F.col("key") == key(r, marked))


def to_rule(row) -> Rule:
    """The canonical rule of a catalog row."""
    atoms = [Atom(a["s"], a["p"], a["o"]) for a in row["atoms"]]
    head = atoms.pop(row["head_idx"])
    return canonical(Rule(head, tuple(atoms)))


def read(catalog: DataFrame, rule_id: int) -> Rule:
    return to_rule(catalog.filter(F.col("rule_id") == rule_id).first())


def ids(catalog: DataFrame) -> DataFrame:
    return catalog.select("rule_id")


def with_status(catalog: DataFrame, which: DataFrame, status: str) -> DataFrame:
    """The rules whose ids are in `which` (rule_id) get the status."""
    hit = which.select(F.col("rule_id").alias("id_")).distinct()
    joined = catalog.join(hit, F.col("rule_id") == F.col("id_"), "left")
    return joined.withColumn("status", F.when(F.col("id_").isNotNull(), status).otherwise(F.col("status"))).drop("id_")


def next_pending(catalog: DataFrame) -> DataFrame:
    """One row: the smallest pending id, or null."""
    return catalog.filter(F.col("status") == PENDING).agg(F.min("rule_id").alias("rule_id"))


def count_pending(catalog: DataFrame) -> DataFrame:
    return catalog.filter(F.col("status") == PENDING).agg(F.count("*").alias("pending"))


def resume(catalog: DataFrame) -> DataFrame:
    """After a stop: what was being processed is pending again."""
    return catalog.withColumn("status", F.when(F.col("status") == PROCESSING, PENDING).otherwise(F.col("status")))
