"""A knowledge graph lifted from the star-schema tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KIND = 10**9
#: Subjects that share all but so many last bits move together.
BLOCK = 10
REGION, NATION, CUSTOMER, SUPPLIER, PART, ORDER, BRAND = range(1, 8)


def _entity(kind: int, key: Column | str) -> Column:
    return (F.lit(kind * KIND) + (F.col(key) if isinstance(key, str) else key).cast("long")).cast("long")


def _in_blocks(pairs: DataFrame) -> DataFrame:
    """The distinct pairs (s, o); a task has all of a subject's, and those of the subjects beside it.

    They move before any are dropped: nearly all are distinct, so a sum before the move would hold each of them.
    """
    return pairs.withColumn("block_", F.shiftright("s", BLOCK)).repartition("block_").distinct().select("s", "o")


def lift(spark: SparkSession, sf_dir: str, by_split: bool = False, blocks: bool = False) -> DataFrame:
    """Triples s, p, o, split of twelve predicates, distinct; all in split 0, or dealt to splits by (s + o) % 10.

    With `blocks` a task has one predicate's triples of whole blocks of subjects.
    """
    nation, customer, supplier, part, orders, item = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "customer", "supplier", "part", "orders", "lineitem"))
    sold = item.join(orders, item["l_orderkey"] == orders["o_orderkey"])
    large = sold.filter("l_quantity >= 40")
    home = supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"])
    urgent = sold.filter("l_quantity = 50 and l_linenumber = 1 and o_orderpriority = '1-URGENT'")
    trade = urgent.join(customer, urgent["o_custkey"] == customer["c_custkey"]).join(supplier, urgent["l_suppkey"] == supplier["s_suppkey"])
    definitions = [
        (nation, "nation_region", _entity(NATION, "n_nationkey"), _entity(REGION, "n_regionkey")),
        (customer, "customer_nation", _entity(CUSTOMER, "c_custkey"), _entity(NATION, "c_nationkey")),
        (supplier, "supplier_nation", _entity(SUPPLIER, "s_suppkey"), _entity(NATION, "s_nationkey")),
        (home, "supplier_region", _entity(SUPPLIER, "s_suppkey"), _entity(REGION, "n_regionkey")),
        (orders, "order_customer", _entity(ORDER, "o_orderkey"), _entity(CUSTOMER, "o_custkey")),
        (item, "order_part", _entity(ORDER, "l_orderkey"), _entity(PART, "l_partkey")),
        (item, "order_supplier", _entity(ORDER, "l_orderkey"), _entity(SUPPLIER, "l_suppkey")),
        (item.filter("l_quantity >= 40"), "supplies", _entity(SUPPLIER, "l_suppkey"), _entity(PART, "l_partkey")),
        (large, "bought", _entity(CUSTOMER, "o_custkey"), _entity(PART, "l_partkey")),
        (large, "bought_from", _entity(CUSTOMER, "o_custkey"), _entity(SUPPLIER, "l_suppkey")),
        (part, "part_brand", _entity(PART, "p_partkey"), _entity(BRAND, F.regexp_extract("p_brand", r"#(\d+)", 1))),
        (trade, "trades_with", _entity(NATION, "c_nationkey"), _entity(NATION, "s_nationkey")),
    ]
    if blocks:
        parts = [_in_blocks(df.select(s.alias("s"), o.alias("o"))).select("s", F.lit(p).alias("p"), "o") for df, p, s, o in definitions]
    else:
        parts = [df.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o")).distinct() for df, p, s, o in definitions]
    kg = parts[0]
    for more in parts[1:]:
        kg = kg.union(more)
    tenth = F.col("s") % 10 + F.col("o") % 10
    split = F.when(tenth % 10 == 8, 1).when(tenth % 10 == 9, 2).otherwise(0) if by_split else F.lit(0)
    return kg.withColumn("split", split.cast("int"))


_SOLD = "lineitem JOIN orders ON l_orderkey = o_orderkey"
_TRADE = f"{_SOLD} JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey"

#: predicate, kind and key of both ends, and what rows
DEFINITIONS = [
    ("nation_region", NATION, "n_nationkey", REGION, "n_regionkey", "nation"),
    ("customer_nation", CUSTOMER, "c_custkey", NATION, "c_nationkey", "customer"),
    ("supplier_nation", SUPPLIER, "s_suppkey", NATION, "s_nationkey", "supplier"),
    ("supplier_region", SUPPLIER, "s_suppkey", REGION, "n_regionkey", "supplier JOIN nation ON s_nationkey = n_nationkey"),
    ("order_customer", ORDER, "o_orderkey", CUSTOMER, "o_custkey", "orders"),
    ("order_part", ORDER, "l_orderkey", PART, "l_partkey", "lineitem"),
    ("order_supplier", ORDER, "l_orderkey", SUPPLIER, "l_suppkey", "lineitem"),
    ("supplies", SUPPLIER, "l_suppkey", PART, "l_partkey", "lineitem WHERE l_quantity >= 40"),
    ("bought", CUSTOMER, "o_custkey", PART, "l_partkey", f"{_SOLD} WHERE l_quantity >= 40"),
    ("bought_from", CUSTOMER, "o_custkey", SUPPLIER, "l_suppkey", f"{_SOLD} WHERE l_quantity >= 40"),
    ("part_brand", PART, "p_partkey", BRAND, "regexp_extract(p_brand, '#(\\d+)', 1)::BIGINT", "part"),
    ("trades_with", NATION, "c_nationkey", NATION, "s_nationkey", f"{_TRADE} WHERE l_quantity = 50 AND l_linenumber = 1 AND o_orderpriority = '1-URGENT'"),
]

#: WITH kg AS (...), to be put before a SELECT.
KG_SQL = (
    "WITH kg AS MATERIALIZED (\n"
    + "\nUNION ALL\n".join(f"SELECT DISTINCT {a}000000000::BIGINT + {s} AS s, '{p}' AS p, {b}000000000::BIGINT + {o} AS o, 0 AS split FROM {rows}" for p, a, s, b, o, rows in DEFINITIONS)
    + ")"
)
