"""Statistics and lookups of triples: what an index over the graph would answer, as aggregates and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hornlake.sources.folders import configured, stored


def laid_out(kg: DataFrame) -> DataFrame:
    """The triples in ranges of predicate and subject, cached: a scan of one predicate reads its ranges only."""
    return kg.repartitionByRange("p", "s").sortWithinPartitions("p", "s").cache()


def kept(kg: DataFrame) -> DataFrame:
    """The distinct triples in files, in ranges of predicate and subject: equal ones are in one range, so they move once, and no cache or shuffle stays."""
    return stored(kg.select("s", "p", "o").repartitionByRange("p", "s").distinct().sortWithinPartitions("p", "s"), "graph")


def kept_as_is(kg: DataFrame) -> DataFrame:
    """Triples that are distinct, in files, as their tasks have them: they are made once and do not move.

    Tasks are of about 8 MB, not as large as the cores are few: what makes the triples distinct then holds a small table.
    """
    with configured(kg.sparkSession, adaptive_coalescePartitions_parallelismFirst="false", adaptive_advisoryPartitionSizeInBytes="8MB"):
        return stored(kg.select("s", "p", "o"), "graph")


def entity_words(kg: DataFrame) -> DataFrame:
    """side ('s' or 'o'), word, bits: the entities at each end of triples, 64 neighbouring ids a row."""
    ends = kg.select(F.lit("s").alias("side"), F.col("s").alias("v")).union(kg.select(F.lit("o"), "o"))
    return ends.groupBy("side", F.shiftright("v", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(v & 63 as int)))").alias("bits"))


def entities_of(words: DataFrame, side: str) -> DataFrame:
    """value: the entities of a side of `entity_words`."""
    bit = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit")
    own = words.filter(F.col("side") == side).select("word", "bits", bit).filter(F.expr("shiftrightunsigned(bits, bit) & 1L") == 1)
    return own.select((F.shiftleft("word", 6) + F.col("bit")).alias("value"))


def in_splits(kg: DataFrame, upto: int | None) -> DataFrame:
    """Triples of splits up to `upto`; all if that is None."""
    return kg if upto is None else kg.filter(F.col("split") <= upto)


def predicate_sizes(kg: DataFrame) -> DataFrame:
    return kg.groupBy("p").agg(F.count("*").alias("size"))


def sizes(kg: DataFrame) -> dict[str, int]:
    """Sizes by predicate; predicates are few."""
    return {r["p"]: r["size"] for r in predicate_sizes(kg).toLocalIterator()}


def entities(kg: DataFrame) -> DataFrame:
    return kg.select(F.col("s").alias("entity")).union(kg.select("o")).distinct()


def entity_count(kg: DataFrame) -> DataFrame:
    """Of all splits."""
    return entities(kg).agg(F.count("*").alias("entities"))


def pairs(kg: DataFrame, p: str) -> DataFrame:
    return kg.filter(F.col("p") == p).select("s", "o")


def by_subject(kg: DataFrame, p: str, subjects: DataFrame) -> DataFrame:
    """Pairs of p whose subject is among the values of the only column of `subjects`."""
    return pairs(kg, p).join(subjects.toDF("s"), "s", "left_semi")


def by_object(kg: DataFrame, p: str, objects: DataFrame) -> DataFrame:
    return pairs(kg, p).join(objects.toDF("o"), "o", "left_semi").select("s", "o")


def subjects(kg: DataFrame, p: str) -> DataFrame:
    return pairs(kg, p).select("s").distinct()


def objects(kg: DataFrame, p: str) -> DataFrame:
    return pairs(kg, p).select("o").distinct()


def in_predicate(kg: DataFrame, p: str, candidates: DataFrame, present: bool = True) -> DataFrame:
    """Rows of `candidates` (s, o) that are pairs of p, or that are not."""
    return candidates.join(pairs(kg, p), ["s", "o"], "left_semi" if present else "left_anti")


def degrees(kg: DataFrame) -> DataFrame:
    """p, entity, out (distinct objects) and inn (distinct subjects) of each entity at each predicate."""
    distinct = kg.select("s", "p", "o").distinct()
    ends = distinct.select("p", F.col("s").alias("entity"), F.lit(1).alias("out"), F.lit(0).alias("inn")).union(distinct.select("p", "o", F.lit(0), F.lit(1)))
    return ends.groupBy("p", "entity").agg(F.sum("out").alias("out"), F.sum("inn").alias("inn"))


def predicate_domain_range(kg: DataFrame) -> DataFrame:
    """p, number of subjects and of objects."""
    return degrees(kg).groupBy("p").agg(F.count_if(F.col("out") > 0).alias("subjects"), F.count_if(F.col("inn") > 0).alias("objects"))
