"""Triple files: read, tagged with their split, de-duplicated, written as a table by predicate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = ("train2id.txt", "valid2id.txt", "test2id.txt")


@dataclass(frozen=True)
class Format:
    """`ids`: s o p, all as they are; `wiki`: s p o with a Q before entities."""

    kind: str
    separator: str


#: The data sets known by name, with their formats and separators.
DATASETS = {
    "BioKG": Format("ids", "\t"),
    "Codex_L": Format("wiki", "\t"),
    "FB13": Format("ids", "\t"),
    "FB15K": Format("ids", " "),
    "FB15K237": Format("ids", " "),
    "Hetionet": Format("ids", "\t"),
    "NELL_995": Format("ids", " "),
    "SNOMED": Format("ids", "\t"),
    "Wikidata5M": Format("wiki", "\t"),
    "WN18": Format("ids", " "),
    "WN18RR": Format("ids", " "),
    "YAGO3_10": Format("ids", " "),
    "WN11": Format("ids", "\t"),
}


def unpack(spark: SparkSession, archive: str, folder: str) -> str:
    """The triple files of a zip archive, streamed to a folder; both are paths of any file system that Spark reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    source, target = (jvm.org.apache.hadoop.fs.Path(p) for p in (archive, folder))
    entries = jvm.java.util.zip.ZipInputStream(source.getFileSystem(conf).open(source))
    try:
        while entry := entries.getNextEntry():
            name = entry.getName().rsplit("/", 1)[-1]
            if name in FILES:
                out = target.getFileSystem(conf).create(jvm.org.apache.hadoop.fs.Path(target, name), True)
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(entries, out, 1 << 16, False)
                finally:
                    out.close()
    finally:
        entries.close()
    return folder


def split_of(path: Column) -> Column:
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(name.contains("train"), 0).when(name.contains("valid"), 1).when(name.contains("test"), 2)


def read(spark: SparkSession, path: str, fmt: Format) -> DataFrame:
    """s, p, o, split, tid of all rows with three fields; others, as a leading count, are skipped.

    tid orders the rows: by split, then by place in the files.
    """
    lines = spark.read.text(path).select(F.split(F.trim("value"), fmt.separator).alias("f"), split_of(F.input_file_name()).alias("split"), F.monotonically_increasing_id().alias("place"))
    rows = lines.filter((F.size("f") == 3) & F.col("split").isNotNull())
    s, o, p = (0, 1, 2) if fmt.kind == "ids" else (0, 2, 1)

    def entity(k: int) -> Column:
        field = F.col("f")[k]
        return (F.regexp_replace(field, "Q", "") if fmt.kind == "wiki" else field).cast("long")

    tid = F.col("split").cast("long") * F.lit(2**60) + F.col("place")
    return rows.select(entity(s).alias("s"), F.col("f")[p].alias("p"), entity(o).alias("o"), F.col("split").cast("int"), tid.alias("tid"))


def deduplicated(triples: DataFrame) -> DataFrame:
    """One row for each (s, p, o): that with the lowest tid."""
    first = triples.groupBy("s", "p", "o").agg(F.min_by(F.struct("split", "tid"), "tid").alias("first"))
    return first.select("s", "p", "o", "first.split", "first.tid")


def write(triples: DataFrame, path: str) -> None:
    """By predicate, so that a scan of one reads only its files; each predicate's rows are spread over tasks."""
    triples.write.mode("overwrite").partitionBy("p").parquet(path)


def load(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """A written graph, up to a split; predicates keep their type as text."""
    kg = spark.read.schema("s long, o long, split int, tid long, p string").parquet(path)
    return kg if upto is None else kg.filter(F.col("split") <= upto)


def paths(base: str, dataset: str, run: int | None = None) -> dict[str, str]:
    """Where a data set's graph, catalog and results lie."""
    name = dataset if run is None else f"{dataset}_{run}"
    return {"graph": f"{base}/graph/{name}", "catalog": f"{base}/catalog/{name}", "results": f"{base}/results/{name}"}
