"""Triple files that arrive one after another, as a stream into the table by predicate, with running statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hornlake.sources.triples import Format, split_of


def read(spark: SparkSession, path: str, fmt: Format) -> DataFrame:
    """s, p, o, split of new lines with three fields."""
    lines = spark.readStream.text(path).select(F.split(F.trim("value"), fmt.separator).alias("f"), split_of(F.input_file_name()).alias("split"))
    s, o, p = (0, 1, 2) if fmt.kind == "ids" else (0, 2, 1)
    clean = lambda k: (F.regexp_replace(F.col("f")[k], "Q", "") if fmt.kind == "wiki" else F.col("f")[k]).cast("long")
    return lines.filter((F.size("f") == 3) & F.col("split").isNotNull()).select(clean(s).alias("s"), F.col("f")[p].alias("p"), clean(o).alias("o"), F.col("split").cast("int"))


def write(triples: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what has come, each triple once in the stream's life, and stops when there is no more."""
    once = triples.dropDuplicates(["s", "p", "o"])
    return once.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("p").trigger(availableNow=True).start()
