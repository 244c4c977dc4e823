"""Where intermediate files go, and files written from the driver through Spark's file systems."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, Row, SparkSession


def working_folder(spark: SparkSession, what: str) -> str:
    """A new path below spark.checkpoint.dir; only a session that runs in one process may do without it."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = Path(tempfile.mkdtemp(prefix="hornlake-")).as_uri()
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


@contextmanager
def configured(spark: SparkSession, **values: str) -> Iterator[None]:
    """Queries made inside run with these settings below spark.sql, named with _ for each dot."""
    names = {f"spark.sql.{k.replace('_', '.')}": v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def dropping_shuffles(spark: SparkSession):
    """Queries made inside delete their shuffle files when they have run."""
    return configured(spark, classic_shuffleDependency_fileCleanup_enabled="true")


def rows_of(few: DataFrame) -> list[Row]:
    """The rows of a small result; the shuffles that made it are gone afterwards."""
    with dropping_shuffles(few.sparkSession):
        return few.select("*").collect()


def stored(df: DataFrame, what: str) -> DataFrame:
    """`df` in files of the working folder, without the shuffles that made it."""
    spark = df.sparkSession
    path = working_folder(spark, what)
    with dropping_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_stored(df: DataFrame) -> None:
    """Deletes the files that `stored` made."""
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> str:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return path
