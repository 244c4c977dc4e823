"""Session helpers: the cluster's shared folder, tables cut off from their lineage, and workers that find this package."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = str(Path(__file__).resolve().parents[2])
#: Bytes of a batch of rows that goes to Python.
BATCH = 4 << 20


def prepare(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver did.

    On a cluster the package is installed or sent with --py-files; the entry is then merely unused.
    """
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")
    if _ROOT not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [_ROOT, known]))


def small_batches(spark: SparkSession) -> None:
    """Batches of BATCH bytes for Python from now on, unless the session has a size of its own.

    The setting stays: a frame that an operator returns is run later, and takes the size that holds then.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(BATCH))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a session that runs in one process may do without the setting; it gets a temporary folder.
    """
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = Path(tempfile.mkdtemp(prefix="hornlake-")).as_uri()
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/hornlake-{what}-{uuid.uuid4().hex}"


def settled(df: DataFrame, what: str) -> DataFrame:
    """`df`, written to the shared folder and read again.

    Later stages read files that outlive any executor; the shuffles that made them are dropped when they are written.
    """
    spark = df.sparkSession
    path = scratch(spark, what)
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the files of tables made by `settled` which no later stage reads."""
    for df in frames:
        spark = df.sparkSession
        for f in {name.rsplit("/", 1)[0] for name in df.inputFiles() if "/hornlake-" in name}:
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def hash_sample(rows: DataFrame, text: str, n: int, *by: str) -> DataFrame:
    """About 2 n distinct texts of each group, or all if there are fewer: those low in a hash of the text.

    A group's count of distinct texts, from a sketch of bounded size (error 2 %, less for few texts), gives the bound of
    the hash, so only the sample itself moves, however many tasks read the table and however many copies there are.
    Adds `h`; the groups must be few.  Null and empty texts are left out.
    """
    space = 1 << 62
    rows = rows.filter(F.col(text) != "").withColumn("h", F.pmod(F.xxhash64(F.col(text)), F.lit(space)))
    counts = rows.groupBy(*by).agg(F.approx_count_distinct("h", 0.02).alias("distinct")).collect()
    bounds = {tuple(r[c] for c in by): min(space, int(2 * n / max(1, r["distinct"]) * space)) for r in counts}
    low = F.lit(False)
    for values, bound in sorted(bounds.items()):
        low |= reduce(lambda a, b: a & b, (F.col(c) == v for c, v in zip(by, values, strict=True)), F.lit(True)) & (F.col("h") < bound)
    return rows.filter(low).groupBy(*by, "h").agg(F.min(text).alias(text))


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """SQL settings, dots as double underscores, for what runs inside."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def rows_with(big: DataFrame, ids: DataFrame, key: str, what: str) -> DataFrame:
    """Rows of a big table whose key is in a small one, settled.

    Spark is asked to build a filter of bounded size over the keys, which drops most other rows before the shuffle.
    """
    spark = big.sparkSession
    listed = settled(ids.select(key).distinct(), "keys")
    selective = listed.filter(F.col(key) > -(2**63))  # always so; marks the side as selective
    prefix = "spark__sql__optimizer__runtime__bloomFilter__"
    with settings(spark, **{f"{prefix}enabled": "true", f"{prefix}applicationSideScanSizeThreshold": "1"}):
        out = settled(big.join(selective, key, "left_semi"), what)
    discard(listed)
    return out


class Marks:
    """A filter of fixed size over 64-bit values: a bit for each value's upper bits.  A value in it is never denied."""

    def __init__(self, bits: np.ndarray, log2: int):
        self.bits, self.shift = bits, np.uint64(64 - log2)

    def has(self, values: np.ndarray) -> np.ndarray:
        at = values.view(np.uint64) >> self.shift
        return (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def marks(values: DataFrame, column: str, log2: int = 26) -> Marks:
    """The filter over a column of hashes, made by an aggregate.  2**log2 bits (8 MB), however many values there are."""
    at = F.shiftrightunsigned(F.col(column), 64 - log2)
    words = values.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - log2}) & 63 as int))")).alias("bits"))
    bits = np.zeros(1 << (log2 - 6), np.uint64)
    rows = words.toArrow()
    bits[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return Marks(bits, log2)


def unused(df: DataFrame, n: int) -> list[str]:
    """Names of working columns that no column of `df` has."""
    taken = {c.lower() for c in df.columns}
    return [name for name in (f"work_{k}" for k in range(len(taken) + n)) if name not in taken][:n]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
