"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Size up to which an explicit broadcast is used; beyond it the same step runs as a shuffled join.
BROADCAST_BYTES = 32 << 20

#: An input of fewer bytes a core is dealt out evenly before long work on its rows.
SMALL_SPLIT = 4 << 20

#: The ASCII white space that separates words, and what deletes it.
SPACE = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: ``spark.checkpoint.dir``, or a temporary one in local mode."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not at:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = sc.getCheckpointDir() or tempfile.mkdtemp(prefix="siftline-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, below one folder an application."""
    return f"{shared_dir(spark)}/siftline-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def settle(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Delete the files of settled tables that no result needs any more."""
    for t in tables:
        path = getattr(t, "settled_at", None)
        if path:
            drop_path(t.sparkSession, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Hadoop's file systems."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def semi(big: DataFrame, keys: DataFrame, on: str, n_keys: int, key_bytes: int = 16) -> DataFrame:
    """Rows of ``big`` whose ``on`` is in ``keys`` (distinct).  Keys of a checked small size are broadcast, so that wide rows
    stay where they are; more keys are joined by a shuffle."""
    if n_keys * key_bytes <= BROADCAST_BYTES:
        keys = F.broadcast(keys)
    return big.join(keys, on, "left_semi")


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> None:
    """Bound the Arrow batches that go to Python, by rows and bytes, where the session still has Spark's defaults: a batch is
    held several times on its way.  The registered queries call this; operators leave the session's settings alone."""
    for key, default, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", str(rows)), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", size)):
        if spark.conf.get(key) == default:
            spark.conf.set(key, value)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; a small one, which may be a single split, is dealt out to all cores, as what follows is long work on
    each row.  A table of more than ``SMALL_SPLIT`` bytes a core is left as it is."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL_SPLIT else df


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def as_documents(docs: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Only the named columns, cast; a missing one is null.  Extra columns, whatever their names, are left behind."""
    have = set(docs.columns)
    return docs.select(*(docs[c].cast(t).alias(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in columns.items()))
