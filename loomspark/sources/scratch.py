"""Folders for files that a query writes and reads again, in the shared folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession, tag: str) -> str:
    """A new folder name; a machine-local one only where the setting is absent and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="loomspark-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root}/loomspark/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def fs(spark: SparkSession, path: str):
    """The file system of a path, and the path as it wants it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def in_order(t: DataFrame, *keys: Column, name: str, tag: str) -> DataFrame:
    """``t`` with ``name``, the position of each row from 0 in the order of ``keys``.

    Ranges of the order are numbered apart and shifted by what lies before, so no task holds all rows. The ranges are written once:
    computed again for their sizes, they would have other bounds (these are sampled) and be joined otherwise (by their bytes).
    """
    spark, path = t.sparkSession, folder(t.sparkSession, tag)
    ks = [f"_k{i}" for i in range(len(keys))]  # columns, since a sort computes an expression at each comparison
    # A range's number, and in the lower 33 bits the position in it.
    s = t.withColumns(dict(zip(ks, keys))).repartitionByRange(*ks).sortWithinPartitions(*ks).drop(*ks).withColumn("_at", F.monotonically_increasing_id())
    s.write.option("compression", "zstd").parquet(path)
    s = spark.read.schema(s.schema).parquet(path).withColumn("_p", F.shiftright("_at", 33))
    before = s.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.join(F.broadcast(before.select("_p", "_before")), "_p")  # one row a range: bounded by the number of shuffle partitions
    return s.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_p", "_before")


@atexit.register
def _release() -> None:
    for spark, path in _made:
        if spark.sparkContext._jsc is not None and getattr(spark.sparkContext._jsc.sc(), "isStopped", lambda: True)() is False:
            f, p = fs(spark, path)
            f.delete(p, True)
