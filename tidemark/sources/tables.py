"""Tables of a folder, and a place for tables in between that all executors share."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a micro-batch of stream_in_order(), about.
ROWS = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path under spark.checkpoint.dir; where that is unset, under a temporary folder of a local session, as in tests. A cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        kept = context._jsc.sc().getCheckpointDir()
        if kept.isDefined():
            root = kept.get()
        elif context.master.split("[")[0] == "local":
            context.setCheckpointDir(root := tempfile.mkdtemp(prefix="tidemark-"))
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex[:12]}"


def stream_in_order(spark: SparkSession, sf_dir: str, name: str, by: str, rows: int = ROWS) -> DataFrame:
    """A stream of a table in the order of the column `by`: micro-batches of about `rows` rows, each after those before it; within one there is no order.

    The files of a table say nothing of an order: they may have been written at the same time and hold any rows. A small table is one micro-batch. A larger one
    is dealt into ranges of `by`, and these are written one after another, a file each, as a stream of files takes the oldest first.
    """
    whole = table(spark, sf_dir, name)
    n = math.ceil(whole.count() / rows)
    source = spark.readStream.schema(whole.schema)
    if n < 2:
        return source.parquet(f"{sf_dir}/{name}.[p]arquet")  # a pattern, so that the table may be one file or a folder of files
    bounds = whole.select(F.col(by).cast("double").alias("by")).approxQuantile("by", [i / n for i in range(1, n)], 0.1 / n)
    place = sum(((F.col(by) > b).cast("int") for b in bounds), F.lit(0))
    ranges, ordered = scratch(spark, f"{name}-ranges"), scratch(spark, f"{name}-in-order")
    whole.withColumn("_range", F.coalesce(place, F.lit(0))).write.partitionBy("_range").parquet(ranges)
    dealt = spark.read.schema(whole.withColumn("_range", F.lit(0)).schema).parquet(ranges)
    for i in range(n):
        # Small row groups, so that several tasks read a file.
        dealt.where(F.col("_range") == i).drop("_range").coalesce(1).write.mode("append").option("parquet.block.size", 1 << 22).parquet(ordered)
    return source.option("maxFilesPerTrigger", 1).parquet(ordered)
