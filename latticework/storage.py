"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

#: how many jobs of one step the driver starts side by side
AT_ONCE = 6


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a local session's own folder or a cluster's warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        local = spark.sparkContext.master.split("[")[0] == "local"
        found = "file://" + tempfile.mkdtemp(prefix="latticework-") if local else spark.conf.get("spark.sql.warehouse.dir")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, *by: str) -> DataFrame:
    """Write df and read it back: the plan ends there and lost executors cost nothing.  by: columns, the last ones, whose values have folders of their own."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/latticework/cut-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def at_once(spark: SparkSession, calls: list[Callable]) -> list:
    """What the calls return, in their order.  Their Spark jobs run side by side, as most are short; the first of several errors is raised."""
    if len(calls) < 2:
        return [f() for f in calls]
    with ThreadPoolExecutor(min(len(calls), AT_ONCE)) as pool:
        return [x.result() for x in [pool.submit(inheritable_thread_target(spark)(f)) for f in calls]]


def any_row(df: DataFrame) -> Row | None:
    """A row of df, None if it has none: one job over all partitions, where head() would try one, then some more; for what is mostly empty."""
    found = df.select(F.struct("*").alias("r")).agg(F.first("r").alias("r")).first()
    return found.r


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """df with the place of each row in an order, from 0, without gathering the rows in one task.

    Rows are range-partitioned, sorted and written once with their place inside the
    partition; a table with one row per partition adds the offsets.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    offsets = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    offsets = offsets.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    placed = rows.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return placed.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_before")
