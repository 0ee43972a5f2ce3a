"""Joins whose rows are bounded by a comparison of both sides: most of their work is their result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut

#: rows of a chunk
CHUNK = 512


def theta(left: DataFrame, right: DataFrame, on: tuple[str, str] | None, pivot: tuple[str, str, str], test: Column) -> DataFrame:
    """The pairs of rows that fulfil test, of equal keys if on names two columns; test implies pivot, a comparison of a left and a right column.

    The right rows are cut into chunks that lie next to each other by key and value.  Left rows, dealt evenly, meet the
    chunks whose bounds allow a pair, and then the rows of these: neither few keys nor few input files decide how many tasks there are.
    """
    a, op, b = pivot
    spark = left.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = right.withColumn("_key", F.col(on[1]) if on else F.lit(0)).where(F.col("_key").isNotNull() & F.col(b).isNotNull())
    rows = cut(rows.repartitionByRange(n, "_key", b).sortWithinPartitions("_key", b).withColumn("_at", F.expr(f"monotonically_increasing_id() div {CHUNK}")))
    chunks = rows.groupBy("_key", "_at").agg(F.min(b).alias("_low"), F.max(b).alias("_high"))
    chunks = cut(chunks.withColumn("_chunk", F.monotonically_increasing_id()))
    rows = rows.join(chunks.select("_key", "_at", "_chunk"), ["_key", "_at"]).select(F.col("_chunk").alias("_c"), *right.columns)
    value = F.col(a)
    bounds = {"<": value < F.col("_high"), "<=": value <= F.col("_high"), ">": value > F.col("_low"), ">=": value >= F.col("_low")}[op]
    dealt = left.repartition(max(n, 4 * spark.sparkContext.defaultParallelism))
    met = dealt.join(chunks, (F.col(on[0]) == F.col("_key")) & bounds if on else bounds).select("_chunk", *left.columns)
    # a chunk's rows come again and again in the result, which packs well
    return met.sortWithinPartitions("_chunk").join(rows, (F.col("_chunk") == F.col("_c")) & test).drop("_chunk", "_c")
