"""Integrity checks over DataFrames: values, uniqueness, endpoints, cardinality.  Each returns the violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.schema import NUMERIC, EntityType


def bad_values(rows: DataFrame, t: EntityType) -> DataFrame:
    """id, rule: enums, ranges, checks, missing values, vector lengths, unsigned ranges."""
    tests = []
    for n, p in t.props.items():
        c = F.col(n)
        if not p.nullable:
            tests.append((c.isNull(), f"{n} is required"))
        if p.enum:
            member = F.size(F.array_except(c, F.array(*map(F.lit, p.enum)))) == 0 if p.list else c.isin(*p.enum)
            tests.append((~member, f"{n} is not in its enum"))
        if p.scalar == "Vector":
            tests.append((F.size(c) != p.dim, f"{n} needs {p.dim} numbers"))
        if p.scalar in ("U32", "U64") and not p.list:
            tests.append(((c < 0) | (c > (2**32 - 1 if p.scalar == "U32" else 2**64 - 1)), f"{n} is out of range"))
        if n in t.ranges and p.scalar in NUMERIC:
            low, high = t.ranges[n]
            tests.append((reduce(lambda a, b: a | b, [F.isnan(c.cast("double")), *([c < low] if low is not None else []), *([c > high] if high is not None else [])]), f"{n} is out of @range"))
        if n in t.checks:
            tests.append((~c.rlike(t.checks[n]), f"{n} fails @check"))
    if not tests:
        return rows.select("id", F.lit("").alias("rule")).where("false")
    rules = F.array(*[F.when(F.coalesce(x, F.lit(False)), F.lit(r)) for x, r in tests])
    return rows.select("id", F.explode(F.array_compact(rules)).alias("rule"))


def duplicates(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The values of columns that several rows share; a null in any exempts a row."""
    return rows.dropna(subset=list(columns)).groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def orphans(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges that miss an end: their columns and missing, 'src' or 'dst'."""
    a = edges.join(sources.select(F.col("id").alias("_end")), F.col("src") == F.col("_end"), "left_anti").withColumn("missing", F.lit("src"))
    b = edges.join(targets.select(F.col("id").alias("_end")), F.col("dst") == F.col("_end"), "left_anti").withColumn("missing", F.lit("dst"))
    return a.union(b)


def cardinality(edges: DataFrame, affected: DataFrame, low: int, high: int | None) -> DataFrame:
    """src, n for the affected sources (column src) whose edges are fewer or more than allowed."""
    counts = edges.groupBy("src").agg(F.count("*").alias("n"))
    all_ = affected.select("src").distinct().join(counts, "src", "left").select("src", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return all_.where((F.col("n") < low) | (F.col("n") > high) if high is not None else F.col("n") < low)
