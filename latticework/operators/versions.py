"""Entity-level comparison of versions: diff, three-way merge, shadowing of pending rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _packed(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    return df.select("id", F.struct(*columns).alias(name))


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """id, op (insert, update, delete), before, after: rows that differ, nulls told from values."""
    cols = before.columns
    both = _packed(before, "before", cols).join(_packed(after, "after", cols), "id", "full_outer")
    op = F.when(F.col("before").isNull(), "insert").when(F.col("after").isNull(), "delete").when(~F.col("before").eqNullSafe(F.col("after")), "update")
    return both.withColumn("op", op).where("op is not null").select("id", "op", "before", "after")


def merge(base: DataFrame, ours: DataFrame, theirs: DataFrame, changed_only: bool = False) -> DataFrame:
    """id, conflict, row: the three-way merge by id; row is null where the entity is gone, conflict null where there is none.

    changed_only: only conflicts and entities that differ from ours.
    """
    cols = base.columns
    all_ = _packed(base, "b", cols).join(_packed(ours, "o", cols), "id", "full_outer").join(_packed(theirs, "t", cols), "id", "full_outer")
    b, o, t = F.col("b"), F.col("o"), F.col("t")
    same_t, same_o, equal = b.eqNullSafe(t), b.eqNullSafe(o), o.eqNullSafe(t)
    clash = F.when(b.isNull(), "DivergentInsert").when(o.isNull() | t.isNull(), "DeleteVsUpdate").otherwise("DivergentUpdate")
    conflict: Column = F.when(same_t | same_o | equal, F.lit(None).cast("string")).otherwise(clash)
    row = F.when(same_t | equal, o).when(same_o, t)
    if changed_only:
        all_ = all_.where(~(same_t | equal))
    return all_.select("id", conflict.alias("conflict"), row.alias("row"))


def shadow(committed: DataFrame, pending: DataFrame) -> DataFrame:
    """Committed rows that no pending row replaces, and the pending rows."""
    return committed.join(pending.select("id"), "id", "left_anti").select(*committed.columns).unionByName(pending)


def last_wins(rows: DataFrame, order: str) -> DataFrame:
    """Per id the row with the greatest value of order."""
    w = Window.partitionBy("id").orderBy(F.col(order).desc())
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", order)
