"""Shared plumbing: durable intermediate tables, internal columns, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python's ASCII white space, the set [\x20\x09-\x0D]
BLANK = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Where that is unset a plain local session gets a fresh temporary folder; a
    cluster falls back to its warehouse folder, which is shared as well.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            found = "file://" + tempfile.mkdtemp(prefix="latticework-")
        else:
            found = spark.conf.get("spark.sql.warehouse.dir")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage is cut, a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/latticework/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table that materialize() wrote, once nothing can read it any more."""
    path = getattr(df, "_table_path", None)
    if path:
        spark = df.sparkSession
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that don't clash with those of df, whatever its case sensitivity."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def quoted(name: str) -> Column:
    """A column by its literal name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def let(value: Column, body) -> Column:
    """Evaluate value once and pass it to body: keeps Catalyst from repeating it in lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column) -> list:
    """Arrow strings as UTF-8 bytes, null as b''."""
    import pyarrow as pa

    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    return [x or b"" for x in column.to_pylist()]


def small_batches(batches, column: int = 1, limit: int = 8 << 20):
    """Slices of record batches that hold about limit bytes of text, so that a worker's memory stays bounded."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, min(n, int(n * limit / max(limit, batch.column(column).nbytes))))
        for at in range(0, n, step):
            yield batch.slice(at, step)
