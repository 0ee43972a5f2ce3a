"""Pages over numbered rows: the same cuts as reading page after page, in a fixed number of passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _next(sizes, max_rows: int, max_bytes: int):
    """For each row as the first of a page, the first row behind that page."""
    import numpy as np

    total, at = np.concatenate([[0], np.cumsum(sizes)]), np.arange(len(sizes))
    full = np.searchsorted(total, total[:-1] + max_bytes, side="right") - 1  # the first row that doesn't fit any more
    return np.minimum(np.maximum(full, at + 1), at + max_rows).clip(max=len(sizes))


def paged(rows: DataFrame, n: str, size: str, max_rows: int, max_bytes: int, block: int | None = None) -> DataFrame:
    """rows with page, from 0; n numbers them from 0 without gaps, size is what counts against max_bytes.

    A page ends at max_rows rows or before the row that would exceed max_bytes; it has one row at least.  Where no page
    can exceed max_bytes a page is a division.  Else rows are dealt in blocks: for each row that a page from the block
    before may leave as the first, a block says where its own last page ends and how many begin in it; the driver
    follows these steps from block to block, and the blocks then number their pages.
    """
    most = rows.agg(F.max(size)).first()[0]
    if most is None or most * max_rows <= max_bytes:
        return rows.withColumn("page", F.expr(f"{n} div {max_rows}").cast("int"))
    block = max(block or max(1 << 16, 256 * max_rows), max_rows)
    own = rows.select(F.expr(f"{n} div {block}").alias("block"), F.col(n).cast("long").alias("n"), F.col(size).cast("long").alias("size"))
    halo = own.where(F.col("block") > 0).where(F.col("n") % block < max_rows).withColumn("block", F.col("block") - 1)
    both = own.union(halo)  # the rows on which the pages that begin in a block can end

    def steps(table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by("n")
        number, at = table["block"][0].as_py(), table["n"].to_numpy()
        m = int(np.searchsorted(at, (number + 1) * block))
        after = _next(table["size"].to_numpy(), max_rows, max_bytes).tolist()
        ends, many = [0] * m, [0] * m
        for k in range(m - 1, -1, -1):
            j = after[k]
            ends[k], many[k] = (j - m, 1) if j >= m else (ends[j], many[j] + 1)
        return pa.Table.from_pydict({"block": [number], "ends": [ends[:max_rows]], "many": [many[:max_rows]]}, pa.schema([("block", pa.int64()), ("ends", pa.list_(pa.int64())), ("many", pa.list_(pa.int64()))]))

    first, page, begins = 0, 0, []
    for r in both.groupBy("block").applyInArrow(steps, "block long, ends array<long>, many array<long>").orderBy("block").toLocalIterator():
        begins.append((r.block, first, page))
        if first < len(r.ends):
            first, page = r.ends[first], page + r.many[first]
    begin = rows.sparkSession.createDataFrame(begins, "block long, first long, page long")

    def label(table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by("n")
        number, first, page = (table[c][0].as_py() for c in ("block", "first", "page"))
        at = table["n"].to_numpy()
        m = int(np.searchsorted(at, (number + 1) * block))
        after, new = _next(table["size"].to_numpy(), max_rows, max_bytes), np.zeros(m, dtype=np.int64)
        k = first
        while k < m:
            new[k], k = 1, int(after[k])
        return pa.Table.from_arrays([pa.array(at[:m]), pa.array((page - 1 + np.cumsum(new)).astype(np.int32))], names=["_at", "page"])

    pages = both.join(begin, "block").groupBy("block").applyInArrow(label, "_at long, page int")
    return rows.join(pages, F.col(n) == F.col("_at")).drop("_at")
