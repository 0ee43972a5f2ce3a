"""Sharding along a Hilbert curve: metadata quantised, ordered by curve index, cut into runs.

Several metadata dimensions (host, language, size, id) are cut into equal-depth levels (strings
by their whole value), a
document's levels are turned into its index on a Hilbert curve, and the order of (index, id,
size, checksum) is cut into runs of equal counts, so that a shard spans a small box in every
dimension and readers skip files by their minima and maxima.  DataFrame functions only.

Dense ranks need no single task: rows are range-partitioned and sorted, written once with
their place inside the partition, and a table with one row per partition adds the offsets.

Defined cases: null or empty texts have size 1 and checksum 0; nulls in a dimension come
first; equal rows are put side by side in any order; an empty table gives an empty result;
the operator needs and returns the id, further columns don't matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions, quoted

BITS = 5


def curve_tables(n: int) -> tuple[list[int], list[int]]:
    """For state * 2**n + corner: the digit on the n-dimensional Hilbert curve, and the next state (entry * n + direction)."""
    size = 1 << n
    mask = size - 1
    rotl = lambda x, k: (x << k % n | x >> (n - k % n)) & mask
    rotr = lambda x, k: rotl(x, n - k % n)

    def ungray(g: int) -> int:
        out = 0
        while g:
            out ^= g
            g >>= 1
        return out

    gray = lambda i: i ^ i >> 1
    ones = lambda i: (~i & (i + 1)).bit_length() - 1  # noqa: E731  trailing ones
    entry = lambda i: 0 if i == 0 else gray(2 * ((i - 1) // 2))
    turn = lambda i: 0 if i == 0 else ones(i - 1) % n if i % 2 == 0 else ones(i) % n
    digit, after = [], []
    for e in range(size):
        for d in range(n):
            for corner in range(size):
                w = ungray(rotr(corner ^ e, d + 1))
                digit.append(w)
                after.append((e ^ rotl(entry(w), d + 1)) * n + (d + turn(w) + 1) % n)
    return digit, after


def hilbert_index(levels: list[Column], bits: int = BITS) -> Column:
    """Index on the Hilbert curve of coordinates of `bits` bits each."""
    n = len(levels)
    digit, after = curve_tables(n)
    table = lambda t: F.expr(f"array({', '.join(map(str, t))})")  # noqa: E731  one call, folded to a literal
    coords = F.array(*[x.cast("int") for x in levels])

    def step(acc: Column, q: Column) -> Column:
        corner = reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(F.expr("0") + F.call_function("getbit", F.get(coords, F.lit(k)), q).cast("int"), k) for k in range(n)])
        at = acc["s"] * (1 << n) + corner
        return F.struct(F.get(table(after), at).alias("s"), (F.shiftleft(acc["h"], n) + F.get(table(digit), at)).alias("h"))

    return F.aggregate(F.array(*[F.lit(q) for q in range(bits - 1, -1, -1)]), F.struct(F.lit(0).alias("s"), F.lit(0).cast("long").alias("h")), step, lambda a: a["h"])


def string_cuts(values: DataFrame, levels: int) -> dict[int, list[str]]:
    """For rows (dim, value), nulls left out: the least value of every level of equal depth but the first, by dimension.

    Whole strings are compared.  Counts per distinct value are pre-aggregated, sorted by range and summed up along
    that order, so no task holds a dimension; what returns has at most `levels` rows a dimension.
    """
    spark = values.sparkSession
    counts = values.where("value is not null").groupBy("dim", "value").count()
    ranged = counts.repartitionByRange(partitions(spark), "dim", "value").sortWithinPartitions("dim", "value")
    ranged = materialize(ranged.withColumn("part", F.spark_partition_id()), "level-values")
    running = ranged.withColumn("inside", F.sum("count").over(Window.partitionBy("part", "dim").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)))
    sums = ranged.groupBy("dim", "part").agg(F.sum("count").alias("n"))  # at most one row per partition and dimension
    by_dim = Window.partitionBy("dim")
    sums = sums.select("dim", "part", (F.sum("n").over(by_dim.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(by_dim).alias("total"))
    level = F.expr(f"(coalesce(inside, 0) + before) * {levels} div total")
    firsts = running.join(F.broadcast(sums), ["dim", "part"]).groupBy("dim", level.alias("level")).agg(F.min("value").alias("least")).collect()
    out: dict[int, list[str]] = {}
    for r in sorted(firsts, key=lambda r: (r.dim, r.level)):
        out.setdefault(r.dim, []).append(r.least)
    return {d: v[1:] for d, v in out.items()}


def hilbert_shards(docs: DataFrame, n_shards: int = 8, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text", strings: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """doc_id, size, text_crc32, hilbert, shard, slot: shards of the curve whose counts are at most one apart, slots from 0 in each."""
    spark = docs.sparkSession
    text = F.encode(F.coalesce(quoted(text_col), F.lit("")), "UTF-8")
    meta = docs.select(quoted(id_col).cast("long").alias("doc_id"), (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *[quoted(s).cast("string").alias(f"d{k}") for k, s in enumerate(strings)])
    meta = materialize(meta, "shard-meta")
    dims = ["size", "doc_id"]
    named = string_cuts(meta.select(F.explode(F.array(*[F.struct(F.lit(k).alias("dim"), F.col(f"d{k}").alias("value")) for k in range(len(strings))])).alias("x")).select("x.*"), 1 << bits) if strings else {}
    # 2**bits - 1 boundaries a dimension: bounded, from a sketch that is pre-aggregated
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    cuts = meta.agg(F.count("*").alias("rows"), *[F.percentile_approx(d, shares, 2000).alias(d) for d in dims]).first()
    level = lambda d: F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in sorted(set(cuts[d] or [0]))]), lambda x: x < F.coalesce(F.col(d), F.lit(-(2**62)))))
    # how many levels start at or before the string; one level holds equal strings, so a hot one is never divided
    string_level = lambda k: F.coalesce(F.size(F.filter(F.array(*map(F.lit, named[k])), lambda x: x <= F.col(f"d{k}"))), F.lit(0)) if named.get(k) else F.lit(0)
    levels = [*[F.when(F.col(f"d{k}").isNull(), 0).otherwise(string_level(k)) for k in range(len(strings))], *map(level, dims)]
    placed = meta.select("doc_id", "size", "text_crc32", hilbert_index(levels, bits).alias("hilbert"))
    order = ["hilbert", "doc_id", "size", "text_crc32"]
    ranged = placed.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    ranged = materialize(ranged.withColumn("at", F.monotonically_increasing_id()), "shard-order")
    part, inside = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    # one row per partition, whatever the number of documents
    offsets = ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    offsets = offsets.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    n = max(cuts["rows"], 1)
    ranked = ranged.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("rank", F.col("before") + inside)
    shard, first = F.expr(f"rank * {n_shards} div {n}"), F.expr(f"(shard * {n}L + {n_shards - 1}) div {n_shards}")
    return ranked.withColumn("shard", shard.cast("int")).select("doc_id", "size", "text_crc32", "hilbert", "shard", (F.col("rank") - first).cast("long").alias("slot"))
