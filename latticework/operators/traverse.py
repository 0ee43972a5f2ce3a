"""Traversals over edge tables: distinct neighbours, edge rows, bounded reachability."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut, numbered


def neighbours(edges: DataFrame, reverse: bool = False, undirected: bool = False) -> DataFrame:
    """(s, n): each neighbour once, parallel edges collapsed."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    pairs = edges.select(F.col(a).alias("s"), F.col(b).alias("n"))
    if undirected:
        pairs = pairs.union(edges.select(F.col(b).alias("s"), F.col(a).alias("n")))
    return pairs.distinct()


def edge_rows(edges: DataFrame, reverse: bool = False, undirected: bool = False) -> DataFrame:
    """(s, n, all edge columns): a row per edge, a self-loop once in either orientation."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    out = edges.select(F.col(a).alias("s"), F.col(b).alias("n"), *edges.columns)
    if undirected:
        out = out.union(edges.where("src <> dst").select(F.col(b).alias("s"), F.col(a).alias("n"), *edges.columns))
    return out


#: nodes of a block, and how many times fewer rows blocks must make than single pairs to be used
BLOCK, GAIN = 1024, 8


def reach(sources: DataFrame, pairs: DataFrame, low: int, high: int, same_type: bool, many: int = 5_000_000) -> DataFrame:
    """(s, n), each once: what each source (column s) first reaches at a hop within [low, high].

    A source counts as visited from the start where both ends are of one type; a self-edge
    shows its own node again but never re-enters the frontier.  The pairs and the frontier of each hop but
    the last are written, so no hop is computed twice and the plan doesn't grow with the bound;
    where nothing new is reached, the walk ends.

    A hop that would join more than many rows goes on in blocks of nodes (see _blocks), if that makes far fewer rows: on
    dense links nearly all rows of the join meet in the same pairs.  Hops find disjoint pairs, and a self-edge of a
    node that was reached within the bounds shows nothing new, so only those of the first hop in bounds are added.
    """
    sources = sources.select("s").distinct()
    if not same_type:  # the next hop has nothing to start from
        return sources.join(pairs, "s").select("s", "n") if low == 1 else pairs.limit(0).select("s", "n")
    pairs = cut(pairs)
    links, loops = pairs.where("s <> n"), pairs.where("s = n").select(F.col("n").alias("self"))
    found, frontier, visited, walk = [], sources.withColumn("n", F.col("s")), None, None
    for hop in range(1, high + 1):
        if hop == low:
            found.append((walk.itself(loops) if walk else frontier.join(loops, F.col("n") == F.col("self"), "left_semi")).select("s", "n"))
        if hop == 1:  # each link is new
            new = links.join(sources, "s", "left_semi").select("s", "n")
            visited = frontier.union(new)
        else:
            if walk is None and hop > 1 and _joined(frontier, "n", links, "s") > many:
                walk = _blocks(frontier, visited, links)
            if walk is not None:
                walk.step(last=hop == high)
                new = walk.frontier
            else:
                step = frontier.select("s", F.col("n").alias("via")).join(links.select(F.col("s").alias("via"), "n"), "via").select("s", "n")
                new = step.distinct().join(visited, ["s", "n"], "left_anti")
                new = cut(new) if hop < high else new
                visited = visited.union(new)
        if hop >= low:
            found.append(walk.reached() if walk else new)
        if hop < high and new.isEmpty():
            break
        frontier = new
    return reduce(DataFrame.union, found) if found else pairs.limit(0)


def _joined(a: DataFrame, x: str, b: DataFrame, y: str) -> int:
    """How many rows a join of a and b on a.x = b.y has."""
    a, b = a.groupBy(F.col(x).alias("key")).agg(F.count("*").alias("p")), b.groupBy(F.col(y).alias("key")).agg(F.count("*").alias("q"))
    return a.join(b, "key").agg(F.sum(F.col("p") * F.col("q"))).first()[0] or 0


class Walk:
    """Hops in blocks: nodes have numbers, a block is BLOCK of them, and a set of nodes in one block is an array of places.

    ids: id, k.  links: node, block, ends: the ends of a node's links in a block.  frontier: node, block, starts: the
    sources in a block that last reached a node.  A hop joins these two on the node; all rows of a block of sources and a block of ends
    then meet in one bit matrix, from which what was visited is taken.
    """

    def __init__(self, ids: DataFrame, links: DataFrame, frontier: DataFrame, visited: DataFrame):
        self.ids, self.links, self.frontier, self.visited, self.new = ids, links, frontier, visited, None

    def step(self, last: bool) -> None:
        product = self.frontier.join(self.links.select("node", F.col("block").alias("J"), F.col("places").alias("b")), "node").select(F.col("block").alias("I"), "J", F.lit(False).alias("old"), F.col("places").alias("a"), "b")
        place = F.array(F.pmod("node", F.lit(BLOCK)).cast("short"))
        old = self.visited.select(F.expr(f"node div {BLOCK}").alias("I"), F.col("block").alias("J"), F.lit(True).alias("old"), place.alias("a"), F.col("places").alias("b"))
        both = product.union(old).repartition("I", "J").sortWithinPartitions("I", "J")
        self.new = cut(both.mapInArrow(_matrices(not last), "across boolean, node long, block long, places array<short>"))
        forward = self.new.where("not across").drop("across")
        self.frontier, self.visited = self.new.where("across").drop("across"), self.visited.union(forward)

    def reached(self) -> DataFrame:
        """(s, n) of the last hop.  Ids are looked up by source and by block of ends, before there is a row for each pair."""
        names = self.ids.groupBy(F.expr(f"k div {BLOCK}").alias("block")).agg(F.sort_array(F.collect_list(F.struct("k", "id")))["id"].alias("names"))
        rows = self.new.where("not across").join(self.ids.select(F.col("k").alias("node"), F.col("id").alias("s")), "node").join(names, "block")
        return rows.select("s", F.explode(F.transform("places", lambda i: F.col("names")[i.cast("int")])).alias("n"))

    def itself(self, loops: DataFrame) -> DataFrame:
        """(s, n) for the nodes of the frontier that have a link to themselves (column self)."""
        own = self.ids.join(loops, F.col("id") == F.col("self")).select(F.col("k").alias("node"), F.col("id").alias("n"))
        rows = self.frontier.join(own, "node").select("n", "block", F.explode("places").alias("at")).select("n", (F.col("block") * BLOCK + F.col("at")).alias("k"))
        return rows.join(self.ids.select("k", F.col("id").alias("s")), "k").select("s", "n")


def _blocks(frontier: DataFrame, visited: DataFrame, links: DataFrame) -> Walk | None:
    """The walk so far in blocks; None if the next hop would not join far fewer rows that way."""
    ids = cut(numbered(links.select(F.explode(F.array("s", "n")).alias("id")).union(visited.select(F.col("s").alias("id"))).distinct(), "k", F.length("id"), F.col("id")))

    def grouped(df: DataFrame, node: str, other: str) -> DataFrame:
        of = lambda name: ids.select(F.col("id").alias(name), F.col("k").alias(f"{name}_k"))
        df = df.join(of(node), node).join(of(other), other)
        df = df.groupBy(F.col(f"{node}_k").alias("node"), F.expr(f"{other}_k div {BLOCK}").alias("block"))
        return cut(df.agg(F.collect_list(F.pmod(F.col(f"{other}_k"), F.lit(BLOCK)).cast("short")).alias("places")))

    ends, starts = grouped(links, "s", "n"), grouped(frontier, "n", "s")
    if _joined(starts, "node", ends, "node") * GAIN > _joined(frontier, "n", links, "s"):
        return None
    return Walk(ids, ends, starts, grouped(visited, "s", "n"))


def _matrices(both_ways: bool):
    """For rows I, J, old, a, b in order of I, J: the pairs a x b of rows that aren't old, less those of old rows; across: by ends instead of by sources."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        schema = pa.schema([("across", pa.bool_()), ("node", pa.int64()), ("block", pa.int64()), ("places", pa.list_(pa.int16()))])
        words = BLOCK // 64
        key, bits, old = None, None, None

        def lists(across: bool, block: int, other: int, m):
            rows = np.flatnonzero(m.any(axis=1))
            _, places = np.nonzero(m[rows])
            ends = np.concatenate([[0], np.cumsum(m[rows].sum(axis=1))]).astype(np.int32)
            places = pa.ListArray.from_arrays(pa.array(ends), pa.array(places.astype(np.int16)))
            n = len(rows)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, across)), pa.array(rows.astype(np.int64) + block * BLOCK), pa.array(np.full(n, other, dtype=np.int64)), places], schema=schema)

        def done():
            left = bits & ~old
            if left.any():
                m = np.unpackbits(left.view(np.uint8), axis=1, bitorder="little").astype(bool)
                yield lists(False, key[0], key[1], m)
                if both_ways:
                    yield lists(True, key[1], key[0], m.T)

        for batch in batches:
            i, j, gone = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("I", "J", "old"))
            (a, a_at), (b, b_at) = ((c.values.to_numpy(), c.offsets.to_numpy()) for c in (batch.column("a"), batch.column("b")))
            for r in range(batch.num_rows):
                if (i[r], j[r]) != key:
                    if key is not None:
                        yield from done()
                    key, bits, old = (int(i[r]), int(j[r])), np.zeros((BLOCK, words), np.uint64), np.zeros((BLOCK, words), np.uint64)
                row = np.zeros(BLOCK, bool)
                row[b[b_at[r] : b_at[r + 1]]] = True
                (old if gone[r] else bits)[a[a_at[r] : a_at[r + 1]]] |= np.packbits(row, bitorder="little").view(np.uint64)
        if key is not None:
            yield from done()

    return run
