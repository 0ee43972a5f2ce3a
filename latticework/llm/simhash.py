"""SimHash near-duplicates: segment-popcount embedding and a grid range-join.

A 64-bit fingerprint is mapped to the bit counts of its 32 two-bit segments.  The
Manhattan distance of two such vectors is a lower bound of the Hamming distance, so
fingerprints within three bits lie within Manhattan distance 3; of the two halves of
the vector one then differs by at most 1.  Each half is a grid whose cells are the
vectors themselves: a fingerprint enters its own cell and, as a visitor, the cells one
step up in a single coordinate.  Pairs that share a cell are verified exactly.

Copies are collapsed to one row per distinct fingerprint before anything is joined.  A
crowded cell is cut into blocks and only pairs of blocks meet in a task; a task emits a
spanning forest of the links it finds, never all pairs, so no link between components
is lost.  Components come from rounds of contraction over the distinct linked
fingerprints, each round a written table.

Defined cases: null and empty texts have fingerprint 0 and are linked like any other;
texts of fewer words than a shingle are one shingle; repeated rows stay as rows; null
doc_ids stay, and a component's id is its smallest non-null doc_id; an empty table
gives an empty result; further columns pass.

The corpus stage (one_of_similar) links texts whose sets of 5-word shingles have a Jaccard
similarity of at least 0.8.  It takes the same steps with fingerprints of these sets: embedding,
grid join, components; what a component holds is a bucket of candidates.  But 0.8 is about
ten differing bits of a fingerprint and up to twenty, more than parts of 64 bits can sort
out, so buckets of equal min-hash bands are added for the pairs that the grid cannot reach:
a pair of similarity s shares none of these with probability (1 - s^5)^32, 3 in a million
at 0.8, fewer above.  The verdict on all candidates is the exact similarity.  In each bucket
all texts first meet its least one; only buckets that then hold several components compare
all pairs, in blocks.  Shingles and texts are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, fresh, materialize, partitions, quoted, small_batches, text_bytes

SHINGLE, LINK_BITS, BLOCK = 3, 3, 2048
STAGE_SHINGLE, SIMILAR, BANDS, BAND_ROWS, SET_BLOCK = 5, 80, 32, 5, 256


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """Bits set in over half the XXH64 (seed 42) of the text's word shingles."""
    import numpy as np
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, 42)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[: 1 - width - 1]]] if width > 1 else [0, *[e + 1 for e in ends[:-1]]]
    hash_ = xxhash.xxh64_intdigest
    n = len(words) - width + 1
    return majority(np.fromiter((hash_(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :], strict=False)), dtype="<u8", count=n))


def majority(h) -> int:
    """Bits set in over half the 64-bit hashes."""
    import numpy as np

    counts = np.zeros(64, np.int64)
    for k in range(0, len(h), 16384):
        bits = np.unpackbits(h[k : k + 16384].view(np.uint8), bitorder="little").reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tag (xxhash64 of the text), fp: the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in small_batches(batches):
            fp = np.fromiter(map(fingerprint, text_bytes(batch.column(1))), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fp.view(np.int64))], names=["doc_id", "tag", "fp"])

    own = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).alias("text"), F.xxhash64(quoted(text_col)).alias("tag"))
    return own.mapInArrow(run, "doc_id long, tag long, fp long")


def _counts(half: Column) -> Column:
    """Bit counts of the 16 two-bit segments of 32 bits, two bits each."""
    return half - F.shiftright(half, 1).bitwiseAND(F.lit(0x55555555))


def grid(fps: DataFrame) -> DataFrame:
    """half, cell, fp, own: each distinct fingerprint in its own cell and as a visitor in the cells one step up."""
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    halves = fps.select("fp", F.explode(F.array(F.struct(F.lit(0).alias("half"), _counts(low).alias("cell")), F.struct(F.lit(1).alias("half"), _counts(high).alias("cell")))).alias("g"))
    halves = halves.select("fp", "g.half", "g.cell")
    full = lambda i: F.shiftright(F.col("cell"), 2 * i).bitwiseAND(F.lit(2)) == 2  # noqa: E731  a segment that is at two already
    up = [F.when(~full(i), F.col("cell") + F.lit(1 << (2 * i))) for i in range(16)]
    return halves.select("half", "fp", F.posexplode(F.array(F.col("cell"), *up)).alias("step", "cell")).where("cell is not null").select("half", "cell", "fp", (F.col("step") == 0).alias("own"))


def _links(bits: int):
    """Streams rows sorted by cell; for each cell a spanning forest of the links between its own and all its fingerprints."""

    def forest(np, own, all_):
        label = np.arange(len(all_))
        near = [np.flatnonzero(np.bitwise_count(all_ ^ x) <= bits) for x in own]  # all_ begins with own
        if all(len(x) == 1 for x in near):
            return None
        while True:
            new = label.copy()
            for i, x in enumerate(near):
                low = min(int(label[x].min()), int(new[x].min()))
                new[x] = low
                new[i] = low
            new = new[new]
            if (new == label).all():
                break
            label = new
        at = np.flatnonzero(label != np.arange(len(all_)))
        return all_[at], all_[label[at]]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        rest: list = []

        def cells(table):
            cols = [table.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
            half, cell, p, q, fp, own = cols
            fp = fp.view(np.uint64)
            new = np.r_[True, (half[1:] != half[:-1]) | (cell[1:] != cell[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])]
            starts = np.flatnonzero(new)
            ends = np.r_[starts[1:], len(half)]
            some = np.add.reduceat(own.astype(np.int64), starts)
            a, b = [], []
            for s, e in zip(starts[(ends - starts > 1) & (some > 0)], ends[(ends - starts > 1) & (some > 0)], strict=True):
                mine = own[s:e]
                got = forest(np, fp[s:e][mine], np.concatenate([fp[s:e][mine], fp[s:e][~mine]]))
                if got:
                    a.append(got[0])
                    b.append(got[1])
            if a:
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], names=["a", "b"])
            return None

        for batch in batches:
            if not batch.num_rows:
                continue
            key = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            differ = np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in key]))
            cut = int(differ[-1]) + 1 if len(differ) else 0
            last = tuple(k[0] for k in key)
            if rest and tuple(rest[0].column(i)[0].as_py() for i in range(4)) != last:
                got = cells(pa.Table.from_batches(rest).combine_chunks())
                rest = []
                if got:
                    yield got
            if cut:
                got = cells(pa.Table.from_batches([*rest, batch.slice(0, cut)]).combine_chunks())
                rest = []
                if got:
                    yield got
            rest.append(batch.slice(cut))
        if rest:
            got = cells(pa.Table.from_batches(rest).combine_chunks())
            if got:
                yield got

    return run


def links(fps: DataFrame, bits: int = LINK_BITS, block: int = BLOCK) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp), enough of them to join whatever is linked at all."""
    if not 0 <= bits <= 3:
        raise ValueError("the grid finds links of at most 3 bits")
    spark = fps.sparkSession
    rows = grid(fps)
    # cells with over `block` rows: at most rows / block of them; Spark broadcasts this table only if it is small
    crowded = rows.groupBy("half", "cell").count().where(F.col("count") > block).select("half", "cell", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    both = rows.join(crowded, ["half", "cell"], "left")
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = F.when(F.col("blocks").isNull(), F.array(F.struct(F.lit(0).alias("p"), F.lit(0).alias("q")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda c: F.struct(F.least(mine, c).alias("p"), F.greatest(mine, c).alias("q")))
    )
    dealt = both.select("half", "cell", F.explode(pairs).alias("d"), "fp", "own").select("half", "cell", "d.p", "d.q", "fp", "own")
    keys = ["half", "cell", "p", "q"]
    return dealt.repartition(partitions(spark), *keys).sortWithinPartitions(*keys).mapInArrow(_links(bits), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """v, root for every vertex of the edges (a, b): equal roots for connected vertices.

    Rounds of contraction: each vertex joins the neighbour (or itself) of least hash; hashes
    change by the round, so that even long chains shrink by a constant factor.  Each round's
    parents are a written table; the answer is read off them in reverse.
    """
    edges = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    parents: list[DataFrame] = []
    while edges.head(1):
        k = len(parents)
        rank = lambda c, k=k: F.struct(F.xxhash64(F.lit(k), c).alias("h"), c.alias("v"))
        both = edges.select("a", "b").union(edges.select("b", "a"))
        up = both.groupBy(F.col("a").alias("v")).agg(F.min(rank(F.col("b"))).alias("m"))
        up = materialize(up.select("v", F.least(rank(F.col("v")), F.col("m"))["v"].alias("parent")), "parents")
        parents.append(up)
        moved = edges.join(up.select(F.col("v").alias("a"), F.col("parent").alias("pa")), "a").join(up.select(F.col("v").alias("b"), F.col("parent").alias("pb")), "b")
        shorter = materialize(moved.where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        drop(edges)
        edges = shorter
    if not parents:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
    found = parents[-1].select("v", F.col("parent").alias("root"))
    for up in reversed(parents[:-1]):
        higher = found.select(F.col("v").alias("parent"), F.col("root"))
        found = up.join(higher, "parent", "left").select("v", F.coalesce("root", "parent").alias("root"))
    return found


def _classes(docs: DataFrame, bits: int, block: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The documents' fingerprints, and per distinct fingerprint its component's smallest doc_id and its root."""
    prints = materialize(fingerprints(docs, id_col, text_col), "prints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp"), bits, block))
    known = distinct.join(roots.withColumnRenamed("v", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    known = materialize(known, "roots")
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints, known.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, bits: int = LINK_BITS, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id for every row."""
    prints, known = _classes(docs, bits, block, id_col, text_col)
    return prints.join(known, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, bits: int = LINK_BITS, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near-duplicates: of each component the document with the smallest (doc_id, text hash) stays, once."""
    prints, known = _classes(docs, bits, block, id_col, text_col)
    return _one_row(docs, prints.join(known, "fp", "left"), id_col, text_col)


def _one_row(docs: DataFrame, both: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs that have the smallest (doc_id, tag) of a root in both (doc_id, tag, root), once."""
    first = both.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "tag")).alias("m"))
    i, t, i2, t2, r = fresh(docs, "sh_id", "sh_tag", "sh_id2", "sh_tag2", "sh_rank")
    stay = first.select(F.col("m.doc_id").alias(i2), F.col("m.tag").alias(t2)).hint("shuffle_hash")
    marked = docs.select(*[quoted(c) for c in docs.columns], quoted(id_col).cast("long").alias(i), F.xxhash64(quoted(text_col)).alias(t))
    kept = marked.join(stay, F.col(i).eqNullSafe(F.col(i2)) & (F.col(t) == F.col(t2)), "left_semi")
    # rows repeated whole: one of them
    return kept.dropDuplicates([i, t]).select(*[quoted(c) for c in docs.columns])


def shingles(text: bytes, width: int = STAGE_SHINGLE):
    """Sorted distinct XXH64 of the text's word shingles; a text of fewer words is one shingle."""
    import numpy as np
    import xxhash

    words = text.lower().split()
    n = max(1, len(words) - width + 1)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), 42) for i in range(n)), dtype="<u8", count=n))


def _prints(texts: DataFrame, width: int) -> DataFrame:
    """tag, fp (the fingerprint of the set of shingles), buckets (one a band) of each distinct text of texts (tag, text)."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        random = np.random.default_rng(42)
        by, plus = random.integers(0, 2**64, (2, BANDS * BAND_ROWS, 1), dtype=np.uint64)
        by |= np.uint64(1)

        def bands(h) -> list:
            least = np.min([(h[k : k + 4096] * by + plus).min(axis=1) for k in range(0, len(h), 4096)], axis=0)
            rows = least.reshape(BANDS, BAND_ROWS)
            return [xxhash.xxh64_intdigest(rows[b].tobytes(), b) for b in range(BANDS)]

        for batch in small_batches(batches):
            fps, found = [], []
            for text in text_bytes(batch.column(1)):
                h = shingles(text, width)
                fps.append(majority(h))
                found.append(bands(h))
            fps, found = (np.array(x, dtype=np.uint64).view(np.int64) for x in (fps, found))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, BANDS, dtype=np.int32)), pa.array(found.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), lists], names=["tag", "fp", "buckets"])

    return texts.mapInArrow(run, "tag long, fp long, buckets array<long>").dropDuplicates(["tag"])


def print_groups(prints: DataFrame, bits: int = LINK_BITS, block: int = BLOCK) -> DataFrame:
    """tag, bucket: each of prints (tag, fp) in the component of its fingerprint, as the grid join links them."""
    distinct = materialize(prints.select("fp").distinct(), "distinct")
    roots = components(links(distinct, bits, block)).withColumnRenamed("v", "fp")
    return prints.join(roots, "fp", "left").select("tag", F.xxhash64(F.lit("fp"), F.coalesce("root", "fp")).alias("bucket"))


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """tag, shingles (eight bytes each)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in small_batches(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t, width).tobytes() for t in text_bytes(batch.column(1))], pa.binary())], names=["tag", "shingles"])

    return texts.mapInArrow(run, "tag long, shingles binary")


def _similar(percent: int):
    """Streams rows (g, p, q, tag, root, own, shingles) sorted by g, p, q; for each group a forest of the links that own rows have, over the roots known."""

    def forest(tags, roots, own, sets) -> tuple[list, list]:
        import numpy as np

        label = np.unique(np.array(roots), return_inverse=True)[1]
        a, b = [], []
        if label.max() == 0:
            return a, b
        sets = [np.frombuffer(x, dtype="<u8") for x in sets]
        size = np.array([len(x) for x in sets])
        flat = np.concatenate(sets)
        holder = np.repeat(np.arange(len(sets)), size)
        order = np.argsort(flat, kind="stable")
        flat, holder = flat[order], holder[order]
        for i in np.flatnonzero(own):
            lo, hi = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
            n = hi - lo
            at = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            common = np.bincount(holder[at], minlength=len(sets))
            near = np.flatnonzero(((100 + percent) * common >= percent * (size[i] + size)) & (label != label[i]))
            for other, k in zip(*np.unique(label[near], return_index=True), strict=True):
                a.append(tags[i])
                b.append(tags[near[k]])
                label[label == other] = label[i]
        return a, b

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        key, rows = None, []

        def done():
            a, b = forest(*zip(*rows, strict=True)) if len(rows) > 1 else ([], [])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]) if a else None

        for batch in batches:
            columns = [batch.column(i) for i in range(7)]
            for at in range(0, batch.num_rows, 256):
                for g, p, q, *row in zip(*[c.slice(at, 256).to_pylist() for c in columns], strict=True):
                    if (g, p, q) != key:
                        if got := done():
                            yield got
                        key, rows = (g, p, q), []
                    rows.append(row)
        if got := done():
            yield got

    return run


def similar_links(docs: DataFrame, percent: int = SIMILAR, width: int = STAGE_SHINGLE, block: int = SET_BLOCK, text_col: str = "text") -> DataFrame:
    """v, root of the texts (tags) that have a text of at least that similarity: equal roots for linked ones."""
    spark = docs.sparkSession
    texts = docs.select(F.xxhash64(quoted(text_col)).alias("tag"), quoted(text_col).alias("text"))
    prints = materialize(_prints(texts, width), "prints")
    groups = materialize(print_groups(prints.select("tag", "fp")), "groups")
    rows = groups.union(prints.select("tag", F.explode("buckets").alias("bucket")))
    # buckets of the same texts are one
    shared = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("tag")).alias("who"), F.min("tag").alias("least")).where("n > 1")
    shared = shared.groupBy("n", "who").agg(F.min(F.struct("bucket", "least")).alias("b")).select("b.bucket", "b.least", "n")
    members = materialize(rows.join(shared, "bucket"), "members")
    drop(prints)
    drop(groups)
    some = members.select("tag").distinct()
    sets = materialize(_sets(texts.join(some, "tag", "left_semi").dropDuplicates(["tag"]), width), "sets")
    keys = ["g", "p", "q"]

    def compared(dealt: DataFrame) -> DataFrame:
        ready = dealt.join(sets, "tag").select(*keys, "tag", "root", "own", "shingles")
        return materialize(ready.repartition(partitions(spark), *keys).sortWithinPartitions(*keys).mapInArrow(_similar(percent), "a long, b long"), "similar")

    # each text against the least one of its buckets
    stars = members.where("tag <> least").select(F.col("least").alias("g"), "tag").distinct()
    blocks = stars.groupBy("g").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    spokes = stars.join(blocks, "g").select("g", F.pmod(F.xxhash64("tag"), F.col("blocks")).cast("int").alias("p"), "tag", F.lit(False).alias("own"))
    hubs = blocks.select("g", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("p"), F.col("g").alias("tag"), F.lit(True).alias("own"))
    first = compared(spokes.union(hubs).select("g", "p", F.lit(0).alias("q"), "tag", F.col("tag").alias("root"), "own"))
    roots = components(first)

    # the buckets that hold several components still, all pairs of them
    known = materialize(members.join(roots.withColumnRenamed("v", "tag"), "tag", "left").select("bucket", "tag", "n", F.coalesce("root", "tag").alias("root")), "known")
    open_ = known.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
    mine, blocks = F.pmod(F.xxhash64("tag"), F.col("blocks")).cast("int"), F.ceil(F.col("n") / block).cast("int")
    dealt = known.where("n > 2").join(open_, "bucket").withColumn("blocks", blocks).select("*", mine.alias("mine"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda c: F.struct(F.least("mine", c).alias("p"), F.greatest("mine", c).alias("q")))
    dealt = dealt.select(F.col("bucket").alias("g"), F.explode(pairs).alias("d"), "tag", "root").select("g", "d.p", "d.q", "tag", "root", F.lit(True).alias("own"))
    second = compared(dealt)
    return components(first.union(second)) if second.head(1) else roots


def one_of_similar(docs: DataFrame, percent: int = SIMILAR, width: int = STAGE_SHINGLE, block: int = SET_BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near copies: of texts linked by a similarity of percent or more the document with the smallest (doc_id, text hash) stays, once."""
    roots = similar_links(docs, percent, width, block, text_col).withColumnRenamed("v", "tag")
    prints = docs.select(quoted(id_col).cast("long").alias("doc_id"), F.xxhash64(quoted(text_col)).alias("tag"))
    return _one_row(docs, prints.join(roots, "tag", "left").select("doc_id", "tag", F.coalesce("root", "tag").alias("root")), id_col, text_col)
