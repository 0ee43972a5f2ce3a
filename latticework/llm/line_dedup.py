"""Line dedup: range-partitioned line hashes, secondary sort, compressed keep bitmaps.

Every line of every document becomes a row (128-bit key hash, document, position).
The rows are range-partitioned and sorted by hash, then document, then position, so
that a very frequent line is cut over several partitions like any other run.  Each
partition is streamed once: a run of one hash tells its first occurrence and its
number of documents.  Runs that touch a partition's edge are settled from a summary
of at most two rows per partition.  What comes back per document is a compressed
bitmap of the lines to keep; texts meet it only in the last, optional step.

Policies
    "frequent": a key found in at least min_docs documents loses all its lines.
    "first": only the first line of a key, by (document, position), stays.

Defined cases: a null or empty text is one empty line; an empty key (under
min_key_chars code points) is never dropped; rows with one doc_id count as one
document, null doc_ids as one too; repeated rows (same doc_id and text) get the same
bitmap; an empty table gives an empty result; further columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, partitions, quoted, small_batches, text_bytes

LINES = "h1 long, h2 long, doc_id long, tag long, pos int, n_lines int"
DECIDED, OPEN, EDGE = 0, 1, 2
DECISIONS = "kind int, h1 long, h2 long, doc_id long, tag long, pos int, n_lines int, part int, n long, first_doc long, last_doc long"


def line_key(line: bytes) -> bytes:
    return line.strip(b" \t\n\x0b\x0c\r").lower()


def _explode(min_chars: int):
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch in small_batches(batches):
            ids, tags = batch.column(0), batch.column(2).to_numpy(zero_copy_only=False)
            digests, row, pos, counts = [], [], [], []
            for i, text in enumerate(text_bytes(batch.column(1))):
                lines = text.split(b"\n")
                for j, line in enumerate(lines):
                    key = line_key(line)
                    if len(key) >= min_chars and (min_chars < 2 or len(key.decode("utf-8", "replace")) >= min_chars):
                        digests.append(xxhash.xxh3_128_digest(key))
                        row.append(i)
                        pos.append(j)
                        counts.append(len(lines))
            h = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            row = np.array(row, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])), ids.take(pa.array(row)), pa.array(tags[row]), pa.array(pos, pa.int32()), pa.array(counts, pa.int32())],
                names=["h1", "h2", "doc_id", "tag", "pos", "n_lines"],
            )

    return run


def _stream(policy: str, min_docs: int):
    """Streams one sorted partition; holds no more rows than one batch and the lines of min_docs documents."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        names = [c.split()[0] for c in DECISIONS.split(", ")]

        def rows(kind, cols):
            n = len(cols[0])
            blank = pa.nulls(n, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *cols, pa.array(np.full(n, part, np.int32)), blank, blank, blank], names=names)

        def docs_of(doc, null):
            # a change of document between neighbours; null is a document of its own
            return (doc[1:] != doc[:-1]) | (null[1:] != null[:-1])

        kept: list = []  # rows of the open run, as Arrow batches
        key, n_docs, last, first_run, first_doc = None, 0, None, True, None

        def close(final: bool):
            """The run has ended: settle its buffered rows; runs at an edge of the partition leave a summary."""
            nonlocal kept
            edge = first_run or final
            if kept and (edge or (policy == "frequent" and n_docs >= min_docs)):
                kind = OPEN if edge and not (policy == "frequent" and n_docs >= min_docs) else DECIDED
                for b in kept:
                    yield rows(kind, b.columns)
            kept = []
            if edge and key is not None:
                one = lambda x, t: pa.array([x], t)
                yield pa.RecordBatch.from_arrays(
                    [one(EDGE, pa.int32()), one(key[0], pa.int64()), one(key[1], pa.int64()), one(None, pa.int64()), one(None, pa.int64()), one(None, pa.int32()), one(None, pa.int32()), one(part, pa.int32()), one(n_docs, pa.int64()), one(first_doc, pa.int64()), one(last, pa.int64())],
                    names=names,
                )

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            h1, h2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            ids = batch.column(2)
            null = ids.is_null().to_numpy(zero_copy_only=False)
            doc = ids.fill_null(0).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
            ends = np.r_[starts[1:], n]
            changed = np.r_[True, docs_of(doc, null)]
            changed[starts] = True
            per_run = np.add.reduceat(changed.astype(np.int64), starts)
            # runs wholly inside the batch, neither first of the partition nor last of the batch: all at once
            inner = np.ones(len(starts), bool)
            inner[-1] = False
            if key is None or (h1[0], h2[0]) == key:
                inner[0] = False
            if key is None:
                first_run = True
            if policy == "frequent":
                gone = np.repeat(inner & (per_run >= min_docs), ends - starts)
            else:
                gone = np.repeat(inner, ends - starts)
                gone[starts[inner]] = False
            for r in ([0] if not inner[0] else []) + ([len(starts) - 1] if len(starts) > 1 else []):
                a, b = int(starts[r]), int(ends[r])
                k = (int(h1[a]), int(h2[a]))
                d0, d1 = (None if null[a] else int(doc[a])), (None if null[b - 1] else int(doc[b - 1]))
                if k == key:
                    n_docs += int(per_run[r]) - (d0 == last)
                    last = d1
                else:
                    if key is not None:
                        yield from close(False)
                        first_run = False
                    key, n_docs, last, first_doc = k, int(per_run[r]), d1, d0
                    if policy == "first":  # the run's first row may be the key's first; the others can't be
                        kept = [batch.slice(a, 1)]
                        a += 1
                if policy == "first":
                    if b > a:
                        yield rows(DECIDED, batch.slice(a, b - a).columns)
                elif n_docs >= min_docs:
                    for x in [*kept, batch.slice(a, b - a)]:
                        yield rows(DECIDED, x.columns)
                    kept = []
                else:
                    kept.append(batch.slice(a, b - a))
            if gone.any():
                yield rows(DECIDED, batch.filter(pa.array(gone)).columns)
        yield from close(True)

    return run


def _bitmaps():
    def run(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            maps, dropped = [], []
            for n, gone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                keep = np.ones(n, np.uint8)
                keep[gone] = 0
                maps.append(zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 6))
                dropped.append(n - int(keep.sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(dropped, pa.int32()), pa.array(maps, pa.binary())], names=["doc_id", "tag", "n_lines", "n_dropped", "keep"])

    return run


def keep_lines(bitmap: bytes | None, n: int) -> list[bool]:
    """The keep flags of a document's n lines; without a bitmap all stay."""
    import zlib

    import numpy as np

    if bitmap is None:
        return [True] * n
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little", count=n).astype(bool).tolist()


def line_bitmaps(docs: DataFrame, policy: str = "frequent", min_docs: int = 10, min_key_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tag (xxhash64 of the text), n_lines, n_dropped, keep: documents that lose lines, with bitmaps of the lines to keep."""
    if policy not in ("frequent", "first"):
        raise ValueError(f"unknown policy {policy!r}")
    spark = docs.sparkSession
    order = ["h1", "h2", "doc_id", "tag", "pos"]
    texts = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).alias("text"), F.xxhash64(quoted(text_col)).alias("tag"))
    lines = materialize(texts.mapInArrow(_explode(min_key_chars), LINES), "lines")
    found = materialize(lines.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(_stream(policy, min_docs), DECISIONS), "line-decisions")
    # at most two rows per partition: bounded by the number of partitions, not by the data
    edges = found.where(f"kind = {EDGE}")
    w = Window.partitionBy("h1", "h2").orderBy("part")
    straddles = F.lag("part").over(w).isNotNull() & F.col("first_doc").eqNullSafe(F.lag("last_doc").over(w))
    keys = edges.withColumn("n", F.col("n") - straddles.cast("long")).groupBy("h1", "h2").agg(F.sum("n").alias("total"), F.min("part").alias("origin"))
    settled = found.where(f"kind = {OPEN}").drop("n").join(F.broadcast(keys), ["h1", "h2"])
    settled = settled.where(F.col("total") >= min_docs) if policy == "frequent" else settled.where("part > origin")
    gone = found.where(f"kind = {DECIDED}").select("doc_id", "tag", "n_lines", "pos").unionByName(settled.select("doc_id", "tag", "n_lines", "pos"))
    return gone.groupBy("doc_id", "tag", "n_lines").agg(F.collect_set("pos").alias("gone")).mapInArrow(_bitmaps(), "doc_id long, tag long, n_lines int, n_dropped int, keep binary")


def _apply(width: int, text_at: int, digest: bool):
    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        for batch in small_batches(batches, text_at):
            kept, n_lines, n_dropped = [], [], []
            for text, bitmap, null in zip(text_bytes(batch.column(text_at)), batch.column(width).to_pylist(), batch.column(text_at).is_null().to_pylist(), strict=True):
                lines = text.split(b"\n")
                flags = keep_lines(bitmap, len(lines))
                rest = text if bitmap is None else b"\n".join(x for x, k in zip(lines, flags, strict=True) if k)
                kept.append(hashlib.sha256(rest).hexdigest() if digest else None if null else rest.decode())
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - sum(flags))
            if digest:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept)], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])
            else:
                cols = list(batch.columns[:width])
                cols[text_at] = pa.array(kept, pa.string())
                yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names[:width])

    return run


def _joined(docs: DataFrame, bitmaps: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs' columns in their order, then the bitmap; the small side is hashed, texts are not sorted."""
    k1, k2, keep, b1, b2 = fresh(docs, "ld_id", "ld_tag", "ld_keep", "ld_b_id", "ld_b_tag")
    marked = docs.select(*[quoted(c) for c in docs.columns], quoted(id_col).cast("long").alias(k1), F.xxhash64(quoted(text_col)).alias(k2))
    b = bitmaps.select(F.col("doc_id").alias(b1), F.col("tag").alias(b2), F.col("keep").alias(keep)).hint("shuffle_hash")
    both = marked.join(b, F.col(k1).eqNullSafe(F.col(b1)) & (F.col(k2) == F.col(b2)), "left")
    return both.select(*[quoted(c) for c in docs.columns], keep)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with the dropped lines taken out of the text; all other columns and all rows stay."""
    both = _joined(docs, line_bitmaps(docs, id_col=id_col, text_col=text_col, **how), id_col, text_col)
    return both.mapInArrow(_apply(len(docs.columns), docs.columns.index(text_col), False), docs.schema)


def line_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for every document."""
    own = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).alias("text"))
    return _joined(own, line_bitmaps(own, **how), "doc_id", "text").mapInArrow(_apply(2, 1, True), "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
