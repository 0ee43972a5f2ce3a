"""Benchmark decontamination: pigeonhole pieces, exact piece hits, Myers verification.

Items and documents are sequences of words (runs of letters and digits, case folded).
An item of w words may differ from a passage in k = w // piece_words - 1 word edits
(at least 0); it is split into k + 1 pieces of piece_words words or more, one of which
then occurs unchanged in any passage within the budget.  Piece hits are found by a
rolling hash of piece_words words over the whole document and set a window; the
window's best edit distance comes from Myers' bit-parallel algorithm over words.

Items of at most block_bytes in all, which is checked first, travel to the tasks, and the
documents are read once and not shuffled.  More items than that stay a table: hashes of
pieces meet hashes of document windows in a join, the windows first thinned out by a
bitmap of fixed size, and the pairs found are brought to the document's text, sorted, so
that a task holds one document and one block of its items at a time.  Both ways search
with the same code and give the same rows; documents are read twice at most, however many
items there are.

Defined cases: null or empty texts and items without a word match nothing; items
shorter than a piece must occur whole; repeated documents or items give a row each;
null ids stay null; empty tables give an empty result; further columns pass.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, partitions, quoted, small_batches

PIECE_WORDS, BLOCK_BYTES, BITMAP_WORDS = 5, 8 << 20, 1 << 21
SCHEMA = "doc_id long, tag long, item_id long, distance int, first_word int, last_word int"


def words_of(text: str | None) -> list[str]:
    import re

    return re.findall(r"[^\W_]+", text.casefold()) if text else []


def budget(n_words: int, piece_words: int = PIECE_WORDS) -> int:
    return max(0, n_words // piece_words - 1)


def pieces(n_words: int, k: int) -> list[tuple[int, int]]:
    """k + 1 pieces as (from, to), sizes one apart at most."""
    cuts = [i * n_words // (k + 1) for i in range(k + 2)]
    return [*zip(cuts, cuts[1:], strict=False)]


def myers(pattern: list, text: list) -> tuple[int, int]:
    """Least edit distance of pattern to any infix of text, and the end of its first best infix."""
    m = len(pattern)
    peq: dict = {}
    for i, w in enumerate(pattern):
        peq[w] = peq.get(w, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score, best, end = mask, 0, m, m, 0
    for j, w in enumerate(text):
        eq = peq.get(w, 0)
        x = eq | vn
        d0 = ((((x & vp) + vp) ^ vp) | x) & mask
        hp, hn = vn | (~(d0 | vp) & mask), d0 & vp
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp, hn = hp << 1 & mask, hn << 1 & mask
        vp, vn = hn | (~(d0 | hp) & mask), hp & d0
        if score < best:
            best, end = score, j + 1
    return best, end


class Index:
    """The pieces of a block of items, by the hash of their first words."""

    def __init__(self, items: list[tuple], piece_words: int):
        import numpy as np

        self.items, by_width = [], {}
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            k = budget(len(words), piece_words)
            at = len(self.items)
            self.items.append((item_id, words, k))
            for a, b in pieces(len(words), k):
                by_width.setdefault(min(piece_words, b - a), []).append((at, a, b))
        self.by_width = {}
        for width, found in by_width.items():
            h = np.array([self.hashes(self.word_ids(self.items[i][1][a : a + width]), width)[0] for i, a, _ in found], np.uint64)
            order = np.argsort(h, kind="stable")
            seen = np.zeros(1 << 20, bool)
            seen[(h >> np.uint64(44)).astype(np.int64)] = True
            self.by_width[width] = (h[order], [found[i] for i in order], seen)

    @staticmethod
    def word_ids(words: list[str]):
        import numpy as np
        import xxhash

        h = xxhash.xxh3_64_intdigest
        return np.fromiter(map(h, words), np.uint64, len(words))

    @staticmethod
    def hashes(ids, width: int):
        import numpy as np

        n = len(ids) - width + 1
        out = np.zeros(max(n, 0), np.uint64)
        if n <= 0:
            return out
        for i in range(width):
            out = (out ^ ids[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out * np.uint64(0xBF58476D1CE4E5B9)

    def search(self, text: str | None) -> list[tuple]:
        """(item_id, distance, first word, last word) of every item within its budget, its best passage."""
        import numpy as np

        words = words_of(text)
        if not words:
            return []
        ids = self.word_ids(words)
        windows: dict[int, list] = {}
        for width, (h, found, seen) in self.by_width.items():
            mine = self.hashes(ids, width)
            hit = np.flatnonzero(seen[(mine >> np.uint64(44)).astype(np.int64)])
            if not len(hit):
                continue
            lo, hi = np.searchsorted(h, mine[hit], "left"), np.searchsorted(h, mine[hit], "right")
            for p, a, b in zip(hit[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                for i, start, end in found[a:b]:
                    _, item, k = self.items[i]
                    if words[p : p + end - start] == item[start:end]:
                        windows.setdefault(i, []).append((max(0, p - start - k), p - start + len(item) + k))
        out = []
        for i, spans in windows.items():
            item_id, item, k = self.items[i]
            best, merged = None, []
            for a, b in sorted(spans):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            for a, b in merged:
                d, end = myers(item, words[a:b])
                if d <= k and (best is None or d < best[0]):
                    start = end - myers(item[::-1], words[a : a + end][::-1])[1]
                    best = (d, a + start, a + end)
            if best:
                out.append((item_id, *best))
        return out


def _batch(rows: list[tuple], schema: str):
    """Rows as an Arrow batch of a schema of long and int columns."""
    import pyarrow as pa

    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    kinds = [pa.int64() if t == "long" else pa.int32() for t in types]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))


def _against_all(own: DataFrame, items: list[tuple], piece_words: int) -> DataFrame:
    """Every document against items that every task holds."""
    carried = own.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator) -> Iterator:
        index = Index(carried.value, piece_words)
        for batch in small_batches(batches):
            rows = []
            for doc_id, text, tag in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                rows += [(doc_id, tag, *r) for r in index.search(text)]
            if rows:
                yield _batch(rows, SCHEMA)

    return own.mapInArrow(run, SCHEMA)


def _piece_rows(piece_words: int):
    """h, width, k for the pieces of items (k, text)."""

    def run(batches: Iterator) -> Iterator:
        for batch in small_batches(batches):
            rows = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for width, (h, _, _) in Index([(k, text)], piece_words).by_width.items():
                    rows += [(x, width, k) for x in h.view("i8").tolist()]
            if rows:
                yield _batch(rows, "h long, width int, k long")

    return run


def _window_rows(widths: list[int], carried):
    """h, width, doc_id, tag for the windows of documents, each once a document, that the bitmap lets through."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        bitmap = np.frombuffer(carried.value, np.uint64)
        top = np.uint64(len(bitmap) - 1)
        for batch in small_batches(batches, limit=1 << 20):
            rows = []
            for doc_id, text, tag in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids = Index.word_ids(words_of(text))
                for width in widths:
                    h = np.unique(Index.hashes(ids, width))
                    h = h[(bitmap[(h >> np.uint64(6)) & top] >> (h & np.uint64(63))) & np.uint64(1) == 1]
                    rows += [(x, width, doc_id, tag) for x in h.view("i8").tolist()]
            if rows:
                yield _batch(rows, "h long, width int, doc_id long, tag long")

    return run


def _verify(piece_words: int, block_bytes: int):
    """Streams rows (doc_id, tag, text, k, item_id, item) sorted by document, its own rows (k null) before those of its items."""

    def run(batches: Iterator) -> Iterator:
        key, text, times, items, size = None, None, 0, [], 0

        def found() -> list[tuple]:
            got = Index(items, piece_words).search(text) if items else []
            return [(*key, *r) for r in got for _ in range(times)]

        for batch in batches:
            rows = []
            for doc_id, tag, own, k, item_id, item in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (doc_id, tag) != key or size >= block_bytes:
                    rows += found()
                    items, size = [], 0
                if (doc_id, tag) != key:
                    key, text, times = (doc_id, tag), None, 0
                if k is None:
                    text, times = own, times + 1
                else:
                    items.append((item_id, item))
                    size += len(item) + 64
            if rows:
                yield _batch(rows, SCHEMA)
        rows = found()
        if rows:
            yield _batch(rows, SCHEMA)

    return run


def _by_join(own: DataFrame, items: DataFrame, piece_words: int, block_bytes: int) -> DataFrame:
    """Documents against a table of items of any size."""
    spark = own.sparkSession
    items = materialize(items.withColumn("k", F.monotonically_increasing_id()), "items")
    pieces = materialize(items.select("k", "text").mapInArrow(_piece_rows(piece_words), "h long, width int, k long"), "pieces")
    # BITMAP_WORDS rows at most, whatever the number of pieces
    words = pieces.groupBy(F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(BITMAP_WORDS - 1)).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))").alias("bits")).toPandas()
    bitmap = bytearray(8 * BITMAP_WORDS)
    if len(words):
        import numpy as np

        np.frombuffer(bitmap, np.int64)[words["at"].to_numpy()] = words["bits"].to_numpy()
    widths = [w for (w,) in pieces.select("width").distinct().collect()]  # piece_words different ones at most
    own = own.where("text is not null")
    windows = own.mapInArrow(_window_rows(widths, spark.sparkContext.broadcast(bytes(bitmap))), "h long, width int, doc_id long, tag long")
    pairs = windows.join(pieces, ["h", "width"]).select("doc_id", "tag", "k").distinct()
    of_items = pairs.join(items, "k").select("doc_id", "tag", F.lit(None).cast("string").alias("own"), "k", "item_id", F.col("text").alias("item"))
    of_docs = own.select("doc_id", "tag", F.col("text").alias("own"), F.lit(None).cast("long").alias("k"), F.lit(None).cast("long").alias("item_id"), F.lit(None).cast("string").alias("item"))
    both = of_docs.unionByName(of_items).repartition(partitions(spark), "doc_id", "tag").sortWithinPartitions("doc_id", "tag", F.col("k").asc_nulls_first())
    return both.mapInArrow(_verify(piece_words, block_bytes), SCHEMA)


def contaminated(docs: DataFrame, benchmark: DataFrame, piece_words: int = PIECE_WORDS, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row per document and item found in it: doc_id, tag (xxhash64 of the text), item_id, distance in words, the passage's first and last word (end exclusive)."""
    own = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).alias("text"), F.xxhash64(quoted(text_col)).alias("tag"))
    items = benchmark.select(quoted(item_col).cast("long").alias("item_id"), quoted(item_text_col).alias("text")).where("text <> ''")
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    if size <= block_bytes:
        return _against_all(own, [tuple(r) for r in items.collect()], piece_words)
    return _by_join(own, items, piece_words, block_bytes)


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without those in which an item was found; all columns stay."""
    i, t, i2, t2 = fresh(docs, "dc_id", "dc_tag", "dc_id2", "dc_tag2")
    hit = contaminated(docs, benchmark, id_col=id_col, text_col=text_col, **how).select(F.col("doc_id").alias(i2), F.col("tag").alias(t2)).distinct().hint("shuffle_hash")
    marked = docs.select(*[quoted(c) for c in docs.columns], quoted(id_col).cast("long").alias(i), F.xxhash64(quoted(text_col)).alias(t))
    return marked.join(hit, F.col(i).eqNullSafe(F.col(i2)) & (F.col(t) == F.col(t2)), "left_anti").select(*[quoted(c) for c in docs.columns])
