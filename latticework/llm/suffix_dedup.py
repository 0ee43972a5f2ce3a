"""Suffix-array dedup: column-wise construction over anchor-aligned passages.

Every byte covered by a string of `length` bytes that also starts elsewhere (in the same
document or another; overlaps count) is found, exactly.

1. Anchors.  In each window of `length` bytes the leftmost 32-byte gram of least hash is
   the window's anchor: equal windows have equal anchors at equal offsets.  A document is
   so cut into strings, one per anchor, which hold all windows that choose it.
2. Strings equal as wholes are counted by a 128-bit hash of their bytes: all their windows
   repeat.  Anchors that occur with one content only need nothing further.
3. The rest is a collection of short strings aligned at their anchors.  Column by column,
   from right to left, each round inserts one symbol per string and updates the order of
   the suffixes (a collection Burrows-Wheeler transform kept per column, as only suffixes
   of one column can be equal windows) and their common prefixes, reading the arrays of
   the column before once from end to end and writing those of the next.  A window
   repeats if its suffix shares `length` bytes with a neighbour in that order.

The arrays are bounded by the batch of strings at hand (batch_bytes), so they live in
memory: a cluster has no machine-local folder to put the files in.  Anchors with many
contents are cut into ranges of window starts, each of which is complete by itself; beyond
HEAVY contents the ranges would be single windows, which are counted by a 128-bit hash in a
plain aggregation, so that no group of strings grows without bound.

Beside the bytes, documents are marked that share a passage of `words` words (whatever blanks
part them) with another document, though it may be shorter than `length` bytes.  Their windows
have anchors of GRAM_WORDS words and take the same way: a string that two documents hold
settles both; for documents that are not settled so, the windows of their anchors are
compared one by one with those of the other strings there.

Defined cases: null and empty texts have no byte to remove; bytes of invalid strings don't
arise (texts are UTF-8); repeated rows (same doc_id and text) are each other's copies, as
are equal texts with other ids (a passage is repeated only by a row of another id or
text); null doc_ids stay; an empty table gives an empty result;
further columns pass.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, fresh, materialize, partitions, quoted, small_batches, text_bytes

LENGTH, GRAM, CROWD, HEAVY = 400, 32, 256, 8192
WORDS, GRAM_WORDS = 50, 8
ANCHORS = "key long, c1 long, c2 long, doc_id long, tag long, s0 int, s1 int, p int"


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM):
    """Arrays (key, first window start, last window start, anchor position); windows of one anchor are consecutive."""
    import numpy as np

    n = len(text) - gram + 1
    wide = length - gram + 1  # grams in a window
    if len(text) < length:
        return None
    w = np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))
    with np.errstate(over="ignore"):
        h = w[:n] * np.uint64(0x9E3779B97F4A7C15)
        for i in range(8, gram - 7, 8):
            h ^= h >> np.uint64(31)
            h += w[i : i + n]
            h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
    return _chosen(h, wide)


def _chosen(h, wide: int):
    """For grams with hashes h: the arrays of anchors(), if a window has `wide` grams and its anchor is the leftmost of least hash."""
    import numpy as np

    n = len(h)
    # hash above, position below: the least is the leftmost of the least hash
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    size = 1
    while 2 * size <= wide:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < wide:
        more = wide - size
        low = np.minimum(low[:-more], low[more:])
    p = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
    last = np.r_[first[1:] - 1, len(p) - 1]
    return h[p[first]].view(np.int64), first, last, p[first]


def _mixed_up(h):
    import numpy as np

    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def word_anchors(text: bytes, words: int = WORDS, gram: int = GRAM_WORDS):
    """(keys, first window starts, last window starts, anchors), counted in words, hashes of the strings, and a function that hashes the windows from a to b; None for fewer words."""
    import numpy as np
    import xxhash

    raw = np.frombuffer(text, np.uint8)
    blank = np.r_[True, (raw == 32) | ((raw >= 9) & (raw <= 13)), True]
    edge = np.diff(blank.view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(starts) < words:
        return None
    size = ends - starts
    load = np.ndarray((len(text),), "<u8", text + bytes(8), strides=(1,))
    masks = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
    with np.errstate(over="ignore"):
        h = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        live, k = np.flatnonzero(size <= 256), 0
        while len(live):
            h[live] = _mixed_up((h[live] ^ load[starts[live] + k] & masks[np.minimum(size[live] - k, 8)]) * np.uint64(0x94D049BB133111EB))
            k += 8
            live = live[size[live] > k]
        for i in np.flatnonzero(size > 256).tolist():
            h[i] = xxhash.xxh3_64_intdigest(text[starts[i] : ends[i]])
        n, c = len(h), 0xD1342543DE82EF95
        up = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, c, np.uint64)])
        down = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, pow(c, -1, 1 << 64), np.uint64)])
        sums = np.r_[np.uint64(0), np.cumsum(h * up[:n])]
        spell = lambda a, b: _mixed_up((sums[b] - sums[a]) * down[a])  # noqa: E731  of the words from a to b
        at = np.arange(n - gram + 1)
        got = _chosen(spell(at, at + gram), words - gram + 1)
        whole = _mixed_up(spell(got[1], got[2] + words) ^ (got[2] - got[1]).astype(np.uint64)).view(np.int64)

    def windows(a: int, b: int):
        at = np.arange(a, b)
        return spell(at, at + words).view(np.int64)

    return got, whole, windows


def _anchor_rows(length: int, words: int):
    """Anchors of bytes with even keys, anchors of words with odd ones."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch in small_batches(batches, limit=2 << 20):
            ids, tags = batch.column(0), batch.column(2).to_numpy(zero_copy_only=False)
            rows, keys, firsts, lasts, ps, content = [], [], [], [], [], []
            for i, text in enumerate(text_bytes(batch.column(1))):
                got = anchors(text, length)
                if got is not None:
                    view = memoryview(text)
                    digests = b"".join([xxhash.xxh3_128_digest(view[a : b + length]) for a, b in zip(got[1].tolist(), got[2].tolist(), strict=True)])
                    content.append(np.frombuffer(digests, "<i8").reshape(-1, 2))
                    rows.append(np.full(len(got[0]), i))
                    for x, y in zip((keys, firsts, lasts, ps), (got[0] & ~1, *got[1:]), strict=True):
                        x.append(y)
                more = word_anchors(text, words) if words else None
                if more is not None:
                    zero = np.zeros_like(more[1])
                    content.append(np.stack([more[1], zero], 1))
                    rows.append(np.full(len(zero), i))
                    for x, y in zip((keys, firsts, lasts, ps), (more[0][0] | 1, zero, zero, zero), strict=True):
                        x.append(y)
            if not rows:
                continue
            row = np.concatenate(rows)
            c = np.concatenate(content)
            cols = [pa.array(np.concatenate(keys)), pa.array(c[:, 0].copy()), pa.array(c[:, 1].copy()), ids.take(pa.array(row)), pa.array(tags[row])]
            cols += [pa.array(np.concatenate(x).astype(np.int32)) for x in (firsts, lasts, ps)]
            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in ANCHORS.split(", ")])

    return run


def repeated_windows(key, strings: list[bytes], at, first, last, length: int):
    """For each string the window starts, counted from its own first byte, whose `length` bytes also start in another string of its key.

    key: group numbers, ascending.  at: the anchor's offset in each string; strings of a key are aligned there.
    first, last: the offsets of the first and last window start in each string.
    """
    import numpy as np

    m = len(strings)
    sizes = np.array([len(s) for s in strings])
    base = np.r_[0, np.cumsum(sizes)[:-1]]
    data = np.frombuffer(b"".join(strings), np.uint8)
    left, right = -at, sizes - at  # columns: [left, right) around the anchor at 0
    w0, w1 = first - at, last - at
    order = np.zeros(0, np.int64)  # active strings, by key and suffix
    lcp = np.zeros(0, np.int32)  # with the one before, 0 at the first of a key
    enter = np.argsort(-right, kind="stable")
    edge, out = 0, [[] for _ in range(m)]
    leaves = set((left - 1).tolist())
    for column in range(int(right.max()) - 1, int(left.min()) - 1, -1):
        if column in leaves and len(order):  # strings that began one column to the right end here
            keep = np.flatnonzero(left[order] <= column)
            if len(keep):
                lcp = np.minimum.reduceat(lcp[: keep[-1] + 1], np.r_[0, keep[:-1] + 1])
            else:
                lcp = lcp[:0]
            order = order[keep]
        new = edge
        while new < m and right[enter[new]] > column:
            new += 1
        if new > edge:  # empty suffixes come first in their key
            order = np.concatenate([enter[edge:new], order])
            lcp = np.concatenate([np.zeros(new - edge, np.int32), lcp])
            by = np.argsort(key[order], kind="stable")
            order, lcp = order[by], lcp[by]
            edge = new
        if not len(order):
            continue
        # one symbol for each string; stable, so suffixes with equal symbols keep their order
        sym = data[base[order] + at[order] + column].astype(np.int64)
        code = key[order] * 256 + sym
        if (code[1:] >= code[:-1]).all():
            same = np.r_[False, code[1:] == code[:-1]]
            lcp = np.where(same, lcp + 1, 0).astype(np.int32)
        else:
            by = np.argsort(code, kind="stable")
            sorted_ = code[by]
            same = np.flatnonzero(sorted_[1:] == sorted_[:-1]) + 1
            fresh_ = np.zeros(len(by), np.int32)
            if len(same):
                a, b = by[same - 1] + 1, by[same] + 1
                near = b - a == 1
                fresh_[same[near]] = lcp[a[near]] + 1
                far = ~near
                if far.any():
                    padded = np.r_[lcp, np.int32(0)]
                    pairs = np.stack([a[far], b[far]], 1).ravel()
                    fresh_[same[far]] = np.minimum.reduceat(padded, pairs)[::2] + 1
            order, lcp = order[by], fresh_
        here = np.maximum(lcp, np.r_[lcp[1:], np.int32(0)]) >= length
        if here.any():
            for i in order[here & (w0[order] <= column) & (column <= w1[order])].tolist():
                out[i].append(column + int(at[i]))
    return [x[::-1] for x in out]


STRINGS = "key long, part int, doc_id long, tag long, start int, at int, first int, last int, n long, bytes binary"


WINDOWS = "h1 long, h2 long, doc_id long, tag long, s int, n long"


def _windows(length: int, heavy: int):
    """The windows of heavy anchors, one by one: hash, place, and how many documents have their string."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        for batch in small_batches(batches, column=2, limit=1 << 18):
            digests, rows = [], []
            for doc_id, tag, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                view = memoryview(text)
                for x in wanted:
                    if x["m"] > heavy:
                        some = range(x["s0"], x["s1"] + 1)
                        digests += [xxhash.xxh3_128_digest(view[a : a + length]) for a in some]
                        rows += [(doc_id, tag, a, x["n"]) for a in some]
            if rows:
                h = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                cols = [pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)]]
                yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in WINDOWS.split(", ")])

    return run


def _word_windows(words: int):
    """Hashes of the windows of the anchors of words that are asked for."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in small_batches(batches, column=2, limit=1 << 20):
            rows, hashes = [], []
            for i, (text, keys) in enumerate(zip(text_bytes(batch.column(2)), batch.column(3).to_pylist(), strict=True)):
                (found, first, last, _), _, windows = word_anchors(text, words)
                for k in np.flatnonzero(np.isin(found | 1, np.array(keys, np.int64))).tolist():
                    hashes.append(windows(first[k], last[k] + 1))
                    rows.append(np.full(len(hashes[-1]), i))
            if rows:
                row = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes)), batch.column(0).take(row), batch.column(1).take(row)], names=["h", "doc_id", "tag"])

    return run


def _cut(length: int, crowd: int, heavy: int):
    """The strings of one document, cut from its text; those of crowded anchors in ranges of window starts."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [c.split()[0] for c in STRINGS.split(", ")]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
        for batch in small_batches(batches, column=2, limit=1 << 20):
            rows = []
            for doc_id, tag, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                for x in wanted:
                    if x["m"] > heavy:
                        continue
                    # window starts by their distance before the anchor, 0 to length - gram; `wide` of them in a part
                    wide = max(1, -(-length // max(1, -(-x["m"] // crowd)))) if x["m"] > crowd else length
                    far, near = x["p"] - x["s0"], x["p"] - x["s1"]
                    for part in range(near // wide, far // wide + 1):
                        a, b = x["p"] - min(far, part * wide + wide - 1), x["p"] - max(near, part * wide)
                        rows.append((x["key"], part, doc_id, tag, a, x["p"] - a, 0, b - a, x["n"], text[a : b + length]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return run


SPANS = "doc_id long, tag long, s int, e int"


def _columns(length: int, batch_bytes: int):
    """Streams strings sorted by key and part, in batches of whole groups; gives the spans that repeat."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def spans(groups):
            # equal strings of a group once: all windows of theirs repeat
            seen, out, rows = {}, [], []
            for g, group in enumerate(groups):
                for r in group:
                    seen.setdefault((g, r[7]), []).append(r)
            for (g, text), same in seen.items():
                r = same[0]
                if len(same) > 1 or r[6] > 1:
                    out += [(x[0], x[1], x[2] + x[4], x[2] + x[5] + length) for x in same]
                rows.append((g, r, text, len(same) > 1 or r[6] > 1))
            many = {}
            for g, *_ in rows:
                many[g] = many.get(g, 0) + 1
            rows = [x for x in rows if many[x[0]] > 1]
            if rows:
                rows.sort(key=lambda x: x[0])
                ints = lambda k: np.array([x[1][k] for x in rows], np.int64)
                got = repeated_windows(np.array([x[0] for x in rows], np.int64), [x[2] for x in rows], ints(3), ints(4), ints(5), length)
                for (_, r, _, done), starts in zip(rows, got, strict=True):
                    if starts and not done:
                        s = np.array(starts)
                        new = np.r_[True, np.diff(s) > length]
                        heads, tails = s[new], s[np.r_[new[1:], True]] + length
                        out += [(r[0], r[1], r[2] + int(a), r[2] + int(b)) for a, b in zip(heads, tails, strict=True)]
            if out:
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "tag", "s", "e"])
            return None

        groups, last, size = [], None, 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:2] != last:
                    if size >= batch_bytes:
                        got = spans(groups)
                        groups, size = [], 0
                        if got:
                            yield got
                    last = row[:2]
                    groups.append([])
                groups[-1].append(row[2:])
                size += len(row[-1])
        got = spans(groups)
        if got:
            yield got

    return run


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(text_col).alias("text"), F.xxhash64(quoted(text_col)).alias("tag"))


def _texts(own: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id, tag, text, wanted: the texts that a table (doc_id, tag, wanted) names.  The texts' shuffle is the same for all such tables."""
    wanted = wanted.select(F.col("doc_id").alias("w_id"), F.col("tag").alias("w_tag"), "wanted").hint("shuffle_hash")
    return own.join(wanted, own["doc_id"].eqNullSafe(F.col("w_id")) & (own["tag"] == F.col("w_tag"))).select("doc_id", "tag", "text", "wanted")


def _repeated(rows: DataFrame, name: str) -> DataFrame:
    """The rows whose anchor occurs twice at least, written: most occur once and need nothing further."""
    # written, so that both sides of the join are plain shuffles: adaptive execution then splits a key that many rows have
    twice = materialize(rows.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key"), f"{name}-keys")
    some = materialize(rows.join(twice, "key"), name)
    drop(twice)
    return some


def _byte_spans(own: DataFrame, some: DataFrame, length: int, crowd: int, heavy: int, batch_bytes: int) -> DataFrame:
    """doc_id, tag, s, e: intervals of bytes."""
    contents = materialize(some.groupBy("key", "c1", "c2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "tag", "s0", "s1", "p")).alias("r")), "contents")
    whole = some.join(contents.where("n > 1").select("key", "c1", "c2"), ["key", "c1", "c2"]).select("doc_id", "tag", F.col("s0").alias("s"), (F.col("s1") + length).alias("e"))
    mixed = contents.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    wanted = contents.join(mixed, "key").select("r.doc_id", "r.tag", F.struct("key", "r.s0", "r.s1", "r.p", "n", "m").alias("x"))
    wanted = materialize(wanted.groupBy("doc_id", "tag").agg(F.collect_list("x").alias("wanted")), "wanted")
    most = wanted.agg(F.max(F.array_max(F.transform("wanted", lambda x: x["m"])))).first()[0] or 0
    texts = _texts(own, wanted)
    strings = texts.mapInArrow(_cut(length, crowd, heavy), STRINGS)
    order = ["key", "part"]
    partial = strings.repartition(partitions(own.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(_columns(length, batch_bytes), SPANS)
    found = whole.unionByName(partial)
    if most > heavy:  # else the texts needn't be read once more
        windows = materialize(texts.where(F.exists("wanted", lambda x: x["m"] > heavy)).mapInArrow(_windows(length, heavy), WINDOWS), "windows")
        often = windows.groupBy("h1", "h2").agg(F.sum("n").alias("all")).where(F.col("all") > 1)
        found = found.unionByName(windows.join(often, ["h1", "h2"]).select("doc_id", "tag", "s", (F.col("s") + length).alias("e")))
    return found


def _sharers(own: DataFrame, some: DataFrame, words: int) -> DataFrame:
    """doc_id, tag, hits: the documents that share a passage with another, and by how many strings or windows that shows."""
    doc = F.xxhash64("doc_id", "tag")  # tells documents apart
    contents = some.groupBy("key", "c").agg(F.min(doc).alias("lo"), F.max(doc).alias("hi"), F.min(F.struct("doc_id", "tag")).alias("r"))
    contents = materialize(contents.withColumn("shared", F.col("lo") < F.col("hi")), "word-contents")
    settled = some.join(contents.where("shared").select("key", "c"), ["key", "c"]).groupBy("doc_id", "tag").agg(F.count("*").alias("hits"))
    settled = materialize(settled, "settled")
    # keys under which a document that is not settled stands with another; every string there shows one text
    open_ = contents.where("not shared").select("key", "r.doc_id", "r.tag").alias("o")
    open_ = open_.join(settled.alias("z"), F.expr("o.doc_id <=> z.doc_id and o.tag = z.tag"), "left_anti").select("key").distinct()
    wanted = contents.groupBy("key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("key").join(open_, "key")
    wanted = contents.join(wanted, "key").groupBy("r.doc_id", "r.tag").agg(F.collect_set("key").alias("wanted"))
    windows = materialize(_texts(own, wanted).mapInArrow(_word_windows(words), "h long, doc_id long, tag long"), "word-windows")
    for done in (some, contents):
        drop(done)
    often = windows.groupBy("h").agg(F.min(doc).alias("lo"), F.max(doc).alias("hi")).where("lo < hi").select("h")
    more = windows.join(often, "h").groupBy("doc_id", "tag").agg(F.count("*").alias("hits"))
    return settled.unionByName(more)


def repeated_spans(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD, heavy: int = HEAVY, batch_bytes: int = 4 << 20, words: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tag (xxhash64 of the text), spans, hits for every document with repeats.

    spans: intervals [s, e) that cover the repeated bytes; they may overlap.  hits: where words > 0, how many
    strings or windows show that the document shares a passage of so many words with another; null for none.
    """
    if length < GRAM + 8 or words and words < 2 * GRAM_WORDS:
        raise ValueError(f"length must be at least {GRAM + 8}, words 0 or at least {2 * GRAM_WORDS}")
    own = _own(docs, id_col, text_col)
    rows = materialize(own.mapInArrow(_anchor_rows(length, words), ANCHORS), "anchors")
    of_words = F.col("key").bitwiseAND(F.lit(1)) == 1
    in_bytes = _repeated(rows.where(~of_words), "repeated-anchors")
    in_words = _repeated(rows.where(of_words).select("key", F.col("c1").alias("c"), "doc_id", "tag"), "repeated-words") if words else None
    drop(rows)
    found = _byte_spans(own, in_bytes, length, crowd, heavy, batch_bytes).select("doc_id", "tag", F.struct("s", "e").alias("span"), F.lit(None).cast("long").alias("hits"))
    if words:
        found = found.unionByName(_sharers(own, in_words, words).select("doc_id", "tag", F.lit(None).cast("struct<s:int,e:int>").alias("span"), "hits"))
    return found.groupBy("doc_id", "tag").agg(F.collect_set("span").alias("spans"), F.sum("hits").alias("hits"))


def merged(spans) -> list[tuple[int, int]]:
    """Maximal intervals, ascending."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((x["s"], x["e"]) for x in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _with_spans(docs: DataFrame, id_col: str, text_col: str, how: dict) -> DataFrame:
    """docs' columns in their order, then the spans."""
    i, t, spans, i2, t2 = fresh(docs, "sd_id", "sd_tag", "sd_spans", "sd_id2", "sd_tag2")
    found = repeated_spans(docs, id_col=id_col, text_col=text_col, **how).select(F.col("doc_id").alias(i2), F.col("tag").alias(t2), F.col("spans").alias(spans)).hint("shuffle_hash")
    marked = docs.select(*[quoted(c) for c in docs.columns], quoted(id_col).cast("long").alias(i), F.xxhash64(quoted(text_col)).alias(t))
    return marked.join(found, F.col(i).eqNullSafe(F.col(i2)) & (F.col(t) == F.col(t2)), "left").select(*[quoted(c) for c in docs.columns], spans)


def _keep(text: bytes, gone: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in gone:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with a further column kept_bytes: the text's UTF-8 bytes without the repeated ones (a cut may fall inside a character); null for a null text."""
    (kept,) = fresh(docs, "kept_bytes")
    width, at = len(docs.columns), docs.columns.index(text_col)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in small_batches(batches, at):
            null = batch.column(at).is_null().to_pylist()
            rest = [None if z else _keep(t, merged(s)) for t, s, z in zip(text_bytes(batch.column(at)), batch.column(width).to_pylist(), null, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(rest, pa.binary())], names=[*batch.schema.names[:width], kept])

    from pyspark.sql.types import BinaryType, StructField, StructType

    return _with_spans(docs, id_col, text_col, how).mapInArrow(run, StructType([*docs.schema.fields, StructField(kept, BinaryType())]))


def repeat_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every document, and passage_hits: 0 unless it shares a passage of `words` words with another."""
    how.setdefault("words", WORDS)

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        for batch in small_batches(batches):
            rows = []
            for text, spans in zip(text_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                gone = merged(spans)
                rows.append((len(text), sum(b - a for a, b in gone), len(gone), hashlib.sha256(_keep(text, gone)).hexdigest()))
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols, batch.column(3)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "passage_hits"])

    # the same three columns by the same keys as in repeated_spans: Spark shuffles the texts once for all joins
    own = _own(docs, id_col, text_col)
    found = repeated_spans(docs, id_col=id_col, text_col=text_col, **how).select(F.col("doc_id").alias("w_id"), F.col("tag").alias("w_tag"), "spans", "hits").hint("shuffle_hash")
    both = own.join(found, own["doc_id"].eqNullSafe(F.col("w_id")) & (own["tag"] == F.col("w_tag")), "left").select(own["doc_id"], "text", "spans", F.coalesce("hits", F.lit(0)).alias("hits"))
    return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, passage_hits long")
