"""Quality rules: text statistics, and lines that too many documents of a host share.

Everything is DataFrame functions.  Per document: words, characters in words, symbols,
repeated lines, words inside repeated 5-word windows.  Across documents: each line is
normalised (trimmed, blanks squeezed, lower case) and hashed; per host the documents that
hold it are counted, and lines in more than `line_limit` documents are removed.  A document
left with less than `keep_percent` of its words is depleted and rejected.

A text is read and its lines are hashed once: statistics and line hashes are written to a
table without texts, from which lines are counted and verdicts are drawn.

Hot lines and hosts: counts are pre-aggregated before every shuffle, and the join of lines
with the few lines above the limit is a plain equi-join that adaptive execution splits.

Defined cases: a null or empty text has no word, so it fails the base; a null host is a host
of its own; rows with equal (doc_id, text) are one document and get the same verdict, and
documents with other ids count each, copies included; lines without a word are never
counted or removed; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let, materialize, quoted

BLANKS = "[\\x20\\x09-\\x0D]+"
LINE_LIMIT, KEEP_PERCENT = 10, 30


def words(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def _repeated_words(w: Column) -> Column:
    """How many words lie in a 5-word window that occurs twice or more, first occurrences included."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)]))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(5), F.coalesce(F.get(p, i + 1) - x, F.lit(5)))), F.lit(0), lambda a, b: a + b)

    def of_sorted(s: Column) -> Column:
        twin = lambda x, i, d: F.coalesce(F.get(s, i + d)["h"] == x["h"], F.lit(False))
        return let(F.sort_array(F.transform(F.filter(s, lambda x, i: twin(x, i, -1) | twin(x, i, 1)), lambda x: x["p"])), covered)

    def of_hashes(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))), of_sorted))

    return F.when(F.size(w) < 6, 0).otherwise(let(hashes, of_hashes))


def statistics(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeated_words(w).cast("long").alias("n_repeat_words"),
        )

    return let(words(text), of_words)


def _profiles(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """A written table: doc_id, tag (xxhash64 of the text), host, s (the statistics), lines: 128-bit hash, position and words of every line with a word."""
    text = F.coalesce(quoted(text_col), F.lit(""))

    def norm(x: Column) -> Column:
        return F.lower(F.trim(F.regexp_replace(x, BLANKS, " ")))

    def line(x: Column, i: Column) -> Column:
        return F.struct(F.when(x != "", F.unhex(F.md5(x))).alias("line"), i.alias("pos"), F.size(F.split(x, " ")).alias("n"))

    lines = F.filter(F.transform(F.transform(F.split(text, "\n", -1), norm), line), lambda x: x["line"].isNotNull())
    own = docs.select(quoted(id_col).cast("long").alias("doc_id"), F.xxhash64(quoted(text_col)).alias("tag"), quoted(host_col).cast("string").alias("host"), statistics(text).alias("s"), lines.alias("lines"))
    return materialize(own, "line-profiles")


def _removed(profiles: DataFrame, line_limit: int) -> DataFrame:
    """doc_id, tag, gone: positions and words of the lines of each document that too many documents of its host hold."""
    held = profiles.select("doc_id", "tag", "host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
    # a repeated row is no further document
    counts = held.groupBy("host", "line", "doc_id", "tag").agg(F.lit(1).alias("one")).groupBy("host", "line").agg(F.count("*").alias("docs"))
    above = counts.where(F.col("docs") > line_limit).select(F.col("host").alias("a_host"), F.col("line").alias("a_line"))
    lines = profiles.select("doc_id", "tag", "host", F.explode("lines").alias("l")).select("doc_id", "tag", "host", "l.*")
    return lines.join(above, lines["host"].eqNullSafe(F.col("a_host")) & (lines["line"] == F.col("a_line"))).groupBy("doc_id", "tag").agg(F.collect_set(F.struct("pos", "n")).alias("gone"))


def _verdicts(docs: DataFrame, line_limit: int, keep_percent: int, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """doc_id, tag, the statistics, n_removed_lines, n_removed_words, base_failed, kept, removed_at (positions of removed lines, null for none) for every row."""
    profiles = _profiles(docs, id_col, text_col, host_col)
    gone = _removed(profiles, line_limit).select(F.col("doc_id").alias("g_id"), F.col("tag").alias("g_tag"), "gone")
    stats = profiles.select("doc_id", "tag", "s.*")
    both = stats.join(gone, stats["doc_id"].eqNullSafe(F.col("g_id")) & (stats["tag"] == F.col("g_tag")), "left")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    removed = F.coalesce(F.aggregate("gone", F.lit(0).cast("long"), lambda a, x: a + x["n"]), F.lit(0)).cast("long")
    both = both.select("*", removed.alias("n_removed_words"), F.coalesce(F.when(F.col("gone").isNotNull(), F.size("gone")), F.lit(0)).cast("long").alias("n_removed_lines"))
    return both.select(
        "doc_id", "tag", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_lines", "n_removed_words",
        failed.alias("base_failed"), (~failed & (100 * (F.col("n_words") - F.col("n_removed_words")) >= keep_percent * F.col("n_words"))).alias("kept"),
        F.transform("gone", lambda x: x["pos"]).alias("removed_at"),
    )


def judge(docs: DataFrame, line_limit: int = LINE_LIMIT, keep_percent: int = KEEP_PERCENT, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, tag, the statistics, n_removed_lines, n_removed_words, base_failed, kept for every row."""
    return _verdicts(docs, line_limit, keep_percent, id_col, text_col, host_col).drop("removed_at")


def apply_rules(docs: DataFrame, line_limit: int = LINE_LIMIT, keep_percent: int = KEEP_PERCENT, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """docs without rejected documents, and without the removed lines in those kept; columns stay."""
    i, t, i2, t2, gone = fresh(docs, "qr_id", "qr_tag", "qr_id2", "qr_tag2", "qr_gone")
    kept = _verdicts(docs, line_limit, keep_percent, id_col, text_col, host_col).where("kept")
    kept = kept.groupBy(F.col("doc_id").alias(i2), F.col("tag").alias(t2)).agg(F.first("removed_at").alias(gone)).hint("shuffle_hash")
    marked = docs.select(*[quoted(c) for c in docs.columns], quoted(id_col).cast("long").alias(i), F.xxhash64(quoted(text_col)).alias(t))
    both = marked.join(kept, F.col(i).eqNullSafe(F.col(i2)) & (F.col(t) == F.col(t2)))
    stay = let(F.split(quoted(text_col), "\n", -1), lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(gone)), lambda k: F.get(x, k)), "\n"))
    text = F.when(F.col(gone).isNull(), quoted(text_col)).otherwise(stay)
    return both.select(*[text.alias(c) if c == text_col else quoted(c) for c in docs.columns])
