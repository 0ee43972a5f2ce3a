from collections import defaultdict
from hashlib import sha256

import pytest

from latticework.llm import line_dedup, queries

from .conftest import got, ordered

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(pairs, min_docs):
    key = lambda line: line.strip(BLANK).translate(LOWER)
    held = defaultdict(set)
    for doc, text in pairs:
        for line in (text or "").split("\n"):
            held[key(line)].add(doc)
    out = []
    for doc, text in pairs:
        lines = (text or "").split("\n")
        stay = [x for x in lines if not key(x) or len(held[key(x)]) < min_docs]
        out.append((doc, len(lines), len(lines) - len(stay), sha256("\n".join(stay).encode()).hexdigest()))
    return ordered(out)


COLUMNS = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]


@pytest.mark.parametrize("min_docs", [2, 10])
def test_frequent(docs, rows, min_docs):
    want = brute([(r[0], r[1]) for r in rows], min_docs)
    assert got(line_dedup.line_digests(docs, min_docs=min_docs), *COLUMNS) == want
    assert sum(r[2] for r in want) > 50


def test_many_partitions(spark, docs, rows):
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    try:
        assert got(line_dedup.line_digests(docs, min_docs=10), *COLUMNS) == brute([(r[0], r[1]) for r in rows], 10)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_small_batches(spark, docs, rows):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert got(line_dedup.line_digests(docs, min_docs=10), *COLUMNS) == brute([(r[0], r[1]) for r in rows], 10)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_query(spark, sf, real):
    assert got(queries.op1_line_dedup(spark, sf), *COLUMNS) == brute([*zip(real.doc_id.tolist(), real.text, strict=True)], 10)


def test_first(spark):
    made = spark.createDataFrame([(1, "a\nb\na"), (2, "B \nc\n\n"), (3, "c\nd")], "doc_id long, text string")
    out = line_dedup.dedup_lines(made, policy="first")
    assert got(out, "doc_id", "text") == [(1, "a\nb"), (2, "c\n\n"), (3, "d")]


def test_columns_and_nulls(docs, rows):
    out = line_dedup.dedup_lines(docs, min_docs=10)
    assert out.columns == docs.columns and out.count() == len(rows)
    assert out.where("text is null").count() == 2 and out.where("tag = 'clash'").count() == len(rows)


def test_empty(empty):
    assert line_dedup.line_digests(empty).collect() == [] and line_dedup.dedup_lines(empty).collect() == []


def test_bitmap():
    assert line_dedup.keep_lines(None, 3) == [True] * 3
