"""Every registered query with SQL gives DuckDB's rows on the same tables."""

import datetime as dt
import glob
import os
import re
import shutil
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from latticework import queries as graph
from latticework import store_queries
from latticework.operators import theta as comparing
from latticework.operators import traverse


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def one(x):
        return round(x, 4) if isinstance(x, float) else x.isoformat() if isinstance(x, dt.date) else x

    return [columns[i] for i in order], sorted((tuple(one(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(graph.SQL))
def test_query(spark, sf, duck, name):
    found = graph.QUERIES[name](spark, sf)
    want = duck.execute(graph.SQL[name])
    columns = [d[0] for d in want.description]
    assert normal(found.columns, [tuple(r) for r in found.collect()]) == normal(columns, want.fetchall())


def test_all_have_sql():
    assert set(graph.SQL) == set(graph.QUERIES)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["segment", "orders"]


def test_imports_without_training_data_operators(tmp_path):
    """The rest must work when the training-data folders and the pipeline are deleted."""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(here, tmp_path / "copy", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op') and n[2].isdigit()]; assert 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", check=True)


def test_plans(spark, sf):
    """Filters and columns reach the scan; a top-k is no full sort."""
    plan = graph.QUERIES["scan_filter_order_limit"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "EqualTo(c_mkt" in plan and "c_nationkey" not in plan
    plan = graph.QUERIES["anti_join_fast"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "text" not in plan


def test_all_suppliers_are_sources(spark, sf, duck):
    """Reach by breadth-first search from every supplier, on the links of the tables."""
    for both in graph.GRAPH.values():
        assert not any(re.search(r"(key|where s) < \d", x) for x in both)
    links = {}
    for a, b in duck.execute("select distinct a.l_suppkey, b.l_suppkey from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber + 1 = b.l_linenumber").fetchall():
        links.setdefault(a, set()).add(b)
    suppliers = {r[0] for r in duck.execute("select s_suppkey from supplier").fetchall()}
    want = set()
    for s in suppliers:
        front, seen = {s}, {s}
        for _ in range(3):
            want |= {(s, x) for x in front if x in links.get(x, ())}
            front = {y for x in front for y in links.get(x, ())} - seen
            seen |= front
            want |= {(s, x) for x in front}
    found = {(r.s, r.t) for r in graph.QUERIES["reach_1_3_all"](spark, sf).collect()}
    assert found == {(s, t) for s, t in want if t in suppliers} and len({s for s, _ in found}) == len(suppliers) > 4


@pytest.mark.parametrize("links", ["dense", "sparse"])
def test_hops_in_blocks(spark, monkeypatch, links):
    """Hops by bit matrices give the pairs of hops by joins and of a plain search: blocks that are crossed, self-links, nodes that are no sources."""
    monkeypatch.setattr(traverse, "BLOCK", 64)
    monkeypatch.setattr(traverse, "GAIN", 0)
    n = 150
    arrows = {(i, (i * i + j * 17) % n) for i in range(n) for j in range(9 if links == "dense" else 1)} | {(i, i) for i in range(0, n, 7)}
    pairs = spark.createDataFrame([(f"v{a}", f"v{b}") for a, b in sorted(arrows)], "s string, n string")
    sources = spark.createDataFrame([(f"v{a}",) for a in range(0, n, 3)] * 2 + [("alone",)], "s string")
    for low, high in ((1, 3), (2, 2), (3, 5), (2, 4)):
        want = set()
        for s in range(0, n, 3):
            front, seen = {s}, {s}
            for hop in range(1, high + 1):
                step = {(x, b) for x, b in arrows if x in front}
                front = {b for a, b in step} - seen
                seen |= front
                want |= {(f"v{s}", f"v{x}") for x in front | {b for a, b in step if a == b} if hop >= low}
        for many in (0, 10**9):
            found = [tuple(r) for r in traverse.reach(sources, pairs, low, high, True, many).collect()]
            assert len(found) == len(set(found)) and set(found) == want, (low, high, many)


def test_dense_hops_write_no_single_pairs(spark, monkeypatch):
    """On dense links a hop joins a row for each node and pair of blocks, not for each path; on thin links it stays a join."""
    made = []
    blocks = traverse._blocks
    monkeypatch.setattr(traverse, "_blocks", lambda *a: made.append(blocks(*a)) or made[-1])
    n = 200
    sources = spark.range(n).select(F.col("id").cast("string").alias("s"))
    dense = spark.range(n).select(F.col("id").cast("string").alias("s"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda x: ((F.col("id") + x) % n).cast("string"))).alias("n"))
    thin = dense.where("pmod(int(n) - int(s), 200) = 1")
    for pairs, hops in ((dense, 40), (thin, 1)):
        found = traverse.reach(sources, pairs, 2, 2, True, 0)
        assert found.count() == found.distinct().count() == n * hops
    walk, none = made
    assert none is None and traverse._joined(walk.links, "node", dense.select(F.col("s").cast("long").alias("node")).distinct(), "node") == n


@pytest.mark.parametrize("op", ["<", "<=", ">", ">="])
def test_comparing_join(spark, monkeypatch, op):
    """Chunks by value, with and without a key, against all pairs: equal values, nulls, NaN, one dominant key; dealt over many tasks whatever the input has."""
    monkeypatch.setattr(comparing, "CHUNK", 4)
    some = [(i, i % 5 % 3, [None, float("nan"), -1.5, 0.0, 2.5, 7.0][i * 7 % 6]) for i in range(40)]
    left, right = spark.createDataFrame(some, "i int, k int, v double").coalesce(1), spark.createDataFrame([(i, None if i == 9 else k, v) for i, k, v in some[:30]], "j int, q int, w double").coalesce(1)
    test = {"<": F.col("v") < F.col("w"), "<=": F.col("v") <= F.col("w"), ">": F.col("v") > F.col("w"), ">=": F.col("v") >= F.col("w")}[op]
    for on in (None, ("k", "q")):
        want = left.crossJoin(right).where(test & (F.col("k") == F.col("q")) if on else test)
        found = comparing.theta(left, right, on, ("v", op, "w"), test)
        assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect())) and found.columns == want.columns
        assert "RoundRobinPartitioning" in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["theta_join_all", "cross_binding_filter"])
def test_comparisons_are_joined_in_chunks(spark, sf, name):
    """The comparison bounds the join itself, and the rows are dealt to tasks before it."""
    plan = graph.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "_chunk" in plan and "Repartition" in plan


@pytest.mark.parametrize("name", [
    "graph_mutation_counts",
    "graph_merge_outcomes",
    "graph_sinks",
    "graph_entity",
    "graph_insert_delete",
    "graph_export",
    "graph_migrate",
    "graph_load_overwrite",
    "graph_change_feed",
    "graph_ingest_fork",
    "graph_mutate",
    "graph_optimize",
    "graph_load_query",
    "graph_branch_merge",
    "graph_merge_conflicts",
    "graph_load_merge",
    "graph_baseline",
])
def test_stored_graphs_read_their_source_once(spark, sf, monkeypatch, name):
    """One pass over a source for each load, whatever a query does with its graph."""
    seen, made, calls = spark.sparkContext.accumulator(0), store_queries._records, []

    def counted(*a):
        calls.append(made(*a).count())
        return made(*a).select(F.udf(lambda v: seen.add(1) or v, "string").asNondeterministic()("value").alias("value"))

    monkeypatch.setattr(store_queries, "_records", counted)
    graph.QUERIES[name](spark, sf)
    assert calls and seen.value == sum(calls)
