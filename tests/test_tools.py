"""Renderings, streaming ingest, lint and policy."""

import json

import pytest

from latticework.graph import Graph
from latticework.functions.search import mock_embedding
from latticework.plans.lint import describe, lint, lint_migration
from latticework.plans.query import parse_queries
from latticework.plans.schema import parse_schema, plan_migration
from latticework.policy import Denied, Policy, Rule
from latticework.sources import sinks
from latticework.sources.embed import fill_vectors
from latticework.streaming.ingest import ingest_stream

SCHEMA = "node Person { name: String @key age: I32? } edge Knows: Person -> Person"


def test_json_values():
    assert sinks.json_value([2**53, -(2**53), 2**53 - 1, float("nan"), float("inf"), -float("inf"), True, None, b"\x01"]) == [str(2**53), str(-(2**53)), 2**53 - 1, "NaN", "Infinity", "-Infinity", True, None, "01"]


def test_render(spark):
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "k int, v string")
    assert sinks.render(df, "jsonl") == '{"k": 1, "v": "a,b"}\n{"k": 2, "v": null}'
    assert sinks.render(df, "csv") == 'k,v\n1,"a,b"\n2,'
    assert sinks.render(df, "kv") == "k: 1\nv: a,b\n\nk: 2\nv: "
    assert sinks.render(df) == "k | v\n--+----\n1 | a,b\n2 |"
    with pytest.raises(ValueError):
        sinks.render(df, "xml")


def test_stream(spark, tmp_path):
    g = Graph.init(spark, f"file://{tmp_path}/g", SCHEMA)
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.jsonl").write_text(json.dumps({"type": "Person", "data": {"name": "Ann", "age": k}}) + "\n" + json.dumps({"type": "Person", "data": {"name": f"P{k}"}}) + "\n")
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in"))
        ingest_stream(g, stream, f"file://{tmp_path}/ck").awaitTermination()
    assert g.table("Person").count() == 4 and len(g.commits()) == 4


def test_export_to_text(spark, tmp_path):
    g = Graph.init(spark, f"file://{tmp_path}/g", SCHEMA)
    g.mutate('query m() { insert Person { name: "A" } insert Person { name: "B" } insert Knows { from: "A", to: "B" } }')
    sinks.write_jsonl(g.export(), f"{tmp_path}/out")
    again = Graph.init(spark, f"file://{tmp_path}/h", SCHEMA)
    done = again.ingest(f"{tmp_path}/out", "copy")
    assert (done.nodes, done.edges) == (2, 1) and again.table("Person").count() == 0 and again.table("Knows", "copy").count() == 1


def test_lint_and_describe():
    catalog = parse_schema(SCHEMA)
    assert [f.code for f in lint("query", catalog)] == ["Q000"]
    assert [f.code for f in lint("query a() { match { $p: Nobody } return { $p } }", catalog)] == ["Q000"]
    assert [f.code for f in lint('query a() { insert Person { name: "x" } }', catalog)] == ["L201"]
    assert lint("query a($n: String) { insert Person { name: $n } }", catalog) == []
    (q,) = parse_queries("query a($n: String) { match { $p: Person { name: $n } $p knows $q } return { $q.name, count($p) as n, avg($p.age) as a } }").values()
    d = describe(q, catalog)
    assert d["columns"] == [("q.name", "String"), ("n", "I64"), ("a", "F64")] and d["reads"] == ["Knows", "Person"] and d["writes"] == []


def test_policy():
    p = Policy((Rule(("ann", "ops-*"), ("read", "change"), ("main", "work/*")), Rule(("root",), ("*",))))
    assert p.test([("ann", "read", "main", True), ("ann", "branch_merge", "main", False), ("ops-1", "change", "work/x", True), ("ops-1", "change", "other", False), ("root", "admin", "any", True), ("bob", "read", "main", False)]) == []
    with pytest.raises(Denied):
        p.require("bob", "read")
    with pytest.raises(ValueError):
        p.allows("ann", "fly")


def test_migration_lint():
    old, new = parse_schema("node A { x: I64 y: String? } node B { n: String } edge E: A -> A"), parse_schema("node A { x: I32 z: String }")
    steps = plan_migration(old, new)
    assert {f.code for f in lint_migration(steps, old)} == {"OG-DS-102", "OG-DS-103", "OG-DS-104", "OG-MF-103", "OG-MF-106"}
    assert {f.query for f in lint_migration(steps, old, {"B"})} == {"B"}


def test_arrow(spark, tmp_path):
    import pyarrow as pa

    df = spark.range(100).selectExpr("id as k", "cast(id as string) as v").repartition(3)
    assert pa.ipc.open_stream(sinks.arrow_stream(df, 7)).read_all().num_rows == 7
    files = sinks.write_arrow(df, f"file://{tmp_path}/out").collect()
    found = [r for f in files for r in pa.ipc.open_file(str(tmp_path / "out" / f.file)).read_all().to_pylist()]
    assert sorted(r["k"] for r in found) == list(range(100)) and sum(f.rows for f in files) == 100


def test_fill_vectors(spark):
    catalog = parse_schema('node Doc { title: String v: Vector(3)? @embed("title") }')
    records = [{"type": "Doc", "data": {"title": "a"}}, {"type": "Doc", "data": {"title": "b", "v": [1, 2, 3]}}, {"type": "Doc", "data": {"v": None}}, {"edge": "X", "from": "a", "to": "b"}]
    df = spark.createDataFrame([(json.dumps(r),) for r in records], "value string").coalesce(1)
    out = [json.loads(r.value) for r in fill_vectors(df, catalog, mock_embedding).collect()]
    assert out == [{"type": "Doc", "data": {"title": "a", "v": mock_embedding("a", 3)}}, *records[1:]]
    assert json.loads(fill_vectors(df, catalog, mock_embedding, again=True).collect()[1].value)["data"]["v"] == mock_embedding("b", 3)
