"""Queries that go the whole way through a stored graph: load records, change, branch, merge, read the feed."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import Graph, MergeConflicts
from .sources import sinks
from .storage import shared_dir
from .streaming.ingest import ingest_stream

SCHEMA = """
node Region { name: String @key }
node Nation { name: String @key }
node Customer { name: String @key balance: F64 segment: String @index }
edge InRegion: Nation -> Region @card(1..1)
edge CustomerIn: Customer -> Nation @card(0..1)
"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region, nation and customer tables as load records."""
    r, n, c = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("region", "nation", "customer"))
    node = lambda df, t, **props: df.select(F.to_json(F.struct(F.lit(t).alias("type"), F.struct(*[F.col(v).alias(k) for k, v in props.items()]).alias("data"))).alias("value"))
    edge = lambda df, t, a, b: df.select(F.to_json(F.struct(F.lit(t).alias("edge"), F.col(a).alias("from"), F.col(b).alias("to"))).alias("value"))
    out = node(r, "Region", name="r_name").union(node(n, "Nation", name="n_name")).union(node(c, "Customer", name="c_name", balance="c_acctbal", segment="c_mktsegment"))
    out = out.union(edge(n.join(r, n.n_regionkey == r.r_regionkey), "InRegion", "n_name", "r_name"))
    return out.union(edge(c.join(n, c.c_nationkey == n.n_nationkey), "CustomerIn", "c_name", "n_name"))


def _loaded(spark: SparkSession, sf_dir: str) -> Graph:
    g = Graph.init(spark, f"{shared_dir(spark)}/latticework/graph-{uuid.uuid4().hex}", SCHEMA)
    g.load(_records(spark, sf_dir))
    return g


def graph_load_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loaded(spark, sf_dir).query("query q() { match { $c: Customer $c customerIn $n $n inRegion $r } return { $r.name as region, count($c) as customers, max($c.balance) as best } }")


def graph_mutate(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _loaded(spark, sf_dir)
    g.mutate('query m($low: F64) { update Customer set { segment: "NONE" } where balance < $low }', {"low": 0.0})
    g.mutate('query m() { delete Nation where name = "NATION_3" }')
    return g.query("query q() { match { $c: Customer $c customerIn $n } return { $c.segment as segment, count($c) as n } }")


def graph_branch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _loaded(spark, sf_dir)
    g.branch_create("work")
    g.mutate('query m() { update Customer set { segment: "LOW" } where balance < 0.0 }', branch="work")
    g.mutate('query m() { update Customer set { segment: "HIGH" } where balance > 9000.0 }')
    g.merge("work")
    return g.query("query q() { match { $c: Customer } return { $c.segment as segment, count($c) as n } }")


def graph_change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _loaded(spark, sf_dir)
    g.mutate('query m() { delete Customer where balance < 0.0 }')
    out = None
    for k, (_, changes) in enumerate(g.poll(None)):
        part = changes.groupBy("type", "op").agg(F.count("*").alias("n")).select(F.lit(k).alias("seq"), "type", "op", "n")
        out = part if out is None else out.union(part)
    return out


def _segments(g: Graph, **how) -> DataFrame:
    return g.query("query q() { match { $c: Customer } return { $c.segment as segment, count($c) as n } }", **how)


def _customers(spark: SparkSession, sf_dir: str, segment: str, where: str) -> DataFrame:
    """Records that put some customers into a segment."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").where(where)
    return c.select(F.to_json(F.struct(F.lit("Customer").alias("type"), F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.lit(segment).alias("segment")).alias("data"))).alias("value"))


def graph_load_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _loaded(spark, sf_dir)
    g.load(_customers(spark, sf_dir, "MERGED", "c_acctbal < 1000"), "merge")
    return _segments(g)


def graph_load_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _loaded(spark, sf_dir)
    g.load(_records(spark, sf_dir).where("get_json_object(value, '$.edge') = 'CustomerIn' and get_json_object(value, '$.to') like '%1%'"), "overwrite")
    return g.query("query q() { match { $c: Customer $c customerIn $n } return { $n.name as nation, count($c) as n } }")


def graph_ingest_fork(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _loaded(spark, sf_dir)
    g.ingest(_customers(spark, sf_dir, "FORKED", "c_acctbal > 5000"), "copy")
    both = [_segments(g, target=b).withColumn("branch", F.lit(b)) for b in ("main", "copy")]
    return both[0].union(both[1])


def graph_insert_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts of a node and an edge, and the deletion of edges, in turn."""
    g = _loaded(spark, sf_dir)
    g.mutate('query m() { insert Customer { name: "new", balance: 1.5, segment: "NEW" } insert CustomerIn { from: "new", to: "NATION_4" } }')
    g.mutate('query m() { delete CustomerIn where to = "NATION_5" }')
    return g.query("query q() { match { $c: Customer $c customerIn $n } return { $n.name as nation, count($c) as n } }")


def graph_time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _loaded(spark, sf_dir)
    before = g.cursor()
    g.mutate('query m() { update Customer set { segment: "LATER" } where balance > 0.0 }')
    both = [_segments(g, target=t).withColumn("at", F.lit(name)) for name, t in (("before", before), ("after", "main"))]
    return both[0].union(both[1])


def graph_optimize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several small writes, folded, and old data cleaned up: the rows stay."""
    g = _loaded(spark, sf_dir)
    for k in range(3):
        g.load(_customers(spark, sf_dir, f"S{k}", f"c_custkey % 10 = {k}"), "merge")
    g.optimize()
    g.cleanup(1)
    return _segments(g)


def graph_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.coalesce(F.get_json_object("value", "$.type"), F.get_json_object("value", "$.edge"))
    return _loaded(spark, sf_dir).export().groupBy(kind.alias("type")).agg(F.count("*").alias("n"), F.sum(F.get_json_object("value", "$.data.balance").cast("double")).alias("total"))


def graph_migrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _loaded(spark, sf_dir)
    g.schema_apply(SCHEMA.replace("segment: String @index", 'part: String @rename_from("segment") note: String?'))
    return g.query("query q() { match { $c: Customer } return { $c.part as part, count($c) as n, count($c.note) as notes } }")


def graph_changes_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages of a commit's changes, one behind the other."""
    g = _loaded(spark, sf_dir)
    g.mutate('query m() { update Customer set { segment: "X" } where balance > 9000.0 }')
    return g.commit_changes_pages(g.cursor(), max_rows=40).select("page", "type", "id", "op")


def graph_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loaded(spark, sf_dir).query(
        "query q($s: String, $low: F64) { match { $c: Customer { segment: $s } $c.balance >= $low } return { $c.name as name, $c.balance as balance } }",
        {"s": "MACHINERY", "low": 2500},
    )


def graph_merge_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conflicts of a merge in which both sides changed some customers, and one changed what the other deleted."""
    g = _loaded(spark, sf_dir)
    g.branch_create("work")
    for where in ("balance < 1000.0", "balance > 8000.0"):
        g.mutate(f'query m() {{ update Customer set {{ segment: "OURS" }} where {where} }}', branch="work")
    g.mutate('query m() { update Customer set { segment: "MAIN" } where balance < 2000.0 }')
    g.mutate('query m() { delete Customer where balance > 9000.0 }')
    try:
        g.merge("work")
    except MergeConflicts as e:
        return e.found
    return spark.createDataFrame([], "type string, id string, conflict string")


def graph_merge_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merges of a branch with nothing new, of one that is ahead, and of one that has parted; the rows that main then shows."""
    g = _loaded(spark, sf_dir)
    g.branch_create("work")
    rows = [(0, g.merge("work"), _marked(g))]
    g.mutate('query m() { update Customer set { segment: "MARK" } where balance < 0.0 }', branch="work")
    rows.append((1, g.merge("work"), _marked(g)))
    g.mutate('query m() { update Customer set { segment: "MARK" } where balance > 9000.0 }', branch="work")
    g.mutate('query m() { delete CustomerIn where to = "NATION_6" }')
    rows.append((2, g.merge("work"), _marked(g)))
    return spark.createDataFrame(rows, "step int, outcome string, marked long")


def _marked(g: Graph) -> int:
    return g.query('query q() { match { $c: Customer { segment: "MARK" } } return { count($c) as n } }').first()[0]


def graph_mutation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many nodes and edges each mutation says it touched; one that finds nothing makes no commit."""
    g = _loaded(spark, sf_dir)
    rows = []
    for k, text in enumerate((
        'insert Customer { name: "new", balance: 1.5, segment: "NEW" } insert CustomerIn { from: "new", to: "NATION_4" }',
        'update Customer set { segment: "LOW" } where balance < 0.0',
        'delete Nation where name = "NATION_3"',
        'delete CustomerIn where to = "NATION_5"',
        'delete Customer where name = "nobody"',
    )):
        done = g.mutate(f"query m() {{ {text} }}")
        rows.append((k, done.nodes, done.edges, done.commit is not None))
    return spark.createDataFrame(rows, "step int, nodes long, edges long, committed boolean")


def graph_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records as of a cursor, then the changes after it."""
    g = _loaded(spark, sf_dir)
    cursor, records = g.baseline()
    g.mutate('query m() { update Customer set { segment: "X" } where balance > 5000.0 }')
    kind = F.coalesce(F.get_json_object("value", "$.type"), F.get_json_object("value", "$.edge"))
    out = records.groupBy(kind.alias("type")).agg(F.count("*").alias("n")).select("type", F.lit("record").alias("what"), "n")
    for _, changes in g.poll(cursor):
        out = out.union(changes.groupBy("type", "op").agg(F.count("*").alias("n")).select("type", F.col("op").alias("what"), "n"))
    return out


def graph_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([_loaded(spark, sf_dir).entity("Nation", "NATION_7")], "id string, name string")


def graph_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(x["type"], x["property"], x["kind"]) for x in _loaded(spark, sf_dir).ensure_indices()], "type string, property string, kind string")


def graph_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written as Arrow and as JSON lines; the latter loaded into a second graph."""
    g, folder = _loaded(spark, sf_dir), f"{shared_dir(spark)}/latticework/sink-{uuid.uuid4().hex}"
    files = sinks.write_arrow(g.table("Customer"), f"{folder}/arrow")
    sinks.write_jsonl(g.export(), f"{folder}/jsonl")
    again = Graph.init(spark, f"{folder}/graph", SCHEMA)
    again.load(f"{folder}/jsonl")
    back = _segments(again)
    return files.agg(F.sum("rows").alias("n")).select(F.lit("arrow").alias("segment"), "n").union(back)


def graph_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node records as a stream of files, a commit for each micro-batch; a second run finds nothing new."""
    folder = f"{shared_dir(spark)}/latticework/stream-{uuid.uuid4().hex}"
    _records(spark, sf_dir).where("get_json_object(value, '$.type') is not null").repartition(4).write.text(f"{folder}/in")
    g = Graph.init(spark, f"{folder}/graph", SCHEMA)
    for _ in range(2):
        stream = spark.readStream.option("maxFilesPerTrigger", 2).text(f"{folder}/in")
        ingest_stream(g, stream, f"{folder}/checkpoint").awaitTermination()
    return _segments(g)


_IN = "customer join nation on c_nationkey = n_nationkey"
STORED: dict[str, tuple[Callable, str]] = {
    "graph_load_query": (graph_load_query, f"select r_name as region, count(*) as customers, max(c_acctbal) as best from {_IN} join region on n_regionkey = r_regionkey group by 1"),
    "graph_mutate": (graph_mutate, f"select case when c_acctbal < 0 then 'NONE' else c_mktsegment end as segment, count(*) as n from {_IN} where n_name <> 'NATION_3' group by 1"),
    "graph_branch_merge": (graph_branch_merge, "select case when c_acctbal < 0 then 'LOW' when c_acctbal > 9000 then 'HIGH' else c_mktsegment end as segment, count(*) as n from customer group by 1"),
    "graph_change_feed": (graph_change_feed, f"""select 0 as seq, 'Region' as type, 'insert' as op, count(*) as n from region union all select 0, 'Nation', 'insert', count(*) from nation union all select 0, 'Customer', 'insert', count(*) from customer
        union all select 0, 'InRegion', 'insert', count(*) from nation join region on n_regionkey = r_regionkey union all select 0, 'CustomerIn', 'insert', count(*) from {_IN}
        union all select 1, 'Customer', 'delete', count(*) from customer where c_acctbal < 0 union all select 1, 'CustomerIn', 'delete', count(*) from {_IN} where c_acctbal < 0"""),
    "graph_load_merge": (graph_load_merge, "select case when c_acctbal < 1000 then 'MERGED' else c_mktsegment end as segment, count(*) as n from customer group by 1"),
    "graph_load_overwrite": (graph_load_overwrite, f"select n_name as nation, count(*) as n from {_IN} where n_name like '%1%' group by 1"),
    "graph_ingest_fork": (graph_ingest_fork, "select c_mktsegment as segment, count(*) as n, 'main' as branch from customer group by 1 union all select case when c_acctbal > 5000 then 'FORKED' else c_mktsegment end, count(*), 'copy' from customer group by 1"),
    "graph_insert_delete": (graph_insert_delete, f"select n_name as nation, count(*) + max(case when n_name = 'NATION_4' then 1 else 0 end) as n from {_IN} where n_name <> 'NATION_5' group by 1"),
    "graph_time_travel": (graph_time_travel, "select c_mktsegment as segment, count(*) as n, 'before' as at from customer group by 1 union all select case when c_acctbal > 0 then 'LATER' else c_mktsegment end, count(*), 'after' from customer group by 1"),
    "graph_optimize": (graph_optimize, "select case when c_custkey % 10 < 3 then 'S' || c_custkey % 10 else c_mktsegment end as segment, count(*) as n from customer group by 1"),
    "graph_export": (graph_export, f"""select 'Region' as type, count(*) as n, cast(null as double) as total from region union all select 'Nation', count(*), null from nation union all select 'Customer', count(*), sum(c_acctbal) from customer
        union all select 'InRegion', count(*), null from nation join region on n_regionkey = r_regionkey union all select 'CustomerIn', count(*), null from {_IN}"""),
    "graph_migrate": (graph_migrate, "select c_mktsegment as part, count(*) as n, 0 as notes from customer group by 1"),
    "graph_changes_page": (graph_changes_page, "select cast((row_number() over (order by c_name) - 1) // 40 as int) as page, 'Customer' as type, c_name as id, 'update' as op from customer where c_acctbal > 9000"),
    "graph_parameters": (graph_parameters, "select c_name as name, c_acctbal as balance from customer where c_mktsegment = 'MACHINERY' and c_acctbal >= 2500"),
    "graph_merge_conflicts": (graph_merge_conflicts, "select 'Customer' as type, c_name as id, case when c_acctbal < 1000 then 'DivergentUpdate' else 'DeleteVsUpdate' end as conflict from customer where c_acctbal < 1000 or c_acctbal > 9000"),
    "graph_merge_outcomes": (graph_merge_outcomes, """select 0 as step, 'AlreadyUpToDate' as outcome, 0 as marked union all select 1, 'FastForward', count(*) from customer where c_acctbal < 0
        union all select 2, 'Merged', count(*) from customer where c_acctbal < 0 or c_acctbal > 9000"""),
    "graph_mutation_counts": (graph_mutation_counts, f"""select 0 as step, 1 as nodes, 1 as edges, true as committed union all select 1, count(*), 0, count(*) > 0 from customer where c_acctbal < 0
        union all select 2, 1, count(*) + 1, true from {_IN} where n_name = 'NATION_3' union all select 3, 0, count(*), count(*) > 0 from {_IN} where n_name = 'NATION_5' union all select 4, 0, 0, false"""),
    "graph_baseline": (graph_baseline, f"""select 'Region' as type, 'record' as what, count(*) as n from region union all select 'Nation', 'record', count(*) from nation union all select 'Customer', 'record', count(*) from customer
        union all select 'InRegion', 'record', count(*) from nation join region on n_regionkey = r_regionkey union all select 'CustomerIn', 'record', count(*) from {_IN} union all select 'Customer', 'update', count(*) from customer where c_acctbal > 5000"""),
    "graph_entity": (graph_entity, "select n_name as id, n_name as name from nation where n_name = 'NATION_7'"),
    "graph_indices": (graph_indices, "select * from (values ('Region', 'name', 'ordered'), ('Nation', 'name', 'ordered'), ('Customer', 'name', 'ordered'), ('Customer', 'segment', 'text'), ('InRegion', 'src', 'ordered'), ('InRegion', 'dst', 'ordered'), ('CustomerIn', 'src', 'ordered'), ('CustomerIn', 'dst', 'ordered')) as t(type, property, kind)"),
    "graph_sinks": (graph_sinks, "select 'arrow' as segment, count(*) as n from customer union all select c_mktsegment, count(*) from customer group by 1"),
    "graph_stream": (graph_stream, "select c_mktsegment as segment, count(*) as n from customer group by 1"),
}
