"""The driver's tables as a graph, one query per operator, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import integrity, versions
from .plans.compile import Compiler
from .plans.query import parse_queries
from .plans.schema import parse_schema
from .store_queries import STORED

SCHEMA = """
node Region { name: String @key }
node Nation { name: String @key }
node Customer { name: String @index balance: F64 segment: String key: I64 }
node Supplier { name: String balance: F64 key: I64 }
node Part { name: String @index brand: String size: I32 price: F64 words: [String] key: I64 }
node Order { status: String total: F64 date: DateTime priority: String key: I64 }
node Document { text: String @index lang: String source: String chars: I64 key: I64 }
node Vec { embedding: Vector(64) label: I32 key: I64 }
node Label { quality: I32? toxic: I32 }
edge InRegion: Nation -> Region
edge CustomerIn: Customer -> Nation
edge SupplierIn: Supplier -> Nation
edge Placed: Customer -> Order
edge Contains: Order -> Part { quantity: F64 price: F64 flag: String }
edge SuppliedBy: Order -> Supplier
edge FollowedBy: Supplier -> Supplier
edge Annotated: Document -> Label
edge SameLabel: Vec -> Vec
"""
CATALOG = parse_schema(SCHEMA)


def tables(spark: SparkSession, sf_dir: str) -> Callable[[str], DataFrame]:
    """DataFrames of the graph's types, read as they are asked for; columns prune down to the scans."""

    def t(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    s = lambda c: F.col(c).cast("string")
    edge = lambda a, b: [F.concat_ws(">", s(a), s(b)).alias("id"), s(a).alias("src"), s(b).alias("dst")]
    line_id = lambda: F.md5(F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate"))

    def followed() -> DataFrame:
        a = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("x"))
        b = t("lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_suppkey").alias("y"))
        return a.join(b, ["l_orderkey", "l_linenumber"]).select(F.concat_ws(">", "l_orderkey", "l_linenumber", "x", "y").alias("id"), s("x").alias("src"), s("y").alias("dst"))

    makers = {
        "Region": lambda: t("region").select(s("r_regionkey").alias("id"), F.col("r_name").alias("name")),
        "Nation": lambda: t("nation").select(s("n_nationkey").alias("id"), F.col("n_name").alias("name")),
        "Customer": lambda: t("customer").select(s("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("key")),
        "Supplier": lambda: t("supplier").select(s("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("key")),
        "Part": lambda: t("part").select(s("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"), F.split("p_type", " ").alias("words"), F.col("p_partkey").alias("key")),
        "Order": lambda: t("orders").select(s("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("total"), F.col("o_orderdate").cast("timestamp").alias("date"), F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("key")),
        "Document": lambda: t("documents").select(s("doc_id").alias("id"), "text", "lang", "source", F.col("n_chars").alias("chars"), F.col("doc_id").alias("key")),
        "Vec": lambda: t("embeddings").select(s("vec_id").alias("id"), "embedding", "label", F.col("vec_id").alias("key")),
        "Label": lambda: t("labels").select(s("doc_id").alias("id"), "quality", "toxic"),
        "InRegion": lambda: t("nation").select(*edge("n_nationkey", "n_regionkey")),
        "CustomerIn": lambda: t("customer").select(*edge("c_custkey", "c_nationkey")),
        "SupplierIn": lambda: t("supplier").select(*edge("s_suppkey", "s_nationkey")),
        "Placed": lambda: t("orders").select(*edge("o_custkey", "o_orderkey")),
        "Contains": lambda: t("lineitem").select(line_id().alias("id"), s("l_orderkey").alias("src"), s("l_partkey").alias("dst"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_returnflag").alias("flag")),
        "SuppliedBy": lambda: t("lineitem").select(line_id().alias("id"), s("l_orderkey").alias("src"), s("l_suppkey").alias("dst")),
        "FollowedBy": followed,
        "Annotated": lambda: t("labels").select(*edge("doc_id", "doc_id")),
        "SameLabel": lambda: t("embeddings").select("vec_id", F.explode(F.array(F.col("vec_id") + 1, F.col("vec_id") + 7)).alias("to")).select(*edge("vec_id", "to")),
    }
    return lambda name: makers[name]()


_Q1, _Q2 = [round(((i * 37) % 19 - 9) / 10, 1) for i in range(64)], [round(((i * 11) % 23 - 11) / 10, 1) for i in range(64)]
PARAMS = {"q1": _Q1, "q2": _Q2}
_vec = lambda q: "[" + ",".join(map(str, q)) + "]"
_dist = lambda q: f"list_sum(list_transform(range(1, 65), lambda i: (cast(embedding[i] as double) - ({_vec(q)})[i]) * (cast(embedding[i] as double) - ({_vec(q)})[i])))"
_STOP = "'a','an','and','are','as','at','be','but','by','for','if','in','into','is','it','no','not','of','on','or','such','that','the','their','then','there','these','they','this','to','was','will','with'"
_tok = lambda c: f"list_transform(list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '' and t not in ({_STOP})), lambda t: case when length(t) > 3 and t like '%s' and t not like '%ss' then left(t, length(t) - 1) else t end)"
_follow = "followed as (select a.l_suppkey as s, b.l_suppkey as n from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber + 1 = b.l_linenumber), pairs as (select distinct s, n from followed)"

#: name: (pattern query, SQL)
GRAPH: dict[str, tuple[str, str | None]] = {
    "scan_filter_order_limit": ("match { $c: Customer { segment: \"BUILDING\" } $c.balance > 5000 } return { $c.name as name, $c.balance as balance } order { $c.balance desc } limit 20",
        "select c_name as name, c_acctbal as balance from customer where c_mktsegment = 'BUILDING' and c_acctbal > 5000 order by c_acctbal desc, cast(c_custkey as varchar) limit 20"),
    "date_filter": ("match { $o: Order $o.date >= datetime(\"1996-01-01T00:00:00\") $o.status != \"F\" } return { $o.key as k, $o.total as total }",
        "select o_orderkey as k, o_totalprice as total from orders where o_orderdate >= timestamp '1996-01-01' and o_orderstatus <> 'F'"),
    "time_of_query": ("match { $o: Order $o.date < now() } return { $o.status as status, count($o) as n }", "select o_orderstatus as status, count(*) as n from orders where o_orderdate < now() group by 1"),
    "time_with_offset": ("match { $o: Order $o.date >= datetime(\"1997-01-01T05:30:00+05:30\") $o.date < datetime(\"1997-12-31T19:00:00-05:00\") } return { $o.key as k }", "select o_orderkey as k from orders where o_orderdate >= timestamp '1997-01-01' and o_orderdate < timestamp '1998-01-01'"),
    "lossless_literal": ("match { $p: Part $p.size = 2.5 } return { $p.key as k }", "select p_partkey as k from part where p_size = 2.5"),
    "string_contains": ("match { $p: Part $p.name contains \"e\" } return { $p.key as k }", "select p_partkey as k from part where contains(p_name, 'e')"),
    "starts_with": ("match { $p: Part $p.brand starts_with \"Brand#1\" } return { $p.key as k }", "select p_partkey as k from part where starts_with(p_brand, 'Brand#1')"),
    "list_contains": ("match { $p: Part $p.words contains \"PROMO\" } return { $p.key as k }", "select p_partkey as k from part where list_contains(string_split(p_type, ' '), 'PROMO')"),
    "inline_list_match": ("match { $p: Part { words: \"LARGE\" } } return { count($p) as n }", "select count(*) as n from part where list_contains(string_split(p_type, ' '), 'LARGE')"),
    "cross_binding_filter": ("match { $c: Customer $s: Supplier $c customerIn $n $s supplierIn $n $c.balance < $s.balance } return { $c.key as c, $s.key as s }",
        "select c_custkey as c, s_suppkey as s from customer join supplier on c_nationkey = s_nationkey where c_acctbal < s_acctbal"),
    "cross_join": ("match { $r: Region $n: Nation } return { $r.name as r, $n.name as n }", "select r_name as r, n_name as n from region, nation"),
    "theta_join_all": ("match { $r: Region $s: Supplier $t: Supplier $s.balance > $t.balance $r.name starts_with \"A\" } return { $r.name as r, $s.key as s, $t.key as t }",
        "select r_name as r, s.s_suppkey as s, t.s_suppkey as t from region, supplier s, supplier t where s.s_acctbal > t.s_acctbal and starts_with(r_name, 'A')"),
    "expand_distinct": ("match { $o: Order { status: \"F\" } $o suppliedBy $s } return { $o.key as o, $s.key as s }",
        "select distinct l_orderkey as o, l_suppkey as s from lineitem join orders on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey where o_orderstatus = 'F'"),
    "expand_reverse": ("match { $n: Nation { name: \"NATION_3\" } $c customerIn $n } return { $c.key as c }", "select c_custkey as c from customer join nation on c_nationkey = n_nationkey where n_name = 'NATION_3'"),
    "expand_two_hop": ("match { $c: Customer $c customerIn $n $n inRegion $r } return { $r.name as region, count($c) as customers } order { customers desc }",
        "select r_name as region, count(*) as customers from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name order by customers desc, region"),
    "cycle_closing": ("match { $c: Customer $c placed $o $o suppliedBy $s $s supplierIn $n $c customerIn $n } return { $c.key as c, $o.key as o, $s.key as s }",
        "select distinct c_custkey as c, o_orderkey as o, s_suppkey as s from customer join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey join supplier on s_suppkey = l_suppkey and s_nationkey = c_nationkey join nation on n_nationkey = c_nationkey"),
    "undirected_neighbours_all": ("match { $s: Supplier $s <followedBy> $t } return { $s.key as s, $t.key as t }",
        f"with {_follow} select s, n as t from (select s, n from pairs union select n, s from pairs) join supplier a on a.s_suppkey = s join supplier b on b.s_suppkey = n"),
    "bound_edge_rows": ("match { $o: Order { priority: \"1-URGENT\" } $o $l:suppliedBy $s } return { $s.key as s, count($l) as n }",
        "select l_suppkey as s, count(*) as n from lineitem join orders on l_orderkey = o_orderkey join supplier on s_suppkey = l_suppkey where o_orderpriority = '1-URGENT' group by 1"),
    "bound_edge_undirected_all": ("match { $s: Supplier $s $e:<followedBy> $t } return { $s.key as s, count($e) as n }",
        f"with {_follow} select s, count(*) as n from (select s, n from followed union all select n, s from followed where s <> n) where s in (select s_suppkey from supplier) and n in (select s_suppkey from supplier) group by s"),
    "reach_1_3_all": ("match { $s: Supplier $s followedBy{1,3} $t } return { $s.key as s, $t.key as t }",
        f"""with {_follow}, v0 as (select s_suppkey as s, s_suppkey as n from supplier),
        e1 as (select distinct v.s, p.n, v.n = p.n as loop from v0 v join pairs p on v.n = p.s), f1 as (select s, n from e1 where not loop), v1 as (select * from v0 union select * from f1),
        e2 as (select distinct f.s, p.n, f.n = p.n as loop from f1 f join pairs p on f.n = p.s), f2 as (select s, n from e2 where not loop except select * from v1), v2 as (select * from v1 union select * from f2),
        e3 as (select distinct f.s, p.n, f.n = p.n as loop from f2 f join pairs p on f.n = p.s), f3 as (select s, n from e3 where not loop except select * from v2)
        select s, n as t from (select * from f1 union select s, n from e1 where loop union select * from f2 union select s, n from e2 where loop union select * from f3 union select s, n from e3 where loop) where n in (select s_suppkey from supplier)"""),
    "reach_2_2_all": ("match { $s: Supplier $s followedBy{2,2} $t } return { $s.key as s, $t.key as t }",
        f"""with {_follow}, v0 as (select s_suppkey as s, s_suppkey as n from supplier),
        f1 as (select distinct v.s, p.n from v0 v join pairs p on v.n = p.s where v.n <> p.n), v1 as (select * from v0 union select * from f1),
        e2 as (select distinct f.s, p.n, f.n = p.n as loop from f1 f join pairs p on f.n = p.s), f2 as (select s, n from e2 where not loop except select * from v1)
        select s, n as t from (select * from f2 union select s, n from e2 where loop) where n in (select s_suppkey from supplier)"""),
    "cross_type_clamped": ("match { $c: Customer $c placed{2,3} $o } return { $c.key as c, $o.key as o }", "select c_custkey as c, o_orderkey as o from customer join orders on o_custkey = c_custkey where false"),
    "anonymous_end": ("match { $s: Supplier $_ suppliedBy $s $s.balance > 0 } return { count($s) as n }",
        "select count(*) as n from (select distinct l_orderkey, l_suppkey from lineitem where l_orderkey in (select o_orderkey from orders)) join supplier on s_suppkey = l_suppkey where s_acctbal > 0"),
    "anti_join_fast": ("match { $d: Document not { $d annotated $_ } } return { $d.key as k }", "select doc_id as k from documents where doc_id not in (select doc_id from labels)"),
    "anti_join_filtered": ("match { $c: Customer not { $c placed $o $o.priority = \"1-URGENT\" } } return { $c.key as k }",
        "select c_custkey as k from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')"),
    "anti_join_nested": ("match { $n: Nation not { $c customerIn $n not { $c placed $o $o.total > 300000 } } } return { $n.name as n }",
        "select n_name as n from nation where not exists (select 1 from customer where c_nationkey = n_nationkey and not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000))"),
    "group_count": ("match { $c: Customer $c placed $o } return { $c.segment as segment, count($o) as orders } order { orders desc }",
        "select c_mktsegment as segment, count(*) as orders from customer join orders on o_custkey = c_custkey group by 1 order by orders desc, segment"),
    "sum_avg_min_max": ("match { $p: Part } return { $p.brand as brand, sum($p.size) as total, avg($p.size) as mean, min($p.size) as low, max($p.name) as high }",
        "select p_brand as brand, sum(cast(p_size as double)) as total, avg(p_size) as mean, min(p_size) as low, max(p_name) as high from part group by 1"),
    "empty_global_aggregate": ("match { $p: Part $p.size > 100000 } return { count($p) as n, sum($p.size) as total, avg($p.price) as mean }",
        "select count(*) as n, sum(cast(p_size as double)) as total, avg(p_retailprice) as mean from part where p_size > 100000"),
    "order_total_tiebreak": ("match { $p: Part } return { $p.size as size, $p.key as k } order { $p.size asc } limit 50", "select p_size as size, p_partkey as k from part order by p_size, cast(p_partkey as varchar) limit 50"),
    "order_multi_key": ("match { $o: Order $o.total < 20000 } return { $o.status as status, $o.total as total } order { $o.status desc, total asc } limit 40",
        "select o_orderstatus as status, o_totalprice as total from orders where o_totalprice < 20000 order by status desc, total, cast(o_orderkey as varchar) limit 40"),
    "nearest_topk": ("match { $v: Vec } return { $v.key as k, $v.label as label } order { nearest($v.embedding, $q1) } limit 10", f"select vec_id as k, label from embeddings order by {_dist(_Q1)}, cast(vec_id as varchar) limit 10"),
    "nearest_prefiltered": ("match { $v: Vec $v.label = 1 } return { $v.key as k } order { nearest($v.embedding, $q1) } limit 5", f"select vec_id as k from embeddings where label = 1 order by {_dist(_Q1)}, cast(vec_id as varchar) limit 5"),
    "nearest_then_expand": ("match { $v: Vec $v sameLabel $w } return { $v.key as v, $w.key as w } order { nearest($v.embedding, $q2) } limit 6",
        f"""with top as (select vec_id, row_number() over (order by {_dist(_Q2)}, cast(vec_id as varchar)) as r from embeddings qualify r <= 6)
        select top.vec_id as v, e.vec_id as w from top join embeddings e on e.vec_id in (top.vec_id + 1, top.vec_id + 7) order by r, cast(v as varchar), cast(w as varchar) limit 6"""),
    "rrf_two_vectors": ("match { $v: Vec } return { $v.key as k } order { rrf(nearest($v.embedding, $q1), nearest($v.embedding, $q2)) } limit 8",
        f"""with a as (select vec_id, row_number() over (order by {_dist(_Q1)}, cast(vec_id as varchar)) - 1 as r from embeddings qualify r < 8),
        b as (select vec_id, row_number() over (order by {_dist(_Q2)}, cast(vec_id as varchar)) - 1 as r from embeddings qualify r < 8)
        select vec_id as k from a full join b using (vec_id) order by coalesce(1.0 / (60 + a.r + 1), 0) + coalesce(1.0 / (60 + b.r + 1), 0) desc, a.r nulls last, b.r nulls last, cast(vec_id as varchar) limit 8"""),
    "search_tokens": ("match { $d: Document search($d.text, \"thing there\") } return { $d.key as k }", f"select doc_id as k from documents where list_has_any({_tok('text')}, ['thing'])"),
    "match_text_tokens": ("match { $d: Document match_text($d.text, \"que\") $d.lang = \"fr\" } return { $d.key as k }", f"select doc_id as k from documents where lang = 'fr' and list_contains({_tok('text')}, 'que')"),
    "fuzzy_tokens": ("match { $p: Part fuzzy($p.name, \"rang\", 1) } return { $p.key as k }", f"select p_partkey as k from part where len(list_filter({_tok('p_name')}, lambda t: levenshtein(t, 'rang') <= 1)) > 0"),
    "bm25_rank": ("match { $d: Document } return { $d.key as k } order { bm25($d.text, \"thing with her\") } limit 15",
        f"""with d as (select doc_id, {_tok('text')} as t from documents), n as (select count(*) as n, avg(len(t)) as a, sum(list_contains(t, 'thing')::int) as d1, sum(list_contains(t, 'her')::int) as d2 from d),
        s as (select doc_id, ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * len(t) / a)) + ln(1 + (n - d2 + 0.5) / (d2 + 0.5)) * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * len(t) / a)) as s
        from (select *, len(list_filter(t, lambda x: x = 'thing'))::double as f1, len(list_filter(t, lambda x: x = 'her'))::double as f2 from d), n)
        select doc_id as k from s where s > 0 order by s desc, cast(doc_id as varchar) limit 15"""),
    "rrf_two_texts": ("match { $d: Document } return { $d.key as k } order { rrf(bm25($d.text, \"thing\"), bm25($d.text, \"her\")) } limit 12",
        f"""with d as (select doc_id, {_tok('text')} as t from documents), n as (select count(*) as n, avg(len(t)) as a, sum(list_contains(t, 'thing')::int) as d1, sum(list_contains(t, 'her')::int) as d2 from d),
        f as (select *, len(list_filter(t, lambda x: x = 'thing'))::double as f1, len(list_filter(t, lambda x: x = 'her'))::double as f2 from d, n),
        s as (select doc_id, ln(1 + (n - d1 + 0.5) / (d1 + 0.5)) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * len(t) / a)) as s1, ln(1 + (n - d2 + 0.5) / (d2 + 0.5)) * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * len(t) / a)) as s2 from f),
        a as (select doc_id, row_number() over (order by s1 desc, cast(doc_id as varchar)) - 1 as r from s where s1 > 0), b as (select doc_id, row_number() over (order by s2 desc, cast(doc_id as varchar)) - 1 as r from s where s2 > 0)
        select doc_id as k from a full join b using (doc_id) order by coalesce(1.0 / (60 + a.r + 1), 0) + coalesce(1.0 / (60 + b.r + 1), 0) desc, a.r nulls last, b.r nulls last, cast(doc_id as varchar) limit 12"""),
    "default_name": ("match { $c: Customer $c placed $o } return { count($o) }", "select count(*) as o from customer join orders on o_custkey = c_custkey"),
}


def run(spark: SparkSession, sf_dir: str, text: str, params: dict | None = None) -> DataFrame:
    """A pattern query over the driver's tables."""
    (q,) = parse_queries(f"query q() {{ {text} }}").values()
    return Compiler(CATALOG, tables(spark, sf_dir), PARAMS | (params or {})).read(q)


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    base = tables(spark, sf_dir)("Customer").drop("key")
    k = F.col("id").cast("long")
    ours = base.where(k % 10 != 3).withColumn("balance", F.when(k % 7 == 0, F.col("balance") + 1).otherwise(F.col("balance")))
    theirs = base.where(k % 15 != 4).withColumn("balance", F.when(k % 5 == 0, F.col("balance") + 2).otherwise(F.col("balance")))
    return base, ours, theirs


def diff_two_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, ours, _ = _versions(spark, sf_dir)
    return versions.diff(base, ours).select("id", "op", F.col("before.balance").alias("was"), F.col("after.balance").alias("now"))


def merge_three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.merge(*_versions(spark, sf_dir)).select("id", "conflict", F.col("row.balance").alias("balance"))


def read_your_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, ours, _ = _versions(spark, sf_dir)
    return versions.shadow(base, ours.where("balance > 9000")).select("id", "balance")


def unique_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.duplicates(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ("l_orderkey", "l_linenumber"))


def orphan_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir)
    few = t("Supplier").where("balance > 0")
    return integrity.orphans(t("SuppliedBy"), t("Order"), few).groupBy("dst", "missing").agg(F.count("*").alias("n"))


def cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables(spark, sf_dir)("Placed")
    return integrity.cardinality(e, e.select("src"), 5, 15)


def value_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = parse_schema('node P { size: I32 @range(size, 5..40) brand: String @check(brand, "[1-3]") kind: enum(a, b)? }').types["P"]
    rows = tables(spark, sf_dir)("Part").select("id", "size", "brand", F.when(F.col("size") % 9 == 0, F.lit("c")).otherwise(F.lit("a")).alias("kind"))
    return integrity.bad_values(rows, t)


_versions_sql = """with base as (select cast(c_custkey as varchar) as id, c_custkey as k, c_acctbal as b from customer),
ours as (select id, case when k % 7 = 0 then b + 1 else b end as o from base where k % 10 <> 3), theirs as (select id, case when k % 5 = 0 then b + 2 else b end as t from base where k % 15 <> 4)"""
OTHER: dict[str, tuple[Callable, str]] = {
    "diff_two_versions": (diff_two_versions, f"{_versions_sql} select id, case when o is null then 'delete' else 'update' end as op, b as was, o as now from base left join ours using (id) where o is distinct from b"),
    "merge_three_way": (merge_three_way, f"""{_versions_sql} select id, case when b is not distinct from t or b is not distinct from o or o is not distinct from t then null when o is null or t is null then 'DeleteVsUpdate' else 'DivergentUpdate' end as conflict,
        case when b is not distinct from t or o is not distinct from t then o when b is not distinct from o then t end as balance from base left join ours using (id) left join theirs using (id)"""),
    "read_your_writes": (read_your_writes, f"{_versions_sql} select id, case when o > 9000 then o else b end as balance from base left join ours using (id)"),
    "unique_violation": (unique_violation, "select l_orderkey, l_linenumber, count(*) as n from lineitem where l_orderkey is not null and l_linenumber is not null group by 1, 2 having count(*) > 1"),
    "orphan_edges": (orphan_edges, "select cast(l_suppkey as varchar) as dst, 'dst' as missing, count(*) as n from lineitem where l_suppkey not in (select s_suppkey from supplier where s_acctbal > 0) group by 1 union all select cast(l_suppkey as varchar), 'src', count(*) from lineitem where l_orderkey not in (select o_orderkey from orders) group by 1"),
    "cardinality": (cardinality, "select cast(o_custkey as varchar) as src, count(*) as n from orders group by 1 having count(*) not between 5 and 15"),
    "value_violations": (value_violations, """select cast(p_partkey as varchar) as id, 'size is out of @range' as rule from part where p_size not between 5 and 40
        union all select cast(p_partkey as varchar), 'brand fails @check' from part where not regexp_matches(p_brand, '[1-3]') union all select cast(p_partkey as varchar), 'kind is not in its enum' from part where p_size % 9 = 0"""),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: (lambda spark, sf_dir, text=text: run(spark, sf_dir, text)) for n, (text, _) in GRAPH.items()} | {n: f for n, (f, _) in (OTHER | STORED).items()}
SQL: dict[str, str] = {n: sql for n, (_, sql) in (GRAPH | OTHER | STORED).items() if sql}
