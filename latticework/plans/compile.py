"""From a parsed query to a DataFrame: typing rules, join order, search placement, tail."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import search as S
from ..operators import traverse
from ..operators.theta import theta
from ..storage import numbered as numbered_all
from .lexer import TypeCheckError
from .query import AGGREGATES, Binding, Expr, Filter, Negation, Query, Traversal
from .schema import NUMERIC, Catalog, EntityType, PropType

SEARCH = ("search", "match_text", "fuzzy")
RANKS = ("nearest", "bm25", "rrf")


def fail(code: str, message: str):
    raise TypeCheckError(code, message)


@dataclass
class Scope:
    """What the variables of a block stand for."""

    types: dict[str, EntityType] = field(default_factory=dict)
    outer: set[str] = field(default_factory=set)


def instant(text: str) -> dt.datetime:
    """A time in UTC without a zone; a text without an offset is in UTC."""
    found = dt.datetime.fromisoformat(text)
    return found.astimezone(dt.UTC).replace(tzinfo=None) if found.tzinfo else found


class Compiler:
    """One query against one snapshot.  tables gives the DataFrame of a type: id, (src, dst,) properties."""

    def __init__(self, catalog: Catalog, tables: Callable[[str], DataFrame], params: dict | None = None, embed: Callable[[str, int], list[float]] = S.mock_embedding, now: dt.datetime | None = None):
        self.catalog, self.tables, self.params, self.embed = catalog, tables, dict(params or {}), embed
        self.now = now or dt.datetime.now(dt.UTC).replace(tzinfo=None)
        self.declared: dict[str, tuple[str, bool]] = {}
        self.named: set[str] | None = None

    # -- typing ------------------------------------------------------------
    def prop(self, scope: Scope, var: str, name: str) -> PropType:
        t = scope.types.get(var) or fail("T6", f"${var} is not bound")
        if name == "id" or (t.kind == "edge" and name in ("src", "dst")):
            return PropType("String")
        return t.props.get(name) or fail("T6", f"${var} has no property {name}")

    def kind(self, scope: Scope, e: Expr) -> PropType | None:
        """The type of an expression; None where it is not known (null, parameters without a declaration)."""
        if e.op == "prop":
            p = self.prop(scope, *e.args)
            if p.scalar == "Blob":
                fail("T24", "a blob is no value of a query")
            return p
        if e.op == "var":
            if e.args[0] in scope.types:
                return PropType("String")
            if e.args[0] not in self.declared and e.args[0] not in self.params:
                fail("T6", f"${e.args[0]} is not bound")
            k = self.declared.get(e.args[0], ("", True))[0]
            return PropType(k.strip("[]"), list=k.startswith("[")) if k and not k.startswith("Vector") else None
        if e.op == "lit":
            return PropType("String", list=True) if e.args[0] == "List" else PropType(e.args[0])
        if e.op == "now":
            return PropType("DateTime")
        return PropType("Bool") if e.op in SEARCH else None

    @staticmethod
    def comparable(a: PropType | None, b: PropType | None) -> bool:
        if a is None or b is None or a.scalar == b.scalar:
            return True
        return a.scalar in NUMERIC and b.scalar in NUMERIC or {a.scalar, b.scalar} <= {"Date", "DateTime", "String"} and "String" in (a.scalar, b.scalar)

    def check_filter(self, scope: Scope, f: Filter) -> None:
        for e in (f.left, f.right):
            self.check_text(scope, e)
        a, b = self.kind(scope, f.left), self.kind(scope, f.right)
        if f.op == "contains" and a and a.list:
            if b and b.list or not self.comparable(PropType(a.scalar), b):
                fail("T7", "contains needs an element of the list")
        elif f.op in ("contains", "starts_with"):
            if any(x and (x.list or x.scalar != "String") for x in (a, b)):
                fail("T7", f"{f.op} needs strings")
        elif any(x and (x.list or x.scalar == "Vector") for x in (a, b)) or not self.comparable(a, b):
            fail("T7", "these operands can't be compared")

    def check_text(self, scope: Scope, e: Expr) -> None:
        if e.op in (*SEARCH, "bm25"):
            for x in e.args[:2]:
                k = self.kind(scope, x)
                if k and (k.scalar != "String" or k.list):
                    fail("T19", f"{e.op} needs strings")

    # -- values ------------------------------------------------------------
    def constant(self, e: Expr):
        if e.op == "lit":
            kind, v = e.args
            if kind == "List":
                return [self.constant(x) for x in v]
            if kind == "Date":
                return dt.date.fromisoformat(v)
            if kind == "DateTime":
                return instant(v)
            return v
        if e.op == "now":
            return self.now
        name = e.args[0]
        if name in self.params:
            return self.coerce(self.params[name], self.declared.get(name, ("", True)))
        if self.declared.get(name, ("", False))[1]:
            return None
        raise ValueError(f"parameter ${name} is not given")

    @staticmethod
    def coerce(value, declared: tuple[str, bool]):
        kind, nullable = declared
        if value is None:
            if not nullable:
                raise ValueError("null for a parameter that can't be null")
            return None
        if kind == "Date" and isinstance(value, str):
            return dt.date.fromisoformat(value)
        if kind == "Date" and isinstance(value, int):
            return dt.date(1970, 1, 1) + dt.timedelta(value)
        if kind == "DateTime" and isinstance(value, str):
            return instant(value)
        if kind == "DateTime" and isinstance(value, int):
            return dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=value)
        limits = {"I32": (-(2**31), 2**31 - 1), "I64": (-(2**63), 2**63 - 1), "U32": (0, 2**32 - 1), "U64": (0, 2**64 - 1)}
        if kind in limits and (isinstance(value, bool) or not isinstance(value, int) or not limits[kind][0] <= value <= limits[kind][1]):
            raise ValueError(f"{value!r} is no {kind}")
        if kind in ("F32", "F64"):
            return float(value)
        if kind == "String" and not isinstance(value, str) or kind == "Bool" and not isinstance(value, bool):
            raise ValueError(f"{value!r} is no {kind}")
        return value

    def value(self, scope: Scope, e: Expr) -> Column:
        if e.op == "prop":
            return F.col("__".join(e.args))
        if e.op == "var" and e.args[0] in scope.types:
            return F.col(f"{e.args[0]}__id")
        if e.op in ("search", "match_text"):
            return S.has_token(self.value(scope, e.args[0]), self.constant(e.args[1]))
        if e.op == "fuzzy":
            return S.fuzzy_token(self.value(scope, e.args[0]), self.constant(e.args[1]), self.constant(e.args[2]) if len(e.args) > 2 else 2)
        v = self.constant(e)
        return F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)

    def condition(self, scope: Scope, f: Filter) -> Column:
        self.check_filter(scope, f)
        a, b, k = self.value(scope, f.left), self.value(scope, f.right), self.kind(scope, f.left)
        if f.op == "contains":
            test = F.array_contains(a, b.cast(k.spark.elementType) if k.scalar not in NUMERIC and k.list else b) if k and k.list else F.contains(a, b)
            return F.coalesce(test, F.lit(False))
        if f.op == "starts_with":
            return F.coalesce(F.startswith(a, b), F.lit(False))
        return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[f.op]

    def variables(self, e: Expr) -> set[str]:
        if e.op in ("prop", "var"):
            return {e.args[0]}
        return set().union(*[self.variables(x) for x in e.args if isinstance(x, Expr)])

    # -- scans -------------------------------------------------------------
    def nodes(self, var: str, t: EntityType) -> DataFrame:
        df = self.tables(t.name)
        return df.select(*[F.col(c).alias(f"{var}__{c}") for c in ["id", *[p for p, k in t.props.items() if k.scalar != "Blob"]]])

    def inline(self, scope: Scope, b: Binding) -> list[Filter]:
        out = []
        for p, v in b.props:
            k = scope.types[b.var].props.get(p) or fail("T2", f"{b.type} has no property {p}")
            given = self.kind(scope, v)
            if k.list and given and given.list:
                fail("T3", f"{p} is a list: match one of its elements")
            if not self.comparable(PropType(k.scalar), given):
                fail("T3", f"{p} can't be compared with this value")
            out.append(Filter(Expr("prop", (b.var, p)), "contains" if k.list else "=", v))
        return out

    # -- the pattern -------------------------------------------------------
    def block(self, clauses: list, scope: Scope, df: DataFrame | None, rank: tuple[str, Callable] | None = None) -> DataFrame:
        """Compile the clauses of a block onto df (its variables are bound already)."""
        bound = set(scope.types) if df is not None else set()
        bindings = {}
        for c in clauses:
            if isinstance(c, Binding):
                t = self.catalog.node(c.type) or fail("T1", f"unknown node type {c.type}")
                if c.var in scope.types and scope.types[c.var].name != t.name:
                    fail("T1", f"${c.var} is bound to two types")
                scope.types[c.var] = t
                bindings[c.var] = c
        todo = [c for c in clauses if isinstance(c, Traversal)]
        for c in todo:
            self.check_traversal(scope, c)
        filters = [c for c in clauses if isinstance(c, Filter)]
        for b in bindings.values():
            filters += self.inline(scope, b)
        for f in filters:
            for e in (f.left, f.right):
                if e.op != "var" or e.args[0] in scope.types:
                    self.kind(scope, e) if e.op in ("prop", "var") else None
        ranked = False
        order = [v for v in bindings if v not in bound]
        for c in todo:  # ends without a binding of their own are scanned if nothing else reaches them
            order += [v for v in (c.src, c.dst) if v != "_" and v not in bound and v not in order]

        def scan(var: str) -> DataFrame:
            nonlocal filters, ranked
            out = self.nodes(var, scope.types[var])
            mine = [f for f in filters if (self.variables(f.left) | self.variables(f.right)) & set(scope.types) == {var}]
            for f in mine:
                out = out.where(self.condition(scope, f))
            filters = [f for f in filters if f not in mine]
            if rank and rank[0] == var:
                out, ranked = rank[1](out), True
            return out

        def loose(f: Filter) -> bool:
            return (self.variables(f.left) | self.variables(f.right)) & set(scope.types) <= bound

        while True:
            ready = next((c for c in todo if c.src in bound or c.dst in bound), None)
            if ready is not None:
                todo.remove(ready)
                df, got = self.expand(scope, ready, df, bound, scan, filters)
                bound |= got
                continue
            rest = [v for v in order if v not in bound]
            if not rest:
                break
            # a component's root: its first declared binding
            root = next((v for v in rest if v in bindings), rest[0])
            one = scan(root)
            if df is None:
                df = one
            else:
                tests = [f for f in filters if (self.variables(f.left) | self.variables(f.right)) & set(scope.types) <= bound | {root}]
                filters = [f for f in filters if f not in tests]
                if pivot := self.pivot(scope, tests, bound, root):
                    df = theta(self.slim(df), self.slim(one), None, pivot[0], self.condition(scope, pivot[1]))
                else:
                    df = df.crossJoin(one)
                for f in tests:
                    df = df.where(self.condition(scope, f))
            bound.add(root)
        if df is None:
            fail("T6", "a pattern needs a binding")
        for f in filters:
            if not loose(f):
                fail("T6", "a filter names an unbound variable")
            df = df.where(self.condition(scope, f))
        if rank and not ranked:
            # a variable that an expansion introduced: rank its distinct entities, keep their rows
            cols = [c for c in df.columns if c.startswith(f"{rank[0]}__")]
            best = rank[1](df.select(*cols).dropDuplicates([f"{rank[0]}__id"])).select(f"{rank[0]}__id", "__rank")
            df = df.join(best, f"{rank[0]}__id")
        for c in clauses:
            if isinstance(c, Negation):
                df = self.negate(scope, c, df)
        return df

    def check_traversal(self, scope: Scope, c: Traversal) -> None:
        e = self.catalog.edge(c.edge) or fail("T4", f"unknown edge {c.edge}")
        if c.high is None or c.low < 1 or c.high < c.low:
            fail("T15", "hops need bounds 1 <= m <= n")
        if c.undirected and e.src != e.dst:
            fail("T22", f"{e.name} joins two types: it has a direction")
        if c.var and (c.bounded and (c.low, c.high) != (1, 1)):
            fail("T23", "an edge can be named over one hop only")
        if c.var:
            scope.types[c.var] = e
        a, b = scope.types.get(c.src), scope.types.get(c.dst)
        forward = (not a or a.name == e.src) and (not b or b.name == e.dst)
        back = (not a or a.name == e.dst) and (not b or b.name == e.src)
        if not forward and not back:
            fail("T5", f"{e.name} does not join these types")
        c.reverse = not forward
        for v, name in ((c.src, e.src if forward else e.dst), (c.dst, e.dst if forward else e.src)):
            if v != "_":
                scope.types.setdefault(v, self.catalog.types[name])

    def pivot(self, scope: Scope, tests: list[Filter], bound: set[str], new: str) -> tuple[tuple[str, str, str], Filter] | None:
        """A comparison of a bound variable's property with one of the new variable's, as columns (bound, operator, new), and its filter."""
        turned = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}
        for f in tests:
            if f.op in turned and f.left.op == f.right.op == "prop":
                (a, b), kinds = (f.left.args, f.right.args), [self.kind(scope, e) for e in (f.left, f.right)]
                if kinds[0].scalar != kinds[1].scalar and not all(k.scalar in NUMERIC for k in kinds):
                    continue  # compared as another type, whose order may differ
                if a[0] in bound and b[0] == new:
                    return ("__".join(a), f.op, "__".join(b)), f
                if b[0] in bound and a[0] == new:
                    return ("__".join(b), turned[f.op], "__".join(a)), f
        return None

    def slim(self, df: DataFrame) -> DataFrame:
        """Only the columns that the query still names, and ids: what is gathered in arrays is not pruned by the optimizer."""
        return df if self.named is None else df.select(*[c for c in df.columns if c in self.named or "__" not in c or c.startswith("__") or c.split("__", 1)[1] in ("id", "src", "dst")])

    def properties(self, x) -> set[str]:
        """The columns that expressions and clauses name."""
        if isinstance(x, Expr):
            return {"__".join(x.args)} if x.op == "prop" else self.properties(list(x.args))
        if isinstance(x, Filter):
            return self.properties([x.left, x.right])
        if isinstance(x, Binding):
            return {f"{x.var}__{p}" for p, _ in x.props} | self.properties([v for _, v in x.props])
        if isinstance(x, Negation):
            return self.properties(x.clauses)
        return set().union(*map(self.properties, x)) if isinstance(x, (list, tuple)) else set()

    def expand(self, scope: Scope, c: Traversal, df: DataFrame, bound: set[str], scan: Callable[[str], DataFrame], filters: list[Filter]) -> tuple[DataFrame, set[str]]:
        e, start, end, reverse = self.catalog.edge(c.edge), c.src, c.dst, c.reverse
        if start not in bound:
            start, end, reverse = end, start, not reverse
        edges = self.tables(e.name)
        if c.var:
            rows = traverse.edge_rows(edges, reverse, c.undirected)
            pairs = rows.select("s", "n", *[F.col(x).alias(f"{c.var}__{x}") for x in edges.columns])
        else:
            pairs = traverse.neighbours(edges, reverse, c.undirected)
            if (c.low, c.high) != (1, 1):
                pairs = traverse.reach(df.select(F.col(f"{start}__id").alias("s")), pairs, c.low, c.high, e.src == e.dst)
        got = {c.var} if c.var else set()
        if end in bound:
            on = (F.col(f"{start}__id") == F.col("s")) & (F.col(f"{end}__id") == F.col("n"))
            return (df.join(pairs, on).drop("s", "n") if c.var else df.join(pairs, on, "left_semi")), got
        if end != "_" and (pivot := self.pivot(scope, filters, bound, end)):  # the comparison is made while the rows are joined, not afterwards
            ends = pairs.join(scan(end), F.col("n") == F.col(f"{end}__id")).drop("n")
            return theta(self.slim(df), self.slim(ends), (f"{start}__id", "s"), pivot[0], self.condition(scope, pivot[1])).drop("s"), got | {end}
        out = df.join(pairs, F.col(f"{start}__id") == F.col("s")).drop("s")
        if end == "_":
            far = self.tables(e.src if reverse else e.dst).select(F.col("id").alias("_far"))
            return out.join(far, F.col("n") == F.col("_far"), "left_semi").drop("n"), got
        return out.join(scan(end), F.col("n") == F.col(f"{end}__id")).drop("n"), got | {end}

    def negate(self, scope: Scope, c: Negation, df: DataFrame) -> DataFrame:
        """Rows without a match of the inner block, which is compiled on the distinct outer entities it names."""
        inner = Scope(dict(scope.types), set(scope.types))
        used = {v for v in self.names(c.clauses) if v in scope.types}
        if not used:
            fail("T9", "a negation must name an outer variable")
        if len(c.clauses) == 1 and isinstance(t := c.clauses[0], Traversal) and (t.low, t.high) == (1, 1) and "_" in (t.src, t.dst) and not t.var:
            self.check_traversal(inner, t)
            mine = t.src if t.dst == "_" else t.dst
            e = self.catalog.edge(t.edge)
            pairs = traverse.neighbours(self.tables(e.name), t.reverse != (mine == t.dst), t.undirected)
            return df.join(pairs, F.col(f"{mine}__id") == F.col("s"), "left_anti")
        inner.types = {v: scope.types[v] for v in used}
        cols = [x for x in df.columns if x.split("__")[0] in used]
        keys = [f"{v}__id" for v in sorted(used)]
        got = self.block(c.clauses, inner, df.select(*cols).dropDuplicates(keys)).select(*keys).distinct()
        return df.join(got, keys, "left_anti").select(*df.columns)

    def names(self, clauses: list) -> set[str]:
        out: set[str] = set()
        for c in clauses:
            if isinstance(c, Binding):
                out |= {c.var}.union(*[self.variables(v) for _, v in c.props])
            elif isinstance(c, Traversal):
                out |= {c.src, c.dst}
            elif isinstance(c, Filter):
                out |= self.variables(c.left) | self.variables(c.right)
            else:
                out |= self.names(c.clauses)
        return out

    # -- ranking -----------------------------------------------------------
    def arm(self, e: Expr, k: int | None, t: Callable[[str], EntityType], dense: bool = False) -> tuple[str, Callable[[DataFrame], DataFrame]]:
        """The variable a rank expression ranks, and a function that keeps its best rows and puts what orders them in __rank: a number if they are k or dense, else score and id."""
        if e.args[0].op != "prop":
            fail("T19", f"{e.op} ranks a property")
        var, prop = e.args[0].args
        col, key = F.col(f"{var}__{prop}"), F.col(f"{var}__id")

        def numbered(df: DataFrame, *order: Column) -> DataFrame:
            return df.withColumn("__rank", F.row_number().over(Window.orderBy(*order)) - 1)

        if e.op == "nearest":
            q = self.constant(e.args[1])
            dim = t(var).props[prop].dim
            if isinstance(q, str):
                q = self.embed(q, dim)
            if not q or dim and len(q) != dim:
                fail("T15", f"nearest needs a vector of {dim} numbers")

            def near(df: DataFrame) -> DataFrame:
                # filters stand below; the window sees k rows
                best = df.where(col.isNotNull()).withColumn("__d", S.distance(col, q)).orderBy("__d", key).limit(k)
                return numbered(best, F.col("__d"), key).drop("__d")

            return var, near
        q = self.constant(e.args[1])

        def match(df: DataFrame) -> DataFrame:
            base = self.tables(t(var).name)
            stats = base.agg(*S.bm25_statistics(F.col(prop), q))  # one row
            scored = df.where(S.may_match(col, q)).crossJoin(F.broadcast(stats)).withColumn("__s", S.bm25_score(col, q)).where(F.col("__s") > 0)
            extra = [c for c in scored.columns if c.startswith("bm_")]
            best, order = scored.drop(*extra), (F.col("__s").desc(), key)
            if dense:
                return numbered_all(best, "__rank", *order).drop("__s")
            return best.withColumn("__rank", F.struct((-F.col("__s")).alias("s"), key.alias("id"))).drop("__s")

        return var, match

    def fused(self, e: Expr, k: int, t) -> tuple[str, Callable[[DataFrame], DataFrame]]:
        arms = [self.arm(x, k if x.op == "nearest" else None, t, dense=True) for x in e.args[:2]]
        if arms[0][0] != arms[1][0]:
            fail("T21", "both arms of rrf must rank one variable")
        c, key = (self.constant(e.args[2]) if len(e.args) > 2 else 60), f"{arms[0][0]}__id"

        def best(df: DataFrame) -> DataFrame:
            a, b = (f(df).select(key, F.col("__rank").alias(n)) for (_, f), n in zip(arms, ("__a", "__b"), strict=True))
            part = lambda r: F.coalesce(1 / (F.lit(float(c)) + F.col(r) + 1), F.lit(0.0))
            both = a.join(b, key, "full_outer").withColumn("__score", part("__a") + part("__b"))
            order = [F.col("__score").desc(), F.col("__a").asc_nulls_last(), F.col("__b").asc_nulls_last(), F.col(key)]
            top = both.orderBy(*order).limit(k)
            return df.join(top.withColumn("__rank", F.row_number().over(Window.orderBy(*order)) - 1).select(key, "__rank"), key)

        return arms[0][0], best

    # -- the whole query ---------------------------------------------------
    def read(self, q: Query) -> DataFrame:
        self.declared = dict(q.params)
        self.named = self.properties([q.match, q.returns, q.order])
        scope = Scope()
        for c in q.match:
            if isinstance(c, Binding):
                scope.types[c.var] = self.catalog.node(c.type) or fail("T1", f"unknown node type {c.type}")
        for c in q.match:
            if isinstance(c, Traversal):
                self.check_traversal(scope, c)
        rank = None
        if q.order and q.order[0][0].op in RANKS:
            e = q.order[0][0]
            if q.limit is None and e.op in ("nearest", "rrf"):
                fail("T17" if e.op == "nearest" else "T21", f"{e.op} needs a limit")
            t = lambda v: scope.types.get(v) or fail("T6", f"${v} is not bound")
            rank = self.fused(e, q.limit, t) if e.op == "rrf" else self.arm(e, q.limit if e.op == "nearest" else None, t)
        df = self.block(q.match, scope, None, rank)
        return self.tail(q, scope, df, rank is not None)

    def tail(self, q: Query, scope: Scope, df: DataFrame, ranked: bool) -> DataFrame:
        names = [alias or self.default(e) for e, alias in q.returns]
        if any(e.op in AGGREGATES for e, _ in q.returns):
            keys, aggs = [], []
            for (e, _), n in zip(q.returns, names, strict=True):
                if e.op in AGGREGATES:
                    aggs.append(self.aggregate(scope, e).alias(n))
                elif e.op in ("prop", "var") and (e.op == "prop" or e.args[0] in scope.types):
                    self.kind(scope, e)
                    keys.append(self.value(scope, e).alias(n))
                else:
                    fail("T9", "group keys are properties or variables")
            out = (df.groupBy(*keys) if keys else df).agg(*aggs).select(*[F.col(f"`{n}`") for n in names])
            key_names = [n for (e, _), n in zip(q.returns, names, strict=True) if e.op not in AGGREGATES]
            order = []
            for e, down in q.order if not ranked else ():
                n = e.args[0] if e.op == "alias" else next((n for (x, _), n in zip(q.returns, names, strict=True) if x == e), None)
                if n not in names:
                    fail("T6", "order names no result column")
                order.append(F.col(f"`{n}`").desc() if down else F.col(f"`{n}`").asc())
            if order or ranked or q.limit is not None:
                out = out.orderBy(*order, *[F.col(f"`{n}`") for n in key_names])
            return out if q.limit is None else out.limit(q.limit)
        cols = []
        for (e, _), n in zip(q.returns, names, strict=True):
            self.kind(scope, e)
            cols.append(self.value(scope, e).alias(n))
        order = [F.col("__rank")] if ranked else []
        aliases = {n: self.value(scope, e) for (e, _), n in zip(q.returns, names, strict=True)}
        for e, down in q.order[1:] if ranked else q.order:
            if e.op == "alias":
                c = aliases.get(e.args[0])
                if c is None:
                    fail("T6", f"order names no result column {e.args[0]}")
            else:
                self.kind(scope, e)
                c = self.value(scope, e)
            order.append(c.desc() if down else c.asc())
        if order or q.limit is not None:
            # ids of all variables make the order total
            df = df.orderBy(*order, *[F.col(f"{v}__id") for v in sorted(scope.types) if f"{v}__id" in df.columns])
            if q.limit is not None:
                df = df.limit(q.limit)
        return df.select(*cols)

    def aggregate(self, scope: Scope, e: Expr) -> Column:
        x = e.args[0]
        if x.op not in ("prop", "var"):
            fail("T8", "aggregates take a property or a variable")
        k, c = self.kind(scope, x), self.value(scope, x)
        if e.op == "count":
            return F.count(c)
        if e.op in ("sum", "avg"):
            if not k or k.list or k.scalar not in NUMERIC:
                fail("T8", f"{e.op} needs a number")
            return (F.sum if e.op == "sum" else F.avg)(c.cast("double"))
        if not k or k.list or k.scalar not in NUMERIC | {"String"}:
            fail("T8", f"{e.op} needs a number or a string")
        return (F.min if e.op == "min" else F.max)(c)

    @staticmethod
    def default(e: Expr) -> str:
        if e.op in AGGREGATES:
            return Compiler.default(e.args[0])
        return {"prop": ".".join(map(str, e.args)), "var": str(e.args[0]) if e.args else ""}.get(e.op, "literal")
