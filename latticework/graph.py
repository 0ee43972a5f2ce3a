"""The engine's front: one object for loading, querying, changing, branching, comparing and merging a graph."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators import integrity, pages, versions
from .plans.compile import Compiler, Scope
from .plans.lexer import TypeCheckError
from .plans.query import Expr, Filter, Query, parse_queries
from .plans.schema import Catalog, EntityType, parse_schema, plan_migration
from .sources import records
from .storage import any_row, at_once, cut, numbered
from .store import Commit, Conflict, Store

MODES = ("append", "merge", "overwrite")


class ResourceLimit(ValueError):
    """A mutation over the limit that the graph was opened with."""


class IntegrityError(ValueError):
    """A write that would break a rule; `kind` names it."""

    def __init__(self, kind: str, message: str):
        super().__init__(f"{kind}: {message}")
        self.kind = kind


#: how many conflicts of a merge an error lists; all of them are in a DataFrame
PREVIEW = 1000


#: what a change has, and the order of changes: nodes before edges, then by type and id
CHANGE_COLUMNS = ["kind", "type", "id", "op", "before", "after"]
CHANGE_ORDER = lambda: (F.col("kind") == "edge", F.col("type"), F.col("id"))


class MergeConflicts(ValueError):
    """conflicts: the first of them (type, id, kind), PREVIEW at most; total: how many there are; found: type, id, conflict of each, None if a rule was broken."""

    def __init__(self, conflicts: list[tuple[str, str, str]], total: int = 1, found: DataFrame | None = None):
        super().__init__(f"{total} conflicts, first {conflicts[0]}")
        self.conflicts, self.total, self.found = conflicts, total, found


@dataclass
class Result:
    commit: str | None
    nodes: int = 0
    edges: int = 0


@dataclass
class Pending:
    """What a write does to one type: rows to put, ids to take away; replace: all others go; stored: where the store has the rows already."""

    rows: DataFrame | None = None
    gone: DataFrame | None = None
    replace: bool = False
    stored: str | None = None


@dataclass
class Draft:
    """A write in progress over one commit."""

    graph: Graph
    base: Commit
    catalog: Catalog
    parts: dict[str, Pending] = field(default_factory=dict)

    def committed(self, name: str) -> DataFrame:
        return self.graph.store.table(self.base.tables.get(name, []), self.catalog.types[name].struct)

    def current(self, name: str) -> DataFrame:
        """Committed rows under the pending ones."""
        p = self.parts.get(name)
        if p is None:
            return self.committed(name)
        out = self.committed(name).limit(0) if p.replace else self.committed(name)
        if p.gone is not None:
            out = out.join(p.gone, "id", "left_anti").select(*out.columns)
        return versions.shadow(out, p.rows) if p.rows is not None else out

    def put(self, name: str, rows: DataFrame) -> None:
        """Later rows replace earlier ones with their ids."""
        p = self.parts.setdefault(name, Pending())
        p.rows, p.stored = rows if p.rows is None else versions.shadow(p.rows, rows), None

    def take(self, name: str, ids: DataFrame) -> None:
        p = self.parts.setdefault(name, Pending())
        p.gone = ids if p.gone is None else p.gone.union(ids).distinct()
        if p.rows is not None:
            p.rows, p.stored = p.rows.join(ids, "id", "left_anti").select(*p.rows.columns), None

    # -- rules -------------------------------------------------------------
    def validate(self) -> None:
        """Values, then keys and unique properties, then edge ends, then cardinality; raises for the first violation."""
        types, checks = [self.catalog.types[n] for n in self.parts], []

        def refuse(kind: str, t: EntityType, df: DataFrame) -> None:
            checks.append((kind, t, df))

        for t in types:
            if (rows := self.parts[t.name].rows) is not None:
                refuse("Value", t, integrity.bad_values(rows, t))
        for t in sorted(types, key=lambda t: t.kind == "edge"):
            rows, p = self.parts[t.name].rows, self.parts[t.name]
            if rows is None:
                continue
            refuse("Unique", t, integrity.duplicates(rows, ("id",)))
            for cols in {*t.unique} - {(), t.key}:  # ids are made of keys: keys are unique if ids are
                refuse("Unique", t, integrity.duplicates(rows, cols))
                if p.replace or not self.base.tables.get(t.name):
                    continue
                others = self.committed(t.name).join(rows.select("id"), "id", "left_anti")
                if p.gone is not None:
                    others = others.join(p.gone, "id", "left_anti")
                refuse("Unique", t, rows.dropna(subset=list(cols)).join(others.select(*cols), list(cols), "left_semi").select("id", *cols))
        for t in self.catalog.types.values():
            if t.kind != "edge":
                continue
            mine = self.parts.get(t.name)
            lost = {n for n in (t.src, t.dst) if n in self.parts and (self.parts[n].gone is not None or self.parts[n].replace)}
            edges = self.current(t.name) if lost else mine.rows if mine else None
            if edges is not None:
                refuse("OrphanEdge", t, integrity.orphans(edges, self.current(t.src), self.current(t.dst)).select("id", "src", "dst", "missing"))
        for t in types:
            p = self.parts[t.name]
            if t.kind != "edge" or not t.card or t.card == (0, None):
                continue
            touched = [x.select("src") for x in (p.rows, *([self.committed(t.name).join(y, "id", "left_semi") for y in (p.gone, p.rows) if y is not None] if self.base.tables.get(t.name) else [])) if x is not None]
            if not touched:
                continue
            affected = touched[0]
            for x in touched[1:]:
                affected = affected.union(x)
            alive = affected.join(self.current(t.src).select(F.col("id").alias("src")), "src", "left_semi")
            refuse("Cardinality", t, integrity.cardinality(self.current(t.name), alive, *t.card))
        found = at_once(self.graph.spark, [lambda df=df: any_row(df) for _, _, df in checks])
        for (kind, t, _), bad in zip(checks, found, strict=True):
            if bad is not None:
                raise IntegrityError(kind, f"{t.name}: {bad.asDict()}")

    def layers(self) -> dict[str, list[dict]]:
        """Write the parts; the commit's tables."""
        out, store, writes = dict(self.base.tables), self.graph.store, []
        for name, p in self.parts.items():
            layer = {"data": p.stored, "gone": None}
            below = [] if p.replace else out.get(name, [])
            ids = [x.select("id") for x in (p.rows, p.gone) if x is not None]
            if p.rows is not None and not p.stored:
                writes.append((layer, "data", p.rows, name))
            if below and ids:
                writes.append((layer, "gone", ids[0] if len(ids) == 1 else ids[0].union(ids[1]).distinct(), f"{name}.gone"))
            out[name] = [*below, layer]
        names = at_once(self.graph.spark, [lambda df=df, name=name: store.write(df, name) for _, _, df, name in writes])
        for (layer, part, _, _), name in zip(writes, names, strict=True):
            layer[part] = name
        return out


class Graph:
    """A graph in a folder that all executors can read."""

    def __init__(self, spark: SparkSession, root: str, embed=None, mutation_rows: int | None = None):
        """embed: text and dimension to a vector.  mutation_rows: how many rows of a type one mutation may write; None for no limit."""
        self.spark, self.store, self.embed, self.mutation_rows = spark, Store(spark, root), embed, mutation_rows
        if not self.store.latest()[1]:
            raise FileNotFoundError(f"no graph in {root}")

    @classmethod
    def init(cls, spark: SparkSession, root: str, schema: str, **how) -> Graph:
        parse_schema(schema)
        store = Store(spark, root)
        if store.latest()[1]:
            raise FileExistsError(root)
        store.commit("main", [], schema, {}, None, {"op": "init"})
        return cls(spark, root, **how)

    # -- commits and branches ----------------------------------------------
    def commit_at(self, target: str | int = "main") -> Commit:
        """By branch name, commit id or manifest version."""
        commits = self.store.commits()
        _, branches = self.store.latest()
        if isinstance(target, int):
            m = self.store.manifests()[target]
            return commits[m["commit"]["id"] if m["commit"] else m["branches"]["main"]]
        found = branches.get(target, target)
        if found not in commits:
            raise KeyError(f"no branch or commit {target}")
        return commits[found]

    def branches(self) -> dict[str, str]:
        return self.store.latest()[1]

    def branch_create(self, name: str, source: str | int = "main") -> None:
        """A new branch shares all data until it is written to."""
        start = self.commit_at(source).id

        def change(version: int, branches: dict) -> tuple[dict, None]:
            if name in branches:
                raise ValueError(f"branch {name} exists")
            return branches | {name: start}, None

        self.store.publish(change)

    def branch_delete(self, name: str) -> None:
        def change(version: int, branches: dict) -> tuple[dict, None]:
            if name == "main" or name not in branches:
                raise ValueError(f"branch {name} can't be deleted")
            return {k: v for k, v in branches.items() if k != name}, None

        self.store.publish(change)

    def commits(self, target: str | int = "main") -> list[Commit]:
        """The ancestors of a target, newest first."""
        all_, todo, seen = self.store.commits(), [self.commit_at(target).id], {}
        while todo:
            c = all_[todo.pop()]
            if c.id not in seen:
                seen[c.id] = c
                todo += c.parents
        return sorted(seen.values(), key=lambda c: -c.version)

    # -- reading -----------------------------------------------------------
    def catalog(self, target: str | int = "main") -> Catalog:
        return parse_schema(self.commit_at(target).schema)

    def table(self, name: str, target: str | int = "main") -> DataFrame:
        c = self.commit_at(target)
        return self.store.table(c.tables.get(name, []), parse_schema(c.schema).types[name].struct)

    def query(self, text: str, params: dict | None = None, name: str | None = None, target: str | int = "main") -> DataFrame:
        """A read query against a branch, commit or manifest version."""
        found = parse_queries(text)
        q = found[name] if name else next(iter(found.values()))
        c = self.commit_at(target)
        catalog = parse_schema(c.schema)
        how = {"embed": self.embed} if self.embed else {}
        return Compiler(catalog, lambda n: self.store.table(c.tables.get(n, []), catalog.types[n].struct), params, **how).read(q)

    def entity(self, type_name: str, id_: str, target: str | int = "main") -> dict | None:
        rows = self.table(type_name, target).where(F.col("id") == id_).head(1)
        return rows[0].asDict(recursive=True) if rows else None

    def blob(self, type_name: str, id_: str, prop: str, start: int = 0, length: int = 4 << 20, target: str | int = "main") -> bytes | None:
        """A range of one blob, four megabytes at most a call."""
        if not 0 <= length <= 4 << 20:
            raise ValueError("at most 4 MiB a call")
        rows = self.table(type_name, target).where(F.col("id") == id_).select(F.substring(f"`{prop}`", start + 1, length).alias("b")).head(1)
        return bytes(rows[0].b) if rows and rows[0].b is not None else None

    def export(self, target: str | int = "main", types: list[str] | None = None) -> DataFrame:
        """value: records of all types, nodes before edges."""
        catalog, out = self.catalog(target), None
        for t in sorted(catalog.types.values(), key=lambda t: (t.kind == "edge", t.name)):
            if types is None or t.name in types:
                part = records.to_records(self.table(t.name, target), t)
                out = part if out is None else out.union(part)
        return out

    # -- writing -----------------------------------------------------------
    def _draft(self, branch: str) -> Draft:
        c = self.commit_at(branch)
        return Draft(self, c, parse_schema(c.schema))

    def _finish(self, draft: Draft, branch: str, note: dict, parents: list[str] | None = None) -> Commit:
        draft.validate()
        return self.store.commit(branch, parents or [draft.base.id], draft.base.schema, draft.layers(), draft.base.id, note)

    def load(self, source: str | DataFrame, mode: str = "append", branch: str = "main", pretty: bool = False, note: dict | None = None) -> Result:
        """Records from a path, or a DataFrame with column value.  append: ids must be new; merge: by id; overwrite: the types that occur are replaced."""
        if mode not in MODES:
            raise ValueError(f"unknown mode {mode!r}")
        draft = self._draft(branch)
        found = records.staged(records.read_records(self.spark, source, pretty) if isinstance(source, str) else source.select("value"), draft.catalog)
        counts = {r[0]: r[1] for r in found.groupBy("name").count().collect()}  # a row per type
        if not counts:
            return Result(None)
        n = {"node": 0, "edge": 0}
        for name, many in counts.items():
            n[draft.catalog.types[name].kind] += many

        def put(name: str) -> Pending:
            """A type's rows in the store; generated ids must not change between check and commit."""
            t = draft.catalog.types[name]
            stored = self.store.write(records.entities(found, t), name)
            written.append(stored)
            wrong = any_row(self.store.rows(stored, T.StructType([T.StructField("id", T.StringType()), T.StructField("_wrong", T.StringType())])).where("_wrong is not null"))
            if wrong:
                raise records.RecordError(f"{name}: {wrong._wrong} has a value of another type in {wrong.id}")
            rows = self.store.rows(stored, T.StructType([T.StructField(f.name, f.dataType) for f in t.struct]))
            if mode == "append" and draft.base.tables.get(name):
                taken = any_row(rows.join(draft.committed(name).select("id"), "id", "left_semi").select("id"))
                if taken:
                    raise IntegrityError("key_conflict", f"{name} {taken.id} exists")
            return Pending(rows, replace=mode == "overwrite", stored=stored)

        written: list[str] = []
        try:
            draft.parts = dict(zip(counts, at_once(self.spark, [lambda name=name: put(name) for name in counts]), strict=True))
            return Result(self._finish(draft, branch, {"op": "load", "mode": mode} | (note or {})).id, n["node"], n["edge"])
        except (records.RecordError, IntegrityError):
            for x in written:  # refused: nothing refers to them
                self.store.delete(x)
            raise

    def ingest(self, source: str | DataFrame, branch: str, base: str = "main", mode: str = "merge", **how) -> Result:
        """load() into a branch that is made from base if it is missing."""
        if branch not in self.branches():
            self.branch_create(branch, base)
        return self.load(source, mode, branch, **how)

    def mutate(self, text: str, params: dict | None = None, name: str | None = None, branch: str = "main", expected_head: str | None = None) -> Result:
        """All statements of a mutation in order, each seeing those before it, as one commit; none if nothing changes."""
        found = parse_queries(text)
        q: Query = found[name] if name else next(iter(found.values()))
        kinds = {m[0] == "delete" for m in q.mutations}
        if len(kinds) != 1:
            raise TypeCheckError("T10", "a mutation either deletes or writes")
        draft = self._draft(branch)
        if expected_head is not None and draft.base.id != expected_head:
            raise Conflict(f"branch {branch} has moved")
        compiler = Compiler(draft.catalog, draft.current, params)
        compiler.declared = dict(q.params)
        n = {"node": 0, "edge": 0}
        for what, type_name, values, where in q.mutations:
            t = draft.catalog.types.get(type_name) or draft.catalog.edge(type_name)
            if t is None:
                raise TypeCheckError("T1" if what != "delete" else "T4", f"unknown type {type_name}")
            n[t.kind] += getattr(self, f"_{what}")(draft, compiler, t, values, where, n)
        if not any(n.values()):
            return Result(None)
        for part, p in draft.parts.items() if self.mutation_rows is not None else ():
            if p.rows is not None and len(p.rows.select("id").head(self.mutation_rows + 1)) > self.mutation_rows:
                raise ResourceLimit(f"{part}: more than {self.mutation_rows} rows in one mutation; load() has no limit")
        return Result(self._finish(draft, branch, {"op": "mutate", "query": q.name}).id, n["node"], n["edge"])

    def _values(self, compiler: Compiler, t: EntityType, values: dict[str, Expr]) -> dict:
        out = {}
        for p, e in values.items():
            if p not in t.props:
                raise TypeCheckError("T11", f"{t.name} has no property {p}")
            given = compiler.kind(Scope(), e)
            if given and not compiler.comparable(given, t.props[p]):
                raise TypeCheckError("T11", f"{t.name}.{p} can't hold this value")
            out[p] = compiler.constant(e)
            if t.props[p].scalar == "Vector" and isinstance(out[p], str):
                out[p] = compiler.embed(out[p], t.props[p].dim)
        return out

    def _insert(self, draft: Draft, compiler: Compiler, t: EntityType, values: dict, where, n: dict) -> int:
        given = dict(values)
        explicit = given.pop("id", None)
        ends = {}
        if t.kind == "edge":
            for word, column in (("from", "src"), ("to", "dst")):
                if word not in given:
                    raise TypeCheckError("T13", "an edge needs from and to")
                ends[column] = str(compiler.constant(given.pop(word)))
        row = self._values(compiler, t, given)
        for p, kind in t.props.items():
            if row.get(p) is None and not kind.nullable:
                raise TypeCheckError("T12", f"{t.name}.{p} is required")
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in t.struct])
        fit = lambda v, p: float(v) if p.scalar in ("F32", "F64") and v is not None and not p.list else [float(x) for x in v] if p.scalar == "Vector" and v is not None else v
        made = str(compiler.constant(explicit)) if explicit is not None else uuid.uuid4().hex
        df = self.spark.createDataFrame([(made, *ends.values(), *[fit(row.get(p), k) for p, k in t.props.items()])], schema)
        if t.key:
            df = df.withColumn("id", records.derived_id(t))
        elif explicit is not None and draft.current(t.name).where(F.col("id") == made).head(1):
            raise IntegrityError("key_conflict", f"{t.name} {made} exists")
        draft.put(t.name, df.select(*schema.names))
        return 1

    def _predicate(self, compiler: Compiler, t: EntityType, where: tuple):
        prop, op, e = where
        column = {"from": "src", "to": "dst"}.get(prop, prop) if t.kind == "edge" else prop
        scope = Scope({"x": t})
        test = compiler.condition(scope, Filter(Expr("prop", ("x", column)), op, e))
        return lambda df: df.select(*[F.col(f"`{c}`").alias(f"x__{c}") for c in df.columns]).where(test).select(*[F.col(f"x__{c}").alias(c) for c in df.columns])

    def _update(self, draft: Draft, compiler: Compiler, t: EntityType, values: dict, where, n: dict) -> int:
        if t.kind == "edge":
            raise TypeCheckError("T16", "edges can't be updated")
        new = self._values(compiler, t, values)
        if set(new) & set(t.key):
            raise TypeCheckError("T14", "a key can't change")
        hit = self._predicate(compiler, t, where)(draft.current(t.name))
        changed = {p: F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v)) for p, v in new.items()}
        hit = cut(hit.select(*[changed[c].cast(t.props[c].spark).alias(c) if c in changed else F.col(f"`{c}`") for c in hit.columns]))
        many = hit.count()
        if many:
            draft.put(t.name, hit)
        return many

    def _delete(self, draft: Draft, compiler: Compiler, t: EntityType, values: dict, where, n: dict) -> int:
        ids = cut(self._predicate(compiler, t, where)(draft.current(t.name)).select("id"))
        many = ids.count()
        if not many:
            return 0
        if t.kind == "node":  # its edges go with it
            for e in draft.catalog.types.values():
                for column, end in (("src", e.src), ("dst", e.dst)):
                    if e.kind == "edge" and end == t.name:
                        hang = cut(draft.current(e.name).join(ids.select(F.col("id").alias(column)), column, "left_semi").select("id"))
                        if lost := hang.count():
                            n["edge"] += lost
                            draft.take(e.name, hang)
        draft.take(t.name, ids)
        return many

    # -- comparing ---------------------------------------------------------
    def _changes(self, a: Commit, b: Commit) -> DataFrame | None:
        """kind, type, id, op, before, after (JSON) between two commits of one schema."""
        out = None
        catalog = parse_schema(b.schema)
        for t in catalog.types.values():
            if a.tables.get(t.name, []) == b.tables.get(t.name, []):
                continue
            mine, theirs = a.tables.get(t.name, []), b.tables.get(t.name, [])
            sides = [self.store.table(x, t.struct) for x in (mine, theirs)]
            same = next((k for k, (x, y) in enumerate(zip(mine, theirs, strict=False)) if x != y), min(len(mine), len(theirs)))
            if same:  # only what the layers above the common ones name can differ
                ids = self.store.touched([*mine[same:], *theirs[same:]])
                sides = [s.join(ids, "id", "left_semi") for s in sides]
            d = versions.diff(*sides)
            part = d.select(F.lit(t.kind).alias("kind"), F.lit(t.name).alias("type"), "id", "op", F.to_json("before").alias("before"), F.to_json("after").alias("after"))
            out = part if out is None else out.union(part)
        return out

    def diff(self, a: str | int, b: str | int, kinds: list[str] | None = None, types: list[str] | None = None, ops: list[str] | None = None) -> DataFrame:
        """Net changes from a to b, nodes before edges, then by type and id."""
        return self._diff(a, b, kinds, types, ops).orderBy(*CHANGE_ORDER())

    def _diff(self, a: str | int, b: str | int, kinds: list[str] | None = None, types: list[str] | None = None, ops: list[str] | None = None) -> DataFrame:
        ca, cb = self.commit_at(a), self.commit_at(b)
        if ca.schema != cb.schema:
            raise ValueError("the schema changed between these commits")
        out = self._changes(ca, cb)
        if out is None:
            return self.spark.createDataFrame([], ", ".join(f"{x} string" for x in CHANGE_COLUMNS))
        for column, wanted in (("kind", kinds), ("type", types), ("op", ops)):
            if wanted is not None:
                out = out.where(F.col(column).isin(*wanted))
        return out

    def commit_changes(self, commit: str) -> DataFrame:
        """What a commit changed, against its first parent."""
        c = self.commit_at(commit)
        return self.diff(c.parents[0], c.id)

    def commit_changes_page(self, commit: str, token: str | None = None, max_rows: int = 1000, max_bytes: int = 4 << 20) -> tuple[list[dict], str | None]:
        """A page of a commit's changes, ordered by kind (nodes first), type and id, and the token of the next page, None behind the last.

        A page ends at max_rows rows or before the row that would exceed max_bytes of JSON images; it has one row at least.
        """
        changes = self.commit_changes(commit)
        if token is not None:
            kind, type_name, id_ = json.loads(token)
            at = F.struct((F.col("kind") == "edge").alias("k"), F.col("type").alias("t"), F.col("id").alias("i"))
            changes = changes.where(at > F.struct(F.lit(kind == "edge"), F.lit(type_name), F.lit(id_)))
        found, size, page = changes.orderBy(*CHANGE_ORDER()).limit(max_rows + 1).collect(), 0, []
        for r in found[:max_rows]:
            size += len(r.before or "") + len(r.after or "")
            if page and size > max_bytes:
                break
            page.append(r.asDict())
        last = page[-1] if page and len(page) < len(found) else None
        return page, json.dumps([last["kind"], last["type"], last["id"]]) if last else None

    def commit_changes_pages(self, commit: str, max_rows: int = 1000, max_bytes: int = 4 << 20) -> DataFrame:
        """page, from 0, kind, type, id, op, before, after: all pages as commit_changes_page() gives them one by one; the changes are compared and sorted once."""
        c = self.commit_at(commit)
        found = numbered(self._diff(c.parents[0], c.id), "_n", *CHANGE_ORDER())
        size = F.coalesce(F.length("before"), F.lit(0)) + F.coalesce(F.length("after"), F.lit(0))
        return pages.paged(found.withColumn("_size", size), "_n", "_size", max_rows, max_bytes).select("page", *CHANGE_COLUMNS)

    def cursor(self, branch: str = "main") -> str:
        """Where a feed that starts now begins: poll() after it gives later commits only."""
        return self.commit_at(branch).id

    def poll(self, after: str | None = None, branch: str = "main", max_commits: int = 128) -> list[tuple[str, DataFrame]]:
        """The next commits of a branch's first-parent chain after a cursor (None: from the beginning), oldest first, with their changes; the last id is the next cursor."""
        all_, chain, c = self.store.commits(), [], self.commit_at(branch)
        while c.id != after:
            chain.append(c)
            if not c.parents:
                if after is not None:
                    raise KeyError(f"{after} is not in the history of {branch}")
                break
            c = all_[c.parents[0]]
        wanted = [c for c in chain[::-1] if c.parents][: min(max_commits, 512)]
        return [(c.id, self.commit_changes(c.id)) for c in wanted]

    def baseline(self, branch: str = "main") -> tuple[str, DataFrame]:
        """A cursor and all records as of it: poll() goes on from there."""
        head = self.commit_at(branch).id
        return head, self.export(head)

    def merge_base(self, a: str, b: str) -> Commit | None:
        """The common ancestor with the least sum of distances, the newest of several."""
        all_ = self.store.commits()

        def distances(start: str) -> dict[str, int]:
            out, edge = {start: 0}, [start]
            while edge:
                edge = [p for c in edge for p in all_[c].parents if p not in out and not out.update({p: out[c] + 1})]
            return out

        da, db = distances(a), distances(b)
        return min((all_[x] for x in da.keys() & db.keys()), key=lambda c: (da[c.id] + db[c.id], -c.version), default=None)

    def merge(self, source: str, target: str = "main") -> str:
        """AlreadyUpToDate, FastForward or Merged; MergeConflicts and nothing written if any entity conflicts."""
        s, t = self.commit_at(source), self.commit_at(target)
        base = self.merge_base(s.id, t.id)
        if base is None:
            raise ValueError("no common ancestor")
        if base.id == s.id:
            return "AlreadyUpToDate"
        if base.id == t.id:

            def change(version: int, branches: dict) -> tuple[dict, None]:
                if branches[target] != t.id:
                    raise Conflict(f"branch {target} has moved")
                return branches | {target: s.id}, None

            self.store.publish(change)
            return "FastForward"
        if not base.schema == s.schema == t.schema:
            raise ValueError("the schema changed since the branches parted")
        draft, conflicts = self._draft(target), []
        for x in draft.catalog.types.values():
            sides = [c.tables.get(x.name, []) for c in (base, t, s)]
            if sides[2] in sides[:2]:
                continue
            both = cut(versions.merge(*(self.store.table(layers, x.struct) for layers in sides), changed_only=True))
            conflicts.append(both.where("conflict is not null").select(F.lit(x.name).alias("type"), "id", "conflict"))
            draft.parts[x.name] = Pending(both.where("row is not null").select("row.*"), both.where("row is null").select("id"))
        found = reduce(DataFrame.union, conflicts) if conflicts else None
        if found is not None and (total := found.count()):
            raise MergeConflicts([tuple(r) for r in found.orderBy("type", "id").limit(PREVIEW).collect()], total, found)
        try:
            self._finish(draft, target, {"op": "merge", "source": source}, [t.id, s.id])
        except IntegrityError as e:
            raise MergeConflicts([(e.kind, str(e), e.kind)]) from e
        return "Merged"

    # -- schema and maintenance ----------------------------------------------
    def schema_apply(self, schema: str, allow_drop: bool = False) -> list[tuple]:
        """Migrate main; refused while other branches exist, or if a step can't be done."""
        if set(self.branches()) != {"main"}:
            raise ValueError("delete the other branches first")
        draft = self._draft("main")
        new = parse_schema(schema)
        steps = plan_migration(draft.catalog, new)
        bad = [s for s in steps if s[0] == "Unsupported" or s[0].startswith("Drop") and not allow_drop]
        if bad:
            raise ValueError(f"refused: {bad[0]}")
        moved = {s[2]: s[1] for s in steps if s[0] == "RenameType"}
        tables = {}
        for n, t in new.types.items():
            before = moved.get(n, n)
            layers = draft.base.tables.get(before, [])
            names = {s[3]: s[2] for s in steps if s[0] == "RenameProperty" and s[1] == n}
            dropped = any(s[0] == "DropProperty" and s[1] == n for s in steps)
            if layers and (names or dropped):
                old = self.store.table(layers, draft.catalog.types[before].struct)
                ends = ["src", "dst"] if t.kind == "edge" else []
                have = draft.catalog.types[before].props
                cols = [F.col(f"`{names.get(p, p)}`").alias(p) for p in t.props if names.get(p, p) in have]
                layers = [{"data": self.store.write(old.select("id", *ends, *cols), n), "gone": None}]
            if layers:
                tables[n] = layers
            added = {s[2] for s in steps if s[0] == "AddConstraint" and s[1] == n}
            if layers and added:  # rows that are there must keep to the new rules
                rows = self.store.table(layers, t.struct)
                broken = [("Unique", integrity.duplicates(rows, s[3])) for s in steps if s[:3] == ("AddConstraint", n, "unique")]
                if added & {"range", "check"}:
                    broken.append(("Value", integrity.bad_values(rows, t)))
                if "card" in added:
                    sources = self.store.table(draft.base.tables.get(moved.get(t.src, t.src), []), new.types[t.src].struct).select(F.col("id").alias("src"))
                    broken.append(("Cardinality", integrity.cardinality(rows, sources, *t.card)))
                for kind, df in broken:
                    if bad_row := df.head(1):
                        raise IntegrityError(kind, f"{n}: {bad_row[0].asDict()}")
        self.store.commit("main", [draft.base.id], schema, tables, draft.base.id, {"op": "schema"})
        return steps

    def optimize(self, branch: str = "main", rows_per_file: int = 5_000_000) -> list[str]:
        """Fold the layers of each type with several into one, in files of about rows_per_file rows."""
        c = self.commit_at(branch)
        catalog, tables, done = parse_schema(c.schema), dict(c.tables), []
        for n, layers in c.tables.items():
            if len(layers) > 1:
                df = self.store.table(layers, catalog.types[n].struct)
                name = f"data/{n}/{uuid.uuid4().hex}"
                df.write.option("maxRecordsPerFile", rows_per_file).parquet(f"{self.store.root}/{name}")
                tables[n] = [{"data": name, "gone": None}]
                done.append(n)
        if done:
            self.store.commit(branch, [c.id], c.schema, tables, c.id, {"op": "optimize"})
        return done

    def ensure_indices(self, target: str | int = "main") -> list[dict]:
        """type, property, kind, built: the indexes that the schema asks for.  Parquet's own statistics prune scans and searches are exact, so none has to be built."""
        kinds = {"String": "text", "Vector": "vector", "Blob": None}
        asked = lambda t: sorted({c for cols in (t.key, *t.unique, *t.index) for c in cols} | ({"src", "dst"} if t.kind == "edge" else set()))
        of = lambda t, c: "ordered" if c in ("src", "dst") or c in t.key else kinds.get(t.props[c].scalar, "ordered")
        return [{"type": t.name, "property": c, "kind": of(t, c), "built": False} for t in self.catalog(target).types.values() for c in asked(t) if of(t, c)]

    def cleanup(self, keep_versions: int | None = 10, older_than: dt.timedelta | None = None) -> list[str]:
        """Delete data that no branch head refers to, nor one of the newest keep_versions commits, nor one that is younger than older_than."""
        if keep_versions is None and older_than is None:
            raise ValueError("keep_versions or older_than is needed")
        commits = self.store.commits()
        newest = sorted(commits.values(), key=lambda c: -c.version)
        since = dt.datetime.now(dt.UTC) - older_than if older_than is not None else None
        young = [c for c in newest if since and dt.datetime.fromisoformat(c.time) >= since]
        kept = [*newest[: max(1, keep_versions or 0)], *young, *(commits[x] for x in self.branches().values())]
        used = {f for c in kept for layers in c.tables.values() for x in layers for f in x.values() if f}
        gone = [f for f in self.store.folders() if f not in used]
        for f in gone:
            self.store.delete(f)
        return gone
