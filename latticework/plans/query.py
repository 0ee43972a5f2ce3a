"""The query language: syntax tree and parser."""

from __future__ import annotations

from dataclasses import dataclass, field

from .lexer import ParseError, Tokens

AGGREGATES = ("count", "sum", "avg", "min", "max")


@dataclass(frozen=True)
class Expr:
    """op: prop, var, lit, now, alias, an aggregate, or a search function."""

    op: str
    args: tuple = ()


@dataclass
class Binding:
    var: str
    type: str
    props: list[tuple[str, Expr]]


@dataclass
class Traversal:
    src: str
    edge: str
    dst: str
    low: int = 1
    high: int | None = 1
    undirected: bool = False
    var: str | None = None
    bounded: bool = False


@dataclass
class Filter:
    left: Expr
    op: str
    right: Expr


@dataclass
class Negation:
    clauses: list


@dataclass
class Query:
    name: str
    params: dict[str, tuple[str, bool]]
    notes: dict[str, str] = field(default_factory=dict)
    match: list = field(default_factory=list)
    returns: list[tuple[Expr, str | None]] = field(default_factory=list)
    order: list[tuple[Expr, bool]] = field(default_factory=list)
    limit: int | None = None
    mutations: list[tuple] = field(default_factory=list)


def literal(t: Tokens) -> Expr:
    kind, text = t.peek()
    if kind == "string":
        return Expr("lit", ("String", t.string()))
    if kind in ("int", "float"):
        t.next()
        return Expr("lit", ("I64", int(text)) if kind == "int" else ("F64", float(text)))
    if text in ("true", "false"):
        t.next()
        return Expr("lit", ("Bool", text == "true"))
    if text in ("date", "datetime") and t.peek(1)[1] == "(":
        t.next()
        t.next()
        value = t.string()
        t.expect(")")
        return Expr("lit", ("Date" if text == "date" else "DateTime", value))
    if text == "[":
        t.next()
        items = []
        while not t.accept("]"):
            items.append(literal(t))
            t.accept(",")
        return Expr("lit", ("List", tuple(items)))
    raise ParseError(f"expected a value, found {text!r}")


def expression(t: Tokens) -> Expr:
    kind, text = t.peek()
    if kind == "var":
        t.next()
        if t.peek()[1] == "." and t.peek(1)[0] == "word":
            t.next()
            return Expr("prop", (text[1:], t.take("word")))
        return Expr("var", (text[1:],))
    if kind == "word" and t.peek(1)[1] == "(" and text not in ("date", "datetime"):
        t.next()
        t.next()
        args = []
        while not t.accept(")"):
            args.append(expression(t))
            t.accept(",")
        arity = {"now": (0,), "search": (2,), "match_text": (2,), "fuzzy": (2, 3), "bm25": (2,), "nearest": (2,), "rrf": (2, 3)} | dict.fromkeys(AGGREGATES, (1,))
        if text not in arity or len(args) not in arity[text]:
            raise ParseError(f"unknown function or wrong number of arguments: {text}")
        if text == "nearest" and args[0].op != "prop":
            raise ParseError("nearest ranks a property")
        return Expr(text, tuple(args))
    if kind == "word" and text not in ("true", "false", "date", "datetime"):
        t.next()
        return Expr("alias", (text,))
    return literal(t)


def _clause(t: Tokens):
    kind, text = t.peek()
    if text == "not" and t.peek(1)[1] == "{":
        t.next()
        return Negation(_block(t))
    if kind == "word" and text in ("search", "fuzzy", "match_text") and t.peek(1)[1] == "(":
        e = expression(t)
        if t.peek()[1] not in ("=", "!="):
            return Filter(e, "=", Expr("lit", ("Bool", True)))
        return Filter(e, t.next()[1], expression(t))
    if kind == "var":
        nk, nt = t.peek(1)
        if nt == ":" and t.peek(2)[0] == "word" and t.peek(2)[1][0].isupper():
            t.next()
            t.next()
            out = Binding(text[1:], t.name(True), [])
            if t.accept("{"):
                while not t.accept("}"):
                    p = t.name(False)
                    t.expect(":")
                    out.props.append((p, expression(t)))
                    t.accept(",")
            return out
        edge = None
        save = t.at
        if nk == "word" and nt[0].islower() or nt == "<" and t.peek(2)[0] == "word" and t.peek(3)[1] == ">":
            edge = ""
        elif nk == "var" and t.peek(2)[1] == ":":
            edge = nt[1:]
        if edge is not None:
            t.next()
            if edge:
                t.next()
                t.next()
            undirected = t.accept("<")
            name = t.name(False)
            if undirected:
                t.expect(">")
            low, high, bounded = 1, 1, False
            if t.accept("{"):
                low, bounded = int(t.take("int")), True
                t.expect(",")
                high = int(t.take("int")) if t.peek()[0] == "int" else None
                t.expect("}")
            if t.peek()[0] == "var" and not (t.peek(1)[1] == "."):
                return Traversal(text[1:], name, t.take("var")[1:], low, high, undirected, edge or None, bounded)
            t.at = save
    left = expression(t)
    op = t.next()[1]
    if op not in (">=", "<=", "!=", ">", "<", "=", "contains", "starts_with"):
        raise ParseError(f"expected a comparison, found {op!r}")
    return Filter(left, op, expression(t))


def _block(t: Tokens) -> list:
    t.expect("{")
    out = [_clause(t)]
    while not t.accept("}"):
        out.append(_clause(t))
    return out


def _mutation(t: Tokens) -> tuple:
    what = t.take("word")
    name = t.name(True)

    def assigned() -> dict:
        t.expect("{")
        out = {}
        while not t.accept("}"):
            k = t.take("word")
            t.expect(":")
            out[k] = expression(t)
            t.accept(",")
        return out

    def predicate() -> tuple:
        t.expect("where")
        k, op = t.take("word"), t.next()[1]
        if op not in (">=", "<=", "!=", ">", "<", "="):
            raise ParseError(f"expected a comparison, found {op!r}")
        return k, op, expression(t)

    if what == "insert":
        return "insert", name, assigned(), None
    if what == "update":
        t.expect("set")
        values = assigned()
        return "update", name, values, predicate()
    if what == "delete":
        return "delete", name, {}, predicate()
    raise ParseError(f"unknown statement {what!r}")


def parse_queries(source: str) -> dict[str, Query]:
    """All queries of a file by name."""
    t, out = Tokens(source), {}
    while t.peek()[0] != "end":
        t.expect("query")
        q = Query(t.take("word"), {})
        t.expect("(")
        while not t.accept(")"):
            var = t.take("var")[1:]
            t.expect(":")
            kind = ""
            if t.accept("["):
                kind = f"[{t.name(True)}]"
                t.expect("]")
            else:
                kind = t.name(True)
                if kind == "Vector":
                    t.expect("(")
                    kind = f"Vector({t.take('int')})"
                    t.expect(")")
            q.params[var] = (kind, t.accept("?"))
            t.accept(",")
        while t.accept("@"):
            note = t.take("word")
            if note not in ("description", "instruction") or note in q.notes:
                raise ParseError(f"unknown or repeated annotation {note}")
            t.expect("(")
            q.notes[note] = t.string()
            t.expect(")")
        t.expect("{")
        if t.accept("match"):
            q.match = _block(t)
            t.expect("return")
            t.expect("{")
            while not t.accept("}"):
                e = expression(t)
                q.returns.append((e, t.take("word") if t.accept("as") else None))
                t.accept(",")
            if not q.returns:
                raise ParseError("return needs a projection")
            if t.accept("order"):
                t.expect("{")
                while not t.accept("}"):
                    e = expression(t)
                    down = t.accept("desc") or (t.accept("asc") and False)
                    q.order.append((e, down))
                    t.accept(",")
            if t.accept("limit"):
                q.limit = int(t.take("int"))
            t.expect("}")
        else:
            while not t.accept("}"):
                q.mutations.append(_mutation(t))
            if not q.mutations:
                raise ParseError("an empty query")
        if q.name in out:
            raise ParseError(f"query {q.name} is declared twice")
        out[q.name] = q
    return out
