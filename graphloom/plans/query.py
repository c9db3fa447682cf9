"""The query language: parser and tree."""

from __future__ import annotations

from dataclasses import dataclass, field

from graphloom.errors import ParseError
from graphloom.plans.lexer import Reader
from graphloom.plans.schema import parse_type
from graphloom.plans.types import PropType

AGGREGATES = ("count", "sum", "avg", "min", "max")
COMPARE = (">=", "<=", "!=", ">", "<", "=")


@dataclass(frozen=True)
class Lit:
    kind: str  # String, I64, F64, Bool, Date, DateTime, List
    value: object


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class PropRef:
    var: str
    prop: str


@dataclass(frozen=True)
class Now:
    pass


@dataclass(frozen=True)
class Alias:
    name: str


@dataclass(frozen=True)
class Call:
    """search, fuzzy, match_text, bm25, nearest, rrf or an aggregate."""

    name: str
    args: tuple


@dataclass(frozen=True)
class Binding:
    var: str
    type: str
    props: tuple[tuple[str, object], ...] = ()


@dataclass(frozen=True)
class Traversal:
    src: str
    edge: str
    dst: str
    low: int = 1
    high: int | None = 1


@dataclass(frozen=True)
class Filter:
    left: object
    op: str
    right: object


@dataclass(frozen=True)
class Negation:
    clauses: tuple


@dataclass(frozen=True)
class Projection:
    expr: object
    alias: str | None = None


@dataclass(frozen=True)
class Ordering:
    expr: object
    desc: bool = False


@dataclass(frozen=True)
class Read:
    clauses: tuple
    projections: tuple[Projection, ...]
    order: tuple[Ordering, ...] = ()
    limit: int | None = None


@dataclass(frozen=True)
class Predicate:
    prop: str
    op: str  # a comparison, "is null" or "is not null"
    value: object = None


@dataclass(frozen=True)
class Mutation:
    verb: str  # insert, put, update, delete
    type: str
    assignments: tuple[tuple[str, object], ...] = ()
    where: tuple[Predicate, ...] = ()


@dataclass(frozen=True)
class Query:
    name: str
    params: dict[str, PropType] = field(hash=False)
    body: Read | Mutation = None
    description: str | None = None
    instruction: str | None = None


def parse_queries(source: str) -> dict[str, Query]:
    r, out = Reader(source), {}
    while r.now.kind != "end":
        q = _query(r)
        if q.name in out:
            raise ParseError(f"query {q.name} is declared twice")
        out[q.name] = q
    return out


def _query(r: Reader) -> Query:
    r.need("query")
    name = r.kind("ident", "a query name")
    r.need("(")
    params: dict[str, PropType] = {}
    while not r.take(")"):
        if params:
            r.need(",")
        var = r.kind("var", "a parameter")[1:]
        r.need(":")
        if var in params:
            raise r.error(f"parameter ${var} stands twice")
        params[var] = parse_type(r, scalars_only=True)
    marks: dict[str, str] = {}
    while r.take("@"):
        mark = r.kind("ident")
        if mark not in ("description", "instruction") or mark in marks:
            raise r.error(f"unexpected @{mark}")
        r.need("(")
        marks[mark] = r.string()
        r.need(")")
    r.need("{")
    body = _read(r) if r.is_("match") else _mutation(r)
    r.need("}")
    return Query(name, params, body, **marks)


def _read(r: Reader) -> Read:
    r.need("match")
    clauses = _clauses(r)
    r.need("return")
    r.need("{")
    projections = []
    while not r.take("}"):
        expr = _expr(r)
        alias = r.kind("ident", "an alias") if r.take("as") else None
        projections.append(Projection(expr, alias))
        r.take(",")
    if not projections:
        raise r.error("return needs a projection")
    order = []
    if r.take("order"):
        r.need("{")
        while True:
            if r.is_("nearest"):
                order.append(Ordering(_expr(r)))
            else:
                expr = _expr(r)
                desc = r.take("desc")
                if not desc:
                    r.take("asc")
                order.append(Ordering(expr, desc))
            if not r.take(","):
                break
        r.need("}")
    limit = int(r.kind("int")) if r.take("limit") else None
    return Read(clauses, tuple(projections), tuple(order), limit)


def _clauses(r: Reader) -> tuple:
    r.need("{")
    out = []
    while not r.take("}"):
        out.append(_clause(r))
    if not out:
        raise r.error("expected a clause")
    return tuple(out)


def _clause(r: Reader):
    if r.is_("not") and r.peek().text == "{":
        r.need("not")
        return Negation(_clauses(r))
    if r.now.kind == "var":
        after = r.peek()
        if after.text == ":":
            return _binding(r)
        if after.kind == "ident" and after.text not in ("not", "contains"):
            return _traversal(r)
        if after.text == "contains" and after.kind == "ident" and r.peek(2).kind == "var" and r.peek(3).text not in (".",):
            return _traversal(r)
    left = _expr(r)
    if r.take("contains"):
        return Filter(left, "contains", _expr(r))
    for op in COMPARE:
        if r.take(op):
            return Filter(left, op, _expr(r))
    if isinstance(left, Call) and left.name in ("search", "fuzzy", "match_text"):
        return Filter(left, "=", Lit("Bool", True))
    raise r.error("expected a comparison")


def _binding(r: Reader) -> Binding:
    var = r.kind("var")[1:]
    r.need(":")
    name = r.kind("type", "a node type")
    props = []
    if r.take("{"):
        while not r.take("}"):
            if props:
                r.need(",")
                if r.take("}"):
                    break
            prop = r.kind("ident", "a property")
            r.need(":")
            props.append((prop, _match_value(r)))
        if not props:
            raise r.error("expected a property")
    return Binding(var, name, tuple(props))


def _traversal(r: Reader) -> Traversal:
    src = r.kind("var")[1:]
    edge = r.kind("ident")
    low, high = 1, 1
    if r.take("{"):
        low = int(r.kind("int"))
        r.need(",")
        high = int(r.kind("int")) if r.now.kind == "int" else None
        r.need("}")
    return Traversal(src, edge, r.kind("var", "a variable")[1:], low, high)


def _match_value(r: Reader):
    if r.now.kind == "var":
        return Var(r.kind("var")[1:])
    if r.is_("now"):
        return _expr(r)
    return _literal(r)


def _literal(r: Reader) -> Lit:
    t = r.now
    if t.kind == "string":
        return Lit("String", r.string())
    if t.kind == "float":
        return Lit("F64", float(r.kind("float")))
    if t.kind == "int":
        return Lit("I64", int(r.kind("int")))
    if r.take("["):
        items: list[Lit] = []
        while not r.take("]"):
            if items:
                r.need(",")
            items.append(_literal(r))
        return Lit("List", tuple(items))
    if r.is_("true", "false"):
        r.at += 1
        return Lit("Bool", t.text == "true")
    if r.is_("date", "datetime") and r.peek().text == "(":
        r.at += 1
        r.need("(")
        text = r.string()
        r.need(")")
        return Lit("Date" if t.text == "date" else "DateTime", text)
    raise r.error(f"expected a value, found {t.text or 'the end'!r}")


_ARITY = {"search": (2, 2), "fuzzy": (2, 3), "match_text": (2, 2), "bm25": (2, 2), "nearest": (2, 2), "rrf": (2, 3)}


def _expr(r: Reader):
    t = r.now
    if t.kind == "var":
        name = r.kind("var")[1:]
        if r.take("."):
            return PropRef(name, r.kind("ident", "a property"))
        return Var(name)
    if t.kind == "ident" and r.peek().text == "(":
        if t.text == "now":
            r.at += 1
            r.need("(")
            r.need(")")
            return Now()
        if t.text in AGGREGATES:
            r.at += 1
            r.need("(")
            arg = _expr(r)
            r.need(")")
            return Call(t.text, (arg,))
        if t.text in _ARITY:
            r.at += 1
            r.need("(")
            args = [_expr(r)]
            while r.take(","):
                args.append(_expr(r))
            r.need(")")
            low, high = _ARITY[t.text]
            if not low <= len(args) <= high:
                raise r.error(f"{t.text} takes {low} to {high} arguments")
            if t.text == "nearest" and not isinstance(args[0], PropRef):
                raise r.error("nearest needs a property")
            if t.text == "rrf" and not all(isinstance(a, Call) and a.name in ("nearest", "bm25") for a in args[:2]):
                raise r.error("rrf joins nearest and bm25")
            return Call(t.text, tuple(args))
    if t.kind == "ident" and t.text not in ("true", "false", "date", "datetime"):
        r.at += 1
        return Alias(t.text)
    return _literal(r)


def _mutation(r: Reader) -> Mutation:
    for verb in ("insert", "put", "update", "delete"):
        if r.take(verb):
            break
    else:
        raise r.error("expected match, insert, put, update or delete")
    name = r.kind("type", "a type name")
    if verb in ("insert", "put"):
        return Mutation(verb, name, _assignments(r))
    assignments = ()
    if verb == "update":
        r.need("set")
        assignments = _assignments(r)
    r.need("where")
    if r.take("{"):
        where = []
        while not r.take("}"):
            where.append(_predicate(r))
        if not where:
            raise r.error("expected a predicate")
    else:
        where = [_predicate(r)]
    return Mutation(verb, name, assignments, tuple(where))


def _assignments(r: Reader) -> tuple:
    r.need("{")
    out = []
    while not r.take("}"):
        prop = r.kind("ident", "a property")
        r.need(":")
        out.append((prop, _match_value(r)))
        r.take(",")
    if not out:
        raise r.error("expected an assignment")
    return tuple(out)


def _predicate(r: Reader) -> Predicate:
    prop = r.kind("ident", "a property")
    if r.take("is"):
        negated = r.take("not")
        r.need("null")
        return Predicate(prop, "is not null" if negated else "is null")
    for op in COMPARE:
        if r.take(op):
            return Predicate(prop, op, _match_value(r))
    raise r.error("expected a comparison")
