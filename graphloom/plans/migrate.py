"""Comparing schemas, planning a migration and applying it as one commit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.errors import StorageError
from graphloom.plans.schema import Catalog, EdgeType, NodeType, Prop, parse_schema
from graphloom.sources.store import Store, Version

SAFE, CONFIRM, BLOCKED = "safe", "confirm", "blocked"
#: Changes of type that lose nothing.
WIDENING = {("I32", "I64"), ("U32", "U64"), ("U32", "I64"), ("F32", "F64")}


@dataclass(frozen=True)
class Step:
    kind: str
    target: str
    safety: str
    detail: str = ""


def _renames(old: dict, new: dict) -> dict[str, str]:
    """New name to old name, of what is new and says where it comes from."""
    return {n: t.renamed_from for n, t in new.items() if t.renamed_from and t.renamed_from in old and n not in old}


def steps(old: Catalog, new: Catalog, has_rows=lambda name: True, count=lambda name, condition: 0) -> list[Step]:
    """What leads from one catalog to the other. ``has_rows(table)`` and ``count(table, condition)`` look at the data."""
    out: list[Step] = []
    for kind, a, b in (("node", old.nodes, new.nodes), ("edge", old.edges, new.edges)):
        renamed = _renames(a, b)
        title = kind.title()
        for name in b:
            if name in a or name in renamed:
                if name in renamed:
                    out.append(Step("RenameType", f"{kind}:{name}", SAFE, f"from {renamed[name]}"))
                out += _props(kind, a[renamed.get(name, name)], b[name], has_rows, count, {v: k for k, v in renamed.items()} if kind == "node" else {}, old, new)
            else:
                out.append(Step(f"Add{title}Type", f"{kind}:{name}", SAFE))
        for name in a:
            if name not in b and name not in renamed.values():
                out.append(Step(f"Drop{title}Type", f"{kind}:{name}", CONFIRM if has_rows(f"{kind}:{name}") else SAFE, f'if it was renamed, mark the new type @rename_from("{name}")'))
    return out


def _props(kind: str, a: NodeType | EdgeType, b: NodeType | EdgeType, has_rows, count, moved: dict, old: Catalog, new: Catalog) -> list[Step]:
    table, out = f"{kind}:{a.name}", []
    where = f"{kind}:{b.name}"
    renamed = _renames(a.props, b.props)
    if isinstance(a, EdgeType):
        was = _renames(old.nodes, new.nodes)
        if (a.source, a.target) != (was.get(b.source, b.source), was.get(b.target, b.target)):
            out.append(Step("RebindEdgeEndpoints", where, BLOCKED if has_rows(table) else SAFE, f"{b.source} -> {b.target}"))
    if (a.description, a.instruction) != (b.description, b.instruction):
        out.append(Step("AlterMetadata", where, SAFE))
    for n, p in b.props.items():
        at = f"{where}.{n}"
        if n not in a.props and n not in renamed:
            ok = p.type.nullable or not has_rows(table)
            out.append(Step("AddProperty", at, SAFE if ok else BLOCKED, "" if ok else "a required property needs values"))
            continue
        o = a.props[renamed.get(n, n)]
        if n in renamed:
            out.append(Step("RenameProperty", at, SAFE, f"from {o.name}"))
        out += _alter(table, at, o, p, has_rows, count)
    for n in a.props:
        if n not in b.props and n not in renamed.values():
            out.append(Step("DropProperty", f"{where}.{n}", CONFIRM if has_rows(table) else SAFE, f'if it was renamed, mark the new property @rename_from("{n}")'))
    return out


def _alter(table: str, at: str, o: Prop, p: Prop, has_rows, count) -> list[Step]:
    out, a, b = [], o.type, p.type
    present = lambda: count(table, F.col(o.name).isNotNull()) > 0
    if (a.scalar, a.list, a.dim) != (b.scalar, b.list, b.dim):
        plain = not a.list and not b.list and not a.vector and not b.vector
        safe = plain and (a.scalar, b.scalar) in WIDENING
        out.append(Step("AlterPropertyType", at, SAFE if safe else BLOCKED if present() else CONFIRM, f"{a} to {b}"))
    if a.enum != b.enum:
        lost = sorted(set(a.enum) - set(b.enum)) if b.enum and a.enum else []
        if b.enum and not a.enum:
            bad = count(table, F.col(o.name).isNotNull() & ~F.col(o.name).isin(*b.enum)) > 0
        else:
            bad = bool(lost) and count(table, F.col(o.name).isin(*lost)) > 0
        out.append(Step("AlterPropertyEnumValues", at, BLOCKED if bad else SAFE, ", ".join(b.enum)))
    if a.nullable != b.nullable:
        bad = not b.nullable and count(table, F.col(o.name).isNull()) > 0
        out.append(Step("AlterPropertyNullability", at, BLOCKED if bad else SAFE))
    for mark, kind in (("key", "AlterPropertyKey"), ("unique", "AlterPropertyUnique"), ("index", "AlterPropertyIndex")):
        if getattr(o, mark) == getattr(p, mark):
            continue
        safety = SAFE
        if mark != "index" and getattr(p, mark) and has_rows(table):
            safety = BLOCKED if count(table, ("twice", o.name)) > 0 else SAFE
        elif mark == "key":
            safety = CONFIRM if has_rows(table) else SAFE
        out.append(Step(kind, at, safety, f"{getattr(o, mark)} to {getattr(p, mark)}"))
    if (o.embed, o.media, o.description) != (p.embed, p.media, p.description):
        out.append(Step("AlterMetadata", at, SAFE))
    return out


def diff(old_source: str, new_source: str) -> tuple[str, list[Step]]:
    """The kind of a change of schema (additive, compatible_with_confirmation, breaking, blocked) and its steps, without data."""
    all_steps = steps(parse_schema(old_source), parse_schema(new_source), lambda t: True, lambda t, c: 1)
    if any(s.kind in ("RebindEdgeEndpoints",) for s in all_steps):
        return "blocked", all_steps
    if any(s.safety == BLOCKED for s in all_steps):
        return "breaking", all_steps
    if any(s.safety == CONFIRM for s in all_steps):
        return "compatible_with_confirmation", all_steps
    return "additive", all_steps


def plan(store: Store, new_source: str, v: Version | None = None) -> list[Step]:
    v = v or store.version()

    def count(table: str, condition) -> int:
        df = store.table(v, table)
        if isinstance(condition, tuple):
            return df.filter(F.col(condition[1]).isNotNull()).groupBy(condition[1]).count().filter("count > 1").limit(1).count()
        return df.filter(condition).limit(1).count()

    return steps(v.catalog, parse_schema(new_source), lambda t: bool(store.table(v, t).take(1)), count)


def migrate(store: Store, new_source: str, *, confirm: bool = False, dry_run: bool = False) -> list[Step]:
    """Plan and apply. Blocked goes before unconfirmed, that before a dry run; nothing is written in these cases."""
    base = store.version()
    todo = plan(store, new_source, base)
    if bad := [s for s in todo if s.safety == BLOCKED]:
        raise StorageError(f"blocked: {bad[0].kind} {bad[0].target} {bad[0].detail}")
    if not confirm and (bad := [s for s in todo if s.safety == CONFIRM]):
        raise StorageError(f"needs confirmation: {bad[0].kind} {bad[0].target} {bad[0].detail}")
    if dry_run or (not todo and new_source == base.schema):
        return todo
    new = parse_schema(new_source)
    tables: dict[str, list[str]] = {}
    for kind, a, b in (("node", base.catalog.nodes, new.nodes), ("edge", base.catalog.edges, new.edges)):
        renamed = _renames(a, b)
        for name, t in b.items():
            source = renamed.get(name, name)
            if source not in a:
                tables[f"{kind}:{name}"] = []
                continue
            old_t = a[source]
            if source == name and [(p.name, p.type.spark()) for p in old_t.props.values()] == [(p.name, p.type.spark()) for p in t.props.values()]:
                continue  # what is stored fits as it is
            df = store.table(base, f"{kind}:{source}")
            tables[f"{kind}:{name}"] = [store.write(f"{kind}:{name}", _converted(df, old_t, t, kind))]
        for name in a:
            if name not in b:
                tables[f"{kind}:{name}"] = []
    store.commit(base, tables, summary="migrate", schema=new_source, changes=store.spark.createDataFrame([], "change_kind string, entity_kind string, type_name string, entity_id bigint, logical_key string, row string"))
    return todo


def _converted(df: DataFrame, a: NodeType | EdgeType, b: NodeType | EdgeType, kind: str) -> DataFrame:
    renamed = _renames(a.props, b.props)
    cols = [F.col(c) for c in (("id",) if kind == "node" else ("id", "src", "dst"))]
    for n, p in b.props.items():
        o = renamed.get(n, n)
        if o not in a.props:
            cols.append(F.lit(None).cast(p.type.spark()).alias(n))
        elif a.props[o].type.list == p.type.list and a.props[o].type.vector == p.type.vector:
            cols.append(F.col(o).cast(p.type.spark()).alias(n))
        else:
            cols.append(F.lit(None).cast(p.type.spark()).alias(n))
    return df.select(*cols)
