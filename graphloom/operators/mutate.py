"""Inserts, upserts, updates and deletes of a graph, each one commit.

A table is a list of folders. An insert adds a folder; an update or delete rewrites only the folders in which a row
matches (``_metadata.file_path`` names them), so a small change to a large table costs its folders with hits.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.errors import ConstraintError
from graphloom.functions.vector import mock_embedding
from graphloom.plans import query as Q
from graphloom.plans.params import literal
from graphloom.plans.schema import EdgeType, NodeType
from graphloom.plans.typecheck import coerced
from graphloom.plans.types import PropType
from graphloom.sources.store import Store, folder, image
from graphloom.util import small_or_plain


@dataclass(frozen=True)
class Affected:
    affected_nodes: int = 0
    affected_edges: int = 0
    matched_nodes: int = 0


class Mutator:
    def __init__(self, store: Store, params: dict, now: dt.datetime, embed=mock_embedding):
        self.store, self.params, self.now, self.embed = store, params, now, embed
        self.base = store.version()
        self.cat = self.base.catalog

    def run(self, m: Q.Mutation) -> Affected:
        if m.type in self.cat.nodes:
            t = self.cat.nodes[m.type]
            return {"insert": self.insert_node, "put": self.put_node, "update": self.update_node, "delete": self.delete_node}[m.verb](m, t)
        e = self.cat.edges[m.type]
        return self.delete_edge(m, e) if m.verb == "delete" else self.put_edge(m, e)

    # -- values and predicates

    def values(self, m: Q.Mutation, t: NodeType | EdgeType) -> dict[str, object]:
        out = {p: coerced(v, t.props[p].type, self.params, self.now) for p, v in m.assignments if p in t.props}
        return out

    def row(self, t: NodeType | EdgeType, ids: dict[str, int], values: dict[str, object]) -> DataFrame:
        if isinstance(t, NodeType):
            for p in t.props.values():
                if p.embed and values.get(p.name) is None and values.get(p.embed) is not None:
                    values[p.name] = self.embed(values[p.embed], p.type.dim)
        cols = [F.lit(i).cast("bigint").alias(c) for c, i in ids.items()]
        cols += [(literal(values[p.name], p.type) if values.get(p.name) is not None else F.lit(None).cast(p.type.spark())).alias(p.name) for p in t.props.values()]
        return self.store.spark.range(0, 1, 1, 1).select(*cols)

    def condition(self, where: tuple[Q.Predicate, ...], t: NodeType | EdgeType) -> Column:
        """All predicates, in three-valued logic: only TRUE matches."""
        out = F.lit(True)
        for w in where:
            if w.prop not in t.props:
                continue
            c, pt = F.col(w.prop), t.props[w.prop].type
            if w.op == "is null":
                out = out & c.isNull()
            elif w.op == "is not null":
                out = out & c.isNotNull()
            else:
                v = literal(coerced(w.value, pt, self.params, self.now), PropType(pt.scalar))
                out = out & {"=": c == v, "!=": c != v, "<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v}[w.op]
        return F.coalesce(out, F.lit(False))

    def token(self, value) -> str:
        raw = self.params[value.name] if isinstance(value, Q.Var) else value.value
        return str(raw)

    def endpoint(self, type_name: str, value) -> int | None:
        t = self.cat.nodes[type_name]
        if t.key is None:
            raise ConstraintError(f"{type_name} has no @key to refer to")
        hit = self.store.table(self.base, f"node:{type_name}").filter(F.col(t.key).cast("string") == self.token(value)).select("id").take(1)
        return hit[0][0] if hit else None

    def split(self, name: str, condition: Column) -> tuple[list[str], list[str], int]:
        """The table's folders without and with matching rows, and how many rows match."""
        paths = self.base.tables.get(name, [])
        if not paths:
            return [], [], 0
        hits = dict(tuple(r) for r in self.store.table(self.base, name).filter(condition).groupBy(folder()).count().collect())
        return [p for p in paths if p not in hits], [p for p in paths if p in hits], sum(hits.values())

    def part(self, name: str, paths: list[str]) -> DataFrame:
        return self.store.part(self.base, name, paths)

    def unique(self, t: NodeType, values: dict[str, object], except_id: int | None = None) -> None:
        old = self.store.table(self.base, f"node:{t.name}")
        for prop in t.unique:
            if values.get(prop) is not None:
                c = F.col(prop) == literal(values[prop], PropType(t.props[prop].type.scalar))
                if except_id is not None:
                    c = c & (F.col("id") != except_id)
                if old.filter(c).take(1):
                    raise ConstraintError(f"{t.name}.{prop}: {values[prop]!r} is there already")

    def commit(self, tables: dict, summary: str, changes: DataFrame, **ids) -> None:
        self.store.commit(self.base, tables, summary=summary, changes=changes, **ids)

    # -- nodes

    def insert_node(self, m: Q.Mutation, t: NodeType) -> Affected:
        values = self.values(m, t)
        self.unique(t, values)
        new = self.row(t, {"id": self.base.next_node}, values)
        name = f"node:{t.name}"
        self.commit({name: [*self.base.tables.get(name, []), self.store.write(name, new)]}, f"insert {t.name}", image("node", t.name, new, "insert"), next_node=self.base.next_node + 1)
        return Affected(1, 0, 0)

    def put_node(self, m: Q.Mutation, t: NodeType) -> Affected:
        """The row with this key is replaced whole and keeps its id; properties not named become null."""
        values, name = self.values(m, t), f"node:{t.name}"
        c = F.col(t.key) == literal(values[t.key], PropType(t.props[t.key].type.scalar))
        old = self.store.table(self.base, name).filter(c).select("id").take(1)
        self.unique(t, {k: v for k, v in values.items() if k != t.key} if old else values, old[0][0] if old else None)
        i = old[0][0] if old else self.base.next_node
        new = self.row(t, {"id": i}, values)
        keep, touched, _ = self.split(name, c)
        paths = list(keep)
        if touched:
            paths.append(self.store.write(name, self.part(name, touched).filter(~c).unionByName(new)))
        else:
            paths.append(self.store.write(name, new))
        self.commit({name: paths}, f"put {t.name}", image("node", t.name, new, "update" if old else "insert"), next_node=max(self.base.next_node, i + 1))
        return Affected(1, 0, 1)

    def update_node(self, m: Q.Mutation, t: NodeType) -> Affected:
        values, name = self.values(m, t), f"node:{t.name}"
        c = self.condition(m.where, t)
        keep, touched, n = self.split(name, c)
        if not n:
            return Affected()
        for prop in t.unique:
            if prop in values and n > 1:
                raise ConstraintError(f"{t.name}.{prop} would be the same in {n} rows")
        if n == 1 and set(t.unique) & set(values):
            i = self.store.table(self.base, name).filter(c).select("id").first()[0]
            self.unique(t, values, i)
        for p in t.props.values():
            if p.embed in values and p.name not in values and values[p.embed] is not None:
                values[p.name] = self.embed(values[p.embed], p.type.dim)
        old = self.part(name, touched)
        value = {p.name: literal(values[p.name], p.type) if values[p.name] is not None else F.lit(None).cast(p.type.spark()) for p in t.props.values() if p.name in values}
        new = old.select("id", *[F.when(c, value[p]).otherwise(F.col(p)).alias(p) if p in value else F.col(p) for p in t.props])
        written = self.store.write(name, new)
        after = old.filter(c).select("id", *[value[p].alias(p) if p in value else F.col(p) for p in t.props])
        self.commit({name: [*keep, written]}, f"update {t.name}", image("node", t.name, after, "update"))
        return Affected(n, 0, n)

    def delete_node(self, m: Q.Mutation, t: NodeType) -> Affected:
        """The rows and all edges at them, in both directions."""
        name, c = f"node:{t.name}", self.condition(m.where, t)
        keep, touched, n = self.split(name, c)
        if not touched:
            return Affected()
        old = self.part(name, touched)
        gone = old.filter(c)
        tables = {name: [*keep, self.store.write(name, old.filter(~c))]}
        changes, edges = image("node", t.name, gone, "delete"), 0
        ids = small_or_plain(gone.select(F.col("id").alias("_gone")), 100_000)
        for e in self.cat.edges.values():
            edge = f"edge:{e.name}"
            paths = self.base.tables.get(edge, [])
            if t.name not in (e.source, e.target) or not paths:
                continue
            # Each edge with whether an end of it is gone; only folders that lose an edge are written again.
            marked = self.store.table(self.base, edge).withColumn("_folder", folder())
            lost = F.lit(False)
            for side, end in (("src", e.source), ("dst", e.target)):
                if end == t.name:
                    marked = marked.join(ids.withColumnRenamed("_gone", f"_{side}"), F.col(side) == F.col(f"_{side}"), "left")
                    lost = lost | F.col(f"_{side}").isNotNull()
            hits = dict(tuple(r) for r in marked.filter(lost).groupBy("_folder").count().collect())
            if not hits:
                continue
            here = marked.filter(F.col("_folder").isin(*hits)) if len(hits) < len(paths) else marked
            columns = self.store.table(self.base, edge).columns
            tables[edge] = [*[p for p in paths if p not in hits], self.store.write(edge, here.filter(~lost).select(*columns))]
            changes = changes.unionByName(image("edge", e.name, here.filter(lost).select(*columns), "delete"))
            edges += sum(hits.values())
        self.commit(tables, f"delete {t.name}", changes)
        return Affected(n, edges, n)

    # -- edges

    def put_edge(self, m: Q.Mutation, e: EdgeType) -> Affected:
        """One row per (from, to): an edge that is there is overwritten and keeps its id."""
        given = dict(m.assignments)
        ends = {}
        for side, c, t in (("from", "src", e.source), ("to", "dst", e.target)):
            ends[c] = self.endpoint(t, given[side])
            if ends[c] is None:
                raise ConstraintError(f"{e.name}: no {t} with key {self.token(given[side])!r}")
        name = f"edge:{e.name}"
        c = (F.col("src") == ends["src"]) & (F.col("dst") == ends["dst"])
        old = self.store.table(self.base, name).filter(c).select("id").take(1)
        i = old[0][0] if old else self.base.next_edge
        new = self.row(e, {"id": i, **ends}, self.values(m, e))
        keep, touched, _ = self.split(name, c)
        rest = self.part(name, touched).filter(~c).unionByName(new) if touched else new
        self.commit({name: [*keep, self.store.write(name, rest)]}, f"{m.verb} {e.name}", image("edge", e.name, new, "update" if old else "insert"), next_edge=max(self.base.next_edge, i + 1))
        return Affected(0, 1, 1 if m.verb == "put" else 0)

    def delete_edge(self, m: Q.Mutation, e: EdgeType) -> Affected:
        c = self.condition(m.where, e)
        for w in m.where:
            if w.prop in ("from", "to"):
                col, t = ("src", e.source) if w.prop == "from" else ("dst", e.target)
                i = self.endpoint(t, w.value)
                if w.op == "=":
                    if i is None:
                        return Affected()
                    c = c & (F.col(col) == i)
                elif w.op == "!=":
                    c = c & (F.col(col) != i) if i is not None else c
                else:
                    raise ConstraintError(f"{e.name}: {w.prop} can be compared with = and != only")
        name = f"edge:{e.name}"
        keep, touched, n = self.split(name, c)
        if not touched:
            return Affected()
        old = self.part(name, touched)
        gone = old.filter(c)
        self.commit({name: [*keep, self.store.write(name, old.filter(~c))]}, f"delete {e.name}", image("edge", e.name, gone, "delete"))
        return Affected(0, n, n)
