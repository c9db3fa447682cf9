"""From a checked query to a DataFrame.

The plan is declarative: scans, equi-joins on edges, anti-joins, aggregates. Pushdown, pruning, join strategy and
skew are Catalyst's and AQE's. What the planner adds is what they can't infer:

* hops are joined in the order of connectivity, not as written, so that no cross join appears where an edge connects;
* a node reached over an edge is joined to its table only if a property of it is used (endpoints exist by the store's
  rules);
* a bounded hop is computed on the distinct sources, level by level, and joined back;
* a negation between two scans that the match multiplies is computed from its own edges, and held by the rows of the larger
  scan before they are multiplied: the product is neither expanded, shuffled nor sorted;
* a score that is used twice is computed once;
* the right side of a comparison is cast to the left side's type, constants on the driver's side of the plan.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.errors import PlanError
from graphloom.functions import rank, text, vector
from graphloom.plans import query as Q
from graphloom.plans.params import literal
from graphloom.plans.schema import Catalog
from graphloom.plans.typecheck import Checked, Hop, Scope, coerced, is_aggregate, literal_type, variables
from graphloom.plans.types import PropType
from graphloom.util import materialize

#: Rows of a scan that is broadcast to be multiplied with another, where a negation stands between them.
MOST_BROADCAST = 100_000


class Lazy(dict):
    """Tables made when they are first asked for: a query opens only what it reads."""

    def __getitem__(self, key):
        value = super().__getitem__(key)
        if not isinstance(value, DataFrame):
            self[key] = value = value()
        return value


@dataclass
class Graph:
    """A catalog with its tables: nodes with ``id`` and properties, edges with ``src``, ``dst`` and properties.

    ``simple``: names of edges known to have one row per (src, dst); other edges are made so when read.
    """

    catalog: Catalog
    nodes: dict[str, DataFrame]
    edges: dict[str, DataFrame]
    simple: set[str] = field(default_factory=set)
    #: Rows of edges before their pairs are made unique, for readers that drop repeats themselves.
    loose: dict[str, DataFrame] = field(default_factory=dict)
    #: Indexes of the tables: ``text(type, prop, tokens)`` and ``vectors(type, prop, target, k)`` give narrower tables, or None.
    indexes: object = None

    def pairs(self, edge: str) -> DataFrame:
        p = self.edges[edge].select("src", "dst")
        return p if edge in self.simple else p.distinct()

    def rows(self, edge: str) -> DataFrame:
        """The pairs, of which some may repeat."""
        return (self.loose if edge in self.loose else self.edges)[edge].select("src", "dst")

    def pairs_by(self, edge: str, at: str) -> DataFrame:
        """The pairs, made unique after the shuffle by ``at`` that a join on it needs anyway."""
        return self.pairs(edge) if edge in self.simple and edge not in self.loose else self.rows(edge).repartition(at).distinct()


def col(var: str, prop: str = "id") -> Column:
    return F.col(f"`{var}::{prop}`")


class Planner:
    def __init__(self, graph: Graph, checked: Checked, params: dict, now: dt.datetime, embed=vector.mock_embedding, approximate: bool | float = False):
        self.g, self.c, self.params, self.now, self.embed = graph, checked, params, now, embed
        self.approximate, self.narrowed = approximate, {}
        self.scores: dict[object, str] = {}
        #: By negation its column and the variable sought there; by variable the columns that its scan gets.
        self.folded: dict[int, tuple[str, str]] = {}
        self.held: dict[str, list[tuple[str, DataFrame]]] = {}
        self.small: set[str] = set()
        body: Q.Read = checked.query.body
        self.used: dict[str, set[str]] = {}
        for e in [*[p.expr for p in body.projections], *[o.expr for o in body.order]]:
            self.use(e, checked.scope)
        self.use_scope(checked.scope)
        # The same without what only scores read.
        whole, self.used = self.used, {}
        for e in [*[p.expr for p in body.projections], *[o.expr for o in body.order]]:
            self.use(e, checked.scope, scored=True)
        for f in checked.scope.filters:
            self.use(f.left, checked.scope, scored=True)
            self.use(f.right, checked.scope, scored=True)
        for n in checked.scope.negations:
            self.use_scope(n)
        self.unscored, self.used = self.used, whole

    # -- which properties are needed

    def use(self, e, scope: Scope, scored: bool = False) -> None:
        if isinstance(e, Q.PropRef):
            self.used.setdefault(e.var, set()).add(e.prop)
        elif isinstance(e, Q.Var) and e.name in scope.types and e.name not in self.c.query.params:
            self.used.setdefault(e.name, set()).add("*")
        elif isinstance(e, Q.Call) and not (scored and e.name in ("bm25", "nearest", "rrf")):
            for a in e.args:
                if not (e.name == "count" and isinstance(a, Q.Var)):
                    self.use(a, scope, scored)

    def use_scope(self, s: Scope) -> None:
        for b in s.bindings:
            self.used.setdefault(b.var, set()).update(p for p, _ in b.props)
        for f in s.filters:
            self.use(f.left, s)
            self.use(f.right, s)
        for n in s.negations:
            self.use_scope(n)

    def needs_table(self, var: str) -> bool:
        return bool(self.used.get(var, set()) - {"id"})

    # -- match

    def scan(self, var: str, type_name: str, s: Scope) -> DataFrame:
        t = self.g.catalog.nodes[type_name]
        df = self.narrowed.get(var, None)
        df = (self.g.nodes[type_name] if df is None else df).select(*[F.col(c).alias(f"{var}::{c}") for c in ("id", *t.props)])
        for b in s.bindings:
            if b.var == var:
                for prop, value in b.props:
                    df = df.filter(self.prop_match(var, prop, value, t.props[prop].type))
        if s is self.c.scope:
            for name, held in self.held.get(var, ()):
                df = df.join(held, col(var) == F.col(f"{name}_at"), "left").drop(f"{name}_at")
            if var in self.small:
                df = F.broadcast(df)
        return df

    def prop_match(self, var: str, prop: str, value, t: PropType) -> Column:
        if t.list and not (isinstance(value, Q.Lit) and value.kind == "List"):
            return F.coalesce(F.array_contains(col(var, prop), self.cast(value, PropType(t.scalar))), F.lit(False))
        return col(var, prop) == self.cast(value, t)

    def cast(self, value, t: PropType) -> Column:
        """A constant cast to type ``t``, as the right side of a comparison is; null where it can't be."""
        have, own = self.constant(value)
        if own.scalar == t.scalar and own.list == t.list:
            return have
        return have.try_cast(t.spark())

    def constant(self, value) -> tuple[Column, PropType]:
        if isinstance(value, Q.Now):
            t = PropType("DateTime")
            return literal(self.now, t), t
        if isinstance(value, Q.Var):
            t = self.c.query.params[value.name]
            return literal(self.params[value.name], t), t
        t = literal_type(value)
        return literal(coerced(value, t, self.params, self.now), t), t

    def match(self, s: Scope, df: DataFrame | None, bound: dict[str, str], exists: bool = False) -> tuple[DataFrame, dict[str, str]]:
        """Join a scope's bindings and hops onto ``df``, in order of connectivity. ``exists``: repeats of rows are dropped later."""
        bound = dict(bound)
        waiting = {b.var: b.type for b in s.bindings if b.var not in bound}
        for b in s.bindings:
            if b.var in bound:
                for prop, value in b.props:
                    df = df.filter(self.prop_match(b.var, prop, value, self.g.catalog.nodes[b.type].props[prop].type))

        def add(var: str, type_name: str) -> None:
            nonlocal df
            one = self.scan(var, type_name, s)
            df = one if df is None else df.join(one)
            bound[var] = type_name
            waiting.pop(var, None)

        hops = list(s.hops)
        while hops:
            h = next((h for h in hops if h.src in bound or h.dst in bound), None)
            if h is None:
                # A new component begins: at a bound variable of the match if there is one, else at the hop's source.
                h = next((h for h in hops if h.src in waiting or h.dst in waiting), hops[0])
                start = h.src if h.src in waiting or h.dst not in waiting else h.dst
                add(start, h.src_type if start == h.src else h.dst_type)
            hops.remove(h)
            df = self.expand(df, h, bound, waiting, s, exists)
        for var, t in list(waiting.items()):
            add(var, t)
        return df, bound

    def expand(self, df: DataFrame, h: Hop, bound: dict, waiting: dict, s: Scope, exists: bool = False) -> DataFrame:
        forward = h.src in bound
        here, there = (h.src, h.dst) if forward else (h.dst, h.src)
        there_type = h.dst_type if forward else h.src_type
        out = h.out if forward else not h.out
        steps = self.reach(df.select(col(here).alias("_from")).distinct(), h, out) if (h.low, h.high) != (1, 1) else self.step(h.edge, out, exists and there not in bound)
        if there in bound:
            return df.join(steps, (col(here) == F.col("_from")) & (col(there) == F.col("_to"))).drop("_from", "_to")
        df = df.join(steps, col(here) == F.col("_from")).drop("_from").withColumnRenamed("_to", f"{there}::id")
        bound[there] = there_type
        waiting.pop(there, None)
        if self.needs_table(there):
            nodes = self.scan(there, there_type, s).withColumnRenamed(f"{there}::id", "_id")
            df = df.join(nodes, col(there) == F.col("_id")).drop("_id")
        return df

    def step(self, edge: str, out: bool, by_from: bool = False) -> DataFrame:
        a, b = ("src", "dst") if out else ("dst", "src")
        return (self.g.pairs_by(edge, a) if by_from else self.g.pairs(edge)).select(F.col(a).alias("_from"), F.col(b).alias("_to"))

    def reach(self, sources: DataFrame, h: Hop, out: bool) -> DataFrame:
        """(_from, _to) pairs joined by a walk of low to high edges, each once."""
        edge = self.g.catalog.edges[h.edge]
        high = h.high if edge.source == edge.target else min(1, h.high)
        steps = self.step(h.edge, out)
        level = sources.join(steps, "_from").select("_from", "_to")
        found = [level] if h.low <= 1 else []
        nxt = steps.select(F.col("_from").alias("_mid"), F.col("_to").alias("_next"))
        for depth in range(2, high + 1):
            level = level.join(nxt, F.col("_to") == F.col("_mid")).select("_from", F.col("_next").alias("_to")).distinct()
            if depth % 4 == 0:
                level = materialize(level)  # the plan would double from here on
            if depth >= h.low:
                found.append(level)
        if not found:
            return level.filter("false")
        union = found[0]
        for f in found[1:]:
            union = union.union(f)
        return union.distinct() if len(found) > 1 else union

    # -- filters

    def pushable(self, f: Q.Filter) -> bool:
        """A property against a constant."""
        const = lambda e: isinstance(e, (Q.Lit, Q.Now)) or (isinstance(e, Q.Var) and e.name in self.c.query.params)
        return f.op != "contains" and ((isinstance(f.left, Q.PropRef) and const(f.right)) or (const(f.left) and isinstance(f.right, Q.PropRef)))

    def condition(self, f: Q.Filter, df: DataFrame) -> Column:
        left, op, right = f.left, f.op, f.right
        if self.pushable(f) and not isinstance(left, Q.PropRef):
            # The constant is cast to the property's type, on whichever side it stands.
            left, right = right, left
            op = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}.get(op, op)
        if op == "=" and right == Q.Lit("Bool", True) and isinstance(left, Q.Call):
            return self.value(left, df)
        a = self.value(left, df)
        if op == "contains":
            t = self.type(left)
            b = self.cast(right, PropType(t.scalar)) if not isinstance(right, (Q.PropRef, Q.Call)) else self.value(right, df).try_cast(PropType(t.scalar).spark())
            return F.coalesce(F.array_contains(a, b), F.lit(False))
        lt, rt = self.type(left), self.type(right)
        b = self.cast(right, lt) if isinstance(right, (Q.Lit, Q.Now)) or (isinstance(right, Q.Var) and right.name in self.c.query.params) else self.value(right, df)
        if isinstance(right, (Q.PropRef, Q.Call)) and lt.scalar != rt.scalar:
            b = b.try_cast(lt.spark())
        return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]

    def type(self, e) -> PropType:
        if isinstance(e, Q.PropRef):
            return PropType("U64") if e.prop == "id" else self.g.catalog.nodes[self.types[e.var]].props[e.prop].type
        if isinstance(e, Q.Call):
            return PropType("Bool" if e.name in ("search", "fuzzy", "match_text") else "F64")
        return self.constant(e)[1]

    def constant_text(self, e) -> str | None:
        if isinstance(e, Q.Lit):
            return e.value
        return self.params[e.name] if isinstance(e, Q.Var) and e.name in self.c.query.params else None

    def number(self, e) -> int:
        return int(e.value if isinstance(e, Q.Lit) else self.params[e.name])

    def value(self, e, df: DataFrame) -> Column:
        if isinstance(e, Q.PropRef):
            return col(e.var, e.prop)
        if isinstance(e, Q.Var) and e.name in self.types and e.name not in self.c.query.params:
            names = ["id", *self.g.catalog.nodes[self.types[e.name]].props]
            return F.struct(*[col(e.name, n).alias(n) for n in names])
        if isinstance(e, (Q.Lit, Q.Var, Q.Now)):
            return self.constant(e)[0]
        if e in self.scores:
            return F.col(f"`{self.scores[e]}`")
        if e.name in ("search", "match_text", "fuzzy"):
            q = self.constant_text(e.args[1])
            q = self.value(e.args[1], df) if q is None else q
            field_ = self.value(e.args[0], df)
            if e.name == "search":
                return text.search(field_, q)
            if e.name == "match_text":
                return text.match_text(field_, q)
            return text.fuzzy(field_, q, self.number(e.args[2]) if len(e.args) == 3 else None)
        raise PlanError(f"{e.name} can't stand here")

    # -- scores

    def calls(self, s: Scope) -> list[Q.Call]:
        """Ranking calls of the query, parts before wholes, each once."""
        out: list[Q.Call] = []

        def walk(e) -> None:
            if isinstance(e, Q.Call):
                for a in e.args:
                    walk(a)
                if e.name in ("bm25", "nearest", "rrf") and e not in out:
                    out.append(e)

        body: Q.Read = self.c.query.body
        for f in s.filters:
            walk(f.left)
            walk(f.right)
        for e in [*[p.expr for p in body.projections], *[o.expr for o in body.order]]:
            walk(e)
        return out

    def score(self, df: DataFrame, e: Q.Call, ids: list[str]) -> DataFrame:
        name = f"_score{len(self.scores)}"
        if e.name == "nearest":
            df = df.withColumn(name, vector.cosine_distance(self.value(e.args[0], df), self.target(e)))
        elif e.name == "bm25":
            q = self.constant_text(e.args[1])
            if q is None:
                raise PlanError("bm25 needs a constant query")
            df = text.bm25(df, self.value(e.args[0], df), q, name)
        else:
            k = self.number(e.args[2]) if len(e.args) == 3 else rank.RRF_K
            if k <= 0:
                raise PlanError("rrf: k must be greater than 0")
            ranks = []
            # Ranking keeps its rows: only what is still used goes in, not the texts and vectors that were scored.
            df = materialize(df.select(*[F.col(f"`{c}`") for c in df.columns if c in ids or c.startswith("_score") or self.later(c)]))
            for i, part in enumerate(e.args[:2]):
                c = F.col(self.scores[part])
                order = [c.asc_nulls_last() if part.name == "nearest" else c.desc_nulls_last(), *[F.col(f"`{x}`") for x in ids]]
                df = rank.global_rank(df, order, f"{name}_{i}")
                ranks.append(F.when(c.isNotNull(), F.col(f"{name}_{i}")))
            df = df.withColumn(name, rank.fuse(*ranks, F.lit(k))).drop(f"{name}_0", f"{name}_1")
        self.scores[e] = name
        return df

    def later(self, column: str) -> bool:
        """Whether a column of the match is used after the scores are there."""
        var, _, prop = column.partition("::")
        props = self.unscored.get(var, set())
        return prop in props or "*" in props

    # -- indexes

    def target(self, e: Q.Call) -> list[float]:
        q = e.args[1]
        t = [x.value for x in q.value] if isinstance(q, Q.Lit) and q.kind == "List" else self.params[q.name] if isinstance(q, Q.Var) else q.value
        if isinstance(t, str):
            t = self.embed(t, self.g.catalog.nodes[self.types[e.args[0].var]].props[e.args[0].prop].type.dim, role="query")
        return [float(x) for x in t]

    def use_indexes(self, s: Scope, body: Q.Read) -> None:
        """Scan only rows that an index leaves: of a text predicate always, of nearest where an approximation is asked for."""
        if self.g.indexes is None:
            return
        calls, own = {c.name for c in self.calls(s)}, {b.var: b.type for b in s.bindings}
        for f in s.filters:
            e = f.left
            # The rows of the match are the corpus of bm25: it needs them all.
            if isinstance(e, Q.Call) and e.name in ("search", "match_text") and (f.op, f.right) == ("=", Q.Lit("Bool", True)) and not calls & {"bm25", "rrf"}:
                at, q = e.args[0], self.constant_text(e.args[1])
                if isinstance(at, Q.PropRef) and at.var in own and at.var not in self.narrowed and q is not None:
                    found = self.g.indexes.text(own[at.var], at.prop, text.query_tokens(q))
                    if found is not None:
                        self.narrowed[at.var] = found
        first = body.order[0].expr if body.order else None
        plain = len(s.bindings) == 1 and not (s.bindings[0].props or s.hops or s.filters or s.negations) and calls == {"nearest"}
        if self.approximate and plain and body.limit and isinstance(first, Q.Call) and first.name == "nearest" and isinstance(first.args[0], Q.PropRef):
            b = s.bindings[0]
            found = self.g.indexes.vectors(b.type, first.args[0].prop, self.target(first), body.limit, None if self.approximate is True else self.approximate)
            if found is not None:
                self.narrowed[b.var] = found

    # -- negation

    def negate(self, df: DataFrame, n: Scope, bound: dict[str, str], tag: int) -> DataFrame:
        """Drop rows for which the inner block matches, correlated on every outer variable that it uses."""
        if tag in self.folded:
            name, v = self.folded[tag]
            return df.filter(~F.coalesce(F.array_contains(F.col(name), col(v)), F.lit(False))).drop(name)
        shared = sorted(self.mentioned(n) & set(bound))
        if not shared:
            raise PlanError("a negation must use a variable from outside")
        # Only the outer columns that the inner block reads, and each combination once.
        keys = [f"{v}::id" for v in shared]
        need = [c for c in df.columns if c.split("::")[0] in shared and (c in keys or c.split("::")[1] in self.used.get(c.split("::")[0], ()) or "*" in self.used.get(c.split("::")[0], ()))]
        outer = df.select(*[F.col(f"`{c}`") for c in need])
        if len(bound) > 1:  # the rows of one scan differ by their id
            outer = outer.dropDuplicates(keys)
        saved, self.types = self.types, {**bound, **n.types}
        first = self.direct(n, shared, bound) if tag < 10 else None
        inner, inner_bound = first or self.match(n, outer, {v: bound[v] for v in shared})
        for f in n.filters:
            inner = inner.filter(self.condition(f, inner))
        for i, m in enumerate(n.negations):
            inner = self.negate(inner, m, inner_bound, tag * 10 + i + 1)
        self.types = saved
        hit = inner.select(*[F.col(f"`{k}`").alias(f"_n{i}") for i, k in enumerate(keys)]).distinct()
        on = None
        for i, k in enumerate(keys):
            c = F.col(f"`{k}`") == F.col(f"_n{i}")
            on = c if on is None else on & c
        return df.join(hit, on, "left_anti")

    def direct(self, n: Scope, shared: list[str], bound: dict[str, str]) -> tuple[DataFrame, dict[str, str]] | None:
        """The inner block from its own edges, where it hangs on a whole type by one hop: no outer row is joined inside.

        So where the outer block is one scan without conditions, and the shared variable stands in one hop of the inner block
        and nowhere else there.
        """
        s = self.c.scope
        if len(shared) != 1 or len(bound) != 1 or s.filters or s.hops or any(b.props for b in s.bindings):
            return None
        v = shared[0]
        at = [h for h in n.hops if v in (h.src, h.dst)]
        rest = Scope(**{**vars(n), "hops": [h for h in n.hops if h not in at]})
        if len(at) != 1 or (at[0].low, at[0].high) != (1, 1) or at[0].src == at[0].dst or v in self.mentioned(rest):
            return None
        h = at[0]
        forward = h.src == v
        there, there_type = (h.dst, h.dst_type) if forward else (h.src, h.src_type)
        df = self.step(h.edge, h.out if forward else not h.out).withColumnsRenamed({"_from": f"{v}::id", "_to": f"{there}::id"})
        if self.needs_table(there):
            nodes = self.scan(there, there_type, n).withColumnRenamed(f"{there}::id", "_id")
            df = df.join(nodes, col(there) == F.col("_id")).drop("_id")
        rest.bindings = [b for b in n.bindings if b.var != there]
        return self.match(rest, df, {v: bound[v], there: there_type})

    def fold(self, n: Scope, tag: int) -> None:
        """Give the larger of two scans that the match only multiplies the ids of the other that the inner block joins to it.

        They are a list in each of its rows, so the product is filtered where it arises; an anti-join would shuffle and sort it
        by both ids. A list is no longer than the smaller scan.
        """
        pair = self.between(n)
        if pair is None:
            return
        s = self.c.scope

        def count(v: str) -> int:
            df = self.scan(v, s.types[v], Scope(bindings=s.bindings))
            for f in s.filters:
                if self.pushable(f) and self.read(f) == {v}:
                    df = df.filter(self.condition(f, df))
            return df.count()

        sizes = {v: count(v) for v in sorted(pair)}
        large, small = sorted(sizes, key=sizes.get, reverse=True)
        self.small |= {v for v in pair if v == small and sizes[v] <= MOST_BROADCAST}
        name = f"_not{tag}"
        hit = self.linked(n, *pair, tag).select(col(large).alias(f"{name}_at"), col(small).alias(name))
        hit = hit.filter(F.col(name).isNotNull()).repartition(f"{name}_at").distinct()
        self.folded[tag] = name, small
        self.held.setdefault(large, []).append((name, hit.groupBy(f"{name}_at").agg(F.collect_list(name).alias(name))))

    def between(self, n: Scope) -> tuple[str, str] | None:
        """Two scans of the match without hops that the inner block connects, the second by one hop and no other."""
        s = self.c.scope
        pair = self.mentioned(n) & set(s.types)
        if len(pair) != 2 or not pair <= {b.var for b in s.bindings} or any(pair & {h.src, h.dst} for h in s.hops):
            return None
        for a, b in (sorted(pair), sorted(pair, reverse=True)):
            at = [h for h in n.hops if b in (h.src, h.dst)]
            if len(at) != 1 or (at[0].low, at[0].high) != (1, 1) or at[0].src == at[0].dst:
                continue
            reached, rest = {a}, [{h.src, h.dst} for h in n.hops if h not in at]
            for _ in rest:
                reached = reached.union(*[ends for ends in rest if ends & reached])
            if reached & {at[0].src, at[0].dst}:
                return a, b
        return None

    def linked(self, n: Scope, a: str, b: str, tag: int) -> DataFrame:
        """Ids of ``a`` and ``b`` for which the inner block matches, from its own edges; they may repeat.

        The two sides of the hop to ``b`` are reduced to what is used beyond it, without repeats, before they meet. They meet
        under the match's own conditions between the two scans, too: pairs that it doesn't have aren't made.
        """
        s = self.c.scope
        saved, self.types = self.types, {**s.types, **n.types}
        h = next(h for h in n.hops if b in (h.src, h.dst))
        middle, out = (h.src, h.out) if h.dst == b else (h.dst, not h.out)
        filters = [*[f for f in s.filters if self.read(f) <= {a, b}], *n.filters]
        rest = Scope(**{**vars(n), "hops": [x for x in n.hops if x is not h], "bindings": [x for x in n.bindings if x.var != b]})
        left, bound = self.match(rest, self.scan(a, s.types[a], Scope(bindings=s.bindings)), {a: s.types[a]}, exists=True)
        right = self.g.rows(h.edge).select(*[F.col(c).alias(v) for c, v in zip(("src", "dst") if out else ("dst", "src"), ("_from", f"{b}::id"), strict=True)])
        both = Scope(bindings=[x for x in (*s.bindings, *n.bindings) if x.var == b], filters=filters, negations=n.negations)
        whole, self.used = self.used, {}
        self.use_scope(both)
        if self.needs_table(b):
            nodes = self.scan(b, s.types[b], both).withColumnRenamed(f"{b}::id", "_id")
            right = right.join(F.broadcast(nodes) if b in self.small else nodes, col(b) == F.col("_id")).drop("_id")
        for f in filters:
            if self.read(f) <= set(bound):
                left = left.filter(self.condition(f, left))
            elif self.read(f) <= {b}:
                right = right.filter(self.condition(f, right))
        later = [f for f in filters if b in self.read(f) and not self.read(f) <= {b}]
        self.used = {}
        self.use_scope(Scope(filters=later, negations=n.negations))
        beyond, self.used = self.used, whole

        def reduced(df: DataFrame, ends: set[str], at: list[str]) -> DataFrame:
            used = lambda v, prop: prop == "id" and v in beyond or {prop, "*"} & beyond.get(v, set())
            return df.select(*[F.col(f"`{c}`") for c in df.columns if c in ends or used(*c.split("::"))]).repartition(*[F.col(f"`{c}`") for c in at]).distinct()

        keys = [(f"{middle}::id", "_from")]
        for f in later:
            ends = [e for e in (f.left, f.right) if isinstance(e, Q.PropRef)]
            if f.op == "=" and len(ends) == 2 and self.type(f.left).scalar == self.type(f.right).scalar:
                keys.append(tuple(f"{e.var}::{e.prop}" for e in sorted(ends, key=lambda e: e.var == b)))
        left = reduced(left, {f"{a}::id", f"{middle}::id"}, [k for k, _ in keys])
        right = reduced(right, {"_from", f"{b}::id"}, [k for _, k in keys])
        inner = left.join(right, col(middle) == F.col("_from")).drop("_from")
        bound[b] = s.types[b]
        for f in later:
            inner = inner.filter(self.condition(f, inner))
        for i, m in enumerate(n.negations):
            inner = self.negate(inner, m, bound, tag * 10 + i + 1)
        self.types = saved
        return inner

    def read(self, f: Q.Filter) -> set[str]:
        return (variables(f.left) | variables(f.right)) - set(self.c.query.params)

    def mentioned(self, s: Scope) -> set[str]:
        out = {b.var for b in s.bindings} | {v for h in s.hops for v in (h.src, h.dst)}
        for f in s.filters:
            out |= variables(f.left) | variables(f.right)
        for n in s.negations:
            out |= self.mentioned(n)
        return out

    # -- the whole

    def plan(self) -> DataFrame:
        s, body = self.c.scope, self.c.query.body
        self.types = s.types
        self.use_indexes(s, body)
        if not self.calls(s):  # ranks are made of the rows of the match before negations
            for i, n in enumerate(s.negations):
                self.fold(n, i + 1)
        df, bound = self.match(s, None, {})
        for f in s.filters:
            if self.pushable(f):
                df = df.filter(self.condition(f, df))
        ids = [f"{v}::id" for v in bound]
        for e in self.calls(s):
            df = self.score(df, e, ids)
        for f in s.filters:
            if not self.pushable(f):
                df = df.filter(self.condition(f, df))
        for i, n in enumerate(s.negations):
            df = self.negate(df, n, bound, i + 1)
        if any(is_aggregate(p.expr) for p in body.projections):
            return self.aggregate(df, body)
        outs = [self.value(p.expr, df).alias(f"_o{i}") for i, p in enumerate(body.projections)]
        keys = []
        for i, o in enumerate(body.order):
            c = F.col(f"_o{self.c.names.index(o.expr.name)}") if isinstance(o.expr, Q.Alias) else self.value(o.expr, df)
            keys.append((c, f"_k{i}", o.desc))
        tie = [F.col(f"`{i}`") for i in ids] if body.order or body.limit is not None else []
        extra = [c.alias(k) for (c, k, _), o in zip(keys, body.order, strict=True) if not isinstance(o.expr, Q.Alias)]
        df = df.select(*outs, *extra, *[t.alias(f"_t{i}") for i, t in enumerate(tie)])
        order = []
        for (c, k, desc), o in zip(keys, body.order, strict=True):
            c = c if isinstance(o.expr, Q.Alias) else F.col(k)
            order.append(c.desc_nulls_last() if desc else c.asc_nulls_last())
        if tie:
            df = df.orderBy(*order, *[F.col(f"_t{i}") for i in range(len(tie))])
        if body.limit is not None:
            df = df.limit(body.limit)
        return df.select(*[F.col(f"_o{i}").alias(n) for i, n in enumerate(self.c.names)])

    def aggregate(self, df: DataFrame, body: Q.Read) -> DataFrame:
        groups, aggs = [], []
        for i, p in enumerate(body.projections):
            if not is_aggregate(p.expr):
                groups.append(self.value(p.expr, df).alias(f"_o{i}"))
                continue
            arg = p.expr.args[0]
            c = col(arg.name) if isinstance(arg, Q.Var) and arg.name in self.types and arg.name not in self.c.query.params else self.value(arg, df)
            f = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max, "avg": lambda x: F.avg(x.cast("double"))}[p.expr.name]
            aggs.append(f(c).alias(f"_o{i}"))
        out = df.groupBy(*groups).agg(*aggs) if groups else df.agg(*aggs)
        order = []
        for o in body.order:
            at = self.c.names.index(o.expr.name) if isinstance(o.expr, Q.Alias) else next(i for i, p in enumerate(body.projections) if p.expr == o.expr)
            c = F.col(f"_o{at}")
            order.append(c.desc_nulls_last() if o.desc else c.asc_nulls_last())
        if order:
            # Ties fall by the group keys, so that a limit is stable; nodes (structs) are left out of that.
            rest = [F.col(f"_o{i}") for i, p in enumerate(body.projections) if not is_aggregate(p.expr) and not isinstance(p.expr, Q.Var)]
            out = out.orderBy(*order, *[c.asc_nulls_last() for c in rest])
        if body.limit is not None:
            out = out.limit(body.limit)
        return out.select(*[F.col(f"_o{i}").alias(n) for i, n in enumerate(self.c.names)])


def plan(graph: Graph, checked: Checked, params: dict, now: dt.datetime, embed=vector.mock_embedding, approximate: bool | float = False) -> DataFrame:
    return Planner(graph, checked, params, now, embed, approximate).plan()
