"""The facade: one object per graph with every operation."""

from __future__ import annotations

import datetime as dt
import tempfile
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import formats
from graphloom.errors import ConflictError, GraphError, PlanError
from graphloom.functions.vector import Chunked, mock_embedding
from graphloom.operators.mutate import Affected, Mutator
from graphloom.plans import migrate as M
from graphloom.plans import query as Q
from graphloom.plans.params import bind
from graphloom.plans.planner import Graph, plan
from graphloom.plans.typecheck import Checked, check, check_mutation
from graphloom.sources import index, jsonl
from graphloom.sources.index import Indexes
from graphloom.sources.store import Store, Version
from graphloom.streaming import feed


def utc_now() -> dt.datetime:
    """Now in UTC, cut to milliseconds: fixed once per execution."""
    t = dt.datetime.now(dt.UTC).replace(tzinfo=None)
    return t.replace(microsecond=t.microsecond // 1000 * 1000)


@dataclass
class Prepared:
    """A read query tied to the snapshot at which it was prepared."""

    db: GraphDB
    query: Q.Query
    checked: Checked
    graph: Graph
    approximate: bool | float = False

    def run(self, params: dict | None = None, *, js: bool = False) -> DataFrame:
        return plan(self.graph, self.checked, bind(self.query.params, params, js=js), utc_now(), self.db.embed_query, self.approximate)


@dataclass(frozen=True)
class Finding:
    code: str
    query: str
    message: str


class GraphDB:
    """A graph at a path; every method works on the newest committed version unless it says otherwise."""

    def __init__(self, spark: SparkSession, path: str, *, provider: Callable = mock_embedding, cache: str | None = None, model: str | None = None):
        """``cache``: a folder (of any file system) in which vectors of texts are kept for later loads, under ``model``'s name."""
        if spark.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC", "GMT", "Etc/GMT", "Zulu", "Z", "+00:00", "GMT+0"):
            raise GraphError("set spark.sql.session.timeZone to UTC")
        self.spark, self.path, self.provider = spark, path, provider
        self.cache, self.model = cache, model or getattr(provider, "model", getattr(provider, "__name__", "provider"))
        self.store = Store(spark, path)
        self.temporary = False
        self._cache: dict[tuple[str, str], dict[str, Q.Query]] = {}

    @classmethod
    def init(cls, spark: SparkSession, path: str, schema: str, **how) -> GraphDB:
        Store.init(spark, path, schema)
        return cls(spark, path, **how)

    @classmethod
    def open(cls, spark: SparkSession, path: str, **how) -> GraphDB:
        db = cls(spark, path, **how)
        db.store.version()
        return db

    @classmethod
    def in_memory(cls, spark: SparkSession, schema: str, **how) -> GraphDB:
        """A graph in a folder of its own that goes with the process."""
        db = cls.init(spark, tempfile.mkdtemp(prefix="graphloom-"), schema, **how)
        db.temporary = True
        return db

    def is_in_memory(self) -> bool:
        return self.temporary

    def close(self) -> None:
        if self.temporary:
            self.store.files.delete("")

    # -- queries

    def queries(self, source: str) -> dict[str, Q.Query]:
        key = (source, "")
        if key not in self._cache:
            self._cache[key] = Q.parse_queries(source)
        return self._cache[key]

    def query(self, source: str, name: str | None) -> Q.Query:
        found = self.queries(source)
        if name is None and len(found) == 1:
            return next(iter(found.values()))
        if name not in found:
            raise PlanError(f"no query {name}")
        return found[name]

    def embed_query(self, text: str, dim: int, role: str = "query") -> list[float]:
        return self.provider(text, dim, role=role) if self.provider is mock_embedding else self.provider(text, dim)

    def prepare(self, source: str, name: str | None = None, version: int | None = None, *, approximate: bool | float = False) -> Prepared:
        q = self.query(source, name)
        if isinstance(q.body, Q.Mutation):
            raise PlanError(f"{q.name} changes the graph")
        v = self.store.version(version)
        g = self.store.graph(v)
        g.indexes = Indexes(self.store, v)
        return Prepared(self, q, check(v.catalog, q), g, approximate)

    def run(self, source: str, name: str | None = None, params: dict | None = None, *, js: bool = False, retries: int = 0, approximate: bool | float = False) -> DataFrame | Affected:
        """Run a query: a DataFrame for reads, the numbers of affected rows for mutations.

        A mutation that loses against another writer raises ConflictError, or is tried again up to ``retries`` times.
        ``approximate``: a plain ``nearest`` may answer from the vector index, if there is one; a number is the share of its cells read.
        """
        q = self.query(source, name)
        if isinstance(q.body, Q.Read):
            return self.prepare(source, q.name, approximate=approximate).run(params, js=js)
        m = check_mutation(self.store.version().catalog, q)
        bound = bind(q.params, params, js=js)
        while True:
            try:
                return Mutator(self.store, bound, utc_now(), self.provider).run(m)
            except ConflictError:
                if retries <= 0:
                    raise
                retries -= 1

    def run_arrow(self, source: str, name: str | None = None, params: dict | None = None) -> bytes:
        """A read query's result as an Arrow IPC stream."""
        return formats.to_ipc(self.prepare(source, name).run(params))

    def run_json(self, source: str, name: str | None = None, params: dict | None = None, *, js: bool = True) -> list[dict] | dict:
        """A result as JSON values; ``js``: whole numbers beyond 2^53 as text."""
        out = self.run(source, name, params, js=js)
        return asdict(out) if isinstance(out, Affected) else list(formats.records(out, js=js))

    def check(self, source: str) -> list[Finding]:
        """Findings of a query file: errors, L201 for nullable properties that no query sets, and mutations without parameters."""
        out, cat = [], self.store.version().catalog
        try:
            found = Q.parse_queries(source)
        except GraphError as e:
            return [Finding("parse", "", str(e))]
        written: set[tuple[str, str]] = set()
        mutated = False
        for q in found.values():
            try:
                if isinstance(q.body, Q.Read):
                    check(cat, q)
                else:
                    mutated = True
                    m = check_mutation(cat, q)
                    written |= {(m.type, p) for p, _ in m.assignments}
                    if not q.params:
                        out.append(Finding("L202", q.name, "a mutation without parameters does the same each time"))
            except GraphError as e:
                out.append(Finding("type", q.name, str(e)))
        if mutated:
            for t in cat.nodes.values():
                for p in t.props.values():
                    if p.type.nullable and p.embed is None and (t.name, p.name) not in written:
                        out.append(Finding("L201", "", f"{t.name}.{p.name} is set by no query"))
        return out

    def describe(self) -> dict:
        v = self.store.version()

        def props(t) -> list[dict]:
            return [{"name": p.name, "type": str(p.type), **{k: x for k, x in asdict(p).items() if k not in ("name", "type") and x}} for p in t.props.values()]

        return {
            "version": v.number,
            "nodes": [{"name": t.name, "description": t.description, "instruction": t.instruction, "key": t.key, "rows": self.store.table(v, f"node:{t.name}").count(), "properties": props(t)} for t in v.catalog.nodes.values()],
            "edges": [{"name": e.name, "from": e.source, "to": e.target, "description": e.description, "rows": self.store.table(v, f"edge:{e.name}").count(), "properties": props(e)} for e in v.catalog.edges.values()],
        }

    # -- data in and out

    def load(self, text: str, mode: str | None = None) -> Version:
        return jsonl.load(self.store, text=text, mode=mode, provider=self._embed, cache=self.cache, model=self.model)

    def load_file(self, path: str, mode: str | None = None) -> Version:
        return jsonl.load(self.store, path=path, mode=mode, provider=self._embed, cache=self.cache, model=self.model)

    @property
    def _embed(self) -> Callable:
        return Chunked(self.provider)

    def export(self, **how) -> DataFrame:
        return jsonl.export(self.store, **how)

    def changes(self, after: int = 0, to: int | None = None) -> DataFrame:
        return feed.changes(self.store, after, to)

    # -- upkeep

    def embed(self, type_name: str | None = None, prop: str | None = None, *, only_null: bool = True, limit: int | None = None, dry_run: bool = False) -> int:
        """Fill vectors of @embed properties, at most ``limit`` of all types and properties together; the number that is made.

        Vectors are made once and kept (``cache``), and only tables that get one are written.
        """
        base = self.store.version()
        tables, n = {}, 0
        for t in base.catalog.nodes.values():
            targets = [p for p in t.props.values() if p.embed and prop in (None, p.name)]
            if not targets or type_name not in (None, t.name):
                continue
            df, mine = self.store.table(base, f"node:{t.name}"), 0
            for p in targets:
                due = F.col(p.embed).isNotNull() & (F.col(p.name).isNull() if only_null else F.lit(True))
                if limit is not None:
                    left = limit - n - mine
                    if left <= 0:
                        break
                    flag = f"_due:{p.name}"
                    ids = df.filter(due).select("id").orderBy("id").limit(left).withColumn(flag, F.lit(True))
                    df = df.join(ids, "id", "left")
                    due = F.coalesce(F.col(f"`{flag}`"), F.lit(False))
                k = df.filter(due).count()
                mine += k
                if k and not dry_run:
                    made = F.when(due, F.col(p.embed))
                    df = jsonl.embed_column(df.withColumn("_text", made).withColumn(p.name, F.when(~due, F.col(p.name))), "_text", p, self._embed, self.cache, self.model)
            if mine and not dry_run:
                tables[f"node:{t.name}"] = [self.store.write(f"node:{t.name}", df.select("id", *t.props))]
            n += mine
        if tables:
            self.store.commit(base, tables, summary="embed")
        return n

    def index(self, type_name: str, prop: str) -> dict:
        """Make the index of a text or vector property anew. It stays right, and loses use, as the table changes."""
        return index.build(self.store, type_name, prop)

    def compact(self, *, min_folders: int = 2, target_bytes: int = 128 << 20) -> dict[str, int]:
        """Rewrite tables that lie in several folders as files of about ``target_bytes``, as one commit without changes."""
        base = self.store.version()
        tables, removed = {}, 0
        for name, paths in base.tables.items():
            if len(paths) < min_folders:
                continue
            size = sum(self.store.files.size(p) for p in paths)
            tables[name] = [self.store.write(name, self.store.table(base, name).repartition(max(1, -(-size // target_bytes)), "id"))]
            removed += len(paths)
        if tables:
            self.store.commit(base, tables, summary="compact", changes=self.store.no_changes())
        return {"tables": len(tables), "folders_removed": removed, "folders_added": len(tables)}

    def cleanup(self, *, keep: int = 1, older_than: float = 86_400.0) -> dict[str, int]:
        """Drop all versions but the newest ``keep``, with their manifests and logs, and the folders that none of these names.

        A folder that no manifest names may belong to a commit under way, and one of a dropped version to a reader that still
        has it open: only folders untouched for ``older_than`` seconds go, and manifests of versions committed before that.
        """
        files, numbers = self.store.files, self.store.numbers()
        old = [n for n in numbers[: -max(1, keep)] if files.age(f"manifests/{n:012d}.json") >= older_than]
        # Versions go from the oldest on, without a gap.
        dropped = numbers[: len(old)]
        kept = numbers[len(dropped) :]
        used = {p for n in kept for ps in self.store.version(n).tables.values() for p in ps}
        good = set(self.store.log_folders(-1, numbers[-1]))
        folders = 0
        for table in files.list("data"):
            for folder in files.list(f"data/{table}"):
                path = f"data/{table}/{folder}"
                if path not in used and files.age(path) >= older_than:
                    files.delete(path)
                    folders += 1
        for n in dropped:
            files.delete(f"manifests/{n:012d}.json")
        for name in files.list("log"):
            n = int(name.partition("-")[0])
            if n < kept[0] or (n <= kept[-1] and name not in good and files.age(f"log/{name}") >= older_than):
                files.delete(f"log/{name}")
        return {"folders": folders, "versions": len(dropped)}

    def doctor(self) -> list[str]:
        """What is wrong with the newest version: lost folders, double ids, keys and pairs, edges without ends."""
        v, out = self.store.version(), []
        for name, paths in v.tables.items():
            out += [f"{name}: folder {p} is gone" for p in paths if not self.store.files.exists(p)]
        if out:
            return out
        for t in v.catalog.nodes.values():
            df = self.store.table(v, f"node:{t.name}")
            for c in ["id", *t.unique]:
                if df.filter(F.col(c).isNotNull()).groupBy(c).count().filter("count > 1").take(1):
                    out.append(f"node:{t.name}: {c} stands twice")
            for p in t.props.values():
                if not p.type.nullable and df.filter(F.col(p.name).isNull()).take(1):
                    out.append(f"node:{t.name}: {p.name} is null")
        for e in v.catalog.edges.values():
            df = self.store.table(v, f"edge:{e.name}")
            if df.groupBy("src", "dst").count().filter("count > 1").take(1):
                out.append(f"edge:{e.name}: a pair stands twice")
            for c, t in (("src", e.source), ("dst", e.target)):
                ids = self.store.table(v, f"node:{t}").select(F.col("id").alias(c))
                if df.join(ids, c, "left_anti").take(1):
                    out.append(f"edge:{e.name}: {c} names no {t}")
        return out

    def schema_diff(self, schema: str) -> tuple[str, list[M.Step]]:
        return M.diff(self.store.version().schema, schema)

    def migrate(self, schema: str, *, confirm: bool = False, dry_run: bool = False) -> list[M.Step]:
        return M.migrate(self.store, schema, confirm=confirm, dry_run=dry_run)
