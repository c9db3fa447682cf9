"""Versioned snapshots of a graph: Parquet folders, and a manifest per version that names them.

A commit writes new folders first, then creates the next manifest exclusively; readers resolve one manifest and keep it.
A table is a list of folders, so that an insert adds a small folder and an update rewrites only folders with hits.
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.errors import ConflictError, StorageError
from graphloom.plans.planner import Graph, Lazy
from graphloom.plans.schema import Catalog, parse_schema
from graphloom.sources.files import Files

CHANGE = (
    "graph_version bigint, tx_id string, committed_at timestamp_ntz, change_kind string, entity_kind string, type_name string, "
    "table_id string, rowid bigint, entity_id bigint, logical_key string, row string, previous_graph_version bigint"
)


def folder() -> Column:
    """The folder of a table that a row lies in."""
    return F.regexp_extract("_metadata.file_path", r"/(data/[^/]+/[^/]+)/[^/]+$", 1)


@dataclass(frozen=True)
class Version:
    number: int
    catalog: Catalog
    schema: str
    tables: dict[str, list[str]]
    next_node: int
    next_edge: int
    summary: str
    time: str
    tx: str


def number(df: DataFrame, start: int, out: str = "id") -> tuple[DataFrame, int]:
    """Rows numbered from ``start`` in their order, without a shuffle, and how many there are.

    The counts of the partitions, one row each, come to the driver and go back as offsets. ``df`` must give the same rows in
    the same partitions each time, as a checkpoint or a scan of files does.
    """
    m = df.withColumn("_m", F.monotonically_increasing_id())
    counts = sorted(tuple(r) for r in m.groupBy(F.shiftright("_m", 33).cast("int")).count().collect())
    offsets, total = [], 0
    for part, n in counts:
        offsets.append((part, start + total))
        total += n
    before = df.sparkSession.createDataFrame(offsets, "_p int, _b bigint")
    numbered = m.withColumn("_p", F.shiftright("_m", 33).cast("int")).join(F.broadcast(before), "_p")
    place = F.col("_b") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return numbered.withColumn(out, place.cast("bigint")).drop("_m", "_p", "_b"), total


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Files(spark, root)

    @classmethod
    def init(cls, spark: SparkSession, root: str, schema: str) -> Store:
        s = cls(spark, root)
        if s.files.list("manifests"):
            raise StorageError(f"{root} is a graph already")
        parse_schema(schema)
        s._put(0, schema, {}, 1, 1, "init", "init")
        return s

    def numbers(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.list("manifests") if n.endswith(".json"))

    def version(self, at: int | None = None) -> Version:
        import json

        if at is None:
            numbers = self.numbers()
            if not numbers:
                raise StorageError(f"{self.files.root} is no graph")
            at = numbers[-1]
        elif not self.files.exists(f"manifests/{at:012d}.json"):
            raise StorageError(f"version {at} isn't there")
        m = json.loads(self.files.read(f"manifests/{at:012d}.json"))
        return Version(m["version"], parse_schema(m["schema"]), m["schema"], m["tables"], m["next_node"], m["next_edge"], m["summary"], m["time"], m["tx"])

    def table(self, v: Version, name: str) -> DataFrame:
        kind, _, t = name.partition(":")
        schema = (v.catalog.nodes if kind == "node" else v.catalog.edges)[t].spark()
        paths = [self.files.url(p) for p in v.tables.get(name, [])]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def part(self, v: Version, name: str, paths: list[str]) -> DataFrame:
        """Some folders of a table."""
        return self.table(replace(v, tables={name: paths}), name)

    def touched(self, v: Version, name: str, rows: DataFrame, on: list[str]) -> tuple[list[str], list[str]]:
        """The table's folders without and with rows that have the values ``on`` of some row of ``rows``."""
        paths = v.tables.get(name, [])
        if not paths:
            return [], []
        hits = {r[0] for r in self.table(v, name).select(*on, folder().alias("_folder")).join(rows.select(*on), on, "left_semi").select("_folder").distinct().collect()}
        return [p for p in paths if p not in hits], [p for p in paths if p in hits]

    def graph(self, v: Version | None = None) -> Graph:
        v = v or self.version()
        nodes = Lazy({n: lambda n=n: self.table(v, f"node:{n}") for n in v.catalog.nodes})
        edges = Lazy({n: lambda n=n: self.table(v, f"edge:{n}") for n in v.catalog.edges})
        # Loads and mutations keep one row per (src, dst).
        return Graph(v.catalog, nodes, edges, simple=set(v.catalog.edges))

    def write(self, name: str, df: DataFrame) -> str:
        path = f"data/{name.replace(':', '.')}/{uuid.uuid4().hex}"
        df.write.parquet(self.files.url(path))
        return path

    def _put(self, n: int, schema: str, tables: dict, next_node: int, next_edge: int, summary: str, tx: str) -> None:
        now = dt.datetime.now(dt.UTC).replace(tzinfo=None).isoformat(timespec="milliseconds")
        self.files.create(f"manifests/{n:012d}.json", {"version": n, "schema": schema, "tables": tables, "next_node": next_node, "next_edge": next_edge, "summary": summary, "time": now, "tx": tx})

    def put_frames(self, frames: dict[str, DataFrame], summary: str = "load frames") -> Version:
        """Replace whole tables (``node:T``, ``edge:E``) by DataFrames that have their ids already, in one commit."""
        base = self.version()
        tables = {}
        for name, df in frames.items():
            kind, _, t = name.partition(":")
            schema = (base.catalog.nodes if kind == "node" else base.catalog.edges)[t].spark()
            tables[name] = [self.write(name, df.select(*[F.col(f.name).cast(f.dataType) for f in schema]))]
        top = {"node": base.next_node, "edge": base.next_edge}
        for name, paths in tables.items():
            most = self.spark.read.parquet(*[self.files.url(p) for p in paths]).agg(F.max("id")).first()[0]
            kind = name.partition(":")[0]
            top[kind] = max(top[kind], (most or 0) + 1)
        return self.commit(base, tables, summary=summary, next_node=top["node"], next_edge=top["edge"])

    def commit(self, base: Version, tables: dict[str, list[str]], *, summary: str, next_node: int | None = None, next_edge: int | None = None, schema: str | None = None, changes: DataFrame | None = None) -> Version:
        """Make ``tables`` (whole lists of folders of the tables that change) the next version."""
        n = base.number + 1
        if self.numbers()[-1] != base.number:
            raise ConflictError(f"version {n} was committed by another writer")
        new = Version(n, parse_schema(schema or base.schema), schema or base.schema, {**base.tables, **tables}, next_node or base.next_node, next_edge or base.next_edge, summary, "", f"tx-{uuid.uuid4().hex[:10]}-{n}")
        if changes is None:
            changes = self.diff(base, new, [t for t in tables])
        if changes is None:
            changes = self.no_changes()
        stamp = F.lit(dt.datetime.now(dt.UTC).replace(tzinfo=None).isoformat(sep=" ", timespec="milliseconds")).cast("timestamp_ntz")
        log = changes.select(
            F.lit(n).cast("bigint").alias("graph_version"), F.lit(new.tx).alias("tx_id"), stamp.alias("committed_at"), "change_kind", "entity_kind", "type_name",
            F.concat_ws(".", "entity_kind", F.lower("type_name")).alias("table_id"), F.col("entity_id").alias("rowid"), "entity_id", "logical_key", "row",
            F.lit(base.number).cast("bigint").alias("previous_graph_version"),
        )
        # Each commit writes a log, if an empty one. It counts only once its version's manifest names its tx.
        log.write.parquet(self.files.url(f"log/{n:012d}-{new.tx}"))
        self._put(n, new.schema, new.tables, new.next_node, new.next_edge, summary, new.tx)
        return new

    def no_changes(self) -> DataFrame:
        return self.spark.createDataFrame([], "change_kind string, entity_kind string, type_name string, entity_id bigint, logical_key string, row string")

    def diff(self, old: Version, new: Version, names: list[str]) -> DataFrame | None:
        """What changed in the named tables: folders in both versions are left out, the rest is joined by id."""
        out = None
        for name in names:
            kind, _, t = name.partition(":")
            both = set(old.tables.get(name, [])) & set(new.tables.get(name, []))
            only = lambda v: Version(v.number, v.catalog, v.schema, {name: [p for p in v.tables.get(name, []) if p not in both]}, 0, 0, "", "", "")  # noqa: B023, E731
            if t not in (old.catalog.nodes if kind == "node" else old.catalog.edges) or t not in (new.catalog.nodes if kind == "node" else new.catalog.edges):
                continue
            gone, come = only(old), only(new)
            if not gone.tables[name]:
                one = image(kind, t, self.table(come, name), "insert")
            elif not come.tables[name]:
                one = image(kind, t, self.table(gone, name), "delete")
            else:
                one = change_rows(kind, t, self.table(gone, name), self.table(come, name))
            out = one if out is None else out.unionByName(one)
        return out

    def log(self, low: int, high: int | None = None) -> DataFrame:
        """The change rows of versions above ``low`` up to ``high`` (at most the committed one)."""
        numbers = self.numbers()
        high = numbers[-1] if high is None else min(high, numbers[-1])
        if low + 1 < numbers[0] and numbers[0] > 0:
            raise StorageError(f"changes are kept from version {numbers[0]} on")
        paths = [self.files.url(f"log/{x}") for x in self.log_folders(low, high)]
        return self.spark.read.schema(CHANGE).parquet(*paths) if paths else self.spark.createDataFrame([], CHANGE)

    def log_folders(self, low: int, high: int) -> list[str]:
        """The logs of committed versions. One that stands alone is the winner's, whose log was written before its manifest."""
        by: dict[int, list[str]] = {}
        for name in self.files.list("log"):
            n = int(name.partition("-")[0])
            if low < n <= high:
                by.setdefault(n, []).append(name)
        out = []
        for n, names in sorted(by.items()):
            out += names if len(names) == 1 else [x for x in names if x.partition("-")[2] == self.version(n).tx]
        return out


def logical_key(kind: str):
    if kind == "node":
        return F.concat(F.lit("id="), F.col("id"))
    return F.concat(F.lit("id="), F.col("id"), F.lit(",src="), F.col("src"), F.lit(",dst="), F.col("dst"))


def image(kind: str, t: str, df: DataFrame, change: str) -> DataFrame:
    """Rows of a table as change rows of one kind."""
    return df.select(F.lit(change).alias("change_kind"), F.lit(kind).alias("entity_kind"), F.lit(t).alias("type_name"), F.col("id").alias("entity_id"), logical_key(kind).alias("logical_key"), F.to_json(F.struct("*")).alias("row"))


def change_rows(kind: str, t: str, old: DataFrame, new: DataFrame) -> DataFrame:
    """Inserts and updates with the new row, deletes with the last one."""
    a = image(kind, t, old, "delete").select(F.col("entity_id").alias("_i"), F.col("logical_key").alias("_k"), F.col("row").alias("_r"))
    b = image(kind, t, new, "insert")
    j = b.join(a, F.col("entity_id") == F.col("_i"), "full_outer")
    what = F.when(F.col("_i").isNull(), "insert").when(F.col("entity_id").isNull(), "delete").when(~F.col("row").eqNullSafe(F.col("_r")), "update")
    return j.select(what.alias("change_kind"), F.lit(kind).alias("entity_kind"), F.lit(t).alias("type_name"), F.coalesce("entity_id", "_i").alias("entity_id"), F.coalesce("logical_key", "_k").alias("logical_key"), F.coalesce("row", "_r").alias("row")).filter("change_kind is not null")
