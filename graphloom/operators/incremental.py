"""Processing only new or changed records.

Method: a high watermark on the monotonic commit sequence. A run fixes its upper limits when it starts (the greatest
version, and the latest ingested_at, that are there), takes every change up to them that no successful run has taken, and
commits its output together with the new watermark in one atomic create: a run that dies before leaves nothing that a
reader sees, a run repeated after takes nothing twice, and a run that loses against another one begins again.

The first run of a job can follow an earlier reader whose runs left holes and late rows behind. Its successful runs are cut
into disjoint version segments, each with the latest read_at of the runs over it; a change was taken if it was visible by
the read_at of its segment. The segment is found by a running maximum in version order, without a range join.

From then on the watermark (version, ingested_at) tells alone what was taken: everything that lies below both. A run reads
only rows above one of them (both filters reach the scan). Those below the version watermark are late: a late one is new
unless an older delivery of it was taken, which is looked up among the old rows of the late rows' versions, and only if
there are late rows.

Defined results
---------------
* a change is (table_id, entity_id, graph_version); of its deliveries the first (by ingested_at) gives the other
  columns. Rows with null table_id, entity_id or graph_version are no changes.
* a change without ingested_at was never seen by an earlier reader's run, so it is not taken; a job takes it once and keeps
  its key in a ledger, as no watermark covers it.
* a status counts without case and padding; runs with a null bound or read_at, or an empty window, take nothing.
* no runs: every change is pending; no changes: no rows. A run that finds nothing new commits nothing.
* a job's transform may drop rows and columns: what was taken is told by the watermark, not by the output.
"""

from __future__ import annotations

import heapq
import json
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.errors import ConflictError
from graphloom.sources.files import Files
from graphloom.util import ROWS_A_CHUNK, cuts, running_max

CHANGE = ("table_id", "entity_id", "graph_version")
NO_RUNS = "table_id string, from_version bigint, to_version bigint, read_at timestamp, status string"


def changes(visible: DataFrame) -> DataFrame:
    """One row per change with its first ingested_at, previous_graph_version and tx_id (of that delivery)."""
    ok = visible.filter(" and ".join(f"{c} is not null" for c in CHANGE))
    # Each column is an aggregate of its own, so that one which isn't used isn't carried.
    first = F.struct(F.col("ingested_at").isNull(), "ingested_at", "previous_graph_version", "tx_id")
    return ok.groupBy(*CHANGE).agg(
        F.min_by("previous_graph_version", first).alias("previous_graph_version"), F.min_by("tx_id", first).alias("tx_id"), F.min("ingested_at").alias("first_ingested_at")
    )


def _sweep(runs: pd.DataFrame) -> pd.DataFrame:
    """Disjoint segments (from exclusive) with the latest read_at of the runs over each; null where no run is."""
    rows = sorted(zip(runs.from_version, runs.to_version, runs.read_us, strict=True))
    cuts = sorted({x for lo, hi, _ in rows for x in (lo, hi)})
    open_runs, out, i = [], [], 0
    for lo in cuts:
        while i < len(rows) and rows[i][0] <= lo:
            heapq.heappush(open_runs, (-rows[i][2], rows[i][1]))
            i += 1
        while open_runs and open_runs[0][1] <= lo:
            heapq.heappop(open_runs)
        out.append((lo, -open_runs[0][0] if open_runs else None))
    table = runs.table_id.iloc[0]
    return pd.DataFrame({"table_id": table, "graph_version": [x for x, _ in out], "read_us": pd.array([r for _, r in out], "Int64")})


def coverage(runs: DataFrame, succeeded: str = "succeeded") -> DataFrame:
    """table_id, graph_version (a segment's exclusive start), read_us: what the successful runs have covered."""
    ok = runs.filter((F.lower(F.trim("status")) == succeeded) & F.col("table_id").isNotNull() & F.col("read_at").isNotNull() & (F.col("from_version") < F.col("to_version")))
    ok = ok.select("table_id", "from_version", "to_version", _micros(ok, "read_at").alias("read_us")).distinct()
    # A group holds the runs of one table, not its rows: one row per run of a scheduled job.
    return ok.groupBy("table_id").applyInPandas(_sweep, "table_id string, graph_version bigint, read_us bigint")


def _micros(df: DataFrame, column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def pending(visible: DataFrame, runs: DataFrame, *, upper: int | None = None, rows_a_chunk: int = ROWS_A_CHUNK) -> DataFrame:
    """The changes up to ``upper`` (by default all that are there) that no successful run has taken, each once."""
    if upper is not None:
        visible = visible.filter(F.col("graph_version") <= upper)
    seen = coverage(runs).select("table_id", "graph_version", F.struct("graph_version", "read_us").alias("segment"))
    places = visible.select("table_id", "graph_version").filter("table_id is not null and graph_version is not null")
    version = F.col("graph_version")
    found = running_max(changes(visible), seen, ["table_id"], "graph_version", "segment", version, cuts(places, version, rows_a_chunk=rows_a_chunk), right_first=False, points=places)
    taken = F.coalesce(_micros(found, "first_ingested_at") <= F.col("run.read_us"), F.lit(False))
    return found.filter(~taken).drop("run")


class IncrementalJob:
    """A job whose every run handles what is pending exactly once.

    ``state`` is a folder on any file system that Spark reaches: ``data/<run>`` with the outputs and ``commits/<n>.json``,
    each with its run, the watermark after it and the number of rows. Readers follow the commits; the output of a run that
    died isn't named by any and is never seen. ``runs``: the runs of an earlier reader, which the first run follows.
    """

    def __init__(self, spark: SparkSession, state: str, runs: DataFrame | None = None):
        self.spark, self.files, self.runs = spark, Files(spark, state), runs

    def numbers(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.list("commits") if n.endswith(".json")]

    def commit(self, n: int) -> dict:
        return json.loads(self.files.read(f"commits/{n:08d}.json"))

    def last(self) -> dict | None:
        numbers = self.numbers()
        return self.commit(numbers[-1]) if numbers else None

    def watermark(self) -> int | None:
        last = self.last()
        return last and last["upper"]

    def output(self, after: int = -1) -> DataFrame | None:
        """What the commits above number ``after`` have written."""
        paths = [self.files.url(f"data/{self.commit(n)['run']}") for n in self.numbers() if n > after]
        return self.spark.read.parquet(*paths) if paths else None

    def run(self, visible: DataFrame, transform: Callable[[DataFrame], DataFrame] = lambda df: df, before_commit: Callable[[], None] = lambda: None, *, attempts: int = 5) -> int:
        """Handle what is pending up to the limits of now; the number of rows written."""
        for attempt in range(attempts):
            try:
                return self._run(visible, transform, before_commit)
            except ConflictError:
                if attempt == attempts - 1:
                    raise
        return 0

    def _run(self, visible: DataFrame, transform, before_commit) -> int:
        base = self.last()
        number = base["number"] + 1 if base else 0
        # Without the filters below nothing of an old row is read but its version and time, from row groups that may hold new ones.
        new = visible if base is None else visible.filter(self._above(visible, base))
        below = F.when(F.col("graph_version") <= (base["upper"] if base else None), F.col("graph_version"))
        limit = new.agg(F.max("graph_version").alias("upper"), F.max(_micros(new, "ingested_at")).alias("read"), F.min(below).alias("low"), F.max(below).alias("high")).first()
        if limit.upper is None:
            return 0
        upper, read = limit.upper, limit.read
        new = new.filter((F.col("graph_version") <= upper) & (F.col("ingested_at").isNull() | self._by(new, read)))
        if base is None:
            todo = pending(new, self.runs if self.runs is not None else self.spark.createDataFrame([], NO_RUNS))
        else:
            upper, read = max(upper, base["upper"]), max(x for x in (read, base["read"], -(1 << 62)) if x is not None)
            todo = changes(new)
            if limit.low is not None:
                todo = todo.join(self._taken(visible, base, limit.low, limit.high), list(CHANGE), "left_anti")
        run = f"{number:08d}-{uuid.uuid4().hex[:8]}"
        transform(todo).write.parquet(self.files.url(f"data/{run}"))
        rows = self.spark.read.parquet(self.files.url(f"data/{run}")).count()
        ledgers = list(base["ledgers"]) if base else []
        if new.filter("ingested_at is null").limit(1).count():
            unseen = todo.filter("first_ingested_at is null").select(*CHANGE)
            unseen.write.parquet(self.files.url(f"ledger/{run}"))
            if self.spark.read.parquet(self.files.url(f"ledger/{run}")).limit(1).count():
                ledgers.append(run)
        if base and not rows and (upper, read, ledgers) == (base["upper"], base["read"], base["ledgers"]):
            self.files.delete(f"data/{run}")
            return 0
        before_commit()
        try:
            # Fails if another run has committed this number: one of two rivals wins, the other begins again.
            self.files.create(f"commits/{number:08d}.json", {"number": number, "run": run, "upper": upper, "read": read, "rows": rows, "ledgers": ledgers})
        except ConflictError:
            self.files.delete(f"data/{run}")
            self.files.delete(f"ledger/{run}")
            raise
        return rows

    def _by(self, df: DataFrame, read: int | None) -> Column:
        """Rows that were there by ``read``, as a comparison that reaches the scan."""
        t = df.schema["ingested_at"].dataType
        return F.col("ingested_at") <= F.timestamp_micros(F.lit(read).cast("bigint")).cast(t)

    def _above(self, df: DataFrame, base: dict) -> Column:
        if base["read"] is None:
            return F.lit(True)
        return (F.col("graph_version") > base["upper"]) | F.col("ingested_at").isNull() | ~self._by(df, base["read"])

    def _taken(self, visible: DataFrame, base: dict, low: int, high: int) -> DataFrame:
        """Keys of changes of the versions low to high that earlier runs have taken."""
        old = visible.filter(F.col("graph_version").between(low, high) & (F.col("graph_version") <= base["upper"]) & self._by(visible, base["read"])).select(*CHANGE)
        if base["ledgers"]:
            old = old.unionByName(self.spark.read.parquet(*[self.files.url(f"ledger/{x}") for x in base["ledgers"]]).select(*CHANGE))
        return old.distinct()
