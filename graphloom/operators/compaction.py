"""Far too many small files.

Method: partition-local compaction. Per dataset (a partition), the live fragments are measured in their raw rows; only
datasets with two or more fragments under their target, and fragments of which more than a tenth is deleted, are
touched. The chosen fragments are put in order and cut where the running sum of their live rows passes the target, and their
rows are rewritten by dynamic overwrite into partitions (dataset, generation) of the next generation, so that a dataset that
needs nothing is neither read nor written, a job that is run again overwrites its own partitions only, and readers keep
their files. A file holds one fragment, or several small ones up to about ``ROWS_A_FILE`` rows, sorted by fragment. Before the commit the records on disk are compared with those before. The commit names the
snapshot it began from: it fails if another writer was faster.

Which fragments are live, with their sizes, stands in tables (a snapshot each); the driver sees no list of files.

Defined results
---------------
* repeated rows of fragments and datasets are one; rows with a null table_id or fragment_id are nothing.
* a live fragment has added_version <= dataset_version and removed_version null or greater; a null version isn't live.
* a live fragment without rows has size 0, so it is a case where another is under the target, and vanishes.
* a null target makes no fragment small; deletions still count. is_deleted null means not deleted.
* a record (row_id) lying in several chosen fragments is written once (from the lowest fragment id), and not at all where it
  lies in a fragment that stays. Rows of a fragment that only repeat a record are dropped with it.
* new fragments are numbered from the dataset's greatest fragment_id on, live or not, and never reuse one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from graphloom.errors import ConflictError, StorageError
from graphloom.sources.files import Files
from graphloom.util import chunk_of, cuts, small_or_plain

KEY = ["table_id", "fragment_id"]
FRAGMENT = [*KEY, "generation"]
DELETED_SHARE = 10
DATA = "fragment_id bigint, row_id bigint, is_deleted boolean, payload string, _t string, _g bigint"
#: ``_t`` is a dot and the table_id, so that an empty one is a folder of its own.
TINY = "row_id bigint, is_deleted boolean, payload string, _t string, _f bigint"
ROWS_A_FILE = 1_000_000
LIVE = "table_id string, fragment_id bigint, generation bigint, size bigint, deleted bigint"


def live_fragments(datasets: DataFrame, fragments: DataFrame) -> DataFrame:
    d = datasets.filter("table_id is not null").groupBy("table_id").agg(F.max("dataset_version").alias("dataset_version"), F.max("target_rows_per_fragment").alias("target"))
    f = fragments.select(*KEY, "added_version", "removed_version").filter("table_id is not null and fragment_id is not null").distinct()
    live = (F.col("added_version") <= F.col("dataset_version")) & (F.col("removed_version").isNull() | (F.col("removed_version") > F.col("dataset_version")))
    return f.join(d, "table_id").filter(live).select(*KEY, "target").distinct()


def measured(datasets: DataFrame, fragments: DataFrame, rows: DataFrame) -> DataFrame:
    """The live fragments with size, deleted and target."""
    deleted = F.coalesce(F.col("is_deleted").cast("int"), F.lit(0))
    sizes = rows.groupBy(*KEY).agg(F.count("*").alias("size"), F.sum(deleted).alias("deleted"))
    m = live_fragments(datasets, fragments).join(sizes, KEY, "left")
    return m.select(*KEY, "target", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("deleted", F.lit(0)).alias("deleted"))


def _folder() -> Column:
    return F.concat(F.lit("."), "table_id").alias("_t")


def _table_id() -> Column:
    return F.expr("substring(_t, 2)").alias("table_id")


def chosen(measured: DataFrame) -> DataFrame:
    """The measured fragments that must go."""
    m = measured.withColumn("small", F.coalesce(F.col("size") < F.col("target"), F.lit(False)))
    per = m.groupBy("table_id").agg(F.sum(F.col("small").cast("int")).alias("n_small"))
    case = (F.col("small") & (F.col("n_small") >= 2)) | (F.col("deleted") * DELETED_SHARE > F.col("size"))
    return m.join(per, "table_id").filter(case).drop("small", "n_small")


def plan(datasets: DataFrame, fragments: DataFrame, rows: DataFrame) -> DataFrame:
    """The fragments that must go: table_id, fragment_id, size, deleted, target."""
    return chosen(measured(datasets, fragments, rows)).select(*KEY, "size", "deleted", "target")


def assign(go: DataFrame, *, chunk_fragments: int = 4096) -> DataFrame:
    """For each chosen fragment where its first row lands: ``start`` rows into the dataset's rewritten rows.

    A dataset may have most of all fragments, so the running sum is taken per (dataset, chunk of fragment ids) and
    shifted by the sums of the chunks before: a window holds about ``chunk_fragments`` fragments, or chunks.
    """
    at = cuts(go, F.col("fragment_id"), rows_a_chunk=chunk_fragments)
    c = go.withColumn("kept", F.col("size") - F.col("deleted")).withColumn("chunk", chunk_of(F.col("fragment_id"), at))
    sums = c.groupBy("table_id", "chunk").agg(F.sum("kept").alias("in_chunk"))
    before = sums.select("table_id", "chunk", F.coalesce(F.sum("in_chunk").over(W.partitionBy("table_id").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inner = W.partitionBy("table_id", "chunk").orderBy("fragment_id").rowsBetween(W.unboundedPreceding, -1)
    c = c.withColumn("here", F.coalesce(F.sum("kept").over(inner), F.lit(0))).join(before, ["table_id", "chunk"])
    return c.select(*KEY, (F.col("before") + F.col("here")).alias("start"), F.greatest(F.coalesce("target", F.lit(1)), F.lit(1)).alias("target"))


class FragmentStore:
    """Fragments under ``root`` on any file system that Spark reaches.

    ``data/_t=<dataset>/_g=<generation>`` holds the rows, ``snapshots/<id>`` the tables ``live`` (LIVE), ``heads`` (the next
    fragment id of each dataset) and ``removed``, and ``commits/<n>.json`` names snapshot n. Generation 0 are the rows as they
    came: ``raw`` (table_id, fragment_id, row_id, is_deleted, payload), or files of one fragment each in
    ``tiny/_t=<dataset>/_f=<fragment>``.
    """

    def __init__(self, spark: SparkSession, root: str, raw: DataFrame | None = None):
        self.spark, self.files, self.raw = spark, Files(spark, root), raw

    def version(self) -> int:
        return max((int(n[:-5]) for n in self.files.list("commits") if n.endswith(".json")), default=-1)

    def snapshot(self, version: int) -> dict:
        return json.loads(self.files.read(f"commits/{version:08d}.json"))

    def table(self, name: str, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if version < 0:
            raise StorageError(f"{self.files.root} has no snapshot")
        return self.spark.read.parquet(self.files.url(f"snapshots/{self.snapshot(version)['snapshot']}/{name}"))

    def commit(self, base: int, snapshot: str, **more) -> int:
        """Make a snapshot the next version; ConflictError if another writer was faster."""
        self.files.create(f"commits/{base + 1:08d}.json", {"snapshot": snapshot, "base": base, **more})
        return base + 1

    def _save(self, snapshot: str, **tables: DataFrame) -> None:
        for name, df in tables.items():
            df.write.parquet(self.files.url(f"snapshots/{snapshot}/{name}"))

    def rows(self, live: DataFrame) -> DataFrame:
        """The rows (deleted ones too) of the fragments named in ``live``, with generation."""
        cols = [*FRAGMENT, "row_id", "is_deleted", "payload"]
        parts = []
        # One number a compaction; so only the partitions of these generations are listed and read.
        generations = [r[0] for r in live.select("generation").distinct().collect()]
        if 0 in generations:
            if self.raw is None:
                # Written once by ``adopt`` and never changed: the many files are listed once.
                self.raw = self.spark.read.schema(TINY).parquet(self.files.url("tiny")).select("*", _table_id(), F.col("_f").alias("fragment_id"))
            parts.append(self.raw.withColumn("generation", F.lit(0).cast("bigint")).select(*cols))
        if any(generations):
            stored = self.spark.read.schema(DATA).parquet(self.files.url("data")).filter(F.col("_g").isin(generations))
            parts.append(stored.select("*", _table_id(), F.col("_g").alias("generation")).select(*cols))
        if not parts:
            return self.spark.createDataFrame([], "table_id string, fragment_id bigint, generation bigint, row_id bigint, is_deleted boolean, payload string")
        names = small_or_plain(live.select(*FRAGMENT), 200_000)
        out = [p.join(names, FRAGMENT, "left_semi") for p in parts]
        return out[0] if len(out) == 1 else out[0].unionByName(out[1])

    def read(self, version: int | None = None) -> DataFrame:
        """Every live, undeleted record once: table_id, fragment_id, row_id, payload."""
        version = self.version() if version is None else version
        r = self.rows(self.table("live", version)).filter(~F.coalesce("is_deleted", F.lit(False)))
        if self.snapshot(version).get("repeated"):
            one = F.min(F.struct("fragment_id", "payload")).alias("b")
            return r.groupBy("table_id", "row_id").agg(one).select("table_id", "b.fragment_id", "row_id", "b.payload")
        return r.select(*KEY, "row_id", "payload")

    def adopt(self, datasets: DataFrame, fragments: DataFrame, rows: DataFrame | None = None) -> int:
        """The first snapshot: the live fragments as they are, their rows left in place, or each written as a file if ``rows`` are given."""
        live = measured(datasets, fragments, self.raw if rows is None else rows)
        if rows is not None:
            out = rows.join(live.select(*KEY), KEY, "left_semi").select("row_id", "is_deleted", "payload", _folder(), F.col("fragment_id").alias("_f"))
            out.repartition("_t", "_f").sortWithinPartitions("_t", "_f").write.mode("overwrite").partitionBy("_t", "_f").parquet(self.files.url("tiny"))
        heads = fragments.filter("table_id is not null").groupBy("table_id").agg((F.coalesce(F.max("fragment_id"), F.lit(-1)) + 1).alias("next_id"))
        name = uuid.uuid4().hex
        self._save(name, live=live.select(*KEY, F.lit(0).cast("bigint").alias("generation"), "size", "deleted"), heads=heads, removed=live.select(*KEY).limit(0))
        return self.commit(-1, name, repeated=True)

    def compact(self, datasets: DataFrame) -> dict[str, int]:
        """Rewrite what must go, check, commit; fragments_removed, fragments_added and rows_rewritten."""
        base = self.version()
        live, heads = self.table("live", base), self.table("heads", base)
        targets = datasets.filter("table_id is not null").groupBy("table_id").agg(F.max("target_rows_per_fragment").alias("target"))
        name = uuid.uuid4().hex
        # A number of this attempt alone: rivals never write to the same partitions.
        generation = (base + 1 << 32) + uuid.uuid4().int % (1 << 32)
        # Written once, the choice is what everything after reads, also if a part runs again.
        self._save(name, removed=chosen(live.join(targets, "table_id")))
        removed = self.spark.read.parquet(self.files.url(f"snapshots/{name}/removed"))
        n_removed = removed.count()
        if not n_removed:
            self._save(name, live=live, heads=heads)
            self.commit(base, name, repeated=self.snapshot(base).get("repeated", True))
            return {"fragments_removed": 0, "fragments_added": 0, "rows_rewritten": 0}
        touched = live.join(removed.select("table_id").distinct(), "table_id", "left_semi")
        old = self.rows(touched).filter(~F.coalesce("is_deleted", F.lit(False)))
        stays = touched.join(removed.select(*KEY), KEY, "left_anti")
        goes = removed.select(*KEY).withColumn("goes", F.lit(True)).join(assign(removed), KEY)
        r = old.select(*KEY, "row_id", "payload").join(small_or_plain(goes, 200_000), KEY, "left").withColumn("goes", F.coalesce("goes", F.lit(False)))
        # A record in several fragments is taken from the one that stays (and isn't written), else from the lowest.
        payload = F.when(F.col("goes"), F.col("payload"))
        one = r.groupBy("table_id", "row_id").agg(F.min(F.struct("goes", "fragment_id", "start", "target", payload.alias("payload"))).alias("b")).filter("b.goes")
        n = F.floor(F.col("b.start") / F.col("b.target"))
        moved = one.select("table_id", n.alias("n"), F.floor(n * F.col("b.target") / ROWS_A_FILE).alias("file"), "row_id", "b.payload").join(heads, "table_id")
        out = moved.select((F.col("next_id") + F.col("n")).alias("fragment_id"), "row_id", F.lit(False).alias("is_deleted"), "payload", _folder(), F.lit(generation).cast("bigint").alias("_g"), "file")
        out = out.repartition("_t", "file").drop("file").sortWithinPartitions("_t", "_g", "fragment_id", "row_id")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_t", "_g").parquet(self.files.url("data"))
        stored = self.spark.read.schema(DATA).parquet(self.files.url("data")).filter(F.col("_g") == generation)
        self._save(name, added=stored.groupBy(_table_id(), "fragment_id", F.col("_g").alias("generation")).agg(F.count("*").alias("size"), F.lit(0).cast("bigint").alias("deleted")))
        added = self.spark.read.parquet(self.files.url(f"snapshots/{name}/added"))
        repeated = self._check(old, self.rows(stays), stored)
        top = added.groupBy("table_id").agg((F.max("fragment_id") + 1).alias("top"))
        self._save(
            name,
            live=live.join(removed.select(*KEY), KEY, "left_anti").unionByName(added).select(*FRAGMENT, "size", "deleted"),
            heads=heads.join(top, "table_id", "left").select("table_id", F.coalesce("top", "next_id").alias("next_id")),
        )
        n, rows = added.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        self.commit(base, name, repeated=repeated)
        return {"fragments_removed": n_removed, "fragments_added": n, "rows_rewritten": rows}

    def _check(self, old: DataFrame, stays: DataFrame, written: DataFrame) -> bool:
        """Compare the records before with those after, as they lie on disk; whether one still stands several times."""
        key = ["table_id", "row_id"]
        before = old.select(*key, F.lit(1).alias("before"), F.lit(0).alias("after"))
        after = stays.filter(~F.coalesce("is_deleted", F.lit(False))).select(*key).unionByName(written.select(_table_id(), "row_id"))
        both = before.unionByName(after.select(*key, F.lit(0).alias("before"), F.lit(1).alias("after"))).groupBy(*key).agg(F.max("before").alias("before"), F.sum("after").alias("after"))
        wrong, several = both.agg(F.count_if((F.col("before") > 0) != (F.col("after") > 0)), F.count_if(F.col("after") > 1)).first()
        if wrong:
            raise StorageError(f"{wrong} records were lost or came up; nothing was committed")
        return several > 0

    def vacuum(self, *, keep: int = 1) -> int:
        """Drop generations of datasets that none of the newest ``keep`` snapshots uses; call it when no writer is at work."""
        top = self.version()
        used = set()
        for v in range(max(0, top - keep + 1), top + 1):
            used |= {tuple(r) for r in self.table("live", v).select("table_id", "generation").distinct().toLocalIterator()}
        n = 0
        stored = self.spark.read.schema(DATA).parquet(self.files.url("data")).select("_t", "_g").distinct() if self.files.exists("data") else None
        for t, g in stored.toLocalIterator() if stored is not None else ():
            if (t[1:], g) not in used:
                escaped = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(t)
                self.files.delete(f"data/_t={escaped}/_g={g}")
                n += 1
        return n


def removed_by(datasets: DataFrame, fragments: DataFrame, rows: DataFrame, root: str) -> tuple[FragmentStore, DataFrame]:
    """Compact fragments whose rows lie in a table; the store, and the fragments of the first snapshot that are no longer live."""
    store = FragmentStore(rows.sparkSession, root, rows)
    first = store.adopt(datasets, fragments)
    store.compact(datasets)
    return store, store.table("live", first).select(*KEY).join(store.table("live").select(*KEY), KEY, "left_anti")
