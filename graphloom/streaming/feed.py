"""The change feed of a store, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame

from graphloom.errors import GraphError
from graphloom.sources.files import Files
from graphloom.sources.store import CHANGE, Store

ORDER = ["graph_version", "entity_kind", "type_name", "rowid", "logical_key", "change_kind"]


def changes(store: Store, after: int = 0, to: int | None = None) -> DataFrame:
    """Changes of versions above ``after`` up to ``to`` (at most the committed one), in order."""
    return store.log(after, to).orderBy(*ORDER)


def window(store: Store, *, since: int | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """``since`` is exclusive; ``first`` and ``last`` are inclusive and go together."""
    if since is not None and (first is not None or last is not None):
        raise GraphError("since can't stand with first and last")
    if (first is None) != (last is None):
        raise GraphError("first and last go together")
    return changes(store, since if since is not None else 0 if first is None else first - 1, last)


def materialize(store: Store, target: str, *, min_new_rows: int = 0, force: bool = False) -> int:
    """Append what is new of the feed to the table ``target``/data; the number of new rows (0: too few to bother).

    A stream over the manifests with a checkpoint beside the target: a manifest is the commit, so a log that is written but
    not committed yet isn't seen until it is. Each batch of manifests reads the logs they name and overwrites its own folder,
    so each run takes what came since the last one, once, also if a run dies. A target that has fallen behind the versions
    that cleanup has kept raises StorageError instead of missing changes.
    """
    spark, data = store.spark, Files(store.spark, target)
    before = max((int(n.partition("=")[2]) for n in data.list("upto")), default=0)
    newest = store.numbers()[-1]
    if newest == before:
        return 0
    # Raises where versions in between were cleaned up.
    new = store.log(before)
    if not force and min_new_rows and new.limit(min_new_rows).count() < min_new_rows:
        return 0

    def take(batch: DataFrame, number: int) -> None:
        versions = sorted(r[0] for r in batch.select("version").collect())
        if not versions:
            return
        folders = [x for n in versions for x in store.log_folders(n - 1, n)]
        where = data.url(f"data/batch={number:08d}")
        if folders:
            spark.read.schema(CHANGE).parquet(*[store.files.url(f"log/{x}") for x in folders]).write.mode("overwrite").parquet(where)
        data.put(f"upto/version={versions[-1]:012d}", {"batch": number})

    manifests = spark.readStream.schema("version bigint").option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", 1000).json(store.files.url("manifests"))
    done = {*data.list("data")}
    q = manifests.writeStream.foreachBatch(take).option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    fresh = [data.url(f"data/{x}") for x in data.list("data") if x not in done]
    return spark.read.schema(CHANGE).parquet(*fresh).count() if fresh else 0
