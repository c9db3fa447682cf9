"""Indexes of stored tables: an inverted one for texts, and cells around centroids for vectors.

An index names the folders it was made of. Folders never change, so whatever was written since is told by the table's list
of folders: rows of folders that the index knows come through it, rows of others are scanned, rows of folders that are gone
are not asked for. An index is never wrong, only less useful as it ages; ``build`` makes it anew.

* Text: the distinct tokens of each row, in buckets of the token's hash, sorted by token, so that a search reads the row
  groups of its tokens alone. What it gives are rows with all tokens; the predicate still decides.
* Vectors: the rows by cell, one folder each. A query reads the cells nearest to it and ranks their rows exactly: an
  approximation, which is only used where it is asked for.
"""

from __future__ import annotations

import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from graphloom.errors import StorageError
from graphloom.functions import text, vector
from graphloom.sources.store import Store, Version

BUCKETS, SPREAD = 64, 16
#: Bounds of what is fitted on the driver: centroids, and sampled rows for each.
MOST_CELLS, SAMPLE_PER_CELL = 1024, 16
#: Cells read for a query: a share of all, and enough for so many rows per wanted one.
PROBED_SHARE, ROWS_PER_HIT = 0.1, 20


def build(store: Store, type_name: str, prop: str) -> dict:
    """Make the index of a String or Vector property anew; what it says of itself."""
    v = store.version()
    t = v.catalog.nodes.get(type_name)
    p = t and t.props.get(prop)
    if p is None or p.type.list or (not p.type.vector and p.type.scalar != "String"):
        raise StorageError(f"{type_name}.{prop} is no text and no vector")
    at, rows = f"index/{type_name}.{prop}/{uuid.uuid4().hex}", store.table(v, f"node:{type_name}").select("id", F.col(prop).alias("value"))
    about = {"at": at, "folders": v.tables.get(f"node:{type_name}", []), "kind": "vector" if p.type.vector else "text"}
    if p.type.vector:
        about |= _cells(store, rows, at, p.type.dim)
    else:
        tokens = rows.select("id", F.explode(F.array_distinct(text.tokens(F.col("value")))).alias("token"))
        # A token that stands in most rows is spread over several files.
        out = tokens.withColumn("bucket", F.pmod(F.crc32("token"), F.lit(BUCKETS)).cast("int")).repartition("bucket", F.pmod("id", F.lit(SPREAD)))
        out.sortWithinPartitions("bucket", "token").write.partitionBy("bucket").parquet(store.files.url(at))
    store.files.put(f"index/{type_name}.{prop}.json", about)
    return about


def _cells(store: Store, rows: DataFrame, at: str, dim: int) -> dict:
    good = rows.filter(F.col("value").isNotNull())
    n = good.count()
    cells = max(1, min(MOST_CELLS, int(np.sqrt(n))))
    sample = good.select("value").sample(min(1.0, 2 * SAMPLE_PER_CELL * cells / max(n, 1)), seed=7).limit(4 * SAMPLE_PER_CELL * MOST_CELLS).toArrow()["value"]
    x = _unit(np.asarray(sample.combine_chunks().flatten(), np.float32).reshape(-1, dim)) if len(sample) else np.zeros((1, dim), np.float32)
    middle = x[np.random.default_rng(0).permutation(len(x))[:cells]]
    for _ in range(4):
        near = (x @ middle.T).argmax(1)
        total = np.zeros_like(middle)
        np.add.at(total, near, x)
        middle = np.where(np.abs(total).sum(1, keepdims=True) > 0, _unit(total), middle)

    @F.arrow_udf(IntegerType())
    def cell(values: pa.Array) -> pa.Array:
        v = _unit(np.asarray(values.flatten(), np.float32).reshape(-1, dim))
        return pa.array((v @ middle.T).argmax(1).astype(np.int32))

    good.withColumn("cell", cell("value")).repartition("cell").write.partitionBy("cell").parquet(store.files.url(at))
    store.spark.createDataFrame([(i, m.tolist()) for i, m in enumerate(middle)], "cell int, middle array<float>").coalesce(1).write.parquet(store.files.url(f"{at}-middle"))
    return {"rows": n, "cells": len(middle), "dim": dim}


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Indexes:
    """The indexes of a store as a version of it can use them."""

    def __init__(self, store: Store, v: Version):
        self.store, self.v = store, v
        self.names = {n[:-5] for n in store.files.list("index") if n.endswith(".json")}

    def _about(self, type_name: str, prop: str, kind: str) -> dict | None:
        if f"{type_name}.{prop}" not in self.names:
            return None
        about = json.loads(self.store.files.read(f"index/{type_name}.{prop}.json"))
        return about if about["kind"] == kind else None

    def _rows(self, type_name: str, about: dict, ids: DataFrame) -> DataFrame:
        name, paths = f"node:{type_name}", self.v.tables.get(f"node:{type_name}", [])
        known = [p for p in paths if p in set(about["folders"])]
        fresh = [p for p in paths if p not in set(about["folders"])]
        parts = []
        if known:
            parts.append(self.store.part(self.v, name, known).join(ids, "id", "left_semi"))
        if fresh or not known:
            parts.append(self.store.part(self.v, name, fresh))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def text(self, type_name: str, prop: str, tokens: list[str]) -> DataFrame | None:
        """The table without rows that can't have all the tokens; None without an index."""
        about = self._about(type_name, prop, "text")
        need = sorted(set(tokens))
        if about is None or not need:
            return None
        buckets = sorted({zlib.crc32(t.encode()) % BUCKETS for t in need})
        p = self.store.spark.read.schema("id bigint, token string, bucket int").parquet(self.store.files.url(about["at"])).filter(F.col("bucket").isin(buckets) & F.col("token").isin(need))
        ids = p.select("id") if len(need) == 1 else p.groupBy("id").count().filter(F.col("count") == len(need)).select("id")
        return self._rows(type_name, about, ids)

    def vectors(self, type_name: str, prop: str, target: list[float], k: int, share: float | None = None) -> DataFrame | None:
        """The table without rows whose cells are far from the target, or that aren't among the nearest of their cells.

        ``share`` of the cells are read at least: well-clustered vectors need few, vectors without any order nearly all.
        """
        about = self._about(type_name, prop, "vector")
        if about is None:
            return None
        middle = self.store.spark.read.parquet(self.store.files.url(f"{about['at']}-middle")).toArrow()
        x = np.asarray(middle["middle"].combine_chunks().flatten(), np.float32).reshape(-1, about["dim"])
        probes = min(about["cells"], max(1, int(np.ceil(about["cells"] * max(share or PROBED_SHARE, min(1.0, ROWS_PER_HIT * k / max(about["rows"], 1)))))))
        near = np.argsort(-(x @ _unit(np.asarray([target], np.float32))[0]), kind="stable")[:probes]
        cells = [int(middle["cell"][int(i)].as_py()) for i in near]
        rows = self.store.spark.read.schema("id bigint, value array<float>, cell int").parquet(self.store.files.url(about["at"])).filter(F.col("cell").isin(cells))
        # Rows of folders that are gone are taken out after the ranking, so more than k are ranked.
        ids = rows.select("id", vector.cosine_distance(F.col("value"), target).alias("far")).orderBy(F.col("far").asc_nulls_last(), "id").limit(4 * k).select("id")
        return self._rows(type_name, about, ids)
