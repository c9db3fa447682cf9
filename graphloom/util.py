"""Helpers shared by the operators: materialising, size-checked broadcasts and running maxima that survive hot keys."""

from __future__ import annotations

import atexit
import shutil
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType
from pyspark.sql.window import Window as W


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The reliable checkpoint folder of the session.

    A cluster names a shared folder in ``spark.checkpoint.dir``; a folder of our own is set only where
    that setting is missing and the master is this very process, as in tests.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="graphloom-checkpoint-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    sc.setCheckpointDir(shared)
    return shared


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint: the result survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def over_cores(df: DataFrame, file_bytes: int = 128 << 20) -> DataFrame:
    """Spread a table of fewer files than cores over the cores, before a costly function of each row.

    A Parquet file can't be read by more tasks than it has row groups (about ``file_bytes`` each), so a table of few small
    files would keep most cores idle. At most ``file_bytes`` per core are shuffled for that; larger tables never are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    files = len(df._jdf.inputFiles())  # the length alone leaves the JVM
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if 0 < max(files, size // file_bytes) < cores else df


def small_or_plain(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only after counting that ``df`` has at most ``max_rows`` rows; else leave it to the planner."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


#: Rows of a chunk: what one task walks in order at most (of one key, or twice that where quantiles are off).
ROWS_A_CHUNK = 200_000
MOST_CHUNKS = 4096


def cuts(df: DataFrame, place: Column, *, rows_a_chunk: int = ROWS_A_CHUNK) -> list[float]:
    """Values of ``place`` that part the rows of ``df`` into chunks of about ``rows_a_chunk`` rows, at most MOST_CHUNKS of them.

    They are quantiles, not equal widths: an outlying value takes no more than its own rows. One pass, whose result is at
    most MOST_CHUNKS numbers.
    """
    steps = [i / MOST_CHUNKS for i in range(1, MOST_CHUNKS)]
    n, q = df.agg(F.count("*"), F.percentile_approx(place.cast("double"), steps, F.lit(10 * MOST_CHUNKS))).first()
    chunks = min(MOST_CHUNKS, -(-n // rows_a_chunk))
    return sorted({q[i * MOST_CHUNKS // chunks - 1] for i in range(1, chunks)}) if q and chunks > 1 else []


def chunk_of(place: Column, at: list[float]) -> Column:
    """The number of cuts that are not above ``place``: a non-decreasing whole number; 0 where it is null."""
    v = place.cast("double")
    if not at:
        return F.lit(0)
    if len(at) > 64:
        values = np.array(at)

        @F.arrow_udf(IntegerType())
        def find(x: pa.Array) -> pa.Array:
            return pa.array(np.searchsorted(values, np.nan_to_num(x.to_numpy(zero_copy_only=False), nan=-np.inf), "right").astype(np.int32))

        return F.coalesce(find(v), F.lit(0))

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(v < at[mid], tree(low, mid)).otherwise(tree(mid + 1, high))

    return F.when(v.isNull(), 0).otherwise(tree(0, len(at)))


def running_max(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    at: str,
    value: str,
    place: Column,
    chunks: list[float],
    *,
    right_first: bool,
    points: DataFrame | None = None,
    out: str = "run",
    first_out: str | None = None,
) -> DataFrame:
    """Each row of ``left`` with the largest ``value`` of the ``right`` rows of its key placed before it by ``at``.

    ``right_first``: a right row at the same place counts. ``first_out`` adds the smallest ``at`` of the key's right
    rows. ``place`` is a number made from ``at`` that doesn't decrease, and ``chunks`` are its cuts (see ``cuts``); keys are
    not null. ``points``: a cheaper table with (at least) the keys and places of ``left``.

    What the maximum depends on is (key, place) alone, so only distinct ones are walked, of one key and chunk at a time; the
    chunks' maxima are prefixed over the chunks before. Neither a hot key nor very many rows at one place are gathered in
    one task. Rows of ``left`` with null ``at`` get null; right rows with null ``at`` don't count.
    """
    rank_right, rank_left = (0, 1) if right_first else (1, 0)
    r = right.filter(F.col(at).isNotNull()).groupBy(*keys, at).agg(F.max(value).alias("_v"))
    l = (left if points is None else points).select(*keys, at).distinct()
    u = l.select(*keys, at, F.lit(rank_left).alias("_side"), F.lit(None).cast(r.schema["_v"].dataType).alias("_v"))
    u = u.unionByName(r.select(*keys, at, F.lit(rank_right).alias("_side"), "_v")).withColumn("_chunk", chunk_of(place, chunks))
    is_right = F.col("_side") == rank_right
    by_chunk = W.partitionBy(*keys, "_chunk")
    here = F.max("_v").over(by_chunk.orderBy(at, "_side").rowsBetween(W.unboundedPreceding, W.currentRow))
    if chunks:
        parts = u.groupBy(*keys, "_chunk").agg(F.max("_v").alias("_cv"), F.min(F.when(is_right, F.col(at))).alias("_cmin"))
        by_key = W.partitionBy(*keys)
        before = F.max("_cv").over(by_key.orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1))
        prefix = parts.select(*keys, "_chunk", before.alias("_before"), F.min("_cmin").over(by_key).alias("_first"))
        seen = u.withColumn("_here", here).filter(~is_right).drop("_v").join(prefix, [*keys, "_chunk"])
    else:
        first = F.min(F.when(is_right, F.col(at))).over(by_chunk)
        seen = u.withColumns({"_here": here, "_first": first, "_before": F.lit(None).cast(r.schema["_v"].dataType)}).filter(~is_right)
    best = F.when(F.col("_before").isNull() | (F.col("_here") > F.col("_before")), F.col("_here")).otherwise(F.col("_before"))
    found = seen.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(at).alias("_at"), F.when(F.col(at).isNotNull(), best).alias(out), *([F.col("_first").alias(first_out)] if first_out else []))
    same = F.col(at).eqNullSafe(F.col("_at"))
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    return left.join(found, same).drop(*[f"_{k}" for k in keys], "_at")
