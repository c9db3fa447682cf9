"""Global ranks without a one-partition window, and reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from graphloom.util import materialize

RRF_K = 60


def global_rank(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """``df`` with the 1-based place of each row in ``order`` (which should be total).

    Rows are range-partitioned in order and numbered within their partition; the partitions' counts, one row each,
    give the offsets. The ranges are cut from a sample, so their result is kept before it is read twice: rank narrow rows.
    """
    ranged = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    local = ranged.withColumn("_n", F.row_number().over(W.partitionBy("_part").orderBy(*order)))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_c"))
    # One row per partition: the window over all of them and the broadcast are bounded by the number of partitions.
    offsets = counts.select("_part", F.coalesce(F.sum("_c").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return local.join(F.broadcast(offsets), "_part").withColumn(out, F.col("_before") + F.col("_n")).drop("_part", "_n", "_before")


def fuse(first: Column, second: Column, k: Column) -> Column:
    """1/(k + rank) summed; a null rank adds nothing."""
    part = lambda r: F.when(r.isNull(), 0.0).otherwise(1.0 / (k.cast("double") + r.cast("double")))
    return part(first) + part(second)
