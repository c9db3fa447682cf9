"""References to records that do not exist.

Method: the distinct (key, period) of the references and of the parents that are sound from a period on are shuffled by key
range, a hash of the key. Within a range the keys are dictionary-encoded as integers, and bitmaps are built per range and
period as containers of 32,768 positions (sorted 16-bit positions, or the plain bits where that is shorter); reference
AND-NOT parent leaves the bits of which a parent isn't surely there, and these are decoded. Repetitions are gone before the
shuffle, so a hot key is a few rows, and a range holds about ``keys_per_range`` keys; bitmaps never travel.

A surviving bit only says that a key may be broken in a period, so an exact check follows for the surviving references
alone: the latest removal among the parent rows loaded until then, a running maximum by time in which neither a key nor a
day is gathered in one task.

Defined results
---------------
* a null key is no reference; an empty key is one. Keys compare character by character.
* an edge name is matched as it stands, or with its first letter in lower case; an undeclared name makes no reference.
* repeated rows give one row; null edge ids stay rows of their own names.
* a parent row without loaded_at was never loaded: it doesn't count. An edge without loaded_at has period null and can't
  be sound: ``late`` if there are parent rows, else ``missing``.
* no edges: no rows; no nodes: all references are missing; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from graphloom.util import ROWS_A_CHUNK, cuts, materialize, running_max, small_or_plain

BITS = 32_768
NEVER = "9999-12-31 23:59:59.999999"


def pack(bits: bytes) -> bytes:
    """A bitmap as a container: b"a" with sorted 16-bit positions, or b"b" with the plain bits, whichever is shorter."""
    at = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")).astype("<u2")
    return b"a" + at.tobytes() if at.nbytes < len(bits) else b"b" + bits


def unpack(container: bytes) -> np.ndarray:
    """The container's bits, one boolean each."""
    out = np.zeros(BITS, bool)
    if container[:1] == b"a":
        out[np.frombuffer(container, "<u2", offset=1)] = True
    else:
        at = np.unpackbits(np.frombuffer(container, np.uint8, offset=1), bitorder="little")
        out[: at.size] = at.astype(bool)[:BITS]
    return out


class Bitmap:
    """Positions as containers, by their number: position // BITS."""

    def __init__(self, at: np.ndarray):
        at = np.unique(at)
        cut = np.flatnonzero(np.diff(at // BITS)) + 1
        self.containers = {int(p[0] // BITS): pack(_bits(p % BITS)) for p in np.split(at, cut) if len(p)}


def _bits(at: np.ndarray) -> bytes:
    out = np.zeros(BITS, bool)
    out[at] = True
    return np.packbits(out, bitorder="little").tobytes()


def _and_not(table: pa.Table) -> pa.Table:
    """One key range, all its periods: the references that no earlier period has made sound."""
    ptype, key = (table[c].combine_chunks().dictionary_encode() for c in ("ptype", "key"))
    width = len(key.dictionary)
    both, code = np.unique(ptype.indices.to_numpy().astype(np.int64) * width + key.indices.to_numpy(), return_inverse=True)
    period = table["period"].to_numpy(zero_copy_only=False)
    kind = table["kind"].to_numpy()
    refs, parents = {}, {}
    periods = sorted({*period.tolist()}, key=lambda p: (p is not None, p or ""))
    for p in periods:
        here = period == p if p is not None else np.array([x is None for x in period])
        refs[p], parents[p] = Bitmap(code[here & (kind == 0)]), Bitmap(code[here & (kind == 1)])
    sound: dict[int, np.ndarray] = {}
    codes, when = [], []
    for p in periods:
        for n, container in refs[p].containers.items():
            bits = unpack(container)
            left = np.flatnonzero(bits & ~sound[n] if n in sound else bits) + n * BITS
            codes.append(left)
            when += [p] * len(left)
        if p is not None:
            for n, container in parents[p].containers.items():
                sound[n] = sound.get(n, np.zeros(BITS, bool)) | unpack(container)
    both = both[np.concatenate(codes)] if codes else np.zeros(0, np.int64)
    return pa.table({"ptype": ptype.dictionary.take(pa.array(both // width)), "key": key.dictionary.take(pa.array(both % width)), "period": pa.array(when, pa.string())})


def references(edges: DataFrame, edge_types: DataFrame) -> DataFrame:
    """One row per end of every edge with a declared name: edge_name, edge_id, side, ptype, key, loaded_at, removed_at, period."""
    name = F.col("edge_name")
    lower_first = F.concat(F.lower(F.substring(name, 1, 1)), F.expr("substring(edge_name, 2)"))
    types = edge_types.filter("edge_name is not null").select("edge_name", "from_type", "to_type").distinct()
    spelled = types.select(name.alias("said"), "edge_name", "from_type", "to_type").unionByName(types.filter(lower_first != name).select(lower_first.alias("said"), "edge_name", "from_type", "to_type"))
    # A name that is declared itself goes before one that only matches by its lower-cased first letter.
    best = W.partitionBy("said").orderBy((name != F.col("said")).cast("int"), name)
    spelled = spelled.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")
    e = edges.select(name.alias("said"), "edge_id", "from_key", "to_key", "loaded_at", "removed_at").join(small_or_plain(spelled, 100_000), "said")
    ends = F.explode(F.array(
        F.struct(F.lit("from").alias("side"), F.col("from_type").alias("ptype"), F.col("from_key").alias("key")),
        F.struct(F.lit("to").alias("side"), F.col("to_type").alias("ptype"), F.col("to_key").alias("key")),
    ))
    e = e.select("edge_name", "edge_id", ends.alias("end"), "loaded_at", "removed_at")
    return e.select("edge_name", "edge_id", "end.*", "loaded_at", "removed_at", F.date_format("loaded_at", "yyyy-MM").alias("period")).filter(F.col("key").isNotNull())


def suspects(refs: DataFrame, nodes: DataFrame, ranges: int) -> DataFrame:
    """By bitmaps: (ptype, key, period) of references that aren't surely sound. nodes: ptype, key, loaded_at, removed_at."""
    held = refs.select("ptype", "key", "period").distinct().withColumn("kind", F.lit(0))
    forever = nodes.filter("removed_at is null and loaded_at is not null").groupBy("ptype", "key").agg(F.date_format(F.min("loaded_at"), "yyyy-MM").alias("period"), F.lit(1).alias("kind"))
    krange = F.pmod(F.xxhash64("ptype", "key"), F.lit(ranges)).cast("int")
    return held.unionByName(forever).withColumn("krange", krange).groupBy("krange").applyInArrow(_and_not, "ptype string, key string, period string")


def find_orphans(edges: DataFrame, edge_types: DataFrame, nodes: DataFrame, *, keys_per_range: int = 16_384, rows_a_chunk: int = ROWS_A_CHUNK) -> DataFrame:
    """Broken ends: edge_name, period_month, edge_id, side, reason. nodes: type_name, slug, loaded_at, removed_at."""
    refs = references(edges, edge_types)
    n = nodes.select(F.col("type_name").alias("ptype"), F.col("slug").alias("key"), "loaded_at", "removed_at").filter("ptype is not null and key is not null and loaded_at is not null")
    # There can't be more keys than ends and nodes: enough ranges for keys that are missing, too.
    ranges = max(1, -(-(nodes.count() + 2 * edges.count()) // keys_per_range))
    open_bits = materialize(suspects(refs, n, ranges))
    names = small_or_plain(open_bits.select(F.col("ptype").alias("_p"), F.col("key").alias("_k"), F.col("period").alias("_m")), 200_000)
    cand = refs.join(names, (F.col("ptype") == F.col("_p")) & (F.col("key") == F.col("_k")) & F.col("period").eqNullSafe(F.col("_m")), "left_semi")
    parents = n.join(small_or_plain(open_bits.select("ptype", "key").distinct(), 200_000), ["ptype", "key"], "left_semi")
    never = F.lit(NEVER).cast(n.schema["removed_at"].dataType)
    place = F.unix_micros(F.col("loaded_at").cast("timestamp"))
    seen = running_max(cand, parents.withColumn("until", F.coalesce("removed_at", never)), ["ptype", "key"], "loaded_at", "until", place, cuts(edges, place, rows_a_chunk=rows_a_chunk), right_first=True, first_out="first_loaded")
    sound = F.coalesce((F.col("run") == never) | (F.col("run") >= F.col("removed_at")), F.lit(False))
    reason = F.when(F.col("first_loaded").isNull(), "missing").when(F.col("run").isNull(), "late").otherwise("deleted")
    return seen.filter(~sound).select("edge_name", F.col("period").alias("period_month"), "edge_id", "side", reason.alias("reason")).distinct()


def report(orphans: DataFrame) -> DataFrame:
    """Broken ends counted per edge type, month, side and reason."""
    return orphans.groupBy("edge_name", "period_month", "side", "reason").agg(F.count("*").alias("broken_ends"))


def node_rows(character_nodes: DataFrame, canon_nodes: DataFrame) -> DataFrame:
    """The rows of both node tables as type_name, slug, loaded_at, removed_at."""
    cols = ["type_name", "slug", "loaded_at", "removed_at"]
    return character_nodes.withColumn("type_name", F.lit("Character")).select(*cols).unionByName(canon_nodes.select(*cols))


