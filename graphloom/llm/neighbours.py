"""Most similar vectors for every vector.

Method: a hierarchical navigable small-world graph per shard, stored as flat neighbour arrays (see ``hnsw``), with the
shards' results merged.

A (target_prop, dim) group of more than ``shard_bytes`` of vectors is cut into cells around pivots, which are fitted on a
bounded sample and drawn in proportion to density; neighbouring cells (about ``CELLS_A_SHARD``) make a shard. A vector is
indexed in the shard of its nearest pivot, and searched in the ``probes`` shards that hold the pivots nearest to it. Many
small cells to a shard follow the data more closely than one pivot a shard would, so two shards suffice. There are at most
``MOST_CELLS`` pivots a group: beyond that many shards, these grow up to ``MOST_BYTES``, and shards beyond that are cut by
hash, with their queries going to all their parts. Every vector is indexed, whatever the size.

Each shard has a number and lies alone in its partition (or shares it only beyond ``MOST_PARTITIONS`` shards, when they are
handled one after the other), so the tasks are as many as the shards and none holds more than one. Exact copies are one
vector in the index, whatever their number; they come back in the merge as their lowest ids (k + 1 suffice).

Defined results: by cosine, ties by the lower id. A vector takes part only if it is not null, has dim elements, none of
them null, NaN or infinite, and a norm above 1e-10. Repeated rows are one vector. Null target_prop or dim: no part. A
group of one vector has no neighbours; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

K = 5
SHARD_BYTES, MOST_BYTES = 4 << 20, 128 << 20
MOST_PARTITIONS = 20_000
PROBES = 2
#: Bounds of what is fitted on the driver, per group: pivots, and sampled rows for each.
CELLS_A_SHARD, MOST_CELLS, SAMPLE_PER_CELL = 64, 8192, 16
GROUP = ["target_prop", "dim"]
KEY = [*GROUP, "h1", "h2"]
FOUND = "target_prop string, dim int, rep bigint, other bigint, cosine double"
#: The graph's parameters, and the steps of the searches of the finished graph: from a vector's own links, and from the top.
GRAPH = {"degree": 32, "beam": 64, "steps": 40, "entries": 16}
OWN_STEPS, GUEST_STEPS = 8, 24


def valid(vectors: DataFrame) -> DataFrame:
    """The vectors that take part: target_prop, dim, h1, h2 (equal for exact copies), vec_id, embedding."""
    e = F.col("embedding").cast("array<float>")
    squares = F.aggregate(e, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    finite = ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = F.when(e.isNotNull() & (F.size(e) == F.col("dim")), F.when(F.coalesce(finite, F.lit(False)), F.sqrt(squares) > 1e-10))
    v = vectors.filter("target_prop is not null and dim is not null and vec_id is not null").filter(F.coalesce(ok, F.lit(False)))
    return v.select(*GROUP, F.xxhash64(e).alias("h1"), F.xxhash64(F.lit(1), e).alias("h2"), "vec_id", e.alias("embedding"))


def _raw(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _norms(x: np.ndarray) -> np.ndarray:
    """In double, a block at a time: no copy of the whole in double is made."""
    return np.concatenate([np.sqrt((x[a : a + 8192].astype(np.float64) ** 2).sum(1)) for a in range(0, len(x), 8192)] or [np.zeros(0)])


def _unit(x: np.ndarray) -> np.ndarray:
    return x * (1 / _norms(x))[:, None].astype(np.float32)


def _fit(x: np.ndarray, cells: int, rounds: int = 2) -> np.ndarray:
    """Pivots: sampled vectors, moved to the middle of what is nearest to them."""
    pivots = x[np.random.default_rng(0).permutation(len(x))[:cells]]
    for _ in range(rounds):
        near = np.concatenate([(x[a : a + 4096] @ pivots.T).argmax(1) for a in range(0, len(x), 4096)])
        total = np.zeros_like(pivots)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        pivots = np.where(norm > 1e-6, total / np.maximum(norm, 1e-6), pivots)
    return pivots


class Route:
    """Where the vectors of one group go: pivots, ordered by shard, and into how many parts each shard is cut."""

    def __init__(self, x: np.ndarray, n: int, shards: int, most_rows: int, first: int):
        """x: a sample of the group's n unit vectors; ``first``: the number of the group's first part."""
        pivots = _fit(x, min(MOST_CELLS, shards * CELLS_A_SHARD, len(x)))
        middle = _fit(pivots, min(shards, len(pivots)), 10)
        shard = (pivots @ middle.T).argmax(1)
        used, shard = np.unique(shard, return_inverse=True)
        by = np.argsort(shard, kind="stable")
        self.pivots, self.starts = pivots[by], np.searchsorted(shard[by], np.arange(len(used)))
        held = np.bincount(self.best(x).argmax(1), minlength=len(used)) * (n / len(x))
        self.cuts = np.maximum(1, np.ceil(held / most_rows).astype(np.int64))
        self.first = first + np.concatenate(([0], np.cumsum(self.cuts)[:-1]))
        self.parts = int(self.cuts.sum())

    def best(self, x: np.ndarray) -> np.ndarray:
        """[vector, shard]: the similarity to the shard's nearest pivot."""
        return np.concatenate([np.maximum.reduceat(x[a : a + 4096] @ self.pivots.T, self.starts, axis=1) for a in range(0, len(x), 4096)])

    def targets(self, x: np.ndarray, rep: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, part, home): where each vector is searched, and where indexed."""
        order = np.argsort(-self.best(x), axis=1, kind="stable")[:, :probes]
        own = (rep * np.int64(0x9E3779B1) >> 16) & 0xFFFF
        rows, part, home = [], [], []
        for p in range(order.shape[1]):
            n = self.cuts[order[:, p]]
            r = np.repeat(np.arange(len(x)), n)
            sub = np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n)
            rows.append(r)
            part.append(self.first[order[r, p]] + sub)
            home.append((sub == own[r] % n[r]) if p == 0 else np.zeros(len(r), bool))
        return np.concatenate(rows), np.concatenate(part).astype(np.int64), np.concatenate(home)


def _routes(vectors: DataFrame, shard_bytes: int) -> tuple[dict, int]:
    """The routes of the groups beyond a shard, and the number of their parts."""
    # Only groups beyond a shard come here: no more than the table has shards.
    n = F.col("n") * F.col("dim") * 4
    counts = vectors.groupBy(*GROUP).agg(F.count("*").alias("n")).filter("target_prop is not null and dim > 0").filter(n > shard_bytes).orderBy(*GROUP).collect()
    out, parts = {}, 0
    for r in counts:
        rows = max(1, shard_bytes // (4 * r["dim"]))
        shards = min(MOST_CELLS, -(-r["n"] // rows))
        # A share of the hash's range picks the sample; the limit only bounds what an unlucky hash could bring.
        share = min(1.0, SAMPLE_PER_CELL * min(MOST_CELLS, shards * CELLS_A_SHARD) / r["n"])
        mine = vectors.filter((F.col("target_prop") == r["target_prop"]) & (F.col("dim") == r["dim"]) & (F.pmod(F.xxhash64(F.lit(7), "vec_id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1))
        picked = valid(mine).select("embedding").limit(2 * SAMPLE_PER_CELL * MOST_CELLS).toArrow()
        # Of copies one is enough; in order, so that the same rows give the same pivots.
        x = np.unique(_raw(picked["embedding"], r["dim"]), axis=0)
        if len(x) < 2:
            continue
        most_rows = 2 * max(rows, min(r["n"] // shards, MOST_BYTES // (4 * r["dim"])))
        route = out[(r["target_prop"], r["dim"])] = Route(_unit(x), r["n"], shards, most_rows, parts)
        parts += route.parts
    return out, parts


def _spans(batch: pa.RecordBatch | pa.Table, names: list[str]) -> Iterator[tuple[int, int]]:
    """The runs of rows that are alike in ``names``."""
    change = np.zeros(max(0, batch.num_rows - 1), bool)
    for n in names:
        c = batch.column(n)
        v = c.to_numpy(zero_copy_only=False)
        change |= v[1:] != v[:-1]
    edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield a, b


ROUTED = "target_prop string, dim int, rep bigint, embedding array<float>, shard bigint, home boolean"


def _route(reps: DataFrame, routes: dict, shards: int, probes: int) -> DataFrame:
    """Rows with (shard, home). Groups within a shard go whole to shards of their own numbers, chosen by hash."""
    spark = reps.sparkSession
    small = (F.lit(shards) + F.pmod(F.xxhash64(*GROUP), F.lit(spark.sparkContext.defaultParallelism))).cast("bigint")
    rows = reps.select(*GROUP, "rep", "embedding", small.alias("shard"), F.lit(True).alias("home"))
    if not routes:
        return rows
    shared = spark.sparkContext.broadcast(routes)

    def send(batches):
        for batch in batches:
            for a, b in _spans(batch, GROUP):
                part = batch.slice(a, b - a)
                prop, dim = part["target_prop"][0].as_py(), part["dim"][0].as_py()
                route = shared.value.get((prop, dim))
                if route is None:
                    yield part
                    continue
                row, shard, home = route.targets(_unit(_raw(part["embedding"], dim)), part["rep"].to_numpy(), probes)
                taken = part.select([*GROUP, "rep", "embedding"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(shard), pa.array(home)], schema=part.schema)

    # Sorted, the rows of a group stand together in their batches.
    return rows.sortWithinPartitions(*GROUP).mapInArrow(send, ROUTED)


def _shard(table: pa.Table, k: int, least: float, options: dict) -> pa.RecordBatch:
    """The k most similar ones within one shard of each vector that is searched in it."""
    from graphloom.llm.hnsw import Hnsw, top

    prop, dim = table["target_prop"][0].as_py(), table["dim"][0].as_py()
    raw, ids = _raw(table["embedding"], dim), table["rep"].to_numpy()
    home = table["home"].to_numpy(zero_copy_only=False)
    norms = _norms(raw)
    at_home, guests = np.flatnonzero(home), np.flatnonzero(~home)
    unit = lambda at: raw[at] * (1 / norms[at])[:, None].astype(np.float32)
    rows, others = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(at_home):
        x = unit(at_home)
        h = Hnsw(x, **options)
        more = k + 3
        # Each vector is searched from its own links in the finished graph.
        found = [(at_home, h.search(x, own=np.arange(len(x)), steps=OWN_STEPS)), (guests, h.search(unit(guests), steps=GUEST_STEPS) if len(guests) else None)]
        for who, result in found:
            if result is not None:
                i, _ = top(*result, more)
                rows.append(np.repeat(who, i.shape[1]))
                others.append(np.where(i.ravel() >= 0, at_home[i.ravel()], -1))
    rows, others = np.concatenate(rows), np.concatenate(others)
    ok = others >= 0
    ok[ok] = ids[rows[ok]] != ids[others[ok]]
    rows, others = rows[ok], others[ok]
    double = lambda at: raw[at].astype(np.float64)
    cos = np.concatenate([np.einsum("ij,ij->i", double(rows[a : a + 16_384]), double(others[a : a + 16_384])) for a in range(0, len(rows), 16_384)] or [np.zeros(0)]) / (norms[rows] * norms[others])
    ok = cos >= least
    rows, others, cos = rows[ok], others[ok], cos[ok]
    by = np.lexsort((ids[others], -cos, rows))
    rows, others, cos = rows[by], others[by], cos[by]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
    rows, others, cos = rows[rank < k], others[rank < k], cos[rank < k]
    n = len(rows)
    return pa.RecordBatch.from_pydict({"target_prop": pa.array([prop] * n, pa.string()), "dim": pa.array(np.full(n, dim, np.int32)), "rep": ids[rows], "other": ids[others], "cosine": cos})


def _search(k: int, least: float, options: dict):
    names = ["shard", *GROUP]

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for a, b in _spans(batch, names):
                part = batch.slice(a, b - a)
                if held and any(held[0][n][0] != part[n][0] for n in names):
                    yield _shard(pa.Table.from_batches(held), k, least, options)
                    held = []
                held.append(part)
        if held:
            yield _shard(pa.Table.from_batches(held), k, least, options)

    return run


def most_similar(vectors: DataFrame, *, k: int = K, least: float = -1.1, shard_bytes: int = SHARD_BYTES, probes: int = PROBES, **options) -> DataFrame:
    """target_prop, dim, vec_id, other_id, cosine: the k most similar of each vector, as far as cosine >= ``least``.

    ``options`` (degree, beam, steps, entries) are the graph's; the README has the recall of the default.
    """
    options = GRAPH | options
    v = valid(vectors)
    reps = v.groupBy(*KEY).agg(F.min("vec_id").alias("rep"), F.first("embedding").alias("embedding"))
    routes, shards = _routes(vectors, shard_bytes)
    routed = _route(reps, routes, shards, probes)
    parts = min(MOST_PARTITIONS, shards + vectors.sparkSession.sparkContext.defaultParallelism)
    # In order of ids: a task that runs again must build the same graph, in whatever order its rows come.
    alone = routed.repartitionById(parts, F.pmod("shard", F.lit(parts)).cast("int")).sortWithinPartitions("shard", *GROUP, "rep")
    found = alone.mapInArrow(_search(k, least, options), FOUND)

    # Copies: their lowest k + 1 ids stand for them as neighbours; as queries each has its own row.
    members = v.select(*KEY, "vec_id").distinct()
    several = members.groupBy(*KEY).agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).filter("n > 1")
    copies = members.join(several.drop("n"), KEY).select(*GROUP, "rep", "vec_id")
    low = copies.withColumn("i", F.row_number().over(W.partitionBy(*GROUP, "rep").orderBy("vec_id"))).filter(F.col("i") <= k + 1).drop("i")
    others = found.join(low.select(*GROUP, F.col("rep").alias("other"), F.col("vec_id").alias("copy")), [*GROUP, "other"], "left")
    lists = others.select(*GROUP, "rep", F.struct((-F.col("cosine")).alias("minus"), F.coalesce("copy", "other").alias("id")).alias("n"))
    lists = lists.unionByName(low.select(*GROUP, "rep", F.struct(F.lit(-1.0).alias("minus"), F.col("vec_id").alias("id")).alias("n")))
    # At most (probes * k + 1) * (k + 1) entries a list.
    lists = lists.groupBy(*GROUP, "rep").agg(F.slice(F.array_sort(F.collect_set("n")), 1, k + 1).alias("list"))
    mine = lists.join(copies, [*GROUP, "rep"], "left").withColumn("vec_id", F.coalesce("vec_id", "rep"))
    own = F.slice(F.filter("list", lambda x: x["id"] != F.col("vec_id")), 1, k)
    pairs = mine.select(*GROUP, "vec_id", F.explode(own).alias("n"))
    return pairs.select(*GROUP, "vec_id", F.col("n.id").alias("other_id"), (-F.col("n.minus")).alias("cosine")).filter(F.col("cosine") >= least)


def similar_pairs(vectors: DataFrame, *, k: int = K, least: float = 0.85, **how) -> DataFrame:
    """vec_a < vec_b: one is among the k most similar of the other, and their cosine is at least ``least``."""
    m = most_similar(vectors, k=k, least=least, **how)
    return m.select(F.least("vec_id", "other_id").alias("vec_a"), F.greatest("vec_id", "other_id").alias("vec_b")).filter("vec_a < vec_b").distinct()
