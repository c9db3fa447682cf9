import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import neighbours
from graphloom.llm.hnsw import FLAT, Hnsw, top

SCHEMA = "vec_id bigint, owner_slug string, target_prop string, dim int, embedding array<float>, shard int"


def clustered(n, dim, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 4, dim))
    x = centres[rng.integers(0, len(centres), n)] + 0.35 * rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def exact(x, k):
    s = x @ x.T
    np.fill_diagonal(s, -2)
    return np.argsort(-s, axis=1, kind="stable")[:, :k], s


@pytest.mark.parametrize("n", [1, 2, 30, 4000])
def test_graph_recall(n):
    x = clustered(max(n, 8), 16)[:n].astype(np.float32)
    h = Hnsw(x, degree=32, beam=64, steps=48, entries=16, batch=256)
    assert (h.upper is None) == (n <= FLAT)
    ids, sims = top(*h.search(x, own=np.arange(n), steps=8), 8)
    ids, sims = zip(*([[j for j, _ in p][:5], [v for _, v in p][:5]] for p in ([(j, v) for j, v in zip(a, b, strict=True) if j not in (i, -1)] for i, (a, b) in enumerate(zip(ids, sims, strict=True)))), strict=True)
    want, s = exact(x, 5)
    hits = 0
    for i in range(n):
        mine = {j for j in ids[i] if j >= 0}
        assert i not in mine and len(mine) == min(5, n - 1)
        assert np.allclose([s[i, j] for j in ids[i] if j >= 0], sims[i][: len(mine)], atol=1e-5)
        hits += len(mine & set(want[i][: n - 1]))
    assert hits >= 0.9 * n * min(5, n - 1)
    found, _ = h.search(x[: min(n, 50)])
    assert all(i in found[i] for i in range(min(n, 50)))


def rows(spark, data):
    return spark.createDataFrame([(i, "o", p, d, None if e is None else [None if v is None else float(v) for v in e], 1) for i, p, d, e in data], SCHEMA)


@pytest.mark.parametrize(("shard_bytes", "probes"), [(1 << 20, 3), (9600, 3), (2000, 8)])
def test_recall_and_merge(spark, shard_bytes, probes):
    x = clustered(900, 12, 3)
    df = rows(spark, [(i, "p", 12, v) for i, v in enumerate(x)])
    got = neighbours.most_similar(df, k=5, shard_bytes=shard_bytes, probes=probes).collect()
    x32 = x.astype(np.float32).astype(np.float64)
    x32 /= np.linalg.norm(x32, axis=1, keepdims=True)
    want, s = exact(x32, 5)
    by = {}
    for r in got:
        assert abs(r.cosine - s[r.vec_id, r.other_id]) < 1e-6
        by.setdefault(r.vec_id, set()).add(r.other_id)
    assert all(len(v) == 5 for v in by.values()) and len(got) == 4500
    assert sum(len(by[i] & set(want[i])) for i in range(900)) >= 0.9 * 4500


def test_what_takes_part_and_copies(spark):
    a, b = [1.0, 0, 0], [0.9, 0.1, 0]
    data = [(i, "p", 3, a) for i in range(1, 10)] + [(20, "p", 3, b), (20, "p", 3, b), (21, "p", 3, [0, 0, 1])]
    data += [(30, "p", 3, None), (31, "p", 3, [0, 0, 0]), (32, "p", 3, [1, 0]), (33, "p", 3, [1, None, 0]), (34, "p", 3, [float("nan"), 1, 0]), (35, "p", 3, [float("inf"), 1, 0]), (36, "q", 3, a), (37, None, 3, a), (38, "p", 2, a)]
    got = {}
    for r in neighbours.most_similar(rows(spark, data), k=5, least=0.85).collect():
        got.setdefault(r.vec_id, []).append(r.other_id)
    assert {k: sorted(v) for k, v in got.items()} == {
        **{i: [j for j in range(1, 7) if j != i][:5] for i in range(1, 10)},
        20: [1, 2, 3, 4, 5],
    }
    pairs = {(r.vec_a, r.vec_b) for r in neighbours.similar_pairs(rows(spark, data)).collect()}
    assert pairs == {(min(i, j), max(i, j)) for i, v in got.items() for j in v}


def test_vectors_of_doubles_and_other_columns(spark):
    df = rows(spark, [(i, "p", 3, [1, i, 0]) for i in range(4)]).withColumn("embedding", F.col("embedding").cast("array<double>")).withColumns({c: F.lit(1) for c in ("rep", "home", "h1", "n")})
    assert neighbours.most_similar(df, k=1, shard_bytes=24).count() == 4


def test_nothing(spark):
    assert neighbours.similar_pairs(rows(spark, [])).collect() == []
    assert neighbours.similar_pairs(rows(spark, [(1, "p", 3, [1, 0, 0])])).collect() == []
