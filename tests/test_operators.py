import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from graphloom.errors import ConflictError
from graphloom.operators import compaction, incremental, orphans, replay
from graphloom.util import chunk_of, cuts, running_max

T0 = dt.datetime(2025, 1, 1)
LOG = "arrival_no bigint, tx_id string, db_version bigint, seq_in_tx int, op string, entity_kind string, type_name string, entity_key string, payload string, committed_at timestamp, chunk string, live int"


def log_rows(spark, rows):
    return spark.createDataFrame([(i, tx, v, s, op, "node", t, k, p, T0, "x", 1) for i, (tx, v, s, op, t, k, p) in enumerate(rows)], LOG)


def brute_replay(rows, committed):
    state, seen = {}, {}
    ok = [r for r in rows if r[0] in committed and r[5] is not None and r[1] is not None and r[2] is not None and (r[3] or "").strip().lower() in replay.OPS]
    for _tx, v, s, op, t, k, p in sorted(ok, key=lambda r: (r[1], r[2])):
        key, op = (t, "".join(k.split())), op.strip().lower()
        if seen.get(key, (-1, -1)) >= (v, s):
            continue
        seen[key] = (v, s)
        if op == "insert":
            state[key] = {}
        elif op == "delete":
            state.pop(key, None)
            continue
        state.setdefault(key, {}).update(replay.payload_columns(p))
    return {k: (*seen[k], c) for k, c in state.items()}


@pytest.mark.parametrize("rows_a_chunk", [5, 60, 100_000])
def test_replay_equals_brute_force(spark, rows_a_chunk):
    rng = random.Random(4)
    rows = []
    for v in range(1, 120):
        for s in range(rng.randrange(1, 5)):
            key = "id=1" if rng.random() < 0.4 else f"id={rng.randrange(2, 9)}"
            op = rng.choice(["insert", "update", "update", "delete", " UPDATE ", "Delete"])
            payload = rng.choice(['{"a": %d}' % v, '{"b": %d, "a": null}' % v, '{"before": {"a": 1}, "after": {"c": %d}}' % v, None, "{broken", "[1]"])
            rows.append((f"tx{v}", v, s, op, rng.choice(["T", "U"]), rng.choice([key, key.replace("=", " = ")]), payload))
    rows += rng.sample(rows, 40)
    rng.shuffle(rows)
    rows += [("tx1", 1, 9, "insert", "T", None, None), ("tx1", None, 9, "insert", "T", "id=5", None), ("tx1", 1, 9, "bogus", "T", "id=5", None), ("lost", 999, 0, "insert", "T", "id=77", None)]
    committed = {f"tx{v}" for v in range(1, 120) if v % 7}
    cat = spark.createDataFrame([(t,) for t in [*committed, *committed, None]], "tx_id string")
    got = replay.current(log_rows(spark, rows), cat, rows_a_chunk=rows_a_chunk).collect()
    mine = {(r.type_name, r.entity_key): (r.db_version, r.seq_in_tx, r["columns"]) for r in got}
    assert len(mine) == len(got)
    assert mine == brute_replay(rows, committed)


def test_replay_counts_what_it_skips(spark):
    rows = [("t", 1, 0, "insert", "T", "k", "{}"), ("t", 1, 0, "insert", "T", "k ", "{}"), ("t", 2, 0, "update", "T", "k", '{"x": "1"}')]
    r = replay.replay(log_rows(spark, rows)).first()
    assert (r.applied, r.skipped, r["columns"]) == (2, 1, {"x": '"1"'})


def test_replay_of_nothing(spark):
    assert replay.replay(log_rows(spark, []), spark.createDataFrame([], "tx_id string")).count() == 0


def day(n, s=0):
    return T0 + dt.timedelta(days=n, seconds=s)


EDGE = "edge_id bigint, edge_name string, from_key string, to_key string, loaded_at timestamp, removed_at timestamp, period string"
NODE = "type_name string, slug string, loaded_at timestamp, removed_at timestamp, bits string"
TYPES = "edge_name string, from_type string, to_type string"


def brute_orphans(edges, types, nodes):
    out = set()
    decl = {}
    for n, a, b in types:
        decl.setdefault(n[0].lower() + n[1:], (n, a, b))
        decl[n] = (n, a, b)
    for i, name, fk, tk, loaded, removed, _ in edges:
        if name not in decl:
            continue
        n, a, b = decl[name]
        for side, t, k in (("from", a, fk), ("to", b, tk)):
            if k is None:
                continue
            own = [x for x in nodes if x[0] == t and x[1] == k and x[2] is not None]
            if loaded is not None and any(x[2] <= loaded and (x[3] is None or (removed is not None and x[3] >= removed)) for x in own):
                continue
            reason = "missing" if not own else "late" if loaded is None or all(x[2] > loaded for x in own) else "deleted"
            out.add((n, loaded and loaded.strftime("%Y-%m"), i, side, reason))
    return out


@pytest.mark.parametrize(("keys_per_range", "rows_a_chunk"), [(3, 20), (16_384, 200_000)])
def test_orphans_equal_brute_force(spark, keys_per_range, rows_a_chunk):
    rng = random.Random(5)
    keys = ["", "a", "b", "hot", "hot", "hot", "c", "Ä", "a "]
    types = [("Knows", "P", "P"), ("In", "P", "Q"), ("in", "Q", "P")]
    when = lambda: None if rng.random() < 0.05 else day(rng.randrange(0, 90), rng.randrange(3))
    edges = [(i, rng.choice(["Knows", "knows", "In", "in", "Nope", None]), rng.choice([*keys, None]), rng.choice([*keys, None]), when(), rng.choice([None, when()]), "clash") for i in range(300)]
    edges += edges[:20]
    nodes = [(rng.choice(["P", "Q", None]), rng.choice([*keys[:-2], None]), when(), rng.choice([None, when(), when()]), "clash") for _ in range(25)]
    got = orphans.find_orphans(spark.createDataFrame(edges, EDGE), spark.createDataFrame(types, TYPES), spark.createDataFrame(nodes + nodes[:3], NODE), keys_per_range=keys_per_range, rows_a_chunk=rows_a_chunk).collect()
    assert len(set(got)) == len(got)
    want = brute_orphans([e for e in edges if e[1] is not None], types, nodes)
    assert {tuple(r) for r in got} == want


def test_orphans_of_nothing(spark):
    e, t, n = spark.createDataFrame([], EDGE), spark.createDataFrame([], TYPES), spark.createDataFrame([], NODE)
    assert orphans.find_orphans(e, t, n).count() == 0
    one = spark.createDataFrame([(1, "Knows", "x", None, T0, None, "")], EDGE)
    r = orphans.find_orphans(one, spark.createDataFrame([("Knows", "P", "P")], TYPES), n).collect()
    assert [tuple(x) for x in r] == [("Knows", "2025-01", 1, "from", "missing")]


def test_containers_round_trip():
    for n in (0, 1, 100, 5000, orphans.BITS):
        bits = bytearray(orphans.BITS // 8)
        for i in random.Random(n).sample(range(orphans.BITS), n):
            bits[i // 8] |= 1 << (i % 8)
        c = orphans.pack(bytes(bits))
        assert len(c) <= orphans.BITS // 8 + 1 and orphans.unpack(c).sum() == n


@pytest.mark.parametrize("rows_a_chunk", [1, 20, 1000])
def test_running_max_by_chunks(spark, rows_a_chunk):
    rng = random.Random(6)
    left = [(rng.choice("ab"), rng.choice([None, rng.randrange(40)]), i) for i in range(80)]
    right = [(rng.choice("abc"), rng.randrange(40), rng.randrange(100)) for _ in range(40)]
    l, r = spark.createDataFrame(left, "k string, at int, i int"), spark.createDataFrame(right, "k string, at int, v int")
    chunks = cuts(l, F.col("at"), rows_a_chunk=rows_a_chunk)
    for first in (True, False):
        got = running_max(l, r, ["k"], "at", "v", F.col("at"), chunks, right_first=first, first_out="lo").collect()
        for x in got:
            before = [v for k, at, v in right if k == x.k and x["at"] is not None and (at <= x["at"] if first else at < x["at"])]
            assert x.run == max(before, default=None)
            assert x.lo == min((at for k, at, _ in right if k == x.k), default=None)
        assert len(got) == 80


@pytest.mark.parametrize("rows", [20_000, 500])
def test_chunks_hold_few_rows_whatever_lies_outside(spark, rows):
    """One outlying version and one day of bulk load leave the other chunks as they are: at most twice the rows asked for."""
    df = spark.range(200_000).select(F.when(F.col("id") == 0, 10**15).when(F.col("id") < 100_000, 500_000 + F.col("id") % 1000).otherwise(F.col("id")).alias("v"))
    at = cuts(df, F.col("v"), rows_a_chunk=rows)
    got = df.groupBy(chunk_of(F.col("v"), at).alias("c")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("c").collect()
    assert max(r.n for r in got) <= 2 * rows and sum(r.n for r in got) == 200_000
    assert all(a.hi < b.lo for a, b in zip(got, got[1:], strict=False))


VISIBLE = "graph_version bigint, tx_id string, table_id string, entity_id bigint, previous_graph_version bigint, ingested_at timestamp, first_ingested_at int"
RUNS = "run_id bigint, table_id string, from_version bigint, to_version bigint, read_at timestamp, status string"


def visible(spark, rng, n=200):
    rows = [(rng.randrange(60), f"tx{i % 9}", rng.choice(["a", "a", "a", "b", None]), rng.randrange(8), None, rng.choice([None, day(rng.randrange(30))]), 0) for i in range(n)]
    return rows + rows[:30], spark.createDataFrame(rows + rows[:30], VISIBLE)


def test_pending_equals_brute_force(spark):
    rng = random.Random(7)
    rows, df = visible(spark, rng)
    runs = [(i, rng.choice(["a", "b", "c", None]), lo := rng.randrange(50), rng.choice([lo, lo + rng.randrange(20), None]), rng.choice([None, day(rng.randrange(30))]), rng.choice(["succeeded", " SUCCEEDED ", "failed", None])) for i in range(30)]
    got = incremental.pending(df, spark.createDataFrame(runs + runs[:5], RUNS), rows_a_chunk=30).select("table_id", "entity_id", "graph_version").collect()
    seen = {}
    for v, _, t, e, _, at, _ in rows:
        if t is not None:
            seen.setdefault((t, e, v), []).append(at)
    want = set()
    for (t, e, v), ats in seen.items():
        first = min((a for a in ats if a is not None), default=None)
        taken = first is not None and any(r[1] == t and (r[5] or "").strip().lower() == "succeeded" and None not in r[2:5] and r[2] < v <= r[3] and r[4] >= first for r in runs)
        if not taken:
            want.add((t, e, v))
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == want


def test_pending_without_runs_or_changes(spark):
    none = spark.createDataFrame([], RUNS)
    _, df = visible(spark, random.Random(1), 20)
    assert incremental.pending(df, none).count() == incremental.changes(df).count()
    assert incremental.pending(spark.createDataFrame([], VISIBLE), none).count() == 0


def keys_of(df):
    return {(r.table_id, r.entity_id, r.graph_version) for r in df.collect()}


def test_job_survives_failures_and_late_rows(spark, tmp_path):
    rng = random.Random(8)
    rows, df = visible(spark, rng)
    job = incremental.IncrementalJob(spark, str(tmp_path / "job"))
    assert job.output() is None

    def die():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        job.run(df, before_commit=die)
    assert job.output() is None and job.watermark() is None
    early = df.filter("graph_version < 30 and (ingested_at is null or day(ingested_at) < 20)")
    assert job.run(early) > 0
    assert job.watermark() == 29
    with pytest.raises(RuntimeError):
        job.run(df, before_commit=die)
    late = df.unionByName(spark.createDataFrame([(5, "txl", "a", 99, None, day(300), 0), (5, "txn", "a", 98, None, None, 0)], VISIBLE))
    assert job.run(df) > 0 and job.run(late) == 2
    again = spark.createDataFrame([(5, "txl", "a", 99, None, day(301), 0), (5, "txn", "a", 98, None, day(302), 0)], VISIBLE)
    assert job.run(late) == 0 and job.run(late.unionByName(again)) == 0
    out = [tuple(r) for r in job.output().select(*incremental.CHANGE).collect()]
    assert len(out) == len(set(out)) and set(out) == keys_of(incremental.changes(late))
    assert incremental.IncrementalJob(spark, str(tmp_path / "none")).run(spark.createDataFrame([], VISIBLE)) == 0


def test_job_takes_each_record_once_whatever_its_transform_drops(spark, tmp_path):
    _, df = visible(spark, random.Random(9))
    df = df.filter("ingested_at is not null")
    job = incremental.IncrementalJob(spark, str(tmp_path / "job"))
    odd = lambda t: t.filter("entity_id % 2 = 1").select("entity_id", "tx_id")
    handled = []
    for part in (df.filter("graph_version < 20"), df.filter("graph_version < 45"), df, df):
        handled.append(job.run(part, odd))
    assert handled[0] > 0 and handled[3] == 0
    assert sum(handled) == incremental.changes(df).filter("entity_id % 2 = 1").count() == job.output().count()


def test_a_run_over_nothing_new_reads_no_old_rows(spark, tmp_path):
    _, df = visible(spark, random.Random(10))
    df = df.filter("ingested_at is not null")
    job = incremental.IncrementalJob(spark, str(tmp_path / "job"))
    job.run(df)
    last = job.last()
    guarded = df.withColumn("tx_id", F.when(F.lit(True), F.raise_error(F.lit("old row read"))).cast("string"))
    assert job.run(guarded) == 0
    fresh = spark.createDataFrame([(last["upper"] + 1, "new", "a", 1, None, day(400), 0)], VISIBLE)
    assert job.run(guarded.unionByName(fresh)) == 1
    path = str(tmp_path / "visible")
    df.write.parquet(path)
    plan = spark.read.schema(VISIBLE).parquet(path).filter(job._above(df, job.last()))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan


def test_rival_runs(spark, tmp_path):
    _, df = visible(spark, random.Random(11), 40)
    job, rival = (incremental.IncrementalJob(spark, str(tmp_path / "job")) for _ in range(2))
    once = []

    def overtaken():
        if not once:
            once.append(rival.run(df.filter("graph_version < 30")))

    job.run(df, before_commit=overtaken)
    out = [tuple(r) for r in job.output().select(*incremental.CHANGE).collect()]
    assert once[0] > 0 and len(out) == len(set(out)) and set(out) == keys_of(incremental.changes(df))
    assert len(job.numbers()) == 2 and len(job.files.list("data")) == 2


def test_job_follows_an_earlier_reader(spark, tmp_path):
    _, df = visible(spark, random.Random(12))
    runs = spark.createDataFrame([(1, "a", 0, 40, day(15), "succeeded"), (2, "b", 10, 60, day(60), "Succeeded")], RUNS)
    job = incremental.IncrementalJob(spark, str(tmp_path / "job"), runs)
    assert job.run(df) == incremental.pending(df, runs).count() > 0
    assert keys_of(job.output()) == keys_of(incremental.pending(df, runs)) and job.run(df) == 0


DS = "type_id bigint, table_id string, dataset_version bigint, row_count bigint, target_rows_per_fragment bigint, size int"
FR = "table_id string, fragment_id bigint, added_version bigint, removed_version bigint, physical_rows bigint, target int"
ROWS = "table_id string, fragment_id bigint, row_id bigint, is_deleted boolean, payload string, goes int"


def tables(spark, seed=9):
    rng = random.Random(seed)
    # Names that file systems don't take as they are, and an empty one.
    names = ["t/0", "", ".", "a=b c", "Ä%41"]
    ds = [(i, names[i], 10, None, rng.choice([8, 8, 20, None]), 1) for i in range(5)]
    fr, rows = [], []
    for i in range(5):
        for f in range(rng.choice([1, 2, 12])):
            fr.append((names[i], f, rng.choice([3, 10, 11]), rng.choice([None, None, 10, 12]), None, 0))
            for _ in range(rng.choice([0, 1, 3, 9, 25])):
                rows.append((names[i], f, rng.randrange(60), None, "", 0))
    rows = [(t, f, r, (r * 7) % 11 == 0 or None, f"p{t}{r}", 0) for t, f, r in sorted({x[:3] for x in rows})]
    return ds, fr, rows


def brute_plan(ds, fr, rows):
    target = {d[1]: (d[2], d[4]) for d in ds}
    live = {(t, f) for t, f, a, r, *_ in fr if a <= target[t][0] and (r is None or r > target[t][0])}
    size = {k: [r for r in rows if (r[0], r[1]) == k] for k in live}
    small = {k for k in live if target[k[0]][1] is not None and len(size[k]) < target[k[0]][1]}
    out = {k for k in small if sum(x[0] == k[0] for x in small) >= 2}
    return live, out | {k for k in live if sum(bool(r[3]) for r in size[k]) * 10 > len(size[k])}


@pytest.mark.parametrize("seed", [9, 10])
def test_compaction(spark, tmp_path, seed):
    ds, fr, rows = tables(spark, seed)
    d, f, r = spark.createDataFrame(ds + ds[:2], DS), spark.createDataFrame(fr + fr[:4], FR), spark.createDataFrame(rows, ROWS)
    live, gone = brute_plan(ds, fr, rows)
    got = compaction.plan(d, f, r).collect()
    assert len(got) == len(gone) and {(x.table_id, x.fragment_id) for x in got} == gone
    starts = {(x.table_id, x.fragment_id): x.start for x in compaction.assign(compaction.plan(d, f, r), chunk_fragments=3).collect()}
    for t, k in gone:
        assert starts[(t, k)] == sum(sum((x.table_id, x.fragment_id) == (y[0], y[1]) and not y[3] for y in rows) for x in got if x.table_id == t and x.fragment_id < k)
    want = {(t, i, p) for t, k, i, dead, p, *_ in rows if (t, k) in live and not dead}

    in_place, removed = compaction.removed_by(d, f, r, str(tmp_path / "p"))
    assert keys(removed, *compaction.KEY) == gone
    files = compaction.FragmentStore(spark, str(tmp_path / "s"))
    files.adopt(d, f, r)
    assert len(list((tmp_path / "s" / "tiny").rglob("*.parquet"))) == len({x[:2] for x in rows} & live)
    done = files.compact(d)
    assert done["fragments_removed"] == len(gone)
    # One file of new fragments a dataset, as they are small.
    assert len(list((tmp_path / "s" / "data").rglob("*.parquet"))) == len({t for t, _ in keys(files.table("live").filter("generation > 0"), "table_id", "generation")})
    for store in (in_place, files):
        out = store.read().collect()
        assert len(out) == len(want) and {(x.table_id, x.row_id, x.payload) for x in out} == want
        # Nothing of the first snapshot is lost to its readers.
        first = {(x.table_id, x.row_id, x.payload) for x in store.read(0).collect()}
        assert first == want and keys(store.table("live", 0), *compaction.KEY) == live
        new = keys(store.table("live"), *compaction.KEY) - live
        top = {t: max(x[1] for x in fr if x[0] == t) for t, _ in live}
        assert len(new) == done["fragments_added"] and all(k > top[t] for t, k in new)
        with pytest.raises(ConflictError):
            store.commit(0, "x")
    files.vacuum()
    assert {(x.table_id, x.row_id, x.payload) for x in files.read().collect()} == want


def keys(df, *names):
    return {tuple(r) for r in df.select(*names).collect()}


def test_compaction_keeps_ids_apart(spark, tmp_path):
    """Ids over a million, many new fragments, a second compaction: no id is used twice in a dataset."""
    big = 3_000_000
    ds = [(0, "t", 10, None, 1, 1)]
    fr = [("t", big + i, 1, None, None, 0) for i in range(6)] + [("t", big + 50, 1, 2, None, 0)]
    rows = [("t", big + i // 3, i, i % 3 == 0, f"p{i}", 0) for i in range(18)]
    d = spark.createDataFrame(ds, DS)
    store = compaction.FragmentStore(spark, str(tmp_path / "s"))
    store.adopt(d, spark.createDataFrame(fr, FR), spark.createDataFrame(rows, ROWS))
    assert store.compact(d) == {"fragments_removed": 6, "fragments_added": 6, "rows_rewritten": 12}
    first = keys(store.table("live"), "fragment_id")
    assert min(first)[0] == big + 51
    wider = spark.createDataFrame([(0, "t", 10, None, 5, 1)], DS)
    store.compact(wider)
    second = keys(store.table("live"), "fragment_id")
    assert not first & second and min(second)[0] > max(first)[0]
    # Fragments of two rows were put together whole: 6, 4 and 2 rows; the two small ones once more, and then no more.
    assert store.read().count() == 12 and [store.compact(wider)["fragments_removed"] for _ in range(2)] == [2, 0]
    assert sorted(r["size"] for r in store.table("live").select("size").collect()) == [6, 6] and store.read().count() == 12


def test_compaction_conflict(spark, tmp_path, monkeypatch):
    ds, fr, rows = tables(spark, 9)
    d = spark.createDataFrame(ds, DS)
    store, rival = (compaction.FragmentStore(spark, str(tmp_path / "s")) for _ in range(2))
    store.adopt(d, spark.createDataFrame(fr, FR), spark.createDataFrame(rows, ROWS))
    before = keys(store.read(), "table_id", "row_id", "payload")
    check = store._check
    monkeypatch.setattr(store, "_check", lambda *a: (rival.commit(0, rival.snapshot(0)["snapshot"], repeated=True), check(*a))[1])
    with pytest.raises(ConflictError):
        store.compact(d)
    assert keys(store.read(), "table_id", "row_id", "payload") == before


def test_compaction_of_nothing(spark, tmp_path):
    d, f, r = spark.createDataFrame([], DS), spark.createDataFrame([], FR), spark.createDataFrame([], ROWS)
    store, removed = compaction.removed_by(d, f, r, str(tmp_path / "s"))
    assert compaction.plan(d, f, r).count() == 0 and removed.count() == 0 and store.read().count() == 0
