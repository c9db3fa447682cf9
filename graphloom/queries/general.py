"""Queries of the core data-processing operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from graphloom.operators import compaction, incremental, orphans, replay
from graphloom.sources.tables import read
from graphloom.util import ensure_checkpoint_dir


def p1_found(spark, d):
    return replay.current(read(spark, d, "cdc_log"), read(spark, d, "tx_catalog")).select("type_name", "entity_key", "db_version", "seq_in_tx")


def p1_columns(spark, d):
    """The columns of every living entity as its partial updates have left them."""
    state = replay.current(read(spark, d, "cdc_log"), read(spark, d, "tx_catalog"))
    return state.select("type_name", "entity_key", F.explode("columns").alias("name", "value"))


def p2_found(spark, d):
    nodes = orphans.node_rows(read(spark, d, "character_nodes"), read(spark, d, "canon_nodes"))
    return orphans.find_orphans(read(spark, d, "edges"), read(spark, d, "edge_types"), nodes)


def p2_report(spark, d):
    return orphans.report(p2_found(spark, d))


def p3_found(spark, d):
    """The next run after those of sync_runs, bounded, written and committed; what it has written."""
    job = incremental.IncrementalJob(spark, f"{ensure_checkpoint_dir(spark)}/job-{uuid.uuid4().hex}", read(spark, d, "sync_runs"))
    visible = read(spark, d, "visible_changes")
    job.run(visible, lambda todo: todo.select(*incremental.CHANGE))
    out = job.output()
    return visible.select(*incremental.CHANGE).limit(0) if out is None else out


def _root(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/fragments-{uuid.uuid4().hex}"


def _compacted(spark, d):
    return compaction.removed_by(read(spark, d, "datasets"), read(spark, d, "fragments"), read(spark, d, "fragment_rows"), _root(spark))


def p4_found(spark, d):
    """The fragments that a committed compaction has removed."""
    return _compacted(spark, d)[1]


def _datasets(store):
    """Per dataset what is read after a compaction: fragments, records, and the largest of the new fragments."""
    live = store.table("live").groupBy("table_id").agg(F.count("*").alias("fragments"), F.coalesce(F.max(F.when(F.col("generation") > 0, F.col("size"))), F.lit(0)).alias("largest_new"))
    r = store.read().groupBy("table_id").agg(F.count("*").alias("records"), F.count_distinct("row_id").alias("row_ids"), F.sum(F.length("payload")).alias("payload_chars"), F.sum(F.conv(F.substring(F.md5("payload"), 1, 8), 16, 10).cast("bigint")).alias("payload_sum"))
    return live.join(r, "table_id", "left")


def p4_rewritten(spark, d):
    """What compaction leaves, by dataset."""
    return _datasets(_compacted(spark, d)[0])


def p4_files(spark, d):
    """The same with every live fragment written as a tiny file of its own first."""
    datasets = read(spark, d, "datasets")
    store = compaction.FragmentStore(spark, _root(spark))
    store.adopt(datasets, read(spark, d, "fragments"), read(spark, d, "fragment_rows"))
    store.compact(datasets)
    return _datasets(store)


QUERIES = {f.__name__: f for f in (p1_found, p1_columns, p2_found, p2_report, p3_found, p4_found, p4_rewritten, p4_files)}

_P2 = """
WITH nodes AS (
  SELECT 'Character' AS t, slug, loaded_at, removed_at FROM character_nodes
  UNION ALL SELECT type_name, slug, loaded_at, removed_at FROM canon_nodes),
e AS (
  SELECT t.edge_name, strftime(e.loaded_at, '%Y-%m') AS period_month, e.edge_id, e.loaded_at, e.removed_at, t.from_type, t.to_type, e.from_key, e.to_key
  FROM edges e JOIN edge_types t ON e.edge_name = t.edge_name OR e.edge_name = lower(t.edge_name[1]) || t.edge_name[2:]),
ends AS (
  SELECT DISTINCT edge_name, period_month, edge_id, loaded_at, removed_at, 'from' AS side, from_type AS t, from_key AS k FROM e WHERE from_key IS NOT NULL
  UNION SELECT DISTINCT edge_name, period_month, edge_id, loaded_at, removed_at, 'to', to_type, to_key FROM e WHERE to_key IS NOT NULL),
judged AS (
  SELECT r.edge_name, r.period_month, r.edge_id, r.side, count(n.slug) AS there, min(n.loaded_at) > r.loaded_at AS all_late,
    coalesce(bool_or(n.loaded_at <= r.loaded_at AND (n.removed_at IS NULL OR n.removed_at >= r.removed_at)), false) AS sound
  FROM ends r LEFT JOIN nodes n ON n.t = r.t AND n.slug = r.k
  GROUP BY r.edge_name, r.period_month, r.edge_id, r.side, r.loaded_at, r.removed_at, r.t, r.k)
SELECT DISTINCT edge_name, period_month, edge_id, side, CASE WHEN there = 0 THEN 'missing' WHEN all_late THEN 'late' ELSE 'deleted' END AS reason
FROM judged WHERE NOT sound
"""

_P4 = """
WITH live AS (
  SELECT DISTINCT f.table_id, f.fragment_id, d.target_rows_per_fragment AS target FROM fragments f
  JOIN (SELECT table_id, max(dataset_version) AS dataset_version, max(target_rows_per_fragment) AS target_rows_per_fragment FROM datasets GROUP BY 1) d USING (table_id)
  WHERE f.added_version <= d.dataset_version AND (f.removed_version IS NULL OR f.removed_version > d.dataset_version)),
m AS (
  SELECT l.table_id, l.fragment_id, l.target, count(r.row_id) AS size, count(CASE WHEN r.is_deleted THEN 1 END) AS deleted
  FROM live l LEFT JOIN fragment_rows r ON r.table_id = l.table_id AND r.fragment_id = l.fragment_id GROUP BY 1, 2, 3),
p AS (SELECT *, count(CASE WHEN size < target THEN 1 END) OVER (PARTITION BY table_id) AS n_small FROM m)
"""

ORACLE = {
    "p1_found": """
WITH e AS (
  SELECT type_name, regexp_replace(entity_key, '\\s+', '', 'g') AS entity_key, db_version, seq_in_tx, lower(trim(op)) AS op FROM cdc_log
  WHERE entity_key IS NOT NULL AND tx_id IN (SELECT tx_id FROM tx_catalog) AND lower(trim(op)) IN ('insert', 'update', 'delete')),
r AS (SELECT *, row_number() OVER (PARTITION BY type_name, entity_key ORDER BY db_version DESC, seq_in_tx DESC) AS n FROM e)
SELECT type_name, entity_key, db_version, seq_in_tx FROM r WHERE n = 1 AND op <> 'delete'
""",
    "p1_columns": """
WITH e AS (
  SELECT type_name, regexp_replace(entity_key, '\\s+', '', 'g') AS entity_key, db_version::HUGEINT * 4294967296 + seq_in_tx AS pos, lower(trim(op)) AS op,
    CASE WHEN json_valid(payload) AND json_type(payload) = 'OBJECT' THEN payload::JSON END AS p, arrival_no FROM cdc_log
  WHERE entity_key IS NOT NULL AND tx_id IN (SELECT tx_id FROM tx_catalog) AND lower(trim(op)) IN ('insert', 'update', 'delete')),
u AS (SELECT *, row_number() OVER (PARTITION BY type_name, entity_key, pos ORDER BY arrival_no) AS n FROM e),
s AS (
  SELECT type_name, entity_key, pos, op, CASE WHEN list_contains(json_keys(p), 'after') AND len(list_filter(json_keys(p), lambda k: k NOT IN ('before', 'after'))) = 0 THEN CASE WHEN json_type(p->'after') = 'OBJECT' THEN p->'after' END ELSE p END AS p,
    max(CASE WHEN op <> 'update' THEN pos END) OVER (PARTITION BY type_name, entity_key) AS reset, arg_max(op, pos) OVER (PARTITION BY type_name, entity_key) AS last_op
  FROM u WHERE n = 1),
k AS (SELECT type_name, entity_key, pos, p, unnest(json_keys(p)) AS name FROM s WHERE last_op <> 'delete' AND op <> 'delete' AND (reset IS NULL OR pos >= reset)),
v AS (SELECT type_name, entity_key, name, json_extract(p, '$."' || name || '"')::VARCHAR AS value, row_number() OVER (PARTITION BY type_name, entity_key, name ORDER BY pos DESC) AS n FROM k)
SELECT type_name, entity_key, name, value FROM v WHERE n = 1
""",
    "p2_found": _P2,
    "p2_report": f"SELECT edge_name, period_month, side, reason, count(*) AS broken_ends FROM ({_P2}) GROUP BY ALL",
    "p3_found": """
WITH c AS (SELECT table_id, entity_id, graph_version, min(ingested_at) AS seen FROM visible_changes GROUP BY 1, 2, 3)
SELECT table_id, entity_id, graph_version FROM c WHERE NOT EXISTS (
  SELECT 1 FROM sync_runs r WHERE r.table_id = c.table_id AND lower(trim(r.status)) = 'succeeded'
  AND r.from_version < c.graph_version AND c.graph_version <= r.to_version AND r.read_at >= c.seen)
""",
    "p4_found": _P4 + "SELECT table_id, fragment_id FROM p WHERE (size < target AND n_small >= 2) OR deleted * 10 > size",
}
#: As the operator defines it: chosen fragments in order, cut where their running live rows pass the target; a record lies
#: where its fragment stays, else in the new fragment of its lowest chosen one.
ORACLE["p4_rewritten"] = ORACLE["p4_files"] = (
    _P4
    + """, c AS (SELECT *, (size < target AND n_small >= 2) OR deleted * 10 > size AS goes FROM p),
s AS (SELECT *, coalesce(sum(CASE WHEN goes THEN size - deleted END) OVER (PARTITION BY table_id ORDER BY fragment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM c),
r AS (SELECT r.table_id, r.row_id, r.payload, s.goes, s.fragment_id, (s.start // greatest(coalesce(s.target, 1), 1))::BIGINT AS n FROM fragment_rows r JOIN s USING (table_id, fragment_id) WHERE r.is_deleted IS NOT TRUE),
one AS (SELECT *, row_number() OVER (PARTITION BY table_id, row_id ORDER BY goes, fragment_id) AS k FROM r),
new AS (SELECT table_id, n, count(*) AS size FROM one WHERE k = 1 AND goes GROUP BY ALL),
f AS (SELECT table_id, 1 AS live, 0 AS size FROM c WHERE NOT goes UNION ALL SELECT table_id, 1, size FROM new),
x AS (SELECT table_id, count(*) AS records, count(*) AS row_ids, sum(length(payload))::BIGINT AS payload_chars, sum(('0x' || md5(payload)[1:8])::BIGINT)::BIGINT AS payload_sum FROM one WHERE k = 1 GROUP BY 1)
SELECT g.table_id, g.fragments, g.largest_new, records, row_ids, payload_chars, payload_sum FROM (SELECT table_id, count(*) AS fragments, max(size)::BIGINT AS largest_new FROM f GROUP BY 1) g LEFT JOIN x ON x.table_id = g.table_id
"""
)
