"""Mutations, loads and the change feed over the star-schema tables, with the SQL of the states they lead to."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from graphloom.database import GraphDB
from graphloom.sources.tpch import graph
from graphloom.streaming import feed
from graphloom.util import ensure_checkpoint_dir

SCHEMA = """
node Region { regionkey: I32 @key  name: String }
node Nation { nationkey: I32 @key  name: String  regionkey: I32? }
node Customer { custkey: I64 @key  name: String  nationkey: I32  acctbal: F64  mktsegment: String }
node Order { orderkey: I64 @key  custkey: I64  status: String  totalprice: F64  orderdate: DateTime  priority: String }
edge InRegion: Nation -> Region
edge LivesIn: Customer -> Nation
edge Placed: Customer -> Order
"""

MUTATIONS = """
query settle() { update Customer set { acctbal: 0.0 } where { acctbal < $zero  mktsegment = "BUILDING" } }
query leave($least: F64) { delete Customer where acctbal < $least }
query found($key: I32, $name: String) { insert Nation { nationkey: $key, name: $name, regionkey: 1 } }
query rename($key: I32, $name: String) { put Nation { nationkey: $key, name: $name } }
query join($nation: String, $region: String) { insert InRegion { from: $nation, to: $region } }
query part($nation: String) { delete InRegion where from = $nation }
""".replace("settle()", "settle($zero: F64)")

READS = """
query balances() { match { $c: Customer } return { $c.custkey, $c.acctbal } }
query orders() { match { $c: Customer  $c placed $o } return { $c.custkey, count($o) as orders } }
query nations() { match { $n: Nation } return { $n.nationkey, $n.name, $n.regionkey } }
query regions() { match { $n: Nation  $n inRegion $r } return { $n.name as nation, $r.name as region } }
"""


def database(spark, d: str, *tables: str) -> GraphDB:
    db = GraphDB.init(spark, f"{ensure_checkpoint_dir(spark)}/graphloom-{uuid.uuid4().hex}", SCHEMA)
    g = graph(spark, d)
    db.store.put_frames({t: (g.nodes if t.startswith("node:") else g.edges)[t.partition(":")[2]] for t in tables})
    return db


CUSTOMERS = ("node:Customer", "node:Order", "edge:Placed")
NATIONS = ("node:Nation", "node:Region", "edge:InRegion")


def update_where(spark, d):
    db = database(spark, d, "node:Customer")
    db.run(MUTATIONS, "settle", {"zero": 0.0})
    return db.run(READS, "balances")


def delete_cascade(spark, d):
    db = database(spark, d, *CUSTOMERS)
    db.run(MUTATIONS, "leave", {"least": 1000.0})
    return db.run(READS, "orders")


def _nations(spark, d) -> GraphDB:
    db = database(spark, d, *NATIONS)
    db.run(MUTATIONS, "found", {"key": 25, "name": "ATLANTIS"})
    db.run(MUTATIONS, "rename", {"key": 3, "name": "RENAMED"})
    db.run(MUTATIONS, "join", {"nation": "25", "region": "2"})
    db.run(MUTATIONS, "part", {"nation": "4"})
    return db


def put_merge(spark, d):
    return _nations(spark, d).run(READS, "nations")


def edge_upsert(spark, d):
    return _nations(spark, d).run(READS, "regions")


def _counted(df):
    return df.groupBy("graph_version", "change_kind", "entity_kind", "type_name").agg(F.count("*").alias("n"))


def cdc_window(spark, d):
    """Versions 2 to 5: what the four mutations changed."""
    return _counted(feed.window(_nations(spark, d).store, first=2, last=5))


def cdc_stream(spark, d):
    """The whole feed, taken by a stream."""
    db = _nations(spark, d)
    target = f"{db.path}-feed"
    feed.materialize(db.store, target)
    return _counted(spark.read.parquet(f"{target}/data"))


def delete_changes(spark, d):
    """Changes of a cascading delete."""
    db = database(spark, d, *CUSTOMERS)
    db.run(MUTATIONS, "leave", {"least": 1000.0})
    return _counted(db.changes(1))


def export_load(spark, d):
    """Nations and regions exported as JSON lines and loaded into an empty graph."""
    db = database(spark, d, *NATIONS)
    path = f"{db.path}-jsonl"
    db.export().write.text(path)
    other = GraphDB.init(spark, f"{db.path}-copy", SCHEMA)
    other.load_file(path)
    return other.run(READS, "regions")


def migrated(spark, d):
    db = database(spark, d, "node:Customer")
    db.migrate(SCHEMA.replace("nationkey: I32  acctbal", 'nation: I64 @rename_from("nationkey")  acctbal'))
    return db.run("query q() { match { $c: Customer } return { $c.custkey, $c.nation } }", "q")


def compacted(spark, d):
    """Nations after four mutations, compaction and cleanup."""
    db = _nations(spark, d)
    db.compact()
    db.cleanup(older_than=0)
    return db.run(READS, "nations")


def prepared_snapshot(spark, d):
    """Nations as a read sees them that was prepared before the mutations."""
    db = database(spark, d, *NATIONS)
    p = db.prepare(READS, "nations")
    db.run(MUTATIONS, "found", {"key": 25, "name": "ATLANTIS"})
    return p.run()


def load_merge(spark, d):
    """Records merged by key into nations: one replaced, one new, one edge more."""
    db = database(spark, d, *NATIONS)
    db.load('{"type":"Nation","data":{"nationkey":3,"name":"MERGED"}}\n{"type":"Nation","data":{"nationkey":77,"name":"FRESH","regionkey":0}}\n{"edge":"InRegion","from":77,"to":0}', "merge")
    return db.run("query q() { match { $n: Nation  $n inRegion $r } return { $n.nationkey, $n.name, $n.regionkey, $r.name as region } }", "q")


QUERIES = {f.__name__: f for f in (update_where, delete_cascade, put_merge, edge_upsert, cdc_window, cdc_stream, delete_changes, export_load, migrated, compacted, prepared_snapshot, load_merge)}

_CHANGES = """SELECT 2::BIGINT AS graph_version, 'insert' AS change_kind, 'node' AS entity_kind, 'Nation' AS type_name, 1::BIGINT AS n
UNION ALL SELECT 3, 'update', 'node', 'Nation', 1 UNION ALL SELECT 4, 'insert', 'edge', 'InRegion', 1 UNION ALL SELECT 5, 'delete', 'edge', 'InRegion', 1"""

ORACLE = {
    "update_where": "SELECT c_custkey AS custkey, CASE WHEN c_acctbal < 0 AND c_mktsegment = 'BUILDING' THEN 0.0 ELSE c_acctbal END AS acctbal FROM customer",
    "delete_cascade": "SELECT c_custkey AS custkey, count(*) AS orders FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal >= 1000 GROUP BY 1",
    "put_merge": "SELECT n_nationkey AS nationkey, CASE WHEN n_nationkey = 3 THEN 'RENAMED' ELSE n_name END AS name, CASE WHEN n_nationkey <> 3 THEN n_regionkey END AS regionkey FROM nation UNION ALL SELECT 25, 'ATLANTIS', 1",
    "edge_upsert": "SELECT CASE WHEN n_nationkey = 3 THEN 'RENAMED' ELSE n_name END AS nation, r_name AS region FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey <> 4 UNION ALL SELECT 'ATLANTIS', r_name FROM region WHERE r_regionkey = 2",
    "cdc_window": _CHANGES,
    "cdc_stream": _CHANGES + """ UNION ALL SELECT 1, 'insert', 'node', 'Nation', count(*) FROM nation UNION ALL SELECT 1, 'insert', 'node', 'Region', count(*) FROM region
UNION ALL SELECT 1, 'insert', 'edge', 'InRegion', count(*) FROM nation""",
    "delete_changes": """SELECT 2::BIGINT AS graph_version, 'delete' AS change_kind, 'node' AS entity_kind, 'Customer' AS type_name, count(*) AS n FROM customer WHERE c_acctbal < 1000
UNION ALL SELECT 2, 'delete', 'edge', 'Placed', count(*) FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 1000""",
    "export_load": "SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON r_regionkey = n_regionkey",
    "migrated": "SELECT c_custkey AS custkey, c_nationkey::BIGINT AS nation FROM customer",
    "prepared_snapshot": "SELECT n_nationkey AS nationkey, n_name AS name, n_regionkey AS regionkey FROM nation",
    "load_merge": "SELECT n_nationkey AS nationkey, CASE WHEN n_nationkey = 3 THEN 'MERGED' ELSE n_name END AS name, CASE WHEN n_nationkey <> 3 THEN n_regionkey END AS regionkey, r_name AS region FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 77, 'FRESH', 0, r_name FROM region WHERE r_regionkey = 0",
}
ORACLE["compacted"] = ORACLE["put_merge"]
