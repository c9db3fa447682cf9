"""Loads, edge properties, null predicates, change rows, results and upkeep over tables that grow, with their SQL."""

from __future__ import annotations

import io
import uuid

import pyarrow as pa
import pyarrow.csv
from pyspark.sql import functions as F

from graphloom import formats
from graphloom.database import GraphDB
from graphloom.errors import ConflictError, GraphError
from graphloom.functions.vector import mock_embedding
from graphloom.operators.mutate import Mutator
from graphloom.plans.typecheck import check_mutation
from graphloom.queries.graph import _TOKENS
from graphloom.queries.language import _values
from graphloom.queries.store import CUSTOMERS, database
from graphloom.sources.tables import read
from graphloom.sources.tpch import graph
from graphloom.streaming import feed
from graphloom.util import ensure_checkpoint_dir

CUSTOMER = "node Customer { custkey: I64 @key  name: String  acctbal: F64?  mktsegment: String? }"
BASKET = "node Order { orderkey: I64 @key } node Part { partkey: I64 @key } edge Contains: Order -> Part { quantity: F64? }"
NOTE = "node Note { docid: I64 @key  text: String?  lang: String?  source: String?  nchars: I64? }"


def _db(spark, schema: str, **how) -> GraphDB:
    return GraphDB.init(spark, f"{ensure_checkpoint_dir(spark)}/graphloom-{uuid.uuid4().hex}", schema, **how)


def _lines(df, db: GraphDB, name: str) -> str:
    """One JSON text column as a file of records; the path."""
    path = f"{db.path}-{name}"
    df.write.text(path)
    return path


def _customers(spark, d, where: str = "true", acctbal: str = "c_acctbal", key: str = "c_custkey"):
    data = F.struct(F.expr(key).alias("custkey"), F.col("c_name").alias("name"), F.expr(acctbal).alias("acctbal"), F.col("c_mktsegment").alias("mktsegment"))
    return read(spark, d, "customer").filter(where).select(F.to_json(F.struct(F.lit("Customer").alias("type"), data.alias("data"))))


def _read_customers(db: GraphDB):
    return db.run("query q() { match { $c: Customer } return { $c.custkey, $c.name, $c.acctbal, $c.mktsegment } }", "q")


def load_append(spark, d):
    db = _db(spark, CUSTOMER)
    db.load_file(_lines(_customers(spark, d, "c_acctbal >= 0"), db, "a"), "append")
    db.load_file(_lines(_customers(spark, d, "c_acctbal < 0"), db, "b"), "append")
    return _read_customers(db)


def load_overwrite(spark, d):
    db = _db(spark, CUSTOMER)
    db.load_file(_lines(_customers(spark, d), db, "a"))
    db.load_file(_lines(_customers(spark, d, "c_acctbal > 5000"), db, "b"), "overwrite")
    return _read_customers(db)


def load_keyed_merge(spark, d):
    """Rows of known keys are replaced whole and keep their ids, others are new."""
    db = _db(spark, CUSTOMER)
    g = graph(spark, d)
    db.store.put_frames({"node:Customer": g.nodes["Customer"]})
    changed = _customers(spark, d, "c_mktsegment = 'BUILDING'", "cast(null as double)").union(_customers(spark, d, "c_acctbal < 0", key="c_custkey + 10000000"))
    db.load_file(_lines(changed, db, "b"), "merge")
    t = db.store.table(db.store.version(), "node:Customer")
    return t.select("custkey", "name", "acctbal", (F.col("id") == F.col("custkey")).alias("kept_id"))


def _pairs(db: GraphDB):
    """The edges with their properties, as exported."""
    e = db.export().filter(F.get_json_object("value", "$.edge").isNotNull())
    v = F.from_json("value", "from string, to string, data struct<quantity: double>").alias("v")
    return e.select(v).select(F.col("v.from").cast("bigint").alias("orderkey"), F.col("v.to").cast("bigint").alias("partkey"), F.col("v.data.quantity").alias("quantity"))


def load_last_edge(spark, d):
    """Records of every line item: of several for one pair the last line counts."""
    db = _db(spark, BASKET)
    line = read(spark, d, "lineitem")
    nodes = [line.select(F.col(c).alias("k")).distinct().select(F.to_json(F.struct(F.lit(t).alias("type"), F.struct(F.col("k").alias(k)).alias("data"))).alias("value"), F.lit(0).alias("a"), F.lit(0).alias("b")) for t, k, c in (("Order", "orderkey", "l_orderkey"), ("Part", "partkey", "l_partkey"))]
    edges = line.select(F.to_json(F.struct(F.lit("contains").alias("edge"), F.col("l_orderkey").alias("from"), F.col("l_partkey").alias("to"), F.struct(F.col("l_quantity").alias("quantity")).alias("data"))).alias("value"), F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b"))
    # A file has an order of lines; here one file is written for all.
    db.load_file(_lines(edges.union(nodes[0]).union(nodes[1]).coalesce(1).sortWithinPartitions("a", "b", "value").select("value"), db, "all"))
    return _pairs(db)


def edge_properties(spark, d):
    db = _db(spark, BASKET)
    g = graph(spark, d)
    db.store.put_frames({"node:Order": g.nodes["Order"], "node:Part": g.nodes["Part"], "edge:Contains": g.edges["Contains"]})
    return _pairs(db)


def edge_puts(spark, d):
    """A pair put twice and one that is there already: properties replaced, no pair twice."""
    db = _db(spark, BASKET)
    g = graph(spark, d)
    db.store.put_frames({"node:Order": g.nodes["Order"], "node:Part": g.nodes["Part"], "edge:Contains": g.edges["Contains"]})
    o, p = read(spark, d, "orders").agg(F.min("o_orderkey")).first()[0], read(spark, d, "part").agg(F.max("p_partkey")).first()[0]
    first = read(spark, d, "lineitem").agg(F.min(F.struct("l_orderkey", "l_partkey"))).first()[0]
    put = "query q($o: String, $p: String, $n: F64) { put Contains { from: $o, to: $p, quantity: $n } }"
    for n in (1.0, 2.0):
        db.run(put, "q", {"o": str(o), "p": str(p), "n": n})
    db.run("query q($o: String, $p: String) { put Contains { from: $o, to: $p } }", "q", {"o": str(first[0]), "p": str(first[1])})
    return _pairs(db)


def _notes(spark, d) -> GraphDB:
    db = _db(spark, NOTE)
    n = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("docid"), "text", "lang", "source", F.col("n_chars").alias("nchars"))
    db.store.put_frames({"node:Note": n})
    return db


def null_predicates(spark, d):
    """Only rows for which all predicates are true are changed; unknown isn't true."""
    db = _notes(spark, d)
    db.run('query q($n: I64) { update Note set { lang: "unknown" } where { lang is null  nchars > $n } }', "q", {"n": 50})
    db.run('query q($s: String) { update Note set { source: "short" } where { nchars < 60  lang != $s  text is not null } }', "q", {"s": "en"})
    db.run("query q() { delete Note where nchars is null }", "q")
    return db.run("query q() { match { $n: Note } return { $n.docid, $n.lang, $n.source } }", "q")


def compare_and_set(spark, d):
    """Two writers from one snapshot: the second is refused, and finds nothing to do when it comes again."""
    db = database(spark, d, "node:Customer")
    source = "query q($a: F64) { update Customer set { acctbal: $a } where { mktsegment = \"MACHINERY\"  acctbal < 0.0 } }".replace("0.0", "$z").replace("$a: F64", "$a: F64, $z: F64")
    m = check_mutation(db.store.version().catalog, db.query(source, "q"))
    one, two = (Mutator(db.store, {"a": a, "z": 0.0}, None) for a in (1.0, 2.0))
    one.run(m)
    try:
        two.run(m)
        refused = False
    except ConflictError:
        refused = True
    again = db.run(source, "q", {"a": 2.0, "z": 0.0}).matched_nodes
    return db.run("query q() { match { $c: Customer } return { $c.custkey, $c.acctbal } }", "q").withColumns({"refused": F.lit(refused), "again": F.lit(again)})


def _numbered(df):
    """A result in its order with the number of each row; the order is the partitions', nothing is gathered."""
    spark = df.sparkSession
    return spark.createDataFrame(df.rdd.zipWithIndex().map(lambda x: (x[1], *x[0])), "no bigint, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema))


def change_rows(spark, d):
    """Row images, keys, previous versions and order of an update, a put and a cascading delete."""
    db = database(spark, d, *CUSTOMERS)
    db.run('query q($z: F64) { update Customer set { acctbal: 7.5 } where { acctbal < $z  mktsegment = "BUILDING" } }', "q", {"z": 0.0})
    db.run("query q($z: F64) { delete Customer where acctbal > $z }", "q", {"z": 9000.0})
    c = db.changes(1)
    data = F.from_json("row", "custkey bigint, acctbal double, src bigint, dst bigint")
    return _numbered(c.select("graph_version", "change_kind", "entity_kind", "type_name", F.when(F.col("entity_kind") == "node", F.col("logical_key")).otherwise(F.regexp_replace("logical_key", "^id=-?[0-9]+,", "")).alias("key"), data["custkey"].alias("custkey"), data["acctbal"].alias("acctbal"), data["src"].alias("src"), data["dst"].alias("dst"), "previous_graph_version").drop("no")).drop("no")


def change_order(spark, d):
    """The feed comes in order: version, kind, type, id."""
    db = database(spark, d, "node:Customer")
    db.run('query q($z: F64) { update Customer set { acctbal: 7.5 } where { acctbal < $z } }', "q", {"z": 0.0})
    db.run("query q($z: F64) { delete Customer where acctbal > $z }", "q", {"z": 9000.0})
    return _numbered(db.changes(1).select("graph_version", "change_kind", "entity_id"))


def feed_table(spark, d):
    """The feed as a table, taken in two runs of the stream with commits between."""
    db = database(spark, d, "node:Customer")
    target = f"{db.path}-feed"
    feed.materialize(db.store, target)
    db.run('query q($z: F64) { update Customer set { acctbal: 7.5 } where { acctbal < $z } }', "q", {"z": 0.0})
    db.run("query q($z: F64) { delete Customer where acctbal > $z }", "q", {"z": 9000.0})
    feed.materialize(db.store, target)
    feed.materialize(db.store, target)
    return spark.read.parquet(f"{target}/data").select("graph_version", "change_kind", "entity_id")


def _small(spark, d) -> GraphDB:
    return database(spark, d, "node:Nation", "node:Region", "edge:InRegion")


RESULT = "query q() { match { $n: Nation  $n inRegion $r } return { $n.nationkey, $n.name as nation, $r.name as region } order { $n.nationkey } }"


def result_ipc(spark, d):
    """A result as an Arrow IPC stream, read again."""
    return spark.createDataFrame(pa.ipc.open_stream(_small(spark, d).run_arrow(RESULT, "q")).read_all())


def result_json(spark, d):
    return spark.createDataFrame(_small(spark, d).run_json(RESULT, "q"), "nationkey int, nation string, region string")


def result_csv(spark, d):
    text = formats.render(_small(spark, d).run(RESULT, "q"), "csv")
    return spark.createDataFrame(pa.csv.read_csv(io.BytesIO(text.encode()))).withColumn("nationkey", F.col("nationkey").cast("int"))


def media_blobs(spark, d):
    """Every text as a blob named by its hash."""
    db = _db(spark, "node Page { docid: I64 @key  mime: String?  file: String? @media_uri(mime) }")
    data = F.struct(F.col("doc_id").alias("docid"), F.lit("text/plain").alias("mime"), F.concat(F.lit("@base64:"), F.regexp_replace(F.base64(F.encode("text", "utf-8")), r"\s", "")).alias("file"))
    pages = read(spark, d, "documents").filter("text is not null").select(F.to_json(F.struct(F.lit("Page").alias("type"), data.alias("data"))))
    db.load_file(_lines(pages, db, "pages"))
    return db.run("query q() { match { $p: Page } return { $p.docid, $p.mime, $p.file } }", "q")


def letters(text: str, dim: int) -> list[float]:
    """A provider whose vectors SQL can compute, too."""
    return [float(len(text)), float(text.count("1")), *[0.0] * (dim - 2)]


EMBEDDED = "node Customer { custkey: I64 @key  name: String  segment: String  v: Vector(3)? @embed(name)  w: Vector(2)? @embed(segment) }"


def _vectors(db: GraphDB):
    return db.store.table(db.store.version(), "node:Customer").select("custkey", *[F.col("v")[i].alias(f"v{i}") for i in range(3)], *[F.col("w")[i].alias(f"w{i}") for i in range(2)])


def _embedded(spark, d, v: str):
    data = F.struct(F.col("c_custkey").alias("custkey"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.expr(v).alias("v"))
    return read(spark, d, "customer").select(F.to_json(F.struct(F.lit("Customer").alias("type"), data.alias("data"))))


def embed_on_load(spark, d):
    """Vectors are made from their text where they aren't given, each text once, from a cache."""
    db = _db(spark, EMBEDDED, provider=letters, cache=f"{ensure_checkpoint_dir(spark)}/vectors-{uuid.uuid4().hex}")
    db.load_file(_lines(_embedded(spark, d, "case when c_acctbal < 0 then array(1, 2, 3) end"), db, "a"))
    return _vectors(db)


def embed_backfill(spark, d):
    db = _db(spark, EMBEDDED, provider=letters)
    c = read(spark, d, "customer")
    none = {n: F.lit(None).cast("array<float>") for n in ("v", "w")}
    db.store.put_frames({"node:Customer": c.select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("custkey"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")).withColumns(none)})
    n = c.count()
    db.embed(limit=n + n // 2)
    return _vectors(db)


def load_errors(spark, d):
    """What a load refuses, and as what; nothing of it is committed."""
    db = _small(spark, d)
    nation = '{"type":"Nation","data":%s}'
    cases = [nation % '{"nationkey":1,"name":"a","colour":"red"}', nation % '{"nationkey":"1","name":"a"}', nation % '{"name":"a"}', nation % '{"nationkey":3000000000,"name":"a"}', '{"type":"Nation"}', '{"type":"Planet","data":{}}',
             "{broken", '{"edge":"InRegion","from":1,"to":99}', '{"edge":"Orbits","from":1,"to":2}', "\n".join([nation % '{"nationkey":50,"name":"a"}'] * 2), ""]
    before, out = db.store.version().number, []
    for i, text in enumerate(cases[:-1]):
        try:
            db.load(text)
            out.append((i, "loaded"))
        except GraphError as e:
            out.append((i, type(e).__name__))
    return spark.createDataFrame([*out, (99, f"{db.store.version().number - before} versions more")], "no int, error string")


def lint_findings(spark, d):
    found = _small(spark, d).check('query a() { insert Nation { nationkey: 1, name: "x" } } query b() { match { $p: Planet } return { $p } }')
    return spark.createDataFrame([(f.code, f.query) for f in found], "code string, query string")


def describe_counts(spark, d):
    x = database(spark, d, *CUSTOMERS).describe()
    rows = [("node", n["name"], n["rows"], n["key"]) for n in x["nodes"]] + [("edge", e["name"], e["rows"], e["from"]) for e in x["edges"]]
    return spark.createDataFrame([r for r in rows if r[2]], "kind string, name string, rows bigint, detail string")


CHANGED = CUSTOMER.replace("name: String ", 'title: String @rename_from("name") ').replace("acctbal: F64?  ", "").replace("mktsegment: String?", "mktsegment: String?  since: Date?")


def schema_steps(spark, d):
    """The steps from one schema to another, and how safe each is over these data."""
    db = _db(spark, CUSTOMER)
    db.load_file(_lines(_customers(spark, d), db, "a"))
    steps = db.migrate(CHANGED, confirm=True)
    return spark.createDataFrame([(s.kind, s.target, s.safety) for s in steps], "kind string, target string, safety string")


def migrated_rows(spark, d):
    db = _db(spark, CUSTOMER)
    db.load_file(_lines(_customers(spark, d), db, "a"))
    db.migrate(CHANGED, confirm=True)
    return db.run("query q() { match { $c: Customer } return { $c.custkey, $c.title, $c.mktsegment, $c.since } }", "q")


def doctor_findings(spark, d):
    """Tables put in place with a lost end, a key twice and a pair twice."""
    db = database(spark, d, *CUSTOMERS)
    g = graph(spark, d)
    c, e = g.nodes["Customer"], g.edges["Placed"]
    lost = c.filter(F.col("id") != e.agg(F.max("src")).first()[0])
    db.store.put_frames({"node:Customer": lost.union(lost.orderBy("id").limit(1)), "edge:Placed": e.union(e.orderBy("dst").limit(1))})
    return spark.createDataFrame([(x.partition(":")[0] + ":" + x.split(":")[1], x.rpartition(": ")[2]) for x in db.doctor()], "place string, finding string")


def search_indexed(spark, d):
    """A search through the index, after later inserts, updates and deletes that the index hasn't seen."""
    db = _notes(spark, d)
    db.index("Note", "text")
    db.run('query q() { insert Note { docid: 90000001, text: "a Beacon, and the harbor" } }', "q")
    db.run('query q($n: I64) { delete Note where nchars > $n }', "q", {"n": 20_000})
    db.run('query q() { insert Note { docid: 90000002, text: "harbor only" } }', "q")
    return db.run('query q() { match { $n: Note  search($n.text, "harbor beacon") } return { $n.docid } }', "q")


def phrase_indexed(spark, d):
    db = _notes(spark, d)
    db.index("Note", "text")
    return db.run('query q() { match { $n: Note  match_text($n.text, "one another") } return { $n.docid } }', "q")


def nearest_indexed(spark, d):
    """Eight targets against the index: whether at least nine in ten of the exact ten nearest come back.

    These vectors have no order in them, so most cells are read; see the README.
    """
    db = _db(spark, "node Vec { vecid: I64 @key  v: Vector(64)? }")
    db.store.put_frames({"node:Vec": read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("vecid"), F.col("embedding").alias("v"))})
    db.index("Vec", "v")
    source = "query q($q: Vector(64)) { match { $x: Vec } return { $x.vecid } order { nearest($x.v, $q) } limit 10 }"
    hits = total = 0
    for i in range(8):
        exact, found = ({x[0] for x in db.run(source, "q", {"q": mock_embedding(f"target {i}", 64)}, approximate=a).collect()} for a in (False, 0.7))
        hits, total = hits + len(exact & found), total + len(exact)
    return spark.createDataFrame([(hits >= 0.9 * total,)], "recalled boolean")


QUERIES = {
    f.__name__: f
    for f in (
        search_indexed, phrase_indexed, nearest_indexed,
        load_append, load_overwrite, load_keyed_merge, load_last_edge, edge_properties, edge_puts, null_predicates, compare_and_set, change_rows, change_order, feed_table, result_ipc, result_json, result_csv,
        media_blobs, embed_on_load, embed_backfill, load_errors, lint_findings, describe_counts, schema_steps, migrated_rows, doctor_findings,
    )
}

_CUSTOMERS = "SELECT c_custkey AS custkey, c_name AS name, c_acctbal AS acctbal, c_mktsegment AS mktsegment FROM customer"
_CONTAINS = "SELECT l_orderkey AS orderkey, l_partkey AS partkey, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2"
_NATIONS = "SELECT n_nationkey AS nationkey, n_name AS nation, r_name AS region FROM nation JOIN region ON r_regionkey = n_regionkey"
_EVENTS = """SELECT 2::BIGINT AS graph_version, 'update' AS change_kind, c_custkey AS entity_id FROM customer WHERE c_acctbal < 0
UNION ALL SELECT 3, 'delete', c_custkey FROM customer WHERE c_acctbal > 9000"""

ORACLE = {
    "search_indexed": f"SELECT doc_id AS docid FROM documents WHERE list_has_all({_TOKENS}, ['harbor', 'beacon']) AND (n_chars IS NULL OR n_chars <= 20000) UNION ALL SELECT 90000001",
    "phrase_indexed": f"SELECT doc_id AS docid FROM documents WHERE contains(' ' || array_to_string({_TOKENS}, ' ') || ' ', ' one another ')",
    "nearest_indexed": "SELECT true AS recalled",
    "load_append": _CUSTOMERS,
    "load_overwrite": _CUSTOMERS + " WHERE c_acctbal > 5000",
    "load_keyed_merge": """SELECT c_custkey AS custkey, c_name AS name, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal END AS acctbal, true AS kept_id FROM customer
UNION ALL SELECT c_custkey + 10000000, c_name, c_acctbal, false FROM customer WHERE c_acctbal < 0""",
    "load_last_edge": "SELECT l_orderkey AS orderkey, l_partkey AS partkey, last(l_quantity ORDER BY l_linenumber, l_quantity::VARCHAR) AS quantity FROM lineitem GROUP BY 1, 2",
    "edge_properties": _CONTAINS,
    "edge_puts": f"""WITH f AS (SELECT min((l_orderkey, l_partkey)) AS k FROM lineitem), n AS (SELECT (SELECT min(o_orderkey) FROM orders) AS o, (SELECT max(p_partkey) FROM part) AS p)
SELECT orderkey, partkey, CASE WHEN (orderkey, partkey) <> f.k THEN quantity END AS quantity FROM ({_CONTAINS}), f, n WHERE NOT (orderkey = o AND partkey = p) UNION ALL SELECT o, p, 2.0 FROM n""",
    "null_predicates": """WITH a AS (SELECT doc_id, text, n_chars, source, CASE WHEN lang IS NULL AND n_chars > 50 THEN 'unknown' ELSE lang END AS lang FROM documents)
SELECT doc_id AS docid, lang, CASE WHEN n_chars < 60 AND lang <> 'en' AND text IS NOT NULL THEN 'short' ELSE source END AS source FROM a WHERE n_chars IS NOT NULL""",
    "compare_and_set": "SELECT c_custkey AS custkey, CASE WHEN c_mktsegment = 'MACHINERY' AND c_acctbal < 0 THEN 1.0 ELSE c_acctbal END AS acctbal, true AS refused, 0::INTEGER AS again FROM customer",
    "change_rows": """SELECT 2::BIGINT AS graph_version, 'update' AS change_kind, 'node' AS entity_kind, 'Customer' AS type_name, 'id=' || c_custkey AS key, c_custkey AS custkey, 7.5::DOUBLE AS acctbal, NULL::BIGINT AS src, NULL::BIGINT AS dst, 1::BIGINT AS previous_graph_version
FROM customer WHERE c_acctbal < 0 AND c_mktsegment = 'BUILDING'
UNION ALL SELECT 3, 'delete', 'node', 'Customer', 'id=' || c_custkey, c_custkey, c_acctbal, NULL, NULL, 2 FROM customer WHERE c_acctbal > 9000
UNION ALL SELECT 3, 'delete', 'edge', 'Placed', 'src=' || c_custkey || ',dst=' || o_orderkey, NULL, NULL, c_custkey, o_orderkey, 2 FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 9000""",
    "change_order": f"SELECT row_number() OVER (ORDER BY graph_version, entity_id) - 1 AS no, * FROM ({_EVENTS})",
    "feed_table": f"SELECT 1::BIGINT AS graph_version, 'insert' AS change_kind, c_custkey AS entity_id FROM customer UNION ALL {_EVENTS}",
    "result_ipc": _NATIONS,
    "result_json": _NATIONS,
    "result_csv": _NATIONS,
    "media_blobs": "SELECT doc_id AS docid, 'text/plain' AS mime, 'blob://sha256/' || sha256(text) AS file FROM documents WHERE text IS NOT NULL",
    "embed_on_load": """SELECT c_custkey AS custkey, CASE WHEN c_acctbal < 0 THEN 1 ELSE length(c_name) END::FLOAT AS v0, CASE WHEN c_acctbal < 0 THEN 2 ELSE length(c_name) - length(replace(c_name, '1', '')) END::FLOAT AS v1,
CASE WHEN c_acctbal < 0 THEN 3 ELSE 0 END::FLOAT AS v2, length(c_mktsegment)::FLOAT AS w0, 0::FLOAT AS w1 FROM customer""",
    "embed_backfill": """WITH c AS (SELECT *, row_number() OVER (ORDER BY c_custkey) <= (SELECT count(*) // 2 FROM customer) AS made FROM customer)
SELECT c_custkey AS custkey, length(c_name)::FLOAT AS v0, (length(c_name) - length(replace(c_name, '1', '')))::FLOAT AS v1, 0::FLOAT AS v2, CASE WHEN made THEN length(c_mktsegment) END::FLOAT AS w0, CASE WHEN made THEN 0 END::FLOAT AS w1 FROM c""",
    "load_errors": _values([*[(i, "LoadError") for i in range(9)], (9, "ConstraintError"), (99, "0 versions more")], "no, error"),
    "lint_findings": "SELECT * FROM (VALUES ('L202', 'a'), ('type', 'b'), ('L201', '')) t(code, query)",
    "describe_counts": """SELECT 'node' AS kind, 'Customer' AS name, count(*) AS rows, 'custkey' AS detail FROM customer UNION ALL SELECT 'node', 'Order', count(*), 'orderkey' FROM orders
UNION ALL SELECT 'edge', 'Placed', count(*), 'Customer' FROM orders""",
    "schema_steps": "SELECT * FROM (VALUES ('RenameProperty', 'node:Customer.title', 'safe'), ('DropProperty', 'node:Customer.acctbal', 'confirm'), ('AddProperty', 'node:Customer.since', 'safe')) t(kind, target, safety)",
    "migrated_rows": "SELECT c_custkey AS custkey, c_name AS title, c_mktsegment AS mktsegment, NULL::DATE AS since FROM customer",
    "doctor_findings": """SELECT * FROM (VALUES ('node:Customer', 'id stands twice'), ('node:Customer', 'custkey stands twice'), ('edge:Placed', 'a pair stands twice'), ('edge:Placed', 'src names no Customer')) t(place, finding)""",
}
