"""Queries of the language's rules and parameters, with their SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from graphloom.errors import GraphError, TypeCheckError
from graphloom.functions.vector import mock_embedding
from graphloom.plans.params import bind
from graphloom.plans.planner import Graph, Lazy, plan
from graphloom.plans.query import Mutation, parse_queries
from graphloom.plans.schema import parse_schema
from graphloom.plans.typecheck import check, check_mutation
from graphloom.queries.graph import _bm25
from graphloom.sources import tpch
from graphloom.sources.tables import read

NOW = dt.datetime(2026, 1, 1)
PARAMS = "$q: Vector(64), $s: String, $i: I32"

#: What a query file may not say, and the rule that says so.
BROKEN = [
    ("T1", "match { $x: Planet } return { $x }"),
    ("T2", 'match { $c: Customer {colour: "red"} } return { $c.name }'),
    ("T3", 'match { $c: Customer {nationkey: "one"} } return { $c.name }'),
    ("T4", "match { $c: Customer  $c admires $n } return { $c.name }"),
    ("T5", "match { $r: Region  $r placed $o } return { $r.name }"),
    ("T6", "match { $c: Customer } return { $d.name }"),
    ("T6", "match { $c: Customer } return { $c.colour }"),
    ("T6", "match { $c: Customer } return { $c.name } order { total desc }"),
    ("T7", 'match { $c: Customer  $c.acctbal > "much" } return { $c.name }'),
    ("T7", "match { $p: Part  $p.words = $p.name } return { $p.name }"),
    ("T8", "match { $c: Customer } return { avg($c.name) as m }"),
    ("T9", "match { $c: Customer  not { $a next $b } } return { $c.name }"),
    ("T10", "insert Planet { name: $s }"),
    ("T11", "update Customer set { colour: $s } where custkey = $i"),
    ("T11", "delete Customer where name is null"),
    ("T12", "insert Nation { name: $s }"),
    ("T13", "update Customer set { name: $s  name: $s } where custkey = $i"),
    ("T14", "delete Customer where custkey = $none"),
    ("T15", "match { $a: Nation  $a next{2,} $b } return { $b.name }"),
    ("T15", "match { $a: Nation  $a next{3,2} $b } return { $b.name }"),
    ("T15", "match { $d: Document } return { nearest($d.text, $q) as x }"),
    ("T16", "update Placed set { x: $i } where from = $s"),
    ("T17", "match { $v: Vec } return { $v.vecid } order { nearest($v.embedding, $q) }"),
    ("T18", "match { $v: Vec } return { $v.vecid as v } order { nearest($v.embedding, $q), v } limit 3"),
    ("T19", "match { $p: Part  search($p.size, $s) } return { $p.name }"),
    ("T20", "match { $p: Part  match_text($p.size, $s) } return { $p.name }"),
    ("T21", "match { $d: Document } return { $d.docid } order { rrf(bm25($d.text, $s), bm25($d.source, $s)) desc }"),
    ("T22", "put User2 { n: $i }"),
]


def type_rules(spark, d):
    """One row per broken query: its place in BROKEN and the rule that refused it."""
    catalog = parse_schema(tpch.SCHEMA + "node User2 { n: I32 }")
    out = []
    for i, (_, body) in enumerate(BROKEN):
        q = parse_queries(f"query q({PARAMS}) {{ {body} }}")["q"]
        try:
            (check_mutation if isinstance(q.body, Mutation) else check)(catalog, q)
            out.append((i, "none"))
        except TypeCheckError as e:
            out.append((i, e.rule))
    return spark.createDataFrame(out, "no int, rule string")


#: A declared parameter with a value that it can't take; "js" values come from JavaScript, where whole numbers end at 2^53.
WRONG_VALUES = [
    ("I32", 3_000_000_000, False), ("I32", 1.5, False), ("I32", None, False), ("I32?", None, False), ("U32", -1, False), ("U64", -1, False), ("I64", 2**60, True), ("String", 5, False),
    ("Bool", 1, False), ("F64", float("nan"), False), ("F64", "1", False), ("Date", "2026-13-01", False), ("DateTime", "noon", False), ("Vector(2)", [1.0], False), ("Vector(2)", ["a", "b"], False),
]
#: The same with values that it takes, and what they become as text.
RIGHT_VALUES = [
    ("I64", "1152921504606846976", True, "1152921504606846976"), ("I64", 2.0, True, "2"), ("U64", 2**64 - 1, False, "18446744073709551615"), ("F64", 3, False, "3.0"), ("Bool", True, False, "True"),
    ("Date", 19_000, False, "2022-01-08"), ("Date", dt.date(2026, 1, 2), False, "2026-01-02"), ("DateTime", 1_000, False, "1970-01-01 00:00:01"), ("DateTime", "2026-01-02T03:04:05+02:00", False, "2026-01-02 01:04:05"),
    ("Vector(2)", [1, 2.5], False, "[1.0, 2.5]"),
]


def param_values(spark, d):
    """What parameters become, or the error."""
    out = []
    for i, (kind, value, js, *_) in enumerate([*WRONG_VALUES, *RIGHT_VALUES]):
        declared = parse_queries(f"query q($p: {kind}) {{ match {{ $c: Customer }} return {{ $c.name }} }}")["q"].params
        try:
            out.append((i, str(bind(declared, {"p": value}, js=js)["p"])))
        except GraphError as e:
            out.append((i, type(e).__name__))
    return spark.createDataFrame(out, "no int, value string")


def _run(spark, d, source: str, params: dict | None = None, graph: Graph | None = None, js: bool = False):
    g = graph or tpch.graph(spark, d)
    q = next(iter(parse_queries(source).values()))
    return plan(g, check(g.catalog, q), bind(q.params, params, js=js), NOW)


def params_native(spark, d):
    return _run(spark, d, "query q($day: DateTime, $least: F64) { match { $o: Order  $o.orderdate >= $day  $o.totalprice > $least } return { $o.orderkey } }", {"day": dt.datetime(1996, 5, 1), "least": 200_000})


def params_js(spark, d):
    """Whole numbers as text, times as milliseconds."""
    return _run(spark, d, "query q($t: DateTime, $k: I64) { match { $o: Order  $o.orderdate < $t  $o.orderkey > $k } return { $o.orderkey } }", {"t": 831_000_000_000, "k": "100"}, js=True)


def output_names(spark, d):
    """Two columns of one name: the later one gets its variable before it."""
    return _run(spark, d, "query q() { match { $c: Customer  $c livesIn $n } return { $c.custkey, $c.name, $n.name } }")


def count_nullable(spark, d):
    return _run(spark, d, "query q() { match { $d: Document } return { $d.source, count($d) as docs, count($d.lang) as langs, count($d.text) as texts, sum($d.nchars) as chars } }")


def empty_aggregates(spark, d):
    return _run(spark, d, "query q() { match { $d: Document  $d.nchars > 999999999 } return { count($d) as n, sum($d.nchars) as s, min($d.nchars) as lo, max($d.nchars) as hi, avg($d.nchars) as m } }")


def nearest_text(spark, d):
    """A text as the target of nearest is embedded by the provider."""
    df = _run(spark, d, 'query q() { match { $v: Vec } return { $v.vecid, nearest($v.embedding, "quiet harbor") as distance } order { nearest($v.embedding, "quiet harbor") } limit 15 }')
    return df.withColumn("distance", F.round("distance", 6))


def rrf_vectors(spark, d):
    """Fusion of a vector rank and a text rank, where many nodes have no vector."""
    catalog = parse_schema("node Page { pageid: I64 @key  text: String?  v: Vector(64)? }")
    pages = lambda: read(spark, d, "documents").join(read(spark, d, "embeddings"), F.col("doc_id") == F.col("vec_id"), "left").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("pageid"), "text", F.col("embedding").alias("v"))
    call = 'rrf(nearest($p.v, $q), bm25($p.text, "harbor beacon"), 20)'
    df = _run(spark, d, f"query q($q: Vector(64)) {{ match {{ $p: Page }} return {{ $p.pageid, {call} as score }} order {{ {call} desc }} limit 25 }}", {"q": mock_embedding("x", 64)}, Graph(catalog, Lazy({"Page": pages}), {}))
    return df.withColumn("score", F.round("score", 9))


QUERIES = {f.__name__: f for f in (type_rules, param_values, params_native, params_js, output_names, count_nullable, empty_aggregates, nearest_text, rrf_vectors)}


def _values(rows: list[tuple], columns: str) -> str:
    text = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"{v}::INTEGER"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows) + f") t({columns})"


def _vector(text: str, role: str = "query") -> str:
    return "[" + ", ".join(map(repr, mock_embedding(text, 64, role=role))) + "]::FLOAT[]::DOUBLE[]"


ORACLE = {
    "type_rules": _values([(i, r) for i, (r, _) in enumerate(BROKEN)], "no, rule"),
    "param_values": _values([(i, "ParamError") for i in range(len(WRONG_VALUES))] + [(len(WRONG_VALUES) + i, v[3]) for i, v in enumerate(RIGHT_VALUES)], "no, value"),
    "params_native": "SELECT o_orderkey AS orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-05-01' AND o_totalprice > 200000",
    "params_js": "SELECT o_orderkey AS orderkey FROM orders WHERE o_orderdate < make_timestamp(831000000000 * 1000) AND o_orderkey > 100",
    "output_names": "SELECT c_custkey AS custkey, c_name AS name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "count_nullable": "SELECT source, count(*) AS docs, count(lang) AS langs, count(text) AS texts, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1",
    "empty_aggregates": "SELECT 0::BIGINT AS n, NULL::BIGINT AS s, NULL::BIGINT AS lo, NULL::BIGINT AS hi, NULL::DOUBLE AS m",
    "nearest_text": f"SELECT vec_id AS vecid, round(1 - list_cosine_similarity(embedding::DOUBLE[], {_vector('quiet harbor')}), 6) AS distance FROM embeddings ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], {_vector('quiet harbor')}), vec_id LIMIT 15",
    "rrf_vectors": f"""WITH b AS ({_bm25('harbor beacon')}),
rb AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 10) DESC, doc_id) AS r FROM b),
ra AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], {_vector('x', 'document')}), vec_id) AS r FROM embeddings JOIN documents ON doc_id = vec_id WHERE embedding IS NOT NULL)
SELECT doc_id AS pageid, round(coalesce(1.0 / (20 + ra.r), 0) + 1.0 / (20 + rb.r), 9) AS score FROM rb LEFT JOIN ra USING (doc_id) ORDER BY coalesce(1.0 / (20 + ra.r), 0) + 1.0 / (20 + rb.r) DESC, doc_id LIMIT 25""",
}
