"""Graph queries over the star-schema view, with their SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from graphloom.plans.params import bind
from graphloom.plans.planner import plan
from graphloom.plans.query import parse_queries
from graphloom.plans.typecheck import check
from graphloom.sources.tpch import graph

NOW = dt.datetime(2026, 1, 1)
VEC = [round(((i * 37) % 19 - 9) / 10, 1) for i in range(64)]

SOURCE = """
query flagship() {
    match { $n: Nation { name: "NATION_3" }  $c livesIn $n  $c placed $o  $o.totalprice > 100000.0 }
    return { $c.name, $o.orderkey, $o.totalprice }
    order { $o.totalprice desc, $o.orderkey }
    limit 20
}
query scan_filter() { match { $c: Customer  $c.acctbal > 5000.0  $c.mktsegment != "BUILDING" } return { $c.custkey, $c.name, $c.acctbal } }
query scan_prop_match($s: String) { match { $o: Order { status: $s } } return { $o.orderkey, $o.totalprice } }
query filter_cast_right() { match { $p: Part  $p.size > 30.5 } return { $p.partkey, $p.size } }
query filter_flipped() { match { $p: Part  30.5 < $p.size } return { $p.partkey, $p.size } }
query filter_temporal() { match { $o: Order  $o.orderdate >= datetime("1996-01-01T00:00:00Z")  $o.orderdate < datetime("1997-01-01T00:00:00Z") } return { $o.orderkey } }
query filter_now() { match { $o: Order  $o.orderdate <= now() } return { count($o) as orders } }
query list_contains($w: String) { match { $p: Part  $p.words contains $w } return { $p.partkey, $p.name } }
query list_prop_match($w: String) { match { $p: Part { words: $w } } return { $p.partkey } }
query one_hop() { match { $c: Customer { mktsegment: "BUILDING" }  $c livesIn $n } return { $c.custkey, $n.name as nation } }
query reverse_hop() { match { $n: Nation { name: "NATION_7" }  $c livesIn $n } return { $c.custkey, $c.name } }
query two_hop() { match { $r: Region  $n inRegion $r  $s basedIn $n } return { $r.name as region, $s.suppkey } }
query heterogeneous_direction() { match { $o: Order { status: "F" }  $o contains $p  $s supplies $p  $s.acctbal > 9000.0 } return { $o.orderkey, $s.suppkey, $p.partkey } }
query cycle_close() { match { $c: Customer  $n: Nation  $c livesIn $n  $s basedIn $n  $c.acctbal > 9900.0 } return { $c.custkey, $s.suppkey } }
query cycle_triangle() { match { $a: Nation  $a next $b  $b next $c  $a next $c } return { $a.name as a, $b.name as b, $c.name as c } }
query fan_in() { match { $c placed $o  $o contains $p  $s supplies $p  $s basedIn $n  $c livesIn $n  $o.totalprice > 450000.0 } return { $c.custkey, $o.orderkey, $s.suppkey, $p.partkey } }
query anonymous() { match { $c: Customer  $c placed $_ } return { $c.custkey, count($c) as orders } }
query cross_theta() { match { $a: Nation  $b: Region  $a.regionkey < $b.regionkey } return { $a.name as nation, $b.name as region } }
query cross_equi() { match { $a: Nation  $b: Region  $a.regionkey = $b.regionkey } return { $a.name as nation, $b.name as region } }
query bounded_1_3() { match { $a: Nation  $a next{1,3} $b } return { $a.name as a, $b.name as b } }
query bounded_exact_2() { match { $a: Nation { name: "NATION_3" }  $a next{2,2} $b } return { $b.name as b } }
query bounded_customers() { match { $c: Customer  $c livesIn $n  $n next{2,3} $m  $m.regionkey = 1 } return { $m.name as nation, count($c) as customers } }
query negation() { match { $c: Customer  not { $c placed $_ } } return { $c.custkey } }
query negation_filtered() { match { $c: Customer  not { $c placed $o  $o.totalprice > 200000.0 } } return { $c.custkey } }
query negation_nested() { match { $c: Customer  not { $c placed $o  not { $o contains $p  $p.size > 45 } } } return { $c.custkey } }
query negation_two_vars() { match { $c: Customer  $s: Supplier  $c.nationkey = $s.nationkey  not { $c placed $o  $o contains $p  $s supplies $p } } return { $c.custkey, $s.suppkey } }
query group_count() { match { $c: Customer  $c livesIn $n } return { $n.name, count($c) as customers } }
query group_sum_avg_min_max() {
    match { $c: Customer  $c placed $o }
    return { $c.mktsegment, count($o) as n, sum($o.totalprice) as total, avg($o.totalprice) as mean, min($o.totalprice) as least, max($o.totalprice) as most }
}
query global_agg() { match { $p: Part } return { count($p) as n, sum($p.size) as sizes, min($p.size) as least, max($p.size) as most, avg($p.size) as mean } }
query temporal_min_max() { match { $o: Order } return { $o.status, min($o.orderdate) as first, max($o.orderdate) as last } }
query alias_order_topk() { match { $c: Customer  $c placed $o } return { $c.custkey, sum($o.totalprice) as total } order { total desc } limit 10 }
query order_unprojected() { match { $c: Customer } return { $c.name } order { $c.acctbal desc, $c.custkey } limit 25 }
query unordered_limit() { match { $o: Order  $o.totalprice > 300000.0 } return { $o.orderkey } limit 15 }
query node_struct() { match { $n: Nation } return { $n } }
query search_tokens($q: String) { match { $d: Document  search($d.text, $q) } return { $d.docid } }
query match_phrase($q: String) { match { $d: Document  match_text($d.text, $q) } return { $d.docid } }
query fuzzy_terms($q: String) { match { $d: Document  fuzzy($d.text, $q) } return { $d.docid } }
query fuzzy_limit($q: String) { match { $d: Document  fuzzy($d.text, $q, 1) } return { $d.docid } }
query bm25_rank($q: String) { match { $d: Document } return { $d.docid, bm25($d.text, $q) as score } order { bm25($d.text, $q) desc } limit 20 }
query nearest_topk($q: Vector(64)) { match { $v: Vec } return { $v.vecid, nearest($v.embedding, $q) as distance } order { nearest($v.embedding, $q) } limit 20 }
query rrf_hybrid($q: String, $r: String) {
    match { $d: Document { lang: "en" } }
    return { $d.docid, rrf(bm25($d.text, $q), bm25($d.text, $r)) as score }
    order { rrf(bm25($d.text, $q), bm25($d.text, $r)) desc }
    limit 20
}
query graph_constrained_rank($q: Vector(64)) { match { $v: Vec  $v.label = 3 } return { $v.vecid, nearest($v.embedding, $q) as distance } order { nearest($v.embedding, $q) } limit 10 }
"""

PARAMS = {
    "scan_prop_match": {"s": "F"}, "list_contains": {"w": "widget"}, "list_prop_match": {"w": "ring"}, "search_tokens": {"q": "harbor beacon"}, "match_phrase": {"q": "one another"},
    "fuzzy_terms": {"q": "harbour lantren"}, "fuzzy_limit": {"q": "beacn"}, "bm25_rank": {"q": "quiet harbor beacon quiet"}, "nearest_topk": {"q": VEC}, "rrf_hybrid": {"q": "harbor beacon", "r": "lantern fleet"}, "graph_constrained_rank": {"q": VEC},
}


def run(spark, d: str, name: str, params: dict | None = None):
    g = graph(spark, d)
    q = parse_queries(SOURCE)[name]
    return plan(g, check(g.catalog, q), bind(q.params, params), NOW)


#: Float columns, rounded alike here and in the SQL: sums differ in their last bits with the order of the rows.
_ROUNDED = {
    "group_sum_avg_min_max": {"total": 2, "mean": 4}, "alias_order_topk": {"total": 2}, "global_agg": {"mean": 6}, "bm25_rank": {"score": 6},
    "nearest_topk": {"distance": 6}, "rrf_hybrid": {"score": 9}, "graph_constrained_rank": {"distance": 6},
}


def _query(name: str):
    def f(spark, d):
        df = run(spark, d, name, PARAMS.get(name))
        if name == "node_struct":
            return df.select("n.id", "n.nationkey", "n.name", "n.regionkey")
        return df.withColumns({c: F.round(c, n) for c, n in _ROUNDED.get(name, {}).items()})

    f.__name__ = name
    return f


QUERIES = {name: _query(name) for name in parse_queries(SOURCE)}

_NEXT = "nxt AS (SELECT DISTINCT a, b FROM (SELECT n_nationkey AS a, (n_nationkey + 1) % 25 AS b FROM nation UNION ALL SELECT n_nationkey, (n_nationkey * 2) % 25 FROM nation))"
_CONTAINS = "con AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem)"
_SUPPLIES = "sup AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem)"
_WALK = "w1 AS (SELECT DISTINCT a, b FROM nxt), w2 AS (SELECT DISTINCT x.a, y.b FROM w1 x JOIN nxt y ON x.b = y.a), w3 AS (SELECT DISTINCT x.a, y.b FROM w2 x JOIN nxt y ON x.b = y.a)"
#: RE2 has no class of alphabetic characters: letters and numbers, with the alphabetic marks of Devanagari and circled letters.
_TOK = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\p{{L}}\\p{{N}}\\x{{900}}-\\x{{903}}\\x{{93A}}\\x{{93B}}\\x{{93E}}-\\x{{94C}}\\x{{94E}}\\x{{94F}}\\x{{955}}-\\x{{957}}\\x{{962}}\\x{{963}}\\x{{24B6}}-\\x{{24E9}}]+')"
_TOKENS = _TOK.format("text")


def _list(q: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in q.split()) + "]"


def _bm25(q: str, where: str = "true") -> str:
    words = q.split()
    counts = {w: words.count(w) for w in words}
    one = " + ".join(
        f"CASE WHEN len(list_filter(t, lambda x: x = '{w}')) > 0 THEN ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * (len(list_filter(t, lambda x: x = '{w}')) * 2.2) / (len(list_filter(t, lambda x: x = '{w}')) + 1.2 * (0.25 + 0.75 * len(t) / avgdl)) * {c} ELSE 0 END"
        for i, (w, c) in enumerate(counts.items())
    )
    dfs = ", ".join(f"count(CASE WHEN list_contains(t, '{w}') THEN 1 END) AS df{i}" for i, w in enumerate(counts))
    return f"SELECT doc_id, CASE WHEN text IS NULL THEN 0.0 ELSE {one} END AS score FROM (SELECT doc_id, text, {_TOKENS} AS t FROM documents WHERE {where}), (SELECT count(*) AS n, avg(len(t)) AS avgdl, {dfs} FROM (SELECT {_TOKENS} AS t FROM documents WHERE text IS NOT NULL AND {where}))"


def _nearest(where: str, k: int) -> str:
    v = "[" + ", ".join(map(str, VEC)) + "]::FLOAT[]::DOUBLE[]"
    return f"SELECT vec_id AS vecid, round(1 - list_cosine_similarity(embedding::DOUBLE[], {v}), 6) AS distance FROM embeddings WHERE {where} ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], {v}), vec_id LIMIT {k}"


ORACLE = {
    "flagship": "SELECT c_name AS name, o_orderkey AS orderkey, o_totalprice AS totalprice FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE n_name = 'NATION_3' AND o_totalprice > 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "scan_filter": "SELECT c_custkey AS custkey, c_name AS name, c_acctbal AS acctbal FROM customer WHERE c_acctbal > 5000 AND c_mktsegment <> 'BUILDING'",
    "scan_prop_match": "SELECT o_orderkey AS orderkey, o_totalprice AS totalprice FROM orders WHERE o_orderstatus = 'F'",
    "filter_cast_right": "SELECT p_partkey AS partkey, p_size AS size FROM part WHERE p_size > 30",
    "filter_flipped": "SELECT p_partkey AS partkey, p_size AS size FROM part WHERE p_size > 30",
    "filter_temporal": "SELECT o_orderkey AS orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'",
    "filter_now": "SELECT count(*) AS orders FROM orders WHERE o_orderdate <= TIMESTAMP '2026-01-01'",
    "list_contains": "SELECT p_partkey AS partkey, p_name AS name FROM part WHERE list_contains(string_split(p_name, ' '), 'widget')",
    "list_prop_match": "SELECT p_partkey AS partkey FROM part WHERE list_contains(string_split(p_name, ' '), 'ring')",
    "one_hop": "SELECT c_custkey AS custkey, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'",
    "reverse_hop": "SELECT c_custkey AS custkey, c_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_7'",
    "two_hop": "SELECT r_name AS region, s_suppkey AS suppkey FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey",
    "heterogeneous_direction": f"WITH {_CONTAINS}, {_SUPPLIES} SELECT o_orderkey AS orderkey, s_suppkey AS suppkey, con.p AS partkey FROM orders JOIN con ON con.o = o_orderkey JOIN sup ON sup.p = con.p JOIN supplier ON s_suppkey = sup.s WHERE o_orderstatus = 'F' AND s_acctbal > 9000",
    "cycle_close": "SELECT c_custkey AS custkey, s_suppkey AS suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE c_acctbal > 9900",
    "cycle_triangle": f"WITH {_NEXT} SELECT x.n_name AS a, y.n_name AS b, z.n_name AS c FROM nxt p JOIN nxt q ON p.b = q.a JOIN nxt r ON r.a = p.a AND r.b = q.b JOIN nation x ON x.n_nationkey = p.a JOIN nation y ON y.n_nationkey = p.b JOIN nation z ON z.n_nationkey = q.b",
    "fan_in": f"WITH {_CONTAINS}, {_SUPPLIES} SELECT c_custkey AS custkey, o_orderkey AS orderkey, s_suppkey AS suppkey, con.p AS partkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN con ON con.o = o_orderkey JOIN sup ON sup.p = con.p JOIN supplier ON s_suppkey = sup.s AND s_nationkey = c_nationkey WHERE o_totalprice > 450000",
    "anonymous": "SELECT c_custkey AS custkey, count(*) AS orders FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "cross_theta": "SELECT n_name AS nation, r_name AS region FROM nation, region WHERE n_regionkey < r_regionkey",
    "cross_equi": "SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey",
    "bounded_1_3": f"WITH {_NEXT}, {_WALK}, r AS (SELECT * FROM w1 UNION SELECT * FROM w2 UNION SELECT * FROM w3) SELECT x.n_name AS a, y.n_name AS b FROM r JOIN nation x ON x.n_nationkey = r.a JOIN nation y ON y.n_nationkey = r.b",
    "bounded_exact_2": f"WITH {_NEXT}, {_WALK} SELECT y.n_name AS b FROM w2 JOIN nation x ON x.n_nationkey = a JOIN nation y ON y.n_nationkey = b WHERE x.n_name = 'NATION_3'",
    "bounded_customers": f"WITH {_NEXT}, {_WALK}, r AS (SELECT * FROM w2 UNION SELECT * FROM w3) SELECT n_name AS nation, count(*) AS customers FROM customer JOIN r ON r.a = c_nationkey JOIN nation ON n_nationkey = r.b WHERE n_regionkey = 1 GROUP BY 1",
    "negation": "SELECT c_custkey AS custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "negation_filtered": "SELECT c_custkey AS custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)",
    "negation_nested": "WITH big AS (SELECT DISTINCT l_orderkey AS o FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 45) SELECT c_custkey AS custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT o FROM big))",
    "negation_two_vars": "WITH hit AS (SELECT DISTINCT o_custkey AS c, b.l_suppkey AS s FROM orders JOIN lineitem a ON a.l_orderkey = o_orderkey JOIN lineitem b ON b.l_partkey = a.l_partkey) SELECT c_custkey AS custkey, s_suppkey AS suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.c = c_custkey AND hit.s = s_suppkey)",
    "group_count": "SELECT n_name AS name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    "group_sum_avg_min_max": "SELECT c_mktsegment AS mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS least, max(o_totalprice) AS most FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "global_agg": "SELECT count(*) AS n, sum(p_size)::BIGINT AS sizes, min(p_size) AS least, max(p_size) AS most, round(avg(p_size), 6) AS mean FROM part",
    "temporal_min_max": "SELECT o_orderstatus AS status, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders GROUP BY 1",
    "alias_order_topk": "SELECT o_custkey AS custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC LIMIT 10",
    "order_unprojected": "SELECT c_name AS name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25",
    "unordered_limit": "SELECT o_orderkey AS orderkey FROM orders WHERE o_totalprice > 300000 ORDER BY o_orderkey LIMIT 15",
    "node_struct": "SELECT n_nationkey::BIGINT AS id, n_nationkey AS nationkey, n_name AS name, n_regionkey AS regionkey FROM nation",
    "search_tokens": f"SELECT doc_id AS docid FROM documents WHERE list_has_all({_TOKENS}, {_list('harbor beacon')})",
    "match_phrase": f"SELECT doc_id AS docid FROM documents WHERE contains(' ' || array_to_string({_TOKENS}, ' ') || ' ', ' one another ')",
    "fuzzy_terms": f"SELECT doc_id AS docid FROM (SELECT doc_id, {_TOKENS} AS t FROM documents WHERE text IS NOT NULL) WHERE len(list_filter(t, lambda x: levenshtein(x, 'harbour') <= 2)) > 0 AND len(list_filter(t, lambda x: levenshtein(x, 'lantren') <= 2)) > 0",
    "fuzzy_limit": f"SELECT doc_id AS docid FROM (SELECT doc_id, {_TOKENS} AS t FROM documents WHERE text IS NOT NULL) WHERE len(list_filter(t, lambda x: levenshtein(x, 'beacn') <= 1)) > 0",
    "bm25_rank": f"SELECT doc_id AS docid, round(score, 6) AS score FROM ({_bm25('quiet harbor beacon quiet')}) ORDER BY round(score, 10) DESC, doc_id LIMIT 20",
    "nearest_topk": _nearest("true", 20),
    "rrf_hybrid": f"""WITH a AS ({_bm25('harbor beacon', "lang = 'en'")}), b AS ({_bm25('lantern fleet', "lang = 'en'")}),
ra AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 10) DESC, doc_id) AS r FROM a), rb AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 10) DESC, doc_id) AS r FROM b)
SELECT ra.doc_id AS docid, round(1.0 / (60 + ra.r) + 1.0 / (60 + rb.r), 9) AS score FROM ra JOIN rb USING (doc_id) ORDER BY 1.0 / (60 + ra.r) + 1.0 / (60 + rb.r) DESC, docid LIMIT 20""",
    "graph_constrained_rank": _nearest("label = 3", 10),
}
