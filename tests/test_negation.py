"""Negations between two scans: every form against brute force, and a plan that doesn't shuffle the product of the scans."""

import datetime as dt
import random

import pytest

from graphloom.plans.planner import Graph, plan
from graphloom.plans.query import parse_queries
from graphloom.plans.schema import parse_schema
from graphloom.plans.typecheck import check

SCHEMA = """
node A { k: I64 @key  g: I32? }
node B { k: I64 @key  g: I32?  v: I32? }
node M { k: I64 @key  w: I32? }
edge X: A -> M
edge Y: M -> M
edge Z: B -> M
edge Likes: A -> B
"""


def tables():
    r = random.Random(7)
    group = lambda: r.choice([0, 1, 1, 2, None])
    a = [(i, i, group()) for i in range(40)] + [(3, 3, 1), (None, None, 1)]
    b = [(i, i, group(), r.choice([None, 1, 5, 9])) for i in range(12)] + [(2, 2, 1, 5), (None, None, 1, 1)]
    m = [(i, i, r.choice([None, 2, 6])) for i in range(30)]
    edges = lambda n, x, y: [(r.randrange(x), r.randrange(y)) for _ in range(n)]
    # Repeats of a pair, and a middle that many share.
    e = {"X": edges(60, 40, 30), "Y": edges(30, 30, 30), "Z": edges(40, 12, 30) + [(1, 7)] * 20, "Likes": edges(50, 40, 12)}
    e["X"] += [(i, 7) for i in range(0, 40, 3)]
    e["X"] += [(None, 7), (4, None)]
    return a, b, m, e


@pytest.fixture(scope="module")
def graph(spark):
    a, b, m, e = tables()
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    nodes = {"A": frame(a, "id bigint, k bigint, g int"), "B": frame(b, "id bigint, k bigint, g int, v int"), "M": frame(m, "id bigint, k bigint, w int")}
    return Graph(parse_schema(SCHEMA), nodes, {n: frame(x, "src bigint, dst bigint") for n, x in e.items()})


def run(graph, body):
    q = parse_queries(f"query q() {{ {body} }}")["q"]
    return plan(graph, check(graph.catalog, q), {}, dt.datetime(2026, 1, 1))


def _walks(e, two=False):
    """(a, b, last middle) over X, perhaps Y, and Z."""
    x = e["X"] if not two else [(p, w) for p, q in e["X"] for v, w in e["Y"] if q == v]
    return {(p, s, q) for p, q in x for s, t in e["Z"] if q == t and None not in (p, q)}


AB = lambda hits: {(p, s) for p, s, *_ in hits}
FORMS = {
    "one middle": ("$a.g = $b.g  not { $a x $m  $b z $m }", lambda a, b, e, w: a[2] is not None and a[2] == b[2] and (a[0], b[0]) not in AB(_walks(e))),
    "two middles": ("$a.g = $b.g  not { $a x $n  $n y $m  $b z $m }", lambda a, b, e, w: a[2] is not None and a[2] == b[2] and (a[0], b[0]) not in AB(_walks(e, two=True))),
    "no condition": ("not { $a x $m  $b z $m }", lambda a, b, e, w: (a[0], b[0]) not in AB(_walks(e))),
    "an edge": ("$a.g < $b.g  not { $a likes $b }", lambda a, b, e, w: None not in (a[2], b[2]) and a[2] < b[2] and (a[0], b[0]) not in e["Likes"]),
    "conditions inside": (
        "$a.g = $b.g  $b.v > 1  not { $a x $m  $b z $m  $m.w < $b.v  $m.w > 2 }",
        lambda a, b, e, w: a[2] is not None and a[2] == b[2] and (b[3] or 0) > 1 and (a[0], b[0]) not in {(p, s) for p, s, m in _walks(e) if w[m] is not None and s == b[0] and 2 < w[m] < b[3]},
    ),
    "a negation inside": (
        "$a.g = $b.g  not { $a x $m  $b z $m  not { $m y $_ } }",
        lambda a, b, e, w: a[2] is not None and a[2] == b[2] and (a[0], b[0]) not in {(p, s) for p, s, m in _walks(e) if m not in {v for v, _ in e["Y"]}},
    ),
    "two negations": (
        "$a.g = $b.g  not { $a x $m  $b z $m }  not { $a likes $b }",
        lambda a, b, e, w: a[2] is not None and a[2] == b[2] and (a[0], b[0]) not in AB(_walks(e)) | set(e["Likes"]),
    ),
}


@pytest.mark.parametrize("form", FORMS)
@pytest.mark.parametrize("bindings", ["$a: A  $b: B", "$b: B  $a: A"])
def test_against_brute_force(graph, form, bindings):
    a, b, m, e = tables()
    body, keeps = FORMS[form]
    w = {i: x for i, _, x in m}
    want = [(p[1], q[1]) for p in a for q in b if keeps(p, q, e, w)]
    found = [tuple(r) for r in run(graph, f"match {{ {bindings}  {body} }} return {{ $a.k as p, $b.k as q }}").collect()]
    order = lambda rows: sorted(rows, key=str)
    assert want and order(found) == order(want)


@pytest.mark.parametrize("most", [100_000, 0])
def test_the_product_is_filtered_where_it_arises(graph, monkeypatch, most):
    from graphloom.plans import planner

    monkeypatch.setattr(planner, "MOST_BROADCAST", most)
    df = run(graph, f"match {{ $a: A  $b: B  {FORMS['one middle'][0]} }} return {{ $a.k as p, $b.k as q }}")
    # An anti-join would shuffle the product by both ids; before that, every pair was expanded over all edges of $a.
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    assert not any("LeftAnti" in x for x in lines)
    product = next(i for i, x in enumerate(lines) if "array_contains" in x)
    assert not any("Exchange" in x or "Sort " in x for x in lines[:product])
