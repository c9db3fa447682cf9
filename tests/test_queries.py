"""Registered queries against their SQL on the smallest data, where these are there."""

import glob
import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
if not os.path.isdir(DATA):
    pytest.skip("no data", allow_module_level=True)

from graphloom.queries import general, graph, language, records, store

CHOSEN = [
    *language.QUERIES, *general.QUERIES, "change_rows", "feed_table", "null_predicates", "edge_puts", "search_indexed", "load_keyed_merge", "embed_backfill", "doctor_findings", "delete_cascade", "export_load",
    "negation", "negation_filtered", "negation_nested", "negation_two_vars", "rrf_hybrid",
]


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    yield c
    c.close()


def plain(rows):
    value = lambda v: ("nan" if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v
    return sorted([str(tuple(value(v) for v in r)) for r in rows])


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_its_sql(spark, sql, name):
    modules = (general, graph, language, records, store)
    query, oracle = (next(getattr(m, part)[name] for m in modules if name in getattr(m, part)) for part in ("QUERIES", "ORACLE"))
    df, rel = query(spark, DATA), sql.sql(oracle)
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    assert plain(map(tuple, df.select(*[f"`{n}`" for n in names]).collect())) == plain(rel.select(*[f'"{n}"' for n in names]).fetchall())


def test_every_query_but_the_named_ones_has_sql():
    for m in (general, graph, language, records, store):
        assert set(m.QUERIES) == set(m.ORACLE)
