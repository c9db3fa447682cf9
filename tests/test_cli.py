import base64
import json

import pytest

from graphloom import formats
from graphloom.__main__ import main
from graphloom.config import read_env
from graphloom.database import GraphDB
from graphloom.errors import CatalogError, LoadError, ParamError, ParseError
from graphloom.functions.vector import mock_embedding
from graphloom.plans.params import bind, coerce
from graphloom.plans.query import parse_queries
from graphloom.plans.schema import parse_schema
from graphloom.plans.types import PropType
from graphloom.sources.media import read_blob

PNG = b"\x89PNG\r\n\x1a\n1234"


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "s.pg").write_text("node P { name: String @key  age: I32? }")
    (tmp_path / "d.jsonl").write_text('{"type":"P","data":{"name":"A","age":3}}\n{"type":"P","data":{"name":"B, \\"C\\""}}\n')
    (tmp_path / "q.gq").write_text('query all($least: I32) @description("Everyone.") { match { $p: P  $p.age >= $least } return { $p.name, $p.age } }\nquery add($n: String) { insert P { name: $n } }')
    (tmp_path / "graphloom.toml").write_text('[db]\ndefault_path = "g"\n[schema]\ndefault_path = "s.pg"\n[query_aliases.old]\nquery = "q.gq"\nname = "all"\nargs = ["least"]\nformat = "json"\n')
    assert main(["init"], spark) == 0 and main(["load", "--data", str(tmp_path / "d.jsonl")], spark) == 0
    capsys.readouterr()
    assert main(["run", "old", "1"], spark) == 0
    assert json.loads(capsys.readouterr().out) == {"query": "all", "description": "Everyone.", "rows": [{"name": "A", "age": 3}]}
    assert main(["-q", "run", "--query", "q.gq", "--name", "all", "--param", "least=1", "--format", "csv"], spark) == 0
    assert capsys.readouterr().out.strip() == "name,age\nA,3"
    assert main(["run", "--query", "q.gq", "--name", "add", "--param", "n=Z"], spark) == 0
    assert json.loads(capsys.readouterr().out)["affected_nodes"] == 1
    assert main(["run", "--query", "q.gq", "--name", "add", "--param", "n=Z"], spark) == 1
    for args in (["describe"], ["check", "--query", "q.gq"], ["export"], ["changes", "--since", "1"], ["doctor"], ["compact"], ["cleanup"], ["version"], ["migrate", "--dry-run"], ["schema-diff", "--from", "s.pg", "--to", "s.pg"]):
        assert main(args, spark) == 0, args
    out = capsys.readouterr().out
    assert '"change_kind": "insert"' in out and "sound" in out


def test_formats(spark):
    df = spark.createDataFrame([("a", 2**60, None), ("b", 1, [1.5])], "name string, n bigint, l array<double>")
    assert formats.render(df, "table").splitlines()[2].startswith("a ")
    assert "-- a\nname: a" in formats.render(df, "kv", name="q")
    assert json.loads(formats.render(df, "jsonl", name="q").splitlines()[0]) == {"type": "meta", "query": "q"}
    assert next(formats.records(df, js=True))["n"] == str(2**60)


def test_media(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(PNG)
    db = GraphDB.init(spark, str(tmp_path / "g"), "node Photo { slug: String @key  uri: String @media_uri(mime)  mime: String  v: Vector(4)? @embed(uri) }")
    data = tmp_path / "d.jsonl"
    lines = [("a", "@file:x.bin"), ("b", "@base64:" + base64.b64encode(PNG).decode()), ("c", "@uri:https://example.com/y.jpg")]
    data.write_text("\n".join(json.dumps({"type": "Photo", "data": {"slug": s, "uri": u}}) for s, u in lines))
    db.load_file(str(data))
    rows = {r.slug: r for r in db.store.table(db.store.version(), "node:Photo").collect()}
    assert rows["a"].uri == rows["b"].uri and read_blob(db.path, rows["a"].uri) == PNG and rows["a"].mime == "image/png"
    assert rows["c"].mime == "image/jpeg" and len(rows["c"].v) == 4
    for bad in ("plain", "@base64:***", "@uri:", "@file:nowhere.png"):
        with pytest.raises(LoadError):
            db.load(json.dumps({"type": "Photo", "data": {"slug": "z", "uri": bad}}))


def test_params():
    t = lambda s, **k: PropType(s, **k)
    assert coerce("18446744073709551615", t("U64")) == 2**64 - 1 and coerce(3.0, t("I32"), js=True) == 3
    for v, p in ((None, t("String", nullable=True)), (2**31, t("I32")), (-1, t("U32")), (True, t("I32")), ("x", t("I64")), ([1.0], t("F32", dim=2)), (1.5, t("I32")), (float("nan"), t("F64")), ("x", t("String", enum=("a",)))):
        with pytest.raises(ParamError):
            coerce(v, p)
    with pytest.raises(ParamError):
        coerce(2**53, t("I64"), js=True)
    with pytest.raises(ParamError):
        bind({"a": t("I32")}, {})
    with pytest.raises(ParamError):
        bind({}, {"b": 1})


@pytest.mark.parametrize(
    "text",
    ["node p {}", "node P { a: Strin }", "node P { a: enum(x, x) }", "node P { a: Vector(0) }", "node P { a: [Vector(2)] }", "edge E: A - B", "node P { a String }", 'node P { a: String "x" }'],
)
def test_schemas_that_dont_parse(text):
    with pytest.raises((ParseError, CatalogError)):
        parse_schema(text)


@pytest.mark.parametrize(
    "text",
    [
        "node P { a: String @key  b: String @key }", "node P { a: [String] @key }", "node P { a: Vector(2) @unique }", "node P { a: String @embed(b)  b: String }", "node P { a: Vector(2) @embed(b) }",
        "node P { a: I32 @media_uri(b)  b: String }", "node P {} edge E: P -> Q", "node P {} edge E: P -> P { a: String @unique }", "node P {} node P {}", "node P : Q {}", "node P { a: String @instruction(\"x\") }", "node P { a: String  a: I32 }",
    ],
)
def test_schemas_that_dont_hold(text):
    with pytest.raises(CatalogError):
        parse_schema(text)


def test_inherited_properties_and_edge_names():
    c = parse_schema("node A { x: String @key }\nnode B : A { y: I32? }\nedge HasPart: A -> B")
    assert list(c.nodes["B"].props) == ["x", "y"] and c.nodes["B"].key == "x"
    assert c.edge("hasPart") is c.edge("HasPart") is c.edges["HasPart"] and c.edge("haspart") is None
    assert len(set(c.ids().values())) == len(c.ids())


@pytest.mark.parametrize("text", ["query q() { match { } return { 1 } }", "query q() { match { $p: P } return { } }", "query q() { match { $p: P  $p Knows $q } return { $p } }", "query q($a: [String]) { match { $p: P } return { $p } }", "query q() { match { $p: P  $p.a > -1 } return { $p } }", "query q( { }", "query q() { match { $p: P  rrf(search($p.a, \"x\"), bm25($p.a, \"x\")) } return { $p } }"])
def test_queries_that_dont_parse(text):
    with pytest.raises(ParseError):
        parse_queries(text)


def test_comments_and_backslashes():
    q = parse_queries('/* a\n b */ query q() { // c\n match { $p: P { n: "a\\nb" } } return { $p.n, } }')["q"]
    assert q.body.clauses[0].props[0][1].value == "a\\nb"


def test_mock_embedding_is_a_unit_vector_of_the_text():
    a, b = mock_embedding("  Harbor ", 16), mock_embedding("harbor", 16)
    assert a == b and abs(sum(x * x for x in a) - 1) < 1e-5 and a != mock_embedding("beacon", 16)


def test_env(tmp_path, monkeypatch):
    (tmp_path / "a").write_text("# x\nK1=1\nexport K2='two'\n")
    (tmp_path / "b").write_text("K1=9\nK3=3\n")
    monkeypatch.setenv("K3", "real")
    assert read_env(str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "c")) == {"K1": "1", "K2": "two", "K3": "real"}
