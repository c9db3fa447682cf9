"""Kinds and safety of migration steps, without data."""

import pytest

from graphloom.plans.migrate import BLOCKED, CONFIRM, SAFE, diff, steps
from graphloom.plans.schema import parse_schema

BASE = "node P { k: String @key  n: I32?  u: String?  e: enum(a, b)?  l: [String]? } node Q { k: String @key } edge E: P -> Q { w: F32? }"

CASES = [
    ("node P { k: String @key  n: I64?  u: String?  e: enum(a, b)?  l: [String]? } node Q { k: String @key } edge E: P -> Q { w: F64? }", {("AlterPropertyType", SAFE)}),
    (BASE.replace("n: I32?", "n: String?"), {("AlterPropertyType", BLOCKED)}),
    (BASE.replace("l: [String]?", "l: String?"), {("AlterPropertyType", BLOCKED)}),
    (BASE.replace("enum(a, b)", "enum(a, b, c)"), {("AlterPropertyEnumValues", SAFE)}),
    (BASE.replace("enum(a, b)", "enum(a)"), {("AlterPropertyEnumValues", BLOCKED)}),
    (BASE.replace("e: enum(a, b)?", "e: String?"), {("AlterPropertyEnumValues", SAFE)}),
    (BASE.replace("n: I32?", "n: I32"), {("AlterPropertyNullability", BLOCKED)}),
    (BASE.replace("u: String?", "u: String? @unique"), {("AlterPropertyUnique", BLOCKED)}),
    (BASE.replace("u: String?", "u: String? @index"), {("AlterPropertyIndex", SAFE)}),
    (BASE.replace("u: String?  ", ""), {("DropProperty", CONFIRM)}),
    (BASE.replace("u: String?", "v: String? @rename_from(\"u\")"), {("RenameProperty", SAFE)}),
    (BASE.replace("u: String?", "u: String?  x: I32"), {("AddProperty", BLOCKED)}),
    (BASE.replace("u: String?", "u: String?  x: I32?"), {("AddProperty", SAFE)}),
    (BASE.replace("E: P -> Q", "E: Q -> P"), {("RebindEdgeEndpoints", BLOCKED)}),
    (BASE.replace("node Q {", "node R @rename_from(\"Q\") {").replace("-> Q", "-> R"), {("RenameType", SAFE)}),
    (BASE + " node Z { k: I32 }", {("AddNodeType", SAFE)}),
    (BASE.replace(" edge E: P -> Q { w: F32? }", ""), {("DropEdgeType", CONFIRM)}),
    (BASE.replace("node Q {", "node Q @description(\"d\") {"), {("AlterMetadata", SAFE)}),
]


@pytest.mark.parametrize(("new", "expected"), CASES)
def test_steps_with_data(new, expected):
    found = steps(parse_schema(BASE), parse_schema(new), lambda t: True, lambda t, c: 1)
    assert {(s.kind, s.safety) for s in found} == expected


@pytest.mark.parametrize("new", [c[0] for c in CASES])
def test_nothing_is_blocked_without_data(new):
    assert not [s for s in steps(parse_schema(BASE), parse_schema(new), lambda t: False, lambda t, c: 0) if s.safety == BLOCKED]


def test_kinds():
    assert diff(BASE, BASE) == ("additive", [])
    assert diff(BASE, CASES[9][0])[0] == "compatible_with_confirmation"
    assert diff(BASE, CASES[1][0])[0] == "breaking"
    assert diff(BASE, CASES[13][0])[0] == "blocked"
    assert "@rename_from" in diff(BASE, CASES[9][0])[1][0].detail
