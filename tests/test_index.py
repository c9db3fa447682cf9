import json
import random

import pytest

from graphloom.database import GraphDB
from graphloom.errors import StorageError

WORDS = ["reef", "quay", "gale", "Ärger", "tide", "mast"]


def node(no, text, v=None):
    return json.dumps({"type": "Note", "data": {"no": no, "text": text} | ({"v": v} if v else {})})


@pytest.fixture
def notes(spark):
    rng = random.Random(1)
    db = GraphDB.in_memory(spark, "node Note { no: I32 @key  text: String?  v: Vector(4)? }")
    db.load("\n".join(node(i, rng.choice([None, "", " ".join(rng.choices(WORDS, k=3))]), [rng.gauss(0, 1) for _ in range(4)] if i % 7 else None) for i in range(200)))
    yield db
    db.close()


def ask(db, call):
    return sorted(r[0] for r in db.run(f"query q() {{ match {{ $n: Note  {call} }} return {{ $n.no }} }}", "q").collect())


def plan(db, call):
    return db.run(f"query q() {{ match {{ $n: Note  {call} }} return {{ $n.no }} }}", "q")._jdf.queryExecution().optimizedPlan().toString()


def test_text_index_gives_the_same_as_a_scan(notes):
    calls = ['search($n.text, "reef GALE")', 'match_text($n.text, "gale reef")', 'search($n.text, "Ärger")', 'search($n.text, "nothing")', 'search($n.text, "")']
    change = ["query q() { delete Note where no < 20 }", 'query q() { update Note set { text: "reef gale reef" } where no = 50 }', 'query q() { insert Note { no: 900, text: "gale and reef" } }', 'query q() { put Note { no: 60 } }']
    for step in [None, *change]:
        if step:
            notes.run(step, "q")
        scanned = [ask(notes, c) for c in calls]
        if step is None:
            notes.index("Note", "text")
            assert "token" in plan(notes, calls[0]) and "token" not in plan(notes, calls[4])
        else:
            notes.store.files.delete("index")
            scanned = [ask(notes, c) for c in calls]
            notes.index("Note", "text") if step == change[1] else None
        assert [ask(notes, c) for c in calls] == scanned


def test_an_old_index_stays_right(notes):
    notes.index("Note", "text")
    notes.run("query q() { delete Note where no < 100 }", "q")
    notes.run('query q() { insert Note { no: 901, text: "reef" } }', "q")
    got = ask(notes, 'search($n.text, "reef")')
    assert 901 in got and min(got) >= 100
    want = sorted(r.no for r in notes.store.table(notes.store.version(), "node:Note").filter("array_contains(split(text, ' '), 'reef')").collect())
    assert got == want


def test_vector_index(notes):
    about = notes.index("Note", "v")
    assert about["cells"] == 13 and about["rows"] == 171
    source = "query q($q: Vector(4)) { match { $n: Note } return { $n.no } order { nearest($n.v, $q) } limit 3 }"
    hits, rng = 0, random.Random(2)
    for _ in range(10):
        q = {"q": [rng.gauss(0, 1) for _ in range(4)]}
        exact, near = ([r[0] for r in notes.run(source, "q", q, approximate=a).collect()] for a in (False, True))
        hits += len(set(exact) & set(near))
    assert hits >= 27
    notes.run('query q($v: Vector(4)) { insert Note { no: 902, v: $v } }', "q", {"v": [5, 0, 0, 0]})
    assert notes.run(source, "q", {"q": [1, 0, 0, 0]}, approximate=True).first()[0] == 902
    filtered = source.replace("$n: Note }", "$n: Note  $n.no > 50 }")
    assert len(notes.run(filtered, "q", {"q": [1, 0, 0, 0]}, approximate=True).collect()) == 3


def test_what_cannot_be_indexed(notes):
    for prop in ("no", "none"):
        with pytest.raises(StorageError):
            notes.index("Note", prop)
