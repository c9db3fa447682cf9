import random

import numpy as np
import pytest

from graphloom.llm import leaks

VOCAB = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(400)]
INSTRUCTION = "you are given a record of past events decide whether the claim holds and say in one sentence why".split()


def passage(rng, n):
    return [rng.choice(VOCAB) for _ in range(n)]


@pytest.fixture(scope="module")
def items():
    rng = random.Random(1)
    return {i: (INSTRUCTION if i % 3 == 0 else []) + passage(rng, 40) for i in range(12)}


def found(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(docs)], "doc_id bigint, text string, item_id string")
    e = spark.createDataFrame([(i, " ".join(w) if w is not None else None, "x") for i, w in items.items()], "item_id bigint, text string, doc_id string")
    rows = leaks.find_leaks(d, e.unionByName(e)).collect()
    assert len(rows) == len(set(rows))
    return {(r.doc_id, r.item_id) for r in rows}


def change(rng, words, n):
    """n words altered, added or left out."""
    out = list(words)
    for at in sorted(rng.sample(range(1, len(out) - 1), n), reverse=True):
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = "changed"
        elif kind == 1:
            out.insert(at, "added")
        else:
            del out[at]
    return out


def test_altered_passages_are_found(spark, items):
    rng = random.Random(2)
    docs, want = [], set()
    for i in range(60):
        item = rng.randrange(12)
        own = items[item][-40:]
        n = rng.choice([16, 17, 20, 24, 32, 40])
        at = rng.randrange(0, 40 - n + 1)
        docs.append(" ".join(passage(rng, 30) + change(rng, own[at : at + n], n // 8) + passage(rng, 30)))
        want.add((i, item))
    assert found(spark, docs, items) == want


def test_what_is_no_leak(spark, items):
    rng = random.Random(3)
    own = items[0][-40:]
    docs = [" ".join(INSTRUCTION), " ".join(own[:12]), " ".join(reversed(own)), None, "", "  \n ", " ".join(own[:8] + passage(rng, 8) + own[8:16] + passage(rng, 8) + own[16:24])]
    heavy = list(own)
    heavy[2::4] = ["changed"] * len(heavy[2::4])
    docs.append(" ".join(heavy))
    assert found(spark, docs, items) == set()


def test_forms_of_writing(spark, items):
    own = items[1][-20:]
    lines = [" ".join(own[i : i + 5]) for i in range(0, 20, 5)]
    docs = [
        "\n".join("> " + x.upper() for x in lines),
        "\r\n".join("// " + x for x in lines),
        "<p>" + "</b> <i class='x'>".join(own) + "</p>",
        " **" + "** _".join(own) + "_.",
        "⁠".join("  ".join(own)),
        " ".join(own).translate({ord(c): ord(c) + 0xFEE0 for c in "abcdefghijklmnopqrstuvwxyz"}),
        " ".join(own).replace("a", "а"),
        " ".join(w[0] + "-\n  " + w[1:] for w in own),
        '{"note": "' + "\\n".join(own) + '"}',
        "&nbsp;".join(own),
        " ".join("".join(c + "́" for c in w) for w in own),
    ]
    assert found(spark, docs, items) == {(i, 1) for i in range(len(docs))}


def test_very_long_text_and_repeats(spark, items):
    rng = random.Random(4)
    own = items[2][-30:]
    long = " ".join(passage(rng, 60_000) + own + passage(rng, 60_000))
    assert found(spark, [long, " ".join(own * 3), "x" * 200_000], items) == {(0, 2), (1, 2)}


def test_shared_words_are_no_evidence(spark):
    rng = random.Random(5)
    both, a, b = passage(rng, 20), passage(rng, 20), passage(rng, 20)
    assert found(spark, [" ".join(both), " ".join(a), " ".join(both + b)], {1: both + a, 2: both + b, 3: None}) == {(1, 1), (2, 2)}


def test_nothing(spark, items):
    e = spark.createDataFrame([], "item_id bigint, text string")
    d = spark.createDataFrame([(1, "a " * 50)], "doc_id bigint, text string")
    assert leaks.find_leaks(d, e).collect() == []
    assert leaks.find_leaks(spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([(1, " ".join(items[0]))], "item_id bigint, text string")).collect() == []


def test_small_pieces_give_the_same(spark, items, monkeypatch):
    monkeypatch.setattr(leaks, "PIECE", 64)
    monkeypatch.setattr(leaks, "CELLS", 500)
    docs = [" ".join(w[-30:] + ["x"] * 3 + w[:20]) for w in items.values()]
    long = {i: w * (3 if i == 1 else 1) for i, w in items.items()}
    assert found(spark, docs, long) == {(i, i) for i in items}


def test_short_words_and_short_texts(spark):
    rng = random.Random(8)
    own = [rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(16)]
    docs = [" ".join(own), " ".join(own[:7] + own[8:]), "a", "ab cd"]
    assert len(docs[0]) == 31 and found(spark, docs, {7: own}) == {(0, 7), (1, 7)}


def test_passage_beside_shared_words(spark):
    """Hits on one diagonal in two passages that shared words part: each passage counts for itself."""
    rng = random.Random(9)
    shared, a, b, c = passage(rng, 8), passage(rng, 16), passage(rng, 18), passage(rng, 20)
    items = {1: a + shared + b, 2: c + shared + passage(rng, 17)}
    docs = [" ".join(a[-6:] + shared + b), " ".join(a + shared + b[:5]), " ".join(a[-6:] + shared + b[:6])]
    assert found(spark, docs, items) == {(0, 1), (1, 1)}


def test_the_mask_finds_what_unbroken_seeds_miss(spark):
    """Every fifth word altered: no five words in a row are left, as one change in five allows."""
    rng = random.Random(10)
    own = passage(rng, 24)
    doc = [w if i % 5 else "altered" for i, w in enumerate(own)]
    flags = np.full(1 << 10, 255, np.uint8)
    shape = leaks.Shape(16, 8)
    assert shape.mask == "11011" and leaks.Shape(16, 5).mask == "1101"
    assert leaks.stretches([" ".join(doc)], flags, shape)[0]
    know = set(leaks.seed_hashes(leaks.word_numbers(" ".join(own)), "11111")[0].tolist())
    assert not know & set(leaks.seed_hashes(leaks.word_numbers(" ".join(doc)), "11111")[0].tolist())
    know = set(leaks.seed_hashes(leaks.word_numbers(" ".join(own)), "11011")[0].tolist())
    assert know & set(leaks.seed_hashes(leaks.word_numbers(" ".join(doc)), "11011")[0].tolist())
    d = spark.createDataFrame([(0, " ".join(doc))], "doc_id bigint, text string")
    e = spark.createDataFrame([(1, " ".join(own))], "item_id bigint, text string")
    assert leaks.find_leaks(d, e, one_in=5).collect() and not leaks.find_leaks(d, e).collect()


def test_a_passage_of_one_word(spark):
    assert leaks.Shape(16, 8).hits == 2 and leaks.Shape(16, 5).hits >= 1
    d = " ".join(["x"] * 9 + ["y"] + ["x"] * 7)
    assert found(spark, [d, " ".join(["x"] * 12)], {1: ["x"] * 18}) == {(0, 1)}


def brute(doc, item, words=16, one_in=8):
    """Whether some successive words of the item stand in the document with so few changes."""
    for i in range(len(item) - words + 1):
        row = [0] * (len(doc) + 1)
        for n in range(1, len(item) - i + 1):
            new = [n]
            for j in range(1, len(doc) + 1):
                new.append(min(row[j - 1] + (item[i + n - 1] != doc[j - 1]), row[j] + 1, new[j - 1] + 1))
            row = new
            if n >= words and min(row) * one_in <= n:
                return True
    return False


def test_equal_to_brute_force(spark):
    rng = random.Random(11)
    items = {i: [rng.choice(VOCAB[:60]) for _ in range(rng.choice([16, 20, 34]))] for i in range(6)}
    docs = []
    for _ in range(150):
        own = items[rng.randrange(6)]
        n = rng.randrange(12, len(own) + 1)
        at = rng.randrange(len(own) - n + 1)
        docs.append([rng.choice(VOCAB) for _ in range(6)] + change(rng, own[at : at + n], rng.randrange(0, 6)) + [rng.choice(VOCAB) for _ in range(6)])
    want = {(i, k) for i, d in enumerate(docs) for k, item in items.items() if brute(d, item)}
    assert 20 < len(want) < 140
    assert found(spark, [" ".join(d) for d in docs], items) == want


def test_reach_against_brute_force():
    rng = random.Random(6)
    for _ in range(200):
        item = [rng.randrange(1, 5) for _ in range(20)]
        doc = list(item)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(1, len(doc))
            doc[at : at + rng.randrange(2)] = [rng.randrange(1, 5)] * rng.randrange(2)
        pad = [0] * 60
        out = leaks._reach(np.array([-1] * 60 + item + [-1] * 60), np.array(pad + doc + pad), np.array([60]), np.array([60]), np.array([20]), 1, 4, 40)
        # Rows of the edit distance table: the longest item prefix within e changes of some document prefix.
        table = np.zeros((21, len(doc) + 1), int)
        table[:, 0], table[0] = range(21), range(len(doc) + 1)
        for i in range(1, 21):
            for j in range(1, len(doc) + 1):
                table[i, j] = min(table[i - 1, j - 1] + (item[i - 1] != doc[j - 1]), table[i - 1, j] + 1, table[i, j - 1] + 1)
        for e in range(5):
            assert out[e][0] == max(i for i in range(21) if table[i].min() <= e)
