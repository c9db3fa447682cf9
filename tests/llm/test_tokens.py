import base64
import random

import pytest

from graphloom.llm import bpe, split, tokenize

tiktoken = pytest.importorskip("tiktoken")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, bpe.read_vocab().splitlines())}
    return tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(n=400):
    rng = random.Random(3)
    letters = [chr(rng.randrange(0x20, 0x3000)) for _ in range(200)] + list("  \n\t\r 　\x85\x1c'sdrt abc123<|endoftext|>") * 6 + ["\U0001f600", "\U00010330", "\U00020000", "\xad", "​", "ࢉ", "ࡰ"]
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(n)] + ["<|endoftext|>", "a" * 3000, "ab" * 9000, "I'll we've 'S 's", "  lead", "trail  ", "\n\n\na"]


def test_encoding_equals_another_implementation(spark, reference):
    texts = odd_texts()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts, None, "", "same", "same"])], "doc_id long, text string, ends string")
    rows = tokenize.decode(tokenize.encode(df)).collect()
    assert len(rows) == len(texts) + 4
    for r in rows:
        assert list(r.ids) == (reference.encode_ordinary(r.text) if r.text else [])
        assert r.decoded == (r.text or "")
        assert r.ends == "x"


def test_encoding_of_nothing(spark):
    assert tokenize.encode(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_stale_entries_and_ties():
    vocab = b"\n".join(base64.b64encode(w) + b" %d" % i for i, w in enumerate([b"a", b"b", b"aa", b"ab", b"aab", b"aaaa"]))
    b = bpe.Bpe(vocab)

    def brute(word):
        parts = [word[i : i + 1] for i in range(len(word))]
        while True:
            best = min(((b.ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in b.ranks), default=None)
            if best is None:
                return [b.ranks[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    rng = random.Random(1)
    for _ in range(300):
        w = bytes(rng.choice(b"aab") for _ in range(rng.randrange(1, 25)))
        if w not in b.ranks:
            assert b.merge(w) == brute(w)


def test_pieces(spark, reference):
    rng = random.Random(2)
    para = lambda: " ".join(rng.choice(["harbor", "it's", "fleet,", "ran.", "x" * 30, "漢字", "42"]) for _ in range(rng.randrange(5, 60)))
    texts = ["\n\n".join(rng.choice(["# Head\n", "", "> "]) + para() for _ in range(12)) for _ in range(6)]
    texts += ["\r\n".join(para() for _ in range(10)), "z" * 2000 + " tail " + "word " * 300, "漢" * 500, "  \n\n " * 80, "a b " * 40, "short", "", None]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, cut int")
    limit, overlap = 100, 10
    rows = split.split(df, limit=limit, overlap=overlap).orderBy("doc_id", "piece_no").collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert set(by) == set(range(len(texts)))
    for i, pieces in by.items():
        text = texts[i] or ""
        total = len(reference.encode_ordinary(text))
        assert (len(pieces) > 1) == (total > limit)
        own = [p.own_start for p in pieces] + [len(text)]
        assert own[0] == 0 and own == sorted(own) and all(p.n_pieces == len(pieces) for p in pieces)
        for k, p in enumerate(pieces):
            assert p.piece == text[p.start : own[k + 1]]
            n = len(reference.encode_ordinary(p.piece))
            assert n <= limit and p.tokens == n
            if k:
                assert p.start <= p.own_start and len(reference.encode_ordinary(text[p.start : p.own_start])) <= overlap
    # Where paragraphs fit, every cut lies at one, and headings stay with what follows.
    even = "\n\n".join(("# Head\n\n" if k % 3 == 0 else "") + "the harbor lit the fleet. " * 4 for k in range(20))
    cut = split.split(spark.createDataFrame([(1, even)], "doc_id long, text string"), limit=limit, overlap=overlap).orderBy("piece_no").collect()
    assert len(cut) > 3 and all(even[p.own_start - 2 : p.own_start] == "\n\n" for p in cut[1:])
    assert not any(p.piece.rstrip().endswith("# Head") for p in cut)


def test_merging_takes_weak_boundaries_first():
    # strengths: before segment 1 strong, before 2 weak
    assert split.merge([3, 3, 3], [9, 5, 1], 6) == [0, 1]
    assert split.merge([3, 3, 3], [9, 1, 5], 6) == [0, 2]
    assert split.merge([5], [9], 1) == [0]


def test_splitting_of_nothing(spark):
    assert split.split(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    with pytest.raises(ValueError):
        split.cut(spark.createDataFrame([], "doc_id long, text string"), limit=5, overlap=5)


def test_words_are_lossless():
    for t in odd_texts(100):
        assert "".join(bpe.WORDS.findall(t)) == t
