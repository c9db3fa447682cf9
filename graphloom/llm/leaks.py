"""Evaluation texts leaking into training text.

Method: spaced-seed hashing. A fixed mask ignores one word position in the middle; the seeds of the items and of the
corpus are joined by hash, and the words around each hit are verified with substitutions, additions and omissions allowed.

A text is read as its words: variant forms of characters folded (compatibility, case, accents, look-alikes), invisible characters, markup, entities,
escapes and line prefixes removed, words that a line end has cut put together. Words that stand in several items (runs of
``SHARED`` words found in two or more of them) are no evidence and end a passage.

Found is a document with at least ``words`` successive words of an item, of which at most one in ``one_in`` is altered,
added or left out. Nothing is missed:

* a passage of 2 * words or more can be halved, and one half has no more changes for its length; so each holds a smallest
  passage of words <= n < 2 * words with at most n // one_in changes. ``reach`` is more than that on either side of a hit.
* its unchanged words lie in one more run than there are changes, so one run has at least ``shortest_run`` words, 5 for 16
  words with one change in 8. The mask (11011) is as long: each such run holds a hit, and so do shorter runs that one
  altered word parts.
* in the same way a smallest passage holds at least ``hits`` of them (2 here): a stretch and a passage with fewer in common
  aren't compared.
* hits that follow each other on one diagonal are one unbroken run of words; the first stands for them.

Nothing is held on the driver but a Bloom filter of the items' seeds (at most 16 MB, so its broadcast is bounded whatever
the number of items; a fuller filter only lets more of the corpus through to the join). The corpus is read in one pass that
puts out the stretches of words around what passes the filter, in pieces of at most ``PIECE`` words that overlap by
``reach``; seeds, pieces and passages meet in joins, where AQE splits what is skewed.

Defined results: null and empty texts and items with fewer than ``words`` words of their own give nothing; repeated rows
give one result; further columns are ignored; very long texts are handled whole.
"""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.util import materialize, over_cores

WORDS, ONE_IN = 16, 8
SHARED = 8
#: Words of a piece.
PIECE = 512
MOST_BITS = 1 << 27
CHUNK_CHARS = 4_000_000
CACHE_WORDS = 400_000
#: Compared words (document by item) that are verified at once.
CELLS = 4_000_000

#: Letters of other alphabets that look like Latin ones, pair by pair.
LOOKALIKES = (
    "\u0410A \u0412B \u0415E \u041aK \u041cM \u041dH \u041eO \u0420P \u0421C \u0422T \u0423Y \u0425X \u0406I \u0408J \u0405S \u04c0I "
    "\u0430a \u0435e \u043eo \u0440p \u0441c \u0443y \u0445x \u0456i \u0458j \u0455s \u04bbh \u0501d \u051bq \u051dw \u04cfl \u043ak "
    "\u0391A \u0392B \u0395E \u0396Z \u0397H \u0399I \u039aK \u039cM \u039dN \u039fO \u03a1P \u03a4T \u03a5Y \u03a7X "
    "\u03b1a \u03b9i \u03bak \u03bdv \u03bfo \u03c1p \u03c5u \u03c7x \u0131i \u0261g"
)
#: Look-alikes to their Latin letters; accents (combining marks) vanish.
_FOLD = {ord(pair[0]): pair[1] for pair in LOOKALIKES.split()} | dict.fromkeys(range(0x300, 0x370))
_WORD = re.compile(r"[^\W_]+")
_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff]")
_QUOTE = re.compile("(?<=\\w)['\u2018\u2019\u02bc\u02b9\u2032\u00b4`\uff07](?=\\w)")
_TAG = re.compile(r"<[A-Za-z/!?][^<>]{0,400}>")
_LINK = re.compile(r"\]\([^()\s]{0,400}\)")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\[nrt]")
_PREFIX = r"[^\S\n]*(?:(?:[>#|*+/;:%$!\-\u2022]+|\[?\d{1,2}:\d\d(?::\d\d)?\]?|\d{4}-\d\d-\d\d|\d{1,4}[.:)|])(?=[^\S\n]|$)[^\S\n]*)*"
_CUT_WORD = re.compile(r"(?<=[^\W\d_])[-\u2010\u2011\u00ad][^\S\n]*\n" + _PREFIX + r"(?=[^\W\d_])")
_LINE_START = re.compile(r"\n" + _PREFIX)


def text_words(text: str | None) -> list[str]:
    """The words of a text as they are compared."""
    if not text:
        return []
    s = text
    if "\r" in s:
        s = s.replace("\r\n", "\n").replace("\r", "\n")
    if "\\" in s:
        s = _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else "\n", s)
    if "&" in s:
        s = html.unescape(s)
    if not s.isascii():
        s = unicodedata.normalize("NFKD", _INVISIBLE.sub("", s)).translate(_FOLD)
    if "<" in s:
        s = _TAG.sub(" ", s)
    if "](" in s:
        s = _LINK.sub("] ", s)
    if "\n" in s:
        if "-" in s or "\u2010" in s:
            s = _CUT_WORD.sub("", s)
        s = _LINE_START.sub("\n", s)
    return _WORD.findall(_QUOTE.sub("", s).casefold())


class Shape:
    """What follows from the passage's length and rate of changes."""

    def __init__(self, words: int, one_in: int):
        self.words, self.one_in = words, one_in
        #: Changes of a smallest passage, and how far it can reach from a hit in it.
        self.changes = (2 * words - 1) // one_in
        self.reach = 2 * words + self.changes + 5
        run = self.shortest_run()
        if run < 3:
            raise ValueError("so many changes leave no run of three words")
        self.mask = "1" * (run // 2) + "0" + "1" * (run - run // 2 - 1)
        #: Hits that a smallest passage has at least: its runs' words but for span - 1 of each run.
        self.hits = max(1, min(n - c - (c + 1) * (run - 1) for n, c in self.smallest()))
        #: Zeros between texts: more than a seed or the changes can cross.
        self.gap = len(self.mask) + self.changes + 1

    def shortest_run(self) -> int:
        """The longest run of unchanged words that every smallest passage has."""
        return min(-(-(n - c) // (c + 1)) for n, c in self.smallest())

    def smallest(self) -> list[tuple[int, int]]:
        """Words and most changes of the smallest passages."""
        return [(n, n // self.one_in) for n in range(self.words, 2 * self.words)]


class _Words(dict):
    """Words to 64-bit numbers that don't depend on the process, never 0 or -1."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word) - (1 << 63)
        self[word] = h = h if h not in (0, -1) else 1
        return h


_known = _Words()


def word_numbers(text: str | None) -> np.ndarray:
    ws = text_words(text)
    if len(_known) > CACHE_WORDS:
        _known.clear()
    return np.fromiter(map(_known.__getitem__, ws), np.int64, len(ws))


def seed_hashes(words: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of every seed of ``mask`` in which no word is a gap (0 or -1)."""
    offsets = [i for i, c in enumerate(mask) if c == "1"]
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    w = words.view(np.uint64)
    is_word = (words != 0) & (words != -1)
    ok, h = np.ones(n, bool), np.zeros(n, np.uint64)
    for o in offsets:
        ok &= is_word[o : o + n]
        h ^= w[o : o + n]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    at = np.flatnonzero(ok)
    return h[at].view(np.int64), at


def pieces_of(low: int, high: int, reach: int) -> list[tuple[int, int]]:
    """[low, high) in pieces of at most PIECE words, each beginning ``reach`` words before the end of the one before."""
    out = []
    while True:
        out.append((low, min(low + PIECE, high)))
        if low + PIECE >= high:
            return out
        low += PIECE - reach


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64()))


def passages(items: DataFrame, item_id: str, text: str, shape: Shape) -> DataFrame:
    """pid, item_id, item_words: what is left of the items without the words that several share, in pieces."""
    t = items.filter(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(F.col(item_id).cast("bigint").alias("item_id"), F.col(text).alias("text"))
    t = t.withColumn("tkey", F.xxhash64("text"))

    def runs(batches):
        for b in batches:
            ids, keys, pos, gram = [], [], [], []
            for i, t, k in zip(*(c.to_pylist() for c in b.columns), strict=True):
                w = word_numbers(t)
                g, _ = seed_hashes(w, "1" * SHARED)
                ids.append(np.full(len(g), i, np.int64))
                keys.append(np.full(len(g), k, np.int64))
                pos.append(np.arange(len(g), dtype=np.int32))
                gram.append(g)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, keys, pos, gram)], names=["item_id", "tkey", "pos", "gram"])

    all_runs = t.mapInArrow(runs, "item_id bigint, tkey bigint, pos int, gram bigint")
    shared = all_runs.groupBy("gram").agg(F.min("item_id").alias("a"), F.max("item_id").alias("b")).filter("a < b").select("gram")
    # A list holds places of one text: no more than it has words.
    taken = all_runs.join(shared, "gram", "left_semi").groupBy("item_id", "tkey").agg(F.collect_set("pos").alias("taken"))

    def free(batches):
        for b in batches:
            ids, out = [], []
            for i, t, taken in zip(*(c.to_pylist() for c in b.columns), strict=True):
                w = word_numbers(t)
                own = np.ones(len(w), bool)
                for p in taken or ():
                    own[p : p + SHARED] = False
                edges = np.flatnonzero(np.diff(np.concatenate(([0], own.astype(np.int8), [0])))).tolist()
                for low, high in zip(edges[::2], edges[1::2], strict=True):
                    if high - low >= shape.words:
                        for x, y in pieces_of(low, high, shape.reach):
                            ids.append(i)
                            out.append(w[x:y])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), _lists(out)], names=["item_id", "item_words"])

    own = t.join(taken, ["item_id", "tkey"], "left").select("item_id", "text", "taken").mapInArrow(free, "item_id bigint, item_words array<bigint>")
    # Read from the checkpoint, a row keeps its number.
    return materialize(own.distinct()).withColumn("pid", F.monotonically_increasing_id())


def seeds_of(own: DataFrame, shape: Shape) -> DataFrame:
    """hash, pid of every seed."""

    def emit(batches):
        for b in batches:
            pid, words = b.column(0).to_numpy(), b.column(1)
            for i in range(b.num_rows):
                h = np.unique(seed_hashes(words[i].values.to_numpy(), shape.mask)[0])
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), pid[i], np.int64))], names=["hash", "pid"])

    return own.select("pid", "item_words").mapInArrow(emit, "hash bigint, pid bigint")


def bloom(seeds: DataFrame, bits: int) -> np.ndarray:
    """A filter of ``bits`` bits, two for each seed, built in Spark; ``bits`` bounds what comes here."""
    shift = 64 - (bits.bit_length() - 1)
    both = F.array(F.shiftrightunsigned("hash", shift), F.shiftrightunsigned("hash", 10).bitwiseAND(F.lit(bits - 1)))
    b = seeds.select(F.explode(both).alias("bit")).groupBy(F.shiftright("bit", 15).alias("at")).agg(F.bitmap_construct_agg(F.col("bit") % 32_768).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for r in b.collect():
        out[r["at"] * 4096 : (r["at"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def _passes(flags: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The places of the hashes that the filter knows."""
    bits = len(flags) * 8
    u = h.view(np.uint64)
    x = u >> np.uint64(64 - (bits.bit_length() - 1))
    at = np.flatnonzero((flags[x >> np.uint64(3)] >> (x & np.uint64(7)).astype(np.uint8)) & 1)
    y = (u[at] >> np.uint64(10)) & np.uint64(bits - 1)
    return at[((flags[y >> np.uint64(3)] >> (y & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)]


def stretches(texts: list[str | None], flags: np.ndarray, shape: Shape) -> tuple[list[int], list[np.ndarray], list[np.ndarray]]:
    """(numbers of the texts, words, hashes): the words around all seeds that the filter knows, in pieces."""
    gap, flat, starts, at = np.zeros(shape.gap, np.int64), [], [], 0
    for t in texts:
        w = word_numbers(t)
        starts.append(at)
        flat += (w, gap)
        at += len(w) + shape.gap
    words = np.concatenate(flat) if flat else np.zeros(0, np.int64)
    h, place = seed_hashes(words, shape.mask)
    hit = _passes(flags, h)
    h, place = h[hit], place[hit]
    docs, own, hashes = [], [], []
    if not len(place):
        return docs, own, hashes
    starts = np.array(starts)
    doc = np.searchsorted(starts, place, "right") - 1
    ends = np.append(starts[1:], at)[doc] - shape.gap
    low, high = np.maximum(starts[doc], place - shape.reach), np.minimum(ends, place + len(shape.mask) + shape.reach)
    first = np.flatnonzero(np.concatenate(([True], low[1:] > high[:-1])))
    last = np.append(first[1:], len(low)) - 1
    for f, a, b in zip(first.tolist(), low[first].tolist(), high[last].tolist(), strict=True):
        for x, y in pieces_of(a, b, shape.reach):
            i, j = np.searchsorted(place, (x, y - len(shape.mask) + 1))
            if i < j:
                docs.append(int(doc[f]))
                own.append(words[x:y])
                hashes.append(h[i:j])
    return docs, own, hashes


def _reach(items: np.ndarray, docs: np.ndarray, p: np.ndarray, a: np.ndarray, room: np.ndarray, step: int, e: int, reach: int) -> np.ndarray:
    """[changes, hit]: item words passed from (p, a) on in direction ``step``, at most ``room``, with so many changes (up to e)."""
    j = np.arange(reach)
    item = items[p[:, None] + step * j]
    runs = []
    for d in range(-e, e + 1):
        same = item == docs[np.clip(a[:, None] + step * (j + d), 0, len(docs) - 1)]
        run = np.zeros((len(p), reach + 1), np.int8)
        for i in range(reach - 1, -1, -1):
            run[:, i] = np.where(same[:, i], run[:, i + 1] + 1, 0)
        runs.append(run)
    room = np.minimum(room, reach).astype(np.int32)
    rows = np.arange(len(p))
    far = np.full((2 * e + 1, len(p)), -1, np.int32)
    far[e] = np.minimum(runs[e][:, 0], room)
    out = [far[e].copy()]
    for _ in range(e):
        new = np.where(far >= 0, far + 1, -1)
        new[1:] = np.maximum(new[1:], far[:-1])
        new[:-1] = np.maximum(new[:-1], np.where(far[1:] >= 0, far[1:] + 1, -1))
        new = np.minimum(new, room)
        for d in range(2 * e + 1):
            ok = new[d] >= 0
            new[d, ok] = np.minimum(new[d, ok] + runs[d][rows[ok], new[d, ok]], room[ok])
        far = new
        out.append(far.max(0))
    return np.stack(out)


def verify(pairs: list[tuple[np.ndarray, np.ndarray]], shape: Shape) -> np.ndarray:
    """Which of the pairs (words of a document, words of an item) hold a passage that counts."""
    e, reach = shape.changes, shape.reach
    pad = reach + shape.gap
    doc_at, item_at, docs, items = [], [], [np.zeros(pad, np.int64)], [np.full(pad, -1, np.int64)]
    d = i = pad
    for doc, item in pairs:
        doc_at.append(d)
        item_at.append(i)
        docs += (doc, np.zeros(shape.gap, np.int64))
        items += (item, np.full(shape.gap, -1, np.int64))
        d, i = d + len(doc) + shape.gap, i + len(item) + shape.gap
    docs = np.concatenate([*docs, np.zeros(pad, np.int64)])
    items = np.concatenate([*items, np.full(pad, -1, np.int64)])
    doc_at, item_at = np.array(doc_at), np.array(item_at)
    item_end = item_at + [len(x) for _, x in pairs]
    dh, da = seed_hashes(docs, shape.mask)
    ih, ip = seed_hashes(items, shape.mask)
    # A seed meets the seeds of its own pair alone.
    mix = np.uint64(0xD6E8FEB86659FD93)
    row_of = lambda at, starts: (np.searchsorted(starts, at, "right") - 1).astype(np.uint64)
    dk = dh.view(np.uint64) ^ (row_of(da, doc_at) * mix)
    ik = ih.view(np.uint64) ^ (row_of(ip, item_at) * mix)
    by = np.argsort(ik, kind="stable")
    ik, ip = ik[by], ip[by]
    lo, hi = np.searchsorted(ik, dk, "left"), np.searchsorted(ik, dk, "right")
    n = hi - lo
    p = ip[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    a = np.repeat(da, n)
    out = np.zeros(len(pairs), bool)
    if not len(p):
        return out
    by = np.lexsort((a, a - p))
    p, a = p[by], a[by]
    keep = np.concatenate(([True], (np.diff(a) != 1) | (np.diff(p) != 1)))
    p, a = p[keep], a[keep]
    row = np.searchsorted(item_at, p, "right") - 1
    for b in range(0, len(p), 20_000):
        pp, aa, rr = p[b : b + 20_000], a[b : b + 20_000], row[b : b + 20_000]
        right = _reach(items, docs, pp, aa, item_end[rr] - pp, 1, e, reach)
        left = _reach(items, docs, pp - 1, aa - 1, pp - item_at[rr], -1, e, reach)
        good = np.zeros(len(pp), bool)
        for changes in range(e + 1):
            most = np.max([left[x] + right[changes - x] for x in range(changes + 1)], axis=0)
            good |= most >= max(shape.words, shape.one_in * changes)
        out[rr[good]] = True
    return out


def find_leaks(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", words: int = WORDS, one_in: int = ONE_IN) -> DataFrame:
    """(doc_id, item_id): the documents that hold a passage of an item."""
    shape = Shape(words, one_in)
    own = passages(items, item_id, text, shape)
    seeds = seeds_of(own, shape)
    n = own.agg(F.sum(F.size("item_words"))).first()[0] or 0
    bits = min(MOST_BITS, max(1 << 20, 1 << (64 * n).bit_length()))
    flags = docs.sparkSession.sparkContext.broadcast(bloom(seeds, bits))
    kind = docs.schema[doc_id].dataType.simpleString()

    def look(batches):
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            at = 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars + len(texts[end] or "") <= CHUNK_CHARS):
                    chars += len(texts[end] or "")
                    end += 1
                doc, found, hashes = stretches(texts[at:end], flags.value, shape)
                if doc:
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.array(doc) + at)), _lists(found), _lists(hashes)], names=["doc_id", "words", "hashes"])
                at = end

    corpus = over_cores(docs.select(F.col(doc_id), F.col(text)))
    near = materialize(corpus.mapInArrow(look, f"doc_id {kind}, words array<bigint>, hashes array<bigint>")).withColumn("seg", F.monotonically_increasing_id())
    # Each place counts, also where words repeat: a passage has so many places, not so many different seeds.
    pairs = near.select("seg", F.explode("hashes").alias("hash")).join(seeds, "hash").groupBy("seg", "pid").count().filter(F.col("count") >= shape.hits).select("seg", "pid")
    both = pairs.join(near.select("seg", "doc_id", "words"), "seg").join(own, "pid").select("doc_id", "item_id", "words", "item_words")

    def check(batches):
        for b in batches:
            left, right = b.column("words"), b.column("item_words")
            good, at = np.zeros(b.num_rows, bool), 0
            while at < b.num_rows:
                end, cells, pairs = at, 0, []
                while end < b.num_rows and (end == at or cells < CELLS):
                    pairs.append((left[end].values.to_numpy(), right[end].values.to_numpy()))
                    cells += len(pairs[-1][0]) * len(pairs[-1][1])
                    end += 1
                good[at:end] = verify(pairs, shape)
                at = end
            yield b.select(["doc_id", "item_id"]).filter(pa.array(good))

    found = both.mapInArrow(check, f"doc_id {kind}, item_id bigint").distinct()
    return found.select(F.col("doc_id").alias(doc_id), F.col("item_id").alias(item_id))
