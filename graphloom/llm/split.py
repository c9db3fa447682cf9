"""Splitting oversized texts at natural boundaries.

Method: agglomerative merging. A text over the limit is cut into atomic segments at headings, paragraphs, lines and
sentences (a segment that is too large itself into words, a word that is too large into runs of characters); adjacent
segments are held as pairs in a heap and the pair with the weakest boundary (of equals the smallest, then the first) is
merged while the combined size and the overlap fit. Each piece after the first begins with the last words of the one
before, up to the overlap.

Sizes are tokens of a public tokenizer. Cuts lie between the tokenizer's words, where the tokens of a piece are exactly
the sum of its words' tokens; only a piece that cuts a word is encoded again to be sure.

Defined results: null and empty texts are one piece of 0 tokens; a text at the limit or under it is one piece, as it
stands; the pieces without their overlaps, concatenated, are the text; further columns pass through.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from graphloom.llm import bpe
from graphloom.llm.tokenize import share
from graphloom.util import over_cores

LIMIT, OVERLAP = 1000, 100
#: Boundaries from the strongest; a pattern's end is where the cut is (for headings: its start).
HEADING = re.compile(r"^#{1,6}[ \t]|^(?=[^\n]{1,200}\n(?:={3,}|-{3,})\s*$)", re.M)
PARAGRAPH = re.compile(r"(?:\r\n?|\n)[ \t]*(?:\r\n?|\n)\s*")
LINE = re.compile(r"\r\n?|[\n\x0b\x0c\x85\u2028\u2029]")
SENTENCE = re.compile(r"[.!?…][\"')\]’”»]*(?=\s)|[。！？।]")
PIECES = ArrayType(StructType([StructField(c, IntegerType()) for c in ("own_start", "start", "end", "tokens")]))


def boundaries(text: str, starts: np.ndarray) -> dict[int, int]:
    """The strength (5 heading .. 2 sentence) of the cut before a word, by word number."""
    out: dict[int, int] = {}
    for strength, pattern in ((2, SENTENCE), (3, LINE), (4, PARAGRAPH), (5, HEADING)):
        at = [m.start() if strength == 5 else m.end() for m in pattern.finditer(text)]
        for w in np.searchsorted(starts, at).tolist():
            if 0 < w < len(starts):
                out[w] = strength
    return out


def merge(sizes: list[int], strengths: list[int], room: int) -> list[int]:
    """The numbers of the segments that begin a piece. strengths[i]: of the boundary before segment i."""
    n, size = len(sizes), list(sizes)
    left, right, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
    # An entry is one number: strength, combined size, place. Numbers compare faster than tuples.
    heap = [(strengths[i + 1] << 64) + ((size[i] + size[i + 1]) << 32) + i for i in range(n - 1) if size[i] + size[i + 1] <= room]
    heapq.heapify(heap)
    pop, push, low = heapq.heappop, heapq.heappush, (1 << 32) - 1
    while heap:
        entry = pop(heap)
        i, both = entry & low, entry >> 32 & low
        j = right[i]
        if not alive[i] or j < 0 or size[i] + size[j] != both:
            continue  # stale
        size[i], alive[j] = both, False
        k = right[i] = right[j]
        if k >= 0:
            left[k] = i
            if both + size[k] <= room:
                push(heap, (strengths[k] << 64) + ((both + size[k]) << 32) + i)
        h = left[i]
        if h >= 0 and size[h] + both <= room:
            push(heap, (strengths[i] << 64) + ((size[h] + both) << 32) + h)
    return [i for i in range(n) if alive[i]]


def _parts(word: str, encoder: bpe.Bpe, most: int) -> list[tuple[str, int]]:
    """A word with more than ``most`` tokens as runs of characters with their tokens."""
    n = encoder.size(word)
    half = len(word) // 2
    if n <= most or not half:
        return [(word, n)]
    return _parts(word[:half], encoder, most) + _parts(word[half:], encoder, most)


def pieces(all_words: list[str], counts: np.ndarray, encoder: bpe.Bpe, limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """(own_start, start, end, tokens) in characters of each piece of one text, given its words and their tokens."""
    room = limit - overlap
    total = int(counts.sum())
    if total <= limit:
        n = sum(map(len, all_words))
        return [(0, 0, n, total)]
    cut_words: set[int] = set()
    if counts.max() > room:
        new, sizes = [], []
        for w, c in zip(all_words, counts.tolist(), strict=True):
            parts = [(w, c)] if c <= room else _parts(w, encoder, max(1, min(room // 8, overlap // 2 or room)))
            cut_words.update(range(len(new) + 1, len(new) + len(parts)))
            new += [p for p, _ in parts]
            sizes += [c for _, c in parts]
        all_words, counts = new, np.array(sizes)
    lens = np.fromiter(map(len, all_words), np.int64, len(all_words))
    starts = np.concatenate(([0], np.cumsum(lens)[:-1]))
    text = "".join(all_words)
    cuts = {w: s for w, s in boundaries(text, starts).items() if w not in cut_words}
    ends = np.cumsum(counts)
    size = lambda a, b: int(ends[b - 1] - (ends[a - 1] if a else 0))
    first, strengths = [], []
    edges = [0, *sorted(cuts), len(all_words)]
    for a, b in zip(edges, edges[1:], strict=False):
        if size(a, b) <= room:
            first.append(a)
            strengths.append(cuts.get(a, 5))
        else:
            first += range(a, b)
            strengths += [cuts.get(w, 0 if w in cut_words else 1) for w in range(a, b)]
    strengths[0] = 9
    bounds = [*first, len(all_words)]
    kept = merge([size(a, b) for a, b in zip(bounds, bounds[1:], strict=False)], strengths, room)
    begin = [first[i] for i in kept]
    out = []
    for n, a in enumerate(begin):
        b = begin[n + 1] if n + 1 < len(begin) else len(all_words)
        s = a
        if n:
            base = int(ends[a - 1])
            s = max(begin[n - 1], int(np.searchsorted(ends, base - overlap, side="left")) + 1) if base > overlap else begin[n - 1]
            s = min(s, a)
        # Parts of one word may join to other tokens: encode what stands there, give up overlap until it fits.
        exact = (lambda: _count(all_words[s:b], cut_words, s, encoder)) if cut_words else (lambda: size(s, b) + _tail(all_words, s, b, encoder))
        while (tokens := exact()) > limit and s < a:
            s += max(1, (a - s) // 2)
        end = int(starts[b]) if b < len(all_words) else len(text)
        out.append((int(starts[a]), int(starts[s]), end, tokens))
    return out


def _count(ws: list[str], cut_words: set[int], at: int, encoder: bpe.Bpe) -> int:
    joined: list[str] = []
    for i, w in enumerate(ws):
        if i and at + i in cut_words:
            joined[-1] += w
        else:
            joined.append(w)
    if len(joined) > 1 and joined[-1].isspace() and joined[-2].isspace():
        joined[-2:] = [joined[-2] + joined[-1]]
    return sum(map(encoder.size, joined))


def _tail(ws: list[str], s: int, b: int, encoder: bpe.Bpe) -> int:
    """What the tokens of ws[s:b] change by when white space stands at the end: two words of it are then one."""
    if b < len(ws) and b - s > 1 and ws[b - 1].isspace() and ws[b - 2].isspace():
        return encoder.size(ws[b - 2] + ws[b - 1]) - encoder.size(ws[b - 2]) - encoder.size(ws[b - 1])
    return 0


def cut(docs: DataFrame, text: str = "text", *, limit: int = LIMIT, overlap: int = OVERLAP, vocab: str = bpe.DEFAULT_VOCAB) -> DataFrame:
    """``docs`` with ``cuts``: the pieces of ``text`` as own_start, start, end, tokens (end -1 for whole texts)."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be under the limit")
    shared = share(docs.sparkSession, vocab)

    @F.arrow_udf(PIECES)
    def find(texts: pa.Array) -> pa.Array:
        encoder, out = bpe.held(shared), []
        for chunk in encoder.chunks(texts.to_pylist()):
            ends = np.concatenate(([0], np.cumsum(chunk.counts)))[chunk.offsets]
            for a, b, n in zip(chunk.offsets[:-1].tolist(), chunk.offsets[1:].tolist(), np.diff(ends).tolist(), strict=True):
                if n <= limit:
                    out.append([{"own_start": 0, "start": 0, "end": -1, "tokens": n}])
                else:
                    out.append([dict(zip(("own_start", "start", "end", "tokens"), p, strict=True)) for p in pieces(chunk.words[a:b], chunk.counts[a:b], encoder, limit, overlap)])
        return pa.array(out, pa.list_(pa.struct([(c, pa.int32()) for c in ("own_start", "start", "end", "tokens")])))

    docs = over_cores(docs)
    # Not deterministic only in name: the optimizer would run it again for a filter that it infers from explode.
    return docs.withColumn("cuts", find.asNondeterministic()(F.col(text)))


def split(docs: DataFrame, text: str = "text", *, limit: int = LIMIT, overlap: int = OVERLAP, vocab: str = bpe.DEFAULT_VOCAB) -> DataFrame:
    """One row per piece: the columns of ``docs`` but the text, piece_no, n_pieces, own_start, start, tokens and piece."""
    c = cut(docs, text, limit=limit, overlap=overlap, vocab=vocab)
    rest = [x for x in docs.columns if x != text]
    p = c.select(*rest, F.col(text).alias("_text"), F.size("cuts").alias("n_pieces"), F.posexplode("cuts").alias("piece_no", "_cut"))
    end = F.when(F.col("_cut.end") < 0, F.char_length(F.coalesce("_text", F.lit("")))).otherwise(F.col("_cut.end"))
    piece = F.substring(F.coalesce("_text", F.lit("")), F.col("_cut.start") + 1, end - F.col("_cut.start"))
    return p.select(*rest, "piece_no", "n_pieces", F.col("_cut.own_start").alias("own_start"), F.col("_cut.start").alias("start"), F.col("_cut.tokens").alias("tokens"), piece.alias("piece"))
