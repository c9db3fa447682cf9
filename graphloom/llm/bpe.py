"""Byte-pair encoding with a public vocabulary.

Method: a priority queue of merge ranks over a doubly linked list of symbols. The pair with the least rank (the
leftmost of equals) is merged, its neighbours' new pairs are queued, and entries whose symbols have changed since are
skipped as stale. n symbols take O(n log n), also where a text is one word of many thousand letters. Decoding
concatenates the vocabulary's strings.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import regex

DEFAULT_VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: White space as Unicode's White_Space has it; spelled out, for classes of regex engines differ.
SPACE = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: Fixed value, the public vocabulary's pattern: how a text is cut into words before merging; the parts cover every character.
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Words kept in a worker's memory; beyond, the memory starts anew.
CACHE_WORDS = 400_000
#: Characters that are handled at once; a longer text is handled alone.
CHUNK_CHARS = 1_000_000


def read_vocab(path: str = DEFAULT_VOCAB) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class _Cache(dict):
    """Words to numbers; a new word is merged when it is first asked for."""

    def __init__(self, bpe: Bpe):
        # Typed arrays: numpy copies them as they lie, without a look at each number.
        self.bpe, self.ids, self.sizes = bpe, array("i"), array("q")

    def __missing__(self, word: str) -> int:
        ids = self.bpe.merge(word.encode())
        n = self[word] = len(self.sizes)
        self.ids.extend(ids)
        self.sizes.append(len(ids))
        return n


class Bpe:
    """A vocabulary of ranks (a token's id is its rank), from the lines ``base64 rank``."""

    def __init__(self, vocab: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocab.splitlines() if line)}
        self.strings = {i: s for s, i in self.ranks.items()}
        self.cache = _Cache(self)

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word."""
        ranks = self.ranks
        if word in ranks:
            return [ranks[word]]
        n = len(word)
        sym: list[bytes | None] = [word[i : i + 1] for i in range(n)]
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, size = heapq.heappop(queue)
            j = right[i] if sym[i] is not None else -1
            if j < 0 or len(sym[i]) + len(sym[j]) != size:
                continue  # stale: one of the pair was merged meanwhile
            sym[i] += sym[j]
            sym[j] = None
            k = right[i] = right[j]
            if k >= 0:
                left[k] = i
                if (r := ranks.get(sym[i] + sym[k])) is not None:
                    heapq.heappush(queue, (r, i, len(sym[i]) + len(sym[k])))
            h = left[i]
            if h >= 0 and (r := ranks.get(sym[h] + sym[i])) is not None:
                heapq.heappush(queue, (r, h, len(sym[h]) + len(sym[i])))
        return [ranks[s] for s in sym if s is not None]

    def size(self, word: str) -> int:
        """The number of ids of one word."""
        n = self.cache.get(word)
        return len(self.merge(word.encode())) if n is None else self.cache.sizes[n]

    def decode(self, ids) -> str:
        return b"".join(self.strings[i] for i in ids).decode("utf-8", errors="replace")

    def chunks(self, texts: list[str | None]) -> Iterator[Chunk]:
        """The texts, in order, in chunks of about CHUNK_CHARS characters."""
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end] or "") <= CHUNK_CHARS):
                chars += len(texts[end] or "")
                end += 1
            yield self._chunk(texts[at:end])
            at = end

    def _chunk(self, texts: list[str | None]) -> Chunk:
        if len(self.cache) > CACHE_WORDS:
            self.cache = _Cache(self)
        words: list[str] = []
        offsets = np.zeros(len(texts) + 1, np.int64)
        for i, t in enumerate(texts):
            if t:
                words += WORDS.findall(t)
            offsets[i + 1] = len(words)
        numbers = np.fromiter(map(self.cache.__getitem__, words), np.int64, len(words))
        return Chunk(words, offsets, numbers, np.array(self.cache.sizes, np.int64), self.cache)


class Chunk:
    """Texts cut into words: the words of text i are words[offsets[i] : offsets[i + 1]]."""

    def __init__(self, words: list[str], offsets: np.ndarray, numbers: np.ndarray, sizes: np.ndarray, cache: _Cache):
        self.words, self.offsets, self.numbers, self.sizes, self.cache = words, offsets, numbers, sizes, cache
        #: The number of tokens of each word.
        self.counts = sizes[numbers] if len(numbers) else np.zeros(0, np.int64)

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): the token ids of text i are ids[offsets[i] : offsets[i + 1]]."""
        pool = np.array(self.cache.ids, np.int32)
        starts = np.concatenate(([0], np.cumsum(self.sizes)))
        ends = np.concatenate(([0], np.cumsum(self.counts)))
        at = np.repeat(starts[self.numbers] - ends[:-1], self.counts) + np.arange(ends[-1])
        return ends[self.offsets], pool[at]


_held: tuple[bytes, Bpe] | None = None


def held(vocab) -> Bpe:
    """The worker's tokenizer for a broadcast vocabulary, built once per worker."""
    global _held
    if _held is None or _held[0] != vocab.value:
        _held = (vocab.value, Bpe(vocab.value))
    return _held[1]
