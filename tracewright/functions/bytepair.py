"""Token counts of byte-pair encodings: the words of a text by a pattern, and in each word merges by a table of ranks.

The table is a public vocabulary's file, at a path that every worker can read; a worker reads it once and keeps the counts of the words that it
met, up to a bound, so that merges run once for a word and not for each place where it stands. A null text has no tokens.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections import Counter

import regex
from pyspark.sql import Column

from tracewright.functions import models

#: Fixed value: the words of byte-level vocabularies, as their public encoders cut them.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Merges:
    """Words to tokens by a table of ranks: of all neighbours whose joint bytes are in the table, those of the lowest rank merge first, the
    leftmost of equal ones. The table must hold every single byte."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = WORDS, known: int = 1 << 17):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the table lacks the bytes {missing}")
        self.ranks, self.words, self.most = ranks, regex.compile(pattern), known
        self.counts, self.older = {}, {}  # of the words met last, and of those before them: frequent words stay

    def pieces(self, word: bytes) -> list[bytes]:
        """The tokens of one word, in time n log n of its length."""
        if word in self.ranks:
            return [word]
        n = len(word)
        stop, before = [*range(1, n + 1)], [*range(-1, n - 1)]  # by a piece's first byte: its end, or 0 once it is merged, and the piece before it
        queue = [(r, i, i + 2) for i in range(n - 1) if (r := self.ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(queue)

        def offer(a: int, end: int) -> None:
            if (r := self.ranks.get(word[a:end])) is not None:
                heapq.heappush(queue, (r, a, end))

        while queue:
            _, a, end = heapq.heappop(queue)
            b = stop[a]
            if not b or b >= n or stop[b] != end:  # one of the two has merged with another neighbour
                continue
            stop[a], stop[b] = end, 0
            if end < n:
                before[end] = a
                offer(a, stop[end])
            if before[a] >= 0:
                offer(before[a], end)
        return [word[i:e] for i, e in enumerate(stop) if e]

    def ids(self, text: str) -> list[int]:
        return [self.ranks[p] for w in self.words.findall(text) for p in self.pieces(w.encode())]

    def count(self, text: str | None) -> int:
        n = 0
        for word, times in Counter(self.words.findall(text or "")).items():
            tokens = self.counts.get(word)
            if tokens is None:
                tokens = self.older.get(word) or len(self.pieces(word.encode()))
                if len(word) <= 64:
                    if len(self.counts) >= self.most:
                        self.counts, self.older = {}, self.counts
                    self.counts[word] = tokens
            n += tokens * times
        return n


@functools.lru_cache(maxsize=4)
def merges(path: str, pattern: str = WORDS) -> Merges:
    """The table in a file of lines with a token in base64 and its rank; read once a worker."""
    with open(path, "rb") as f:
        return Merges({base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}, pattern)


def token_count(c: Column, path: str, pattern: str = WORDS) -> Column:
    """Number of tokens of a text by the vocabulary at path."""
    return models.token_counts(c, lambda: merges(path, pattern).count)


def token_ids(c: Column, path: str, pattern: str = WORDS, most: int = 1 << 30) -> Column:
    """The first `most` token ids of a text by the vocabulary at path."""
    return models.encode_ids(c, lambda: merges(path, pattern).ids, most)
