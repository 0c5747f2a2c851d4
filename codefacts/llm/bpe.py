"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The queue of a pre-token has a bucket per merge rank, a list of the positions whose pair has that
rank, and a two-level bitmap over the ranks: find-first-set on each level gives the next rank.
Positions live in a linked list; a merge unlinks one, and entries whose pair has changed since are
skipped when they come up. So a pre-token of n bytes takes O(n log n), also when it is very long.

Text is first split by the tokenizer's pattern. Results of short pre-tokens are kept in a bounded
two-generation memo per Python worker.

Defined cases: a null or empty text has no ids; the text of special tokens is ordinary text; lone
surrogates can't occur in a Parquet string; rows are independent, so repeated rows, ties and other
columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import tidied

#: Entries of one generation of the memo, and the longest pre-token that it takes, in characters.
MEMO, MEMO_CHARS = 250_000, 32
#: Single bits, of a leaf of 256 or of the top, which has one for each leaf: enough for 2^20 ranks.
_BITS = [1 << i for i in range(1 << 12)]


class RankQueue:
    """What the queue is made of; a drained queue is as good as new, so an encoder keeps one.

    Bit l of ``top`` (a local of the merge loop) is set if leaf l has a bit, and bit r of a leaf if
    the bucket of rank ``l * 256 + r`` has positions.
    """

    __slots__ = ("buckets", "leaves")

    def __init__(self, ranks: int) -> None:
        self.leaves = [0] * ((ranks >> 8) + 1)
        self.buckets: list[list[int]] = [[] for _ in range(ranks)]


class BytePairs:
    """An encoder for one rank file (lines of base64 bytes and rank) and its pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pieces = {r: b for b, r in self.ranks.items()}
        self.bytes = [self.ranks.get(bytes([b])) for b in range(256)]
        self.queue = RankQueue(max(self.pieces) + 1)
        #: Whether an id takes two bytes; the memo keeps ids packed.
        self.narrow = max(self.pieces) < 1 << 16
        self.names = {r: str(r) for r in self.pieces}
        self.find = regex.compile(pattern).findall
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merge(self, word: bytes) -> tuple[int, ...]:
        """The ids of one pre-token: always the pair of least rank, the leftmost first."""
        ranks = self.ranks
        if (whole := ranks.get(word)) is not None:
            return (whole,)
        n = len(word)
        # Token i covers word[i:nxt[i]]; pair[i] is the rank of it and the next one, or -1; own[i] is its id.
        nxt, prv, own = [*range(1, n + 1)], [*range(-1, n - 1)], [*map(self.bytes.__getitem__, word)]
        get, bits, buckets, leaves, top = ranks.get, _BITS, self.queue.buckets, self.queue.leaves, 0
        pair = [get(word[i : i + 2], -1) for i in range(n - 1)]
        pair.append(-1)  # the last one's, and what position -1 reads
        fresh = range(n - 1)
        while True:
            for i in fresh:  # push
                r = pair[i]
                if r < 0:
                    continue
                bucket = buckets[r]
                if bucket:
                    heappush(bucket, i)
                else:
                    bucket.append(i)
                    leaf = r >> 8
                    leaves[leaf] |= bits[r & 255]
                    top |= bits[leaf]
            if not top:
                break
            # Find-first-set on each level, then the leftmost position of that rank.
            leaf = (top & -top).bit_length() - 1
            left = leaves[leaf]
            low = left & -left
            r = leaf << 8 | low.bit_length() - 1
            bucket = buckets[r]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket.pop()
                leaves[leaf] = left = left ^ low
                if not left:
                    top ^= bits[leaf]
            if pair[i] != r:
                fresh = ()  # stale
                continue
            j = nxt[i]
            nxt[i] = end = nxt[j]
            own[i], own[j], pair[j] = r, -1, -1
            if end < n:
                prv[end] = i
                pair[i] = get(word[i : nxt[end]], -1)
            else:
                pair[i] = -1
            h = prv[i]
            if h >= 0:
                pair[h] = get(word[h:end], -1)
            fresh = (h, i)
        return tuple([x for x in own if x >= 0])

    def _missing(self, piece: str) -> bytes:
        found = self.old.get(piece)
        if found is None:
            found = array("H" if self.narrow else "I", self.merge(piece.encode())).tobytes()
        if len(piece) <= MEMO_CHARS:
            if len(self.young) >= MEMO:
                self.old, self.young = self.young, {}
            self.young[piece] = found
        return found

    def encode(self, text: str | None) -> list[int]:
        get, missing = self.young.get, self._missing
        parts = []
        for piece in self.find(text or ""):
            if (found := get(piece)) is None:
                found, get = missing(piece), self.young.get
            parts.append(found)
        ids = array("H" if self.narrow else "I")
        ids.frombytes(b"".join(parts))
        return ids.tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> BytePairs:
    return BytePairs(path, pattern)


def encode(text: Column | str, path: str, pattern: str) -> Column:
    """The ids of a text, ``array<int>``. The rank file lies at ``path`` on every executor."""

    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = _encoder(path, pattern)
        for part in texts:
            yield pd.Series([own.encode(t) for t in part], dtype=object)

    return F.pandas_udf(tidied(ids), "array<int>")(text)


def decode(ids: Column | str, path: str, pattern: str) -> Column:
    """The bytes that ids stand for."""

    def data(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = _encoder(path, pattern)
        for part in parts:
            yield pd.Series([b"" if x is None else own.decode(x) for x in part], dtype=object)

    return F.pandas_udf(tidied(data), "binary")(ids)


def digests(text: Column | str, path: str, pattern: str) -> Column:
    """(n_tokens, ids_sha256, decoded_sha256) of a text: encoded, then decoded from its ids,
    without moving either back to the JVM."""

    def both(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = _encoder(path, pattern)
        for part in texts:
            rows = []
            for t in part:
                ids = own.encode(t)
                said = ",".join(map(own.names.__getitem__, ids)).encode()
                rows.append((len(ids), hashlib.sha256(said).hexdigest(), hashlib.sha256(own.decode(ids)).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return F.pandas_udf(tidied(both), "n_tokens long, ids_sha256 string, decoded_sha256 string")(text)
