"""Byte-level BPE with a public rank file: minimal perfect hash for whole pre-tokens, a heap for the rest."""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterable

import numpy as np

from pinfold.llm.pretokens import class_table, slices, token_starts

#: Where the public vocabularies lie; a parameter of every operator that reads one.
TOKENIZERS = os.environ.get("PINFOLD_TOKENIZERS", "/opt/tokenizers")
WORDS = 4  # a key holds up to 32 bytes of a pre-token exactly; longer ones are looked up one by one
WIDTH = 8 * WORDS
#: Remembered segments of a worker; when full the memory is emptied, which changes no result.
REMEMBER = 400_000
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
_S32, _S29 = np.uint64(32), np.uint64(29)


def key_words(raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of pre-tokens of at most WIDTH bytes, as WORDS columns of 64 bits, zero after the end."""
    padded = np.concatenate([raw, np.zeros(WIDTH + 8, np.uint8)])
    view = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
    out = np.zeros((WORDS, len(begin)), np.uint64)
    left, rows = size, None
    for k in range(WORDS):
        if k:
            rows = np.flatnonzero(size > 8 * k)
            if not len(rows):
                break
            left = size[rows] - 8 * k
        b = begin if rows is None else begin[rows]
        w = view[b + 8 * k]
        cut = (np.uint64(64) - np.minimum(left, 8).astype(np.uint64) * np.uint64(8)) % np.uint64(64)
        w = (w << cut) >> cut
        if rows is None:
            out[0] = w
        else:
            out[k, rows] = w
    return out


def key_hash(words: np.ndarray, size: np.ndarray) -> np.ndarray:
    h = size.astype(np.uint64) * _C[4]
    h ^= words[0] * _C[0]
    h ^= h >> _S29
    more = np.flatnonzero(size > 8)
    if len(more):
        g = h[more]
        for k in range(1, WORDS):
            g = (g ^ (g >> _S32)) * _C[4] + words[k, more] * _C[k]
        h[more] = g
    h = (h ^ (h >> _S32)) * _C[0]
    h ^= h >> _S29
    return h


class Vocabulary:
    """A rank file as arrays: the pre-tokens' exact bytes at their slots of a minimal perfect hash.

    Hash and displace: keys fall into buckets, large buckets first look for a displacement that moves their keys to
    free slots, and the single keys left take the free slots by number. As many slots as keys, one probe a lookup.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.table = class_table()
        short = [t for t in ranks if len(t) <= WIDTH]
        raw = np.frombuffer(b"".join(short), np.uint8)
        size = np.array([len(t) for t in short], np.int64)
        begin = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
        words = key_words(raw, begin, size)
        h = key_hash(words, size)
        self.n, self.buckets = len(short), max(1, len(short) // 3)
        self.shift, slot = self._place(h)
        self.words = np.zeros((WORDS, self.n), np.uint64)
        self.size = np.zeros(self.n, np.int64)
        self.ids = np.zeros(self.n, np.int32)
        self.words[:, slot] = words
        self.size[slot] = size
        self.ids[slot] = [ranks[t] for t in short]

    def _bucket(self, h: np.ndarray) -> np.ndarray:
        return ((h >> _S32) % np.uint64(self.buckets)).astype(np.int64)

    def _slot(self, h: np.ndarray, d: np.ndarray | int) -> np.ndarray:
        x = (h + np.asarray(d).astype(np.uint64) * _C[2]) * _C[3]
        return (((x ^ (x >> _S29)) * _C[1] >> _S32) % np.uint64(self.n)).astype(np.int64)

    def _place(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(np.unique(h)) < len(h):
            raise ValueError("two keys share a hash")
        bucket = self._bucket(h)
        order = np.argsort(bucket, kind="stable")
        counts = np.bincount(bucket, minlength=self.buckets)
        ends = np.cumsum(counts)
        shift = np.zeros(self.buckets, np.int64)
        slot = np.full(len(h), -1, np.int64)
        taken = np.zeros(self.n, bool)
        tries = np.arange(64)
        for k in np.argsort(-counts, kind="stable"):
            own = order[ends[k] - counts[k] : ends[k]]
            if len(own) < 2:
                break
            d = 0
            while True:
                at = self._slot(h[own][None, :], (d + tries)[:, None])
                free = ~taken[at].any(1)
                for i in np.flatnonzero(free).tolist():
                    if len(set(at[i].tolist())) == len(own):
                        break
                else:
                    d += len(tries)
                    continue
                break
            shift[k], slot[own], taken[at[i]] = d + i, at[i], True
        left = iter(np.flatnonzero(~taken).tolist())
        for k in np.flatnonzero(counts == 1):
            own = order[ends[k] - 1]
            slot[own] = next(left)
            shift[k] = -slot[own] - 1  # the slot itself
        return shift, slot

    def find(self, words: np.ndarray, size: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The id of each key, -1 where the vocabulary hasn't got it."""
        d = self.shift[self._bucket(h)]
        at = np.where(d < 0, -d - 1, self._slot(h, d))
        ok = self.size[at] == size
        ok &= self.words[0, at] == words[0]
        more = np.flatnonzero(ok & (size > 8))
        if len(more):
            for k in range(1, WORDS):
                ok[more] &= self.words[k, at[more]] == words[k, more]
        return np.where(ok, self.ids[at], -1)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


_LOADED: dict[tuple[str, float], Vocabulary] = {}


def vocabulary(path: str | None = None) -> Vocabulary:
    path = path or f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
    key = (path, os.path.getmtime(path))
    if key not in _LOADED:
        _LOADED[key] = Vocabulary(read_ranks(path))
    return _LOADED[key]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """BPE of one segment: linked bytes, and a heap of the adjacent pairs by rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))  # the part that begins at i ends there; 0: swallowed
    prev = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        r = ranks.get(piece[i : i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, to = heapq.heappop(heap)
        mid = end[i]
        if not mid or mid >= n or end[mid] != to or mid >= to:
            continue  # one side has changed since
        end[i], end[mid] = to, 0
        if to < n:
            prev[to] = i
            r = ranks.get(piece[i : end[to]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[to]))
        p = prev[i]
        if p >= 0:
            r = ranks.get(piece[p:to])
            if r is not None:
                heapq.heappush(heap, (r, p, to))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    """Encodes slices of an Arrow buffer. One per Python worker's task; remembers the segments it has merged."""

    def __init__(self, vocab: Vocabulary):
        self.v = vocab
        self.seen: dict[bytes, list[int]] = {}

    def _merged(self, piece: bytes) -> list[int]:
        got = self.seen.get(piece)
        if got is None:
            if len(self.seen) >= REMEMBER:
                self.seen.clear()
            got = self.seen[piece] = merge(piece, self.v.ranks)
        return got

    def tokens(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[int]]]:
        """(first byte, id or -1 - place in the list, ids per pre-token, the merged segments)."""
        begin = token_starts(raw, offsets, self.v.table)
        size = np.diff(np.append(begin, len(raw)))
        long = size > WIDTH
        cut = np.where(long, 0, size)
        words = key_words(raw, begin, cut)
        h = key_hash(words, cut)
        ids = self.v.find(words, cut, h)
        ids[long] = -1
        many = np.ones(len(begin), np.int64)
        lists: list[list[int]] = []
        miss = np.flatnonzero((ids < 0) & ~long)
        if len(miss):
            _, one, back = np.unique(h[miss], return_index=True, return_inverse=True)
            own = miss[one]
            same = (words[:, miss] == words[:, own[back]]).all(0) & (size[miss] == size[own[back]])
            lists = [self._merged(raw[b : b + s].tobytes()) for b, s in zip(begin[own].tolist(), size[own].tolist())]
            ids[miss] = -1 - back
            odd = miss[~same]  # another segment with the same hash
            for i in odd.tolist():
                ids[i] = -1 - len(lists)
                lists.append(self._merged(raw[begin[i] : begin[i] + size[i]].tobytes()))
        for i in np.flatnonzero(long).tolist():
            ids[i] = -1 - len(lists)
            lists.append(self._merged(raw[begin[i] : begin[i] + size[i]].tobytes()))
        if lists:
            lens = np.array([len(x) for x in lists], np.int64)
            w = ids < 0
            many[w] = lens[-1 - ids[w]]
        return begin, ids, many, lists

    def counts(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(offsets) - 1, np.int64)
        for a, b in slices(offsets):
            begin, _, many, _ = self.tokens(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            total = np.concatenate([[0], np.cumsum(many)])
            at = np.searchsorted(begin, offsets[a : b + 1] - offsets[a])
            out[a:b] = np.diff(total[at])
        return out

    def ids(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one after another, offsets by text)."""
        parts, counts = [], np.zeros(len(offsets), np.int64)
        for a, b in slices(offsets):
            begin, ids, many, lists = self.tokens(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            total = np.concatenate([[0], np.cumsum(many)])
            out = np.empty(total[-1], np.int32)
            hit = ids >= 0
            out[total[:-1][hit]] = ids[hit]
            w = np.flatnonzero(~hit)
            if len(w):
                flat = np.fromiter((x for y in lists for x in y), np.int32)
                lens = np.array([len(x) for x in lists], np.int64)
                first = np.concatenate([[0], np.cumsum(lens)[:-1]])
                place = -1 - ids[w]
                k = lens[place]
                step = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                out[np.repeat(total[w], k) + step] = flat[np.repeat(first[place], k) + step]
            parts.append(out)
            at = np.searchsorted(begin, offsets[a : b + 1] - offsets[a])
            counts[a + 1 : b + 1] = np.diff(total[at])
        return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), np.cumsum(counts)


def encode_all(texts: Iterable[str], vocab: Vocabulary) -> list[list[int]]:
    """Small convenience for tests: the ids of a few texts."""
    import pyarrow as pa

    from pinfold.llm.pretokens import string_buffers

    flat, off = Encoder(vocab).ids(*string_buffers(pa.array(list(texts), pa.string())))
    return [flat[a:b].tolist() for a, b in zip(off[:-1], off[1:])]
