"""Kernels of the stored index, in Arrow batches: texts to terms, terms asked for to postings, postings to the best items.

An item's terms stay in its own row, so whatever is summed over an item is summed where the item lies, and a search moves
only the best items of each task.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pinfold.functions import text as T

K1, B = 1.2, 0.75
#: Postings that a segment holds at a time, and folded tokens that are remembered.
SEGMENT, KNOWN = 1 << 20, 1 << 16
ASCII = re.compile(r"\w+", re.ASCII)


def _ranges(chars: list[str]) -> str:
    """A character class's inside; characters must ascend."""
    out: list[list[int]] = []
    for c in map(ord, chars):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


@cache
def _tables() -> tuple[re.Pattern, re.Pattern, re.Pattern, re.Pattern, dict[int, str]]:
    """Words of texts below U+10000 and of any, marks, characters by which a text can't be folded word by word, and accents:
    as ``text.WORD`` and ``text.fold``. Patterns without characters above that are looked up in a table, others one by one."""
    word, mark, odd, accents = [], [], [], str.maketrans(*T._accents())
    for c in map(chr, range(sys.maxunicode + 1)):
        kind = unicodedata.category(c)
        if kind[0] == "M":
            mark.append(c)
        elif kind[0] == "L" or kind == "Nd" or c == "_":
            word.append(c)
    every, marks = re.compile(f"[{_ranges(word)}]+"), re.compile(f"[{_ranges(mark)}]+")
    for c in map(chr, range(0x80, 0x10000)):
        low = c.lower()
        if c == "Σ" or (low != c or ord(c) in accents) and bool(every.fullmatch(c)) != bool(every.fullmatch(marks.sub("", low).translate(accents))):
            odd.append(c)
    low = lambda chars: _ranges(sorted(c for c in chars if c < "\U00010000"))
    return re.compile(f"[{low(word)}]+"), every, marks, re.compile(f"[{low(mark + odd)}\U00010000-\U0010ffff]"), accents


class Tokens:
    """The terms of texts; a token that has come before isn't folded or split again."""

    def __init__(self):
        self.low, self.every, self.marks, self.odd, self.accents = _tables()
        self.known: dict[str, tuple[list[str], str | None, list[str]]] = {}

    def fold(self, text: str) -> str:
        return text.lower() if text.isascii() else self.marks.sub("", text.lower()).translate(self.accents)

    def words(self, text: str) -> list[str]:
        return ASCII.findall(text) if text.isascii() else (self.every if max(text) > "\uffff" else self.low).findall(text)

    def of(self, token: str) -> tuple[list[str], str | None, list[str]]:
        """(its terms, for a compound identifier its lower-cased form and the terms of its parts)."""
        got = self.known.get(token)
        if got is None:
            if len(self.known) >= KNOWN:
                self.known.clear()
            parts = pieces(token) if len(token.encode()) >= 3 else []
            some = len(parts) > 1
            of_parts = [t for p in parts for t in self.words(self.fold(p.lower()))] if some else []
            got = self.known[token] = (self.words(self.fold(token)), token.lower() if some else None, of_parts)
        return got

    def terms(self, text: str | None) -> tuple[list[str], list[str]]:
        """(tokens as written, folded terms) of a text."""
        if not text:
            return [], []
        if text.isascii():
            raw = ASCII.findall(text)
        elif self.odd.search(text):
            return self.words(text), self.words(self.fold(text))
        else:
            raw = self.low.findall(text)
        known = self.known
        return raw, [t for x in raw for t in (known.get(x) or self.of(x))[0]]

    def expanded(self, raw: list[str]) -> list[str]:
        """The terms of the parts of every distinct compound identifier."""
        seen, out = set(), []
        for x in raw:
            _, low, parts = self.of(x)
            if low is not None and low not in seen:
                seen.add(low)
                out += parts
        return out


def pieces(token: str) -> list[str]:
    """The parts of an identifier, as ``text.HUMP`` splits it."""
    kinds = [unicodedata.category(c) for c in token]
    out, own = [], ""
    for i, c in enumerate(token):
        if c == "_":
            out, own = [*out, own], ""
            continue
        if own:
            a, b = kinds[i - 1], kinds[i]
            hump = b == "Lu" and (a == "Ll" or a == "Lu" and i + 1 < len(token) and kinds[i + 1] == "Ll")
            if hump or (a[0] == "L" and b == "Nd") or (a == "Nd" and b[0] == "L"):
                out, own = [*out, own], ""
        own += c
    return [x for x in [*out, own] if x]


def indexer(kept: list[str], weights: dict[str, float], expand: tuple[str, ...] | None):
    """For mapInArrow: ``kept``, dl, the item's distinct terms and the sum of the weights of each. With ``expand``, the
    column of that name holds the parts of compound identifiers of those columns."""

    def run(batches):
        tokens = Tokens()
        names = [c for c in weights if not (expand and c == "expand")]
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in names]
            more = [names.index(c) for c in expand or ()]
            dl, terms, sums = [], [], []
            for texts in zip(*columns):
                f: dict[str, float] = {}
                n, raws = 0, []
                for c, text in zip(names, texts):
                    raw, own = tokens.terms(text)
                    raws.append(raw)
                    n += len(own)
                    w = float(weights[c])
                    for t in own:
                        f[t] = f.get(t, 0.0) + w
                if expand:
                    own = tokens.expanded([x for i in more for x in raws[i]])
                    n += len(own)
                    w = float(weights["expand"])
                    for t in own:
                        f[t] = f.get(t, 0.0) + w
                dl.append(n)
                terms.append(" ".join(f))
                sums.append(array("d", f.values()).tobytes())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(dl, pa.int32()), pa.array(terms, pa.string()), pa.array(sums, pa.binary())], [*kept, "dl", "terms", "f"]
            )

    return run


def matched(batch: pa.RecordBatch, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in the vocabulary, place among the batch's terms) of each of the batch's terms that the vocabulary has."""
    lists = pc.split_pattern(batch.column("terms"), " ")
    n = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    at = pc.fill_null(pc.index_in(lists.flatten(), value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
    hit = np.flatnonzero(at >= 0)
    return np.repeat(np.arange(len(n), dtype=np.int32), n)[hit], at[hit], hit


def sums(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("f").to_pylist()))


def rows_of(batch: pa.RecordBatch, columns: list[str]) -> list[tuple]:
    return list(zip(*[batch.column(c).to_pylist() for c in columns])) if columns else [()] * batch.num_rows


def finder(kept: list[str], handle):
    """For mapInArrow: (kept, term, f) of the terms in the broadcast vocabulary."""

    def run(batches):
        for batch in batches:
            row, at, hit = matched(batch, handle.value)
            own = batch.select(kept).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*own.columns, handle.value.take(pa.array(at)), pa.array(sums(batch)[hit])], [*kept, "term", "f"])

    return run


def counter(part: list[str], schema: pa.Schema, handle):
    """For mapInArrow: (part, at, df), how many items of a part hold each term of the broadcast vocabulary."""

    def run(batches):
        found: dict[tuple, np.ndarray] = {}
        for batch in batches:
            row, at, _ = matched(batch, handle.value)
            rows = rows_of(batch, part)
            code = {p: i for i, p in enumerate(dict.fromkeys(rows))}
            of = np.array([code[p] for p in rows], np.int64)[row]
            n = np.bincount(of * len(handle.value) + at, minlength=len(code) * len(handle.value)).reshape(len(code), -1)
            for p, i in code.items():
                found[p] = found[p] + n[i] if p in found else n[i]
        for p, n in found.items():
            at = np.flatnonzero(n)
            own = [pa.array([v] * len(at), schema.field(c).type) for c, v in zip(part, p)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(at.astype(np.int32)), pa.array(n[at])], [*part, "at", "df"])

    return run


class Best:
    """The k best items of each query and lane so far, by higher score, then smaller key."""

    def __init__(self, queries: int, lanes: int, k: int):
        self.k, self.lanes = k, lanes
        self.score, self.item = np.full((queries, lanes, k), -np.inf), np.full((queries, lanes, k), -1)
        self.keys: dict[int, tuple] = {}
        self.next = 0

    def begin(self, keys: list[tuple]) -> None:
        """A segment's items, in the order of their keys."""
        used = set(np.unique(self.item).tolist())
        self.keys = {i: x for i, x in self.keys.items() if i in used}
        self.own = keys

    def least(self, q: int) -> float:
        return self.score[q, :, -1].min()

    def add(self, q: int, lane: int, items: np.ndarray, scores: np.ndarray) -> None:
        """``items``: ascending places in the segment."""
        kth = self.score[q, lane, -1]
        take = np.flatnonzero(scores >= kth)
        if len(take) > self.k:
            take = take[np.argsort(-scores[take], kind="stable")[: self.k]]
        if not len(take):
            return
        old = [(-s, sortable(self.keys[i]), i) for s, i in zip(self.score[q, lane].tolist(), self.item[q, lane].tolist()) if i >= 0]
        new = []
        for s, i in zip(scores[take].tolist(), items[take].tolist()):
            self.keys[self.next + i] = self.own[i]
            new.append((-s, sortable(self.own[i]), self.next + i))
        both = sorted(old + new)[: self.k]
        self.score[q, lane, : len(both)] = [-x[0] for x in both]
        self.item[q, lane, : len(both)] = [x[2] for x in both]

    def end(self) -> None:
        self.next += len(self.own)


def sortable(key: tuple) -> tuple:
    return tuple((x is not None, x) for x in key)


def rounded(scores: np.ndarray) -> np.ndarray:
    return np.floor(scores * 1e6 + 0.5) / 1e6


def ranker(key: list[str], part: list[str], by: list[str], lane, lanes: int, k: int, schema: pa.Schema, handle):
    """For mapInArrow: (query_id, lane, key, score), the task's k best items of each query and lane.

    The broadcast has the queries' ids, terms (places in the vocabulary) and values that ``lane`` knows them by, the vocabulary,
    and by part the terms' weights and the mean length. Terms whose best postings can't lift an item into the k best together
    don't bring items up; they are added to those that the others brought.
    """

    def run(batches):
        ids, asked, known, vocabulary, weights = handle.value
        best = Best(len(ids), lanes, k)
        groups: dict[tuple, int] = {}
        held: list[tuple] = []
        n = 0

        def lane_of(values: tuple, made: dict[tuple, np.ndarray]) -> np.ndarray:
            if values not in made:
                got = [lane(values, g) for g in groups]
                made[values] = np.array([-1 if x is None else x for x in got], np.int8)
            return made[values]

        def flush() -> None:
            keys = [x for h in held for x in h[0]]
            order = sorted(range(len(keys)), key=lambda i: sortable(keys[i]))
            place = np.empty(len(keys), np.int32)
            place[order] = np.arange(len(keys), dtype=np.int32)
            group = np.concatenate([h[1] for h in held])[order]
            doc, at, s = place[np.concatenate([h[2] for h in held])], np.concatenate([h[3] for h in held]), np.concatenate([h[4] for h in held])
            by_term = np.lexsort((doc, at))
            doc, at, s = doc[by_term], at[by_term], s[by_term]
            ends = np.searchsorted(at, np.arange(len(vocabulary) + 1))
            best.begin([keys[i] for i in order])
            total, mark, made = np.zeros(len(keys)), np.zeros(len(keys), bool), {}
            for q, terms in enumerate(asked):
                lists = [(s[a:b].max(), doc[a:b], s[a:b]) for a, b in ((ends[t], ends[t + 1]) for t in terms) if b > a]
                lists.sort(key=lambda x: x[0])
                least, most, rest = best.least(q) - 1e-6, 0.0, 0
                while rest < len(lists) and most + lists[rest][0] < least:
                    most += lists[rest][0]
                    rest += 1
                if rest == len(lists):
                    continue
                for _, d, x in lists[rest:]:
                    total[d] += x
                    mark[d] = True
                found = np.flatnonzero(mark)
                scores = total[found]
                total[found], mark[found] = 0, False
                if lane is None:
                    lane_at = np.zeros(len(found), np.int8)
                else:
                    lane_at = lane_of(known[q], made)[group[found]]
                    ok = lane_at >= 0
                    found, scores, lane_at = found[ok], scores[ok], lane_at[ok]
                ok = scores + most >= least
                found, scores, lane_at = found[ok], scores[ok], lane_at[ok]
                for _, d, x in lists[:rest]:
                    i = np.minimum(np.searchsorted(d, found), len(d) - 1)
                    scores += np.where(d[i] == found, x[i], 0)
                scores = rounded(scores)
                for i in range(lanes):
                    own = slice(None) if lanes == 1 else lane_at == i
                    best.add(q, i, found[own], scores[own])
            best.end()

        for batch in batches:
            row, at, hit = matched(batch, vocabulary)
            f, dl = sums(batch)[hit], batch.column("dl").to_numpy()[row]
            parts = list(weights)
            code = {p: i for i, p in enumerate(parts)}
            of = np.array([code.get(p, -1) for p in rows_of(batch, part)], np.int64)
            ok = of[row] >= 0
            row, at, f, dl = row[ok], at[ok], f[ok], dl[ok]
            if not len(row):
                continue
            weight, mean = np.stack([weights[p][0] for p in parts]), np.array([weights[p][1] for p in parts])
            of = of[row]
            s = weight[of, at] * f * (K1 + 1) / (f + K1 * (1 - B + B * dl / mean[of]))
            own = np.array([groups.setdefault(g, len(groups)) for g in rows_of(batch, by)], np.int32)
            items, row = np.unique(row, return_inverse=True)
            took = batch.select(key).take(pa.array(items))
            held.append((rows_of(took, key), own[items], row + sum(len(h[0]) for h in held), at, s))
            n += len(at)
            if n >= SEGMENT:
                flush()
                held, n = [], 0
        if held:
            flush()
        q, i, j = np.nonzero(best.item >= 0)
        for a in range(0, len(q), 1 << 16):
            x = q[a : a + (1 << 16)], i[a : a + (1 << 16)], j[a : a + (1 << 16)]
            keys = [best.keys[d] for d in best.item[x].tolist()]
            own = [pa.array([t[c] for t in keys], schema.field(name).type) for c, name in enumerate(key)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[x[0]]), pa.array(x[1].astype(np.int32)), *own, pa.array(best.score[x])], ["query_id", "lane", *key, "score"])

    return run
