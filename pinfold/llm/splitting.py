"""Cutting oversized text into overlapping pieces at natural boundaries (problem 4).

The places where a text may be cut are its headings, blank lines, fences, lines and sentences. At each of them the words
before and after are compared; valleys of that similarity mark a change of topic. Within each window that a piece may
end in, the deepest valley is cut, a better kind of place adding to its depth. A place inside a sentence is taken only
where the window holds no other.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pinfold.session import ship

MOST, OVERLAP, BYTES = 650, 60, 4
#: Words on either side of a place that are compared, and what the kinds of places add to the depth of a valley.
BLOCK = 40
HEADING, BLANK, FENCE, LINE, SENTENCE = 1.0, 0.6, 0.5, 0.2, 0.1
#: Pieces before the last are filled at least to this share where the places allow.
FILL = 0.5

_LINE = re.compile(r"[^\n]*\n|[^\n]+$")
_HEAD = re.compile(r" {0,3}(#{1,6})[ \t]+(.*?)[ \t#]*$")
_FENCE = re.compile(r" {0,3}(```+|~~~+)")
_SENTENCE = re.compile(r"[.!?…][\"'”’)\]`*_]*[ \t]+|[。！？]")
_WORD = re.compile(r"\w{3,}")


@dataclass
class Places:
    """Where a text may be cut: offsets in order, the kind's weight of each, and the headings that begin somewhere."""

    at: list[int]
    weight: list[float]
    heads: list[tuple[int, int, str]]  # offset, level, title


def places(text: str) -> Places:
    found: dict[int, float] = {}
    heads: list[tuple[int, int, str]] = []
    fence, blank = "", False

    def add(i: int, w: float) -> None:
        if 0 < i < len(text):
            found[i] = max(found.get(i, 0.0), w)

    for m in _LINE.finditer(text):
        a, b, line = m.start(), m.end(), m[0].rstrip("\r\n")
        mark = _FENCE.match(line)
        if fence:
            add(a, LINE / 2)  # inside a fence only for want of better
            if mark and mark[1].startswith(fence) and not line.strip().strip(fence[0]):
                fence = ""
                add(b, FENCE)
            continue
        if mark:
            fence = mark[1]
            add(a, BLANK if blank else FENCE)
        elif head := _HEAD.match(line):
            heads.append((a, len(head[1]), head[2]))
            add(a, HEADING)
        else:
            add(a, BLANK if blank else LINE)
            for s in _SENTENCE.finditer(text, a, a + len(line)):
                add(s.end(), SENTENCE)
        blank = not line.strip()
    at = sorted(found)
    return Places(at, [found[i] for i in at], heads)


def depths(text: str, at: list[int]) -> list[float]:
    """How deep the valley of similarity is at each place: the climbs to the next peaks on both sides."""
    low = text.lower()
    if len(low) != len(text):
        low = text
    words, begins = [], []
    for m in _WORD.finditer(low):
        words.append(m[0])
        begins.append(m.start())
    same = []
    for i in at:
        k = bisect_left(begins, i)
        before, after = Counter(words[max(k - BLOCK, 0) : k]), Counter(words[k : k + BLOCK])
        if not before or not after:
            same.append(0.0)
            continue
        dot = sum(n * after[w] for w, n in before.items() if w in after)
        same.append(dot / math.sqrt(sum(n * n for n in before.values()) * sum(n * n for n in after.values())))
    out, n = [0.0] * len(at), len(at)
    peak = [0.0] * n  # to the left: as long as it climbs
    for i in range(n):
        peak[i] = peak[i - 1] if i and same[i - 1] >= same[i] and peak[i - 1] >= same[i - 1] else same[i]
        out[i] += peak[i] - same[i]
    for i in range(n - 1, -1, -1):
        peak[i] = peak[i + 1] if i + 1 < n and same[i + 1] >= same[i] and peak[i + 1] >= same[i + 1] else same[i]
        out[i] += peak[i] - same[i]
    return out


def cuts(text: str, most: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start with overlap, start of its own, end) of each piece, in characters; no piece is of more than ``most`` bytes
    and no overlap of more than ``overlap`` bytes."""
    size = [0]
    if text.isascii():
        size = range(len(text) + 1)
    else:
        for c in text:
            size.append(size[-1] + (1 if c < "\x80" else 2 if c < "ࠀ" else 3 if c < "\U00010000" else 4))
    total = size[len(text)]
    if total <= most:
        return [(0, 0, len(text))]
    found = places(text)
    deep = depths(text, found.at)
    worth = [d + w for d, w in zip(deep, found.weight)]
    out, start, own = [], 0, 0
    while True:
        if total - size[start] <= most:
            out.append((start, own, len(text)))
            return out
        end = bisect_right(size, size[start] + most) - 1  # as far as the limit allows
        lo = max(own + 1, bisect_left(size, size[start] + int(most * FILL)))
        best = None
        for floor in (lo, own + 1):
            i, j = bisect_left(found.at, floor), bisect_right(found.at, end)
            if i < j:
                best = max(range(i, j), key=lambda k: (worth[k], found.at[k]))
                break
        if best is not None:
            cut = found.at[best]
        else:  # one sentence or line longer than a piece: the last blank, or the limit itself
            cut = max(text.rfind(" ", lo, end), text.rfind("\t", lo, end)) + 1
            if cut <= own:
                cut = end
        cut = max(cut, own + 1)
        out.append((start, own, cut))
        earliest = max(bisect_left(size, size[cut] - overlap), own)
        i, j = bisect_left(found.at, earliest), bisect_left(found.at, cut)
        if i < j:
            start = found.at[i]
        else:
            blank = text.find(" ", earliest, cut)
            start = blank + 1 if 0 <= blank < cut - 1 else cut
        own = cut


def headings(path: str | None, heads: list[tuple[int, int, str]], at: int) -> str | None:
    """The heading path in force at a place: the item's own, then the headings of the text up to there."""
    stack: list[tuple[int, str]] = []
    for i, level, title in heads:
        if i > at:
            break
        while stack and stack[-1][0] >= level:
            stack.pop()
        stack.append((level, title))
    own = path or ""
    mark = " > " if " > " in own and " › " not in own else " › "
    known = {x.strip() for x in re.split(" [>›] ", own)}
    return mark.join([*([own] if own else []), *(t for _, t in stack if t and t not in known)]) or path


def split(items: DataFrame, key: list[str], text: str, path: str, most: int = MOST, overlap: int = OVERLAP) -> DataFrame:
    """(*key, piece, start, text, heading_path, tokens, shared): the pieces of every item of more than ``most`` tokens.

    Tokens are estimated: UTF-8 bytes by four, rounded up. ``start`` is the piece's first character in the whole text,
    ``shared`` how many of its first characters end the piece before. Without those the pieces make up the text exactly.
    Items within the limit, empty and null texts give no rows. Of rows with one key the last by ``retrieved_at`` counts
    if there is such a column, else the greatest text. Other columns may have any names; an empty table gives no rows.
    """
    ship(items.sparkSession)
    big = items.filter(F.octet_length(text) > most * BYTES)
    when = F.col("retrieved_at") if "retrieved_at" in items.columns else F.lit(0)
    last = big.groupBy(*[F.col(k).alias(f"k{i}") for i, k in enumerate(key)]).agg(F.max(F.struct(when, F.col(text).alias("t"), F.col(path).cast("string").alias("p"))).alias("x"))
    rows = last.select(*[f"k{i}" for i in range(len(key))], "x.t", "x.p")
    kinds = [rows.schema[f"k{i}"].dataType.simpleString() for i in range(len(key))]
    names = [f"k{i}" for i in range(len(key))]

    def run(frames):
        for pdf in frames:
            out = []
            for row in pdf.itertuples(index=False, name=None):
                *ks, body, trail = row
                heads = places(body).heads
                for n, (a, own, b) in enumerate(cuts(body, most * BYTES, overlap * BYTES)):
                    piece = body[a:b]
                    out.append((*ks, n, a, piece, headings(trail, heads, own), -(-len(piece.encode()) // BYTES), own - a))
            yield pd.DataFrame(out, columns=[*names, "piece", "start", "text", "heading_path", "tokens", "shared"])

    schema = ", ".join([*(f"{n} {k}" for n, k in zip(names, kinds)), "piece int, start int, text string, heading_path string, tokens int, shared int"])
    return rows.mapInPandas(run, schema).withColumnsRenamed(dict(zip(names, key)))
