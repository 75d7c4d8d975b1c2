"""Splitting of UTF-8 text into byte-level BPE pre-tokens, on whole Arrow buffers.

The split is the published one of the rank files: contractions, an optional blank with a run of letters, numbers or
other signs, and white space, of which the last blank before a word belongs to the word. All of it is worked out on
arrays of code points, so that no Python object is made per token.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
#: Bytes of text that are worked on at a time, unless one text is longer.
SLICE = 1 << 20


def class_table() -> np.ndarray:
    """The class of every code point, by the Unicode tables of the regex module."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            if a < 0xD800 <= b:
                out[a:0xD800] = kind
                a = 0xE000
            out[a : b + 1] = kind
    return out


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null texts have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE):
    """Ranges of texts that together hold about ``most`` bytes; each range has at least one text."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def code_points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, the byte each begins at) of valid UTF-8."""
    if not len(raw) or raw.max() < 0x80:
        return raw.astype(np.int32), np.arange(len(raw), dtype=np.int32)
    at = np.flatnonzero((raw & 0xC0) != 0x80).astype(np.int32)
    lead = raw[at].astype(np.int32)
    cp = lead.copy()
    padded = np.concatenate([raw, np.zeros(3, np.uint8)])
    for low, high, mask, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
        w = np.flatnonzero((lead >= low) & (lead < high))
        if len(w):
            v = lead[w] & mask
            for k in range(1, more + 1):
                v = (v << 6) | (padded[at[w] + k] & 0x3F)
            cp[w] = v
    return cp, at


def token_starts(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The bytes at which pre-tokens begin, over texts that lie one after another in ``raw``."""
    if not len(raw):
        return np.zeros(0, np.int64)
    cp, at = code_points(raw)
    n = len(cp)
    kind = table[cp]
    bounds = offsets[:-1][np.diff(offsets) > 0]  # where texts begin
    first = bounds if len(at) == len(raw) else np.searchsorted(at, bounds)
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start[first] = True
    text_end = np.zeros(n + 1, bool)
    text_end[first] = True
    text_end[n] = True
    runs = np.flatnonzero(start)
    ends = np.append(runs[1:], n)
    blank = kind[runs] == SPACE
    led = blank & ~text_end[ends]  # white space with something after it in its text
    last = ends[led] - 1
    start[last] = True
    joins = last[cp[last] == 0x20]
    start[joins + 1] = False
    # a lone apostrophe that has no blank before it takes a contraction's letters
    quote = runs[(cp[runs] == 0x27) & (ends - runs == 1)]
    if len(quote):
        quote = quote[start[quote] & ~text_end[quote + 1]]
    if len(quote):
        pad = np.concatenate([cp, np.zeros(3, np.int32)])
        within = ~np.concatenate([text_end, np.ones(3, bool)])
        c1, c2 = pad[quote + 1], np.where(within[quote + 2], pad[quote + 2], 0)
        one = np.isin(c1, [0x73, 0x74, 0x6D, 0x64])
        two = ((c1 == 0x72) & (c2 == 0x65)) | ((c1 == 0x76) & (c2 == 0x65)) | ((c1 == 0x6C) & (c2 == 0x6C))
        takes = np.where(one, 1, np.where(two, 2, 0))
        hit = takes > 0
        start[quote[hit] + 1] = False
        rest = quote[hit] + 1 + takes[hit]
        start[rest[rest < n]] = True
    return at[start].astype(np.int64)
