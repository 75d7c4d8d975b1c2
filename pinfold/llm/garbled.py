"""Text decoded with the wrong character encoding (problem 9).

1. Statistics over the whole corpus: in how many texts each pair of adjacent characters occurs, one of them not ASCII,
   each single character, and each character beyond ASCII that stands alone with the two on either side of it. They fill
   tables of a fixed size, so what is broadcast has a fixed bound. A slot that several share holds at most the number of
   texts times (such places a text / slots) more on average, far below the shares of texts that count as known.
2. Adjacent pairs of a text are scored by their mutual information; maximum-scoring segments of improbability are the
   runs under suspicion. Characters that are a UTF-8 sequence to a wrong decoder are so however often they occur.
3. Only inside such runs inverse mappings are tried: the characters back to the bytes of a wrong encoding, and those
   bytes read as UTF-8 or as another single-byte encoding, up to three times over. A mapping holds if the text it gives
   is better supported by the corpus than what stands there.

U+FFFD is what a decoder leaves for bytes it can't read, so it needs no inverse: such texts are found, and stay as they
are in those places.
"""

from __future__ import annotations

import codecs
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pinfold.llm.pretokens import code_points, slices, string_buffers
from pinfold.session import ship

#: Slots of the pairs, the characters and the lone characters in their places; fixed, so 9 MB are broadcast however large
#: the corpus. Counts are kept as 32-bit floats, exact up to 2^24 and never too large for it.
PAIRS, SINGLES, PLACES = 1 << 20, 1 << 18, 1 << 20
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Decoders that may have been applied wrongly. Bytes they leave undefined pass as control characters.
WRONG = ("cp1252", "latin-1", "cp1250", "cp1251", "cp1253", "cp1254", "iso8859-2", "iso8859-5", "iso8859-9", "iso8859-15", "cp437", "cp850", "cp852", "cp866", "koi8-r", "mac-roman")
#: Encodings that the bytes may have been in, besides UTF-8.
RIGHT = ("cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "iso8859-2", "iso8859-5", "iso8859-9", "iso8859-15", "cp437", "cp850", "cp852", "cp866", "koi8-r", "mac-roman")
UTF8 = re.compile(b"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
#: Encodings of two bytes a character that are tried besides; a run in them must give so many known characters.
WIDE, LEAST = ("cp932", "euc_jp", "gb18030", "big5", "euc_kr"), 3
CLUSTER = re.compile("[^\x00-\x7f]+")
#: How many times over a text may have been decoded wrongly.
DEPTH = 3


def _decoder(name: str) -> list[str]:
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


def mappings() -> tuple[list[dict[int, int]], list[dict[int, int]]]:
    """(characters to bytes of each wrong decoder, characters to characters of each pair of single-byte encodings)."""
    tables = {n: _decoder(n) for n in {*WRONG, *RIGHT}}
    back = []
    for n in WRONG:
        m = {ord(c): b for b, c in enumerate(tables[n]) if b > 127}
        if n != "latin-1":  # a decoder that passes undefined bytes, or a later cleaning, leaves control characters
            m = {**{b: b for b in range(128, 160) if b not in m and b not in m.values()}, **m}
        if m not in back:
            back.append(m)
    single = []
    for w in WRONG:
        for r in RIGHT:
            m = {ord(tables[w][b]): ord(tables[r][b]) for b in range(128, 256) if tables[w][b] != tables[r][b]}
            m = {a: b for a, b in m.items() if not 128 <= b < 160}
            if m and m not in single:
                single.append(m)
    return back, single


class _Back(dict):
    """Characters to bytes for str.translate; what the encoding hasn't got becomes a character that is no byte."""

    def __missing__(self, c: int) -> int:
        self[c] = got = c if c < 128 else 0xFFFF
        return got


def fold(cp: np.ndarray) -> np.ndarray:
    """Digits count as one character, capitals and white space stay apart."""
    return np.where((cp >= 48) & (cp <= 57), 48, cp)


def pair_slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a.astype(np.uint64) << np.uint64(21) | b.astype(np.uint64)) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return (x >> np.uint64(44)).astype(np.int64)


def place_slot(around: np.ndarray) -> np.ndarray:
    """Slots of rows of five characters, the third of which stands alone."""
    x = np.zeros(len(around), np.uint64)
    for k in range(5):
        x = (x ^ around[:, k].astype(np.uint64)) * _M1
        x ^= x >> np.uint64(29)
    return ((x * _M2) >> np.uint64(44)).astype(np.int64)


def lone(cp: np.ndarray) -> np.ndarray:
    """Places of characters beyond ASCII between ASCII ones; two characters lie on either side."""
    high = cp > 127
    return 2 + np.flatnonzero(high[2:-2] & ~high[1:-3] & ~high[3:-1])


def char_slot(a: np.ndarray) -> np.ndarray:
    return np.where(a < SINGLES, a, SINGLES // 2 + a % (SINGLES // 2)).astype(np.int64)


def text_marks(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(folded code points with a blank before, between and after the texts, the text of each)."""
    n = len(offsets) - 1
    cp, at = code_points(raw)
    text = np.searchsorted(offsets, at, side="right") - 1
    out = np.full(len(cp) + n + 1, 32, np.int32)
    place = np.arange(len(cp)) + text + 1
    out[place] = cp
    owner = np.zeros(len(out), np.int64)
    owner[place] = text
    ends = np.cumsum(np.bincount(text, minlength=n)) + np.arange(1, n + 1)  # the blank after each text
    owner[ends] = np.arange(n)
    return out, owner


def statistics(df: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(texts with each pair, with each character, with each lone character in its place, texts), over all rows."""
    spark = df.sparkSession
    ship(spark)

    def run(batches):
        pairs, singles, places, texts = np.zeros(PAIRS, np.int64), np.zeros(SINGLES, np.int64), np.zeros(PLACES, np.int64), 0
        for batch in batches:
            raw, offsets = string_buffers(batch.column(0))
            texts += len(offsets) - 1
            for a, b in slices(offsets):
                part, off = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                if not len(part):
                    continue
                cp, owner = text_marks(part, off)
                cp = fold(cp)
                two = np.flatnonzero((cp[:-1] > 127) | (cp[1:] > 127))
                keys = np.unique(owner[np.where(cp[two] > 127, two, two + 1)] * PAIRS + pair_slot(cp[two], cp[two + 1]))
                pairs += np.bincount(keys % PAIRS, minlength=PAIRS)
                seen = np.zeros((b - a) * 128, bool)  # ASCII without sorting
                low = cp < 128
                seen[owner[low] * 128 + cp[low]] = True
                singles[:128] += seen.reshape(-1, 128).sum(0)
                keys = np.unique(owner[~low] * SINGLES + char_slot(cp[~low]))
                singles += np.bincount(keys % SINGLES, minlength=SINGLES)
                at = lone(cp)
                five = at[:, None] + np.arange(-2, 3)
                around = np.where(owner[five] == owner[at][:, None], cp[five], 32)  # blanks beyond the ends
                keys = np.unique(owner[at] * PLACES + place_slot(around))
                places += np.bincount(keys % PLACES, minlength=PLACES)
        n = np.concatenate([pairs, singles, places, [texts]])
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n[own])], ["slot", "n"])

    rows = df.select(F.col(text).cast("string").alias("t")).filter("t IS NOT NULL").mapInArrow(run, "slot bigint, n bigint")
    got = rows.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most one row a slot
    table = np.zeros(PAIRS + SINGLES + PLACES + 1, np.float64)
    table[got["slot"].to_numpy()] = got["n"].to_numpy()
    pairs, singles, places = np.split(table[:-1].astype(np.float32), [PAIRS, PAIRS + SINGLES])
    return pairs, singles, places, int(table[-1])


class Model:
    """Mutual information of adjacent characters, shrunk to 0 where few texts would hold the pair by chance."""

    def __init__(self, pairs: np.ndarray, singles: np.ndarray, places: np.ndarray, texts: int):
        self.pairs, self.singles, self.places, self.texts = pairs, singles, places, max(texts, 1)
        #: Texts from which on a pair counts as known.
        self.known_from = 2 + 0.0003 * texts
        #: Texts up to which a pair counts as rare, and up to which it is looked at anyway.
        self.rare_to, self.doubt_to = max(3, 0.002 * texts), max(3, 0.005 * texts)
        self.memory: dict[tuple[str, str], tuple[float, int]] = {}
        self.worths: dict[tuple[str, str], float] = {}
        self.likes: dict[tuple[str, str], float] = {}

    def scores(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(mutual information, texts) of folded pairs."""
        n = self.pairs[pair_slot(a, b)]
        chance = self.singles[char_slot(a)].astype(float) * self.singles[char_slot(b)] / self.texts
        return np.log((n + 1) / (chance + 1)), n

    def pair(self, a: str, b: str) -> tuple[float, int]:
        got = self.memory.get((a, b))
        if got is None:
            if len(self.memory) > 500_000:
                self.memory.clear()
            x, y = (fold(np.array([ord(c)])) for c in (a, b))
            info, n = self.scores(x, y)
            got = self.memory[a, b] = float(info[0]), int(n[0])
        return got

    def worth(self, a: str, b: str) -> float:
        got = self.worths.get((a, b))
        if got is None:
            if len(self.worths) > 500_000:
                self.worths.clear()
            info, n = self.pair(a, b)
            got = self.worths[a, b] = min(info, 0.0) + 0.25 * (math.log1p(n) - math.log1p(self.texts))
        return got

    def like(self, a: str, b: str) -> float:
        """The worth of a pair of which one character is ASCII, at least what its best like is worth, less 1: a small
        letter instead of a small one, a capital for a capital, a mark or blank for a mark."""
        got = self.likes.get((a, b))
        if got is None:
            got = self.worth(a, b)
            if a < "\x80":
                got = max(got, max(self.worth(x, b) for x in _likes(a)) - 1.0)
            elif b < "\x80":
                got = max(got, max(self.worth(a, x) for x in _likes(b)) - 1.0)
            if len(self.likes) > 500_000:
                self.likes.clear()
            self.likes[a, b] = got
        return got

    def place(self, around: str) -> float:
        """Texts that hold the third of five characters between the others."""
        return float(self.places[place_slot(fold(np.array([[ord(c) for c in around]])))[0]])


_SMALL, _LARGE, _MARK = [[chr(c) for c in range(32, 127) if ok(chr(c))] for ok in (str.islower, str.isupper, lambda c: not c.isalpha())]


def _likes(c: str) -> list[str]:
    return _SMALL if c.islower() else _LARGE if c.isupper() else _MARK


def segments(at: np.ndarray, score: np.ndarray, gap: float) -> list[tuple[int, int]]:
    """All maximal scoring segments over positions with scores; each position in between costs ``gap``.

    Gives (first, last) places in ``at``. One pass with a stack of candidate segments.
    """
    out: list[list[float]] = []  # [first, last, sum before, sum with]
    total = np.cumsum(score - gap * (np.diff(at, prepend=at[:1] - 1) - 1))
    high = np.flatnonzero(score > 0)
    for i, left, with_ in zip(high.tolist(), (total[high] - score[high]).tolist(), total[high].tolist()):
        new = [i, i, left, with_]
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= new[2]:
                j -= 1
            if j < 0 or out[j][3] >= new[3]:
                out.append(new)
                break
            new = [out[j][0], i, out[j][2], new[3]]
            del out[j:]
    return [(int(a), int(b)) for a, b, _, _ in out]


class Repair:
    """Finds and undoes wrong decodings in one text."""

    #: A pair counts as improbable from this mutual information down; rare ones by so much in any case.
    FLOOR, RARE = -1.0, 0.3
    #: What a UTF-8 reading must gain; what each sequence of three bytes or more counts, which chance hardly makes, and
    #: each of two bytes in an unusual place.
    UTF_GAIN, LONG, SHORT = 0.5, 8.0, 3.0
    #: Readings in another single-byte encoding: mutual information that each changed character may have at most on
    #: either side, the sum to gain, the mean gain in the logarithm of texts, and the latter for long runs.
    ODD, GAIN, SUPPORT, RUN = -0.25, 1.5, 1.2, 4
    #: Mean gain in the logarithm of texts that suffices by itself where every pair that changes is rare.
    FAR = 3.0
    #: Share of a long run's characters that must be better off.
    MOST = 0.9
    #: How many more texts, as a logarithm, must hold another character in a lone one's place.
    ALONE = 3.0
    #: Pairs that tell a group's mix-up, and how far below the middle the shares of their garbled forms may
    #: lie.
    PROFILE, EVEN = 12, 2.5

    def __init__(self, model: Model, mixed: dict[int, float] | None = None):
        self.model, self.mixed = model, mixed or {}
        back, self.single = mappings()
        self.back = [_Back(m) for m in back]
        #: The byte of each character in each wrong decoder's encoding, 0 if it has none.
        self.bytes = np.zeros((len(back), 1 << 16), np.uint8)
        self.bytes[:, :128] = np.arange(128)
        for d, m in enumerate(back):
            for c, b in m.items():
                if c < 0xFFFF:
                    self.bytes[d, c] = b
        known = lambda c: c < 128 or c == 0xFEFF or model.singles[c if c < SINGLES else SINGLES // 2] >= model.known_from
        self.known = known
        self.single = [m for m in ({a: b for a, b in x.items() if known(b) and not chr(a).isspace()} for x in self.single) if m]
        self.sequences = Sequences(self)
        self.found: dict[str, tuple[str, int]] = {}
        self.stood: dict[str, str] = {}
        self.outcomes: dict[str, list[int]] = {}
        self.read: dict[bytes, str] = {}  # UTF-8 sequences, at most as many as there are characters

    def utf8(self, run: str) -> list[tuple[str, float]]:
        """The run with every UTF-8 sequence in it read as such, for each wrong decoder that allows one; and what the
        sequences themselves weigh as evidence."""
        out = []
        codes = self.bytes[:, np.minimum(np.frombuffer(run.encode("utf-32-le"), np.uint32), 0xFFFF)]
        begin = (codes[:, :-1] - np.uint8(0xC2) <= 0xF4 - 0xC2) & (codes[:, 1:] & 0xC0 == 0x80)
        for d in np.flatnonzero(begin.any(1)).tolist():
            last, parts, weight = 0, [], 0.0
            for h in UTF8.finditer(codes[d].tobytes()):
                c = self.read.get(h[0])
                if c is None:
                    c = self.read[h[0]] = h[0].decode("utf-8", "ignore")
                if not c:
                    continue
                more = len(h[0]) > 2
                # else the bytes may have met by chance
                if self.known(ord(c)) or more and (parts or self.rare(run[max(h.start() - 1, 0) : h.end() + 1])):
                    parts += [run[last : h.start()], c]
                    weight += self.LONG if more else self.SHORT if not self.common(run[max(h.start() - 1, 0) : h.end() + 1]) else 0.0
                    last = h.end()
            fixed = "".join([*parts, run[last:]])
            if last and fixed != run and all(fixed != x for x, _ in out):
                out.append((fixed, weight))
        return out

    def wide(self, run: str) -> list[str]:
        """Readings of a run in encodings of two bytes a character, whose second byte may be ASCII."""
        out = []
        for m in self.back:
            try:
                code = run[1:].translate(m).encode("latin-1")
            except UnicodeEncodeError:
                continue
            for name in WIDE:
                for end in (len(code) - 1, len(code)):
                    try:
                        new = run[0] + code[:end].decode(name) + run[1 + end :]
                    except UnicodeDecodeError:
                        continue
                    fresh = [c for c in new if c > "\x7f"]
                    if len(fresh) >= LEAST and new not in out and all(self.known(ord(c)) for c in fresh) and self.mean(new) >= self.mean(run) + 1.5:
                        out.append(new)
        return out

    def mean(self, run: str) -> float:
        """The mean logarithm of texts over a run's pairs."""
        n = [math.log1p(self.model.pair(a, b)[1]) for a, b in zip(run, run[1:]) if a > "\x7f" or b > "\x7f"]
        return sum(n) / max(len(n), 1)

    def rare(self, run: str) -> bool:
        return all(self.model.pair(a, b)[1] <= self.model.rare_to for a, b in zip(run, run[1:]) if a > "\x7f" or b > "\x7f")

    def common(self, run: str) -> bool:
        return all(self.model.pair(a, b)[1] > self.model.doubt_to for a, b in zip(run, run[1:]) if a > "\x7f" or b > "\x7f")

    def value(self, run: str, reading: bool = False) -> float:
        """What the corpus says of a run: low mutual information, support, and no control characters.

        High mutual information counts for nothing, as the characters of one garbled sequence only meet each other. For
        a reading as UTF-8, what is like a pair speaks for it too: a word that is always garbled has no pairs of its own.
        """
        worth, total = self.model.like if reading else self.model.worth, 0.0
        for a, b in zip(run, run[1:]):
            if a > "\x7f" or b > "\x7f":
                total += worth(a, b)
        return total - 2.0 * sum(1 for c in run if "\x80" <= c <= "\x9f")

    def without(self, old: tuple[float, int], now: int, share: float) -> tuple[float, int]:
        """(mutual information, texts) of a pair without the texts that a group's mix-up explains."""
        n = max(old[1] - math.ceil(share * now), 0)
        return old[0] + math.log((n + 1) / (old[1] + 1)), n

    def fits(self, s: str, k: int) -> bool:
        """Whether all of a text reads well with a group's mapping; letters that are right do so only here and there."""
        m = self.single[k]
        places = [(a, b) for a, b in zip(" " + s, s + " ") if ord(a) in m or ord(b) in m]
        known = sum(self.model.pair(a.translate(m), b.translate(m))[1] >= self.model.known_from for a, b in places)
        return known >= self.MOST * len(places)

    def single_holds(self, run: str, new: str, share: float = 0.0) -> bool:
        """Whether another single-byte reading is better supported at every character that it changes.

        With the share of a group's mix-up, the texts it explains don't count for what stands there.
        """
        pair = self.model.pair
        changed = [i for i, (a, b) in enumerate(zip(run, new)) if a != b]
        places = sorted({i for c in changed for i in (c - 1, c)})
        old = {i: pair(run[i], run[i + 1]) for i in places}
        now = {i: pair(new[i], new[i + 1]) for i in places}
        if share:
            old = {i: self.without(old[i], now[i][1], share) for i in places}
        known = [i for i in places if now[i][1] >= self.model.known_from]
        if len(known) < len(places) and (len(changed) < self.RUN or len(known) < self.MOST * len(places)):
            return False
        more = sum(math.log1p(now[i][1]) - math.log1p(old[i][1]) for i in places) / len(places)
        if more < self.SUPPORT:
            return False
        if len(changed) >= self.RUN and more >= 1.5 * self.SUPPORT and sum(now[i][1] > old[i][1] for i in places) >= self.MOST * len(places):
            return True
        if len(known) < len(places):
            return False
        if any(n > self.model.rare_to for _, n in old.values()):
            return False  # a few characters that stand like this in many texts
        if more >= self.FAR:
            return True
        if any(old[i][0] > self.ODD or now[i][0] < old[i][0] - 0.2 for i in places):
            return False
        return sum(now[i][0] - old[i][0] for i in places) >= self.GAIN

    def whole(self, runs: list[str], held: set[int]) -> dict[int, int]:
        """The single-byte mapping that reads all of a text's runs best, among those that agree with one that held.

        What held for one run may leave characters alone that look right there and are wrong elsewhere.
        """
        own = {ord(c) for r in runs for c in r if c > "\x7f"}
        sure = [{c: m[c] for c in own if c in m} for m in (self.single[k] for k in held)]
        tried: list[dict[int, int]] = []
        for m in self.single:
            part = {c: m[c] for c in own if c in m}
            if part not in tried and any(s.items() <= part.items() for s in sure):
                tried.append(part)
        # the value of a run is a sum over its pairs, so those of all runs are counted first; the ends of a run are context
        pairs = Counter((a, b, i > 0, i + 2 < len(r)) for r in runs for i, (a, b) in enumerate(zip(r, r[1:])) if a > "\x7f" or b > "\x7f")
        controls = Counter(c for r in runs for c in r[1:-1] if "\x80" <= c <= "\x9f")

        def score(m: dict[int, int]) -> float:
            total = -2.0 * sum(n for c, n in controls.items() if ord(c) not in m)
            for (a, b, left, right), n in pairs.items():
                total += n * self.model.worth(a.translate(m) if left else a, b.translate(m) if right else b)
            return total

        return max(tried, key=score, default={})

    def between(self, s: str, a: int, b: int, mapping: dict[int, int]) -> str:
        """A stretch of text with those clusters of characters beyond ASCII mapped that the corpus supports better so."""
        out, last = [], a
        for m in CLUSTER.finditer(s, a, b):
            lead, tail = s[m.start() - 1] if m.start() else " ", s[m.end()] if m.end() < len(s) else " "
            x = m[0].translate(mapping)
            if x != m[0] and self.value(lead + x + tail) > self.value(lead + m[0] + tail):
                out += [s[last : m.start()], x]
                last = m.end()
        return "".join([*out, s[last:b]])

    def best(self, run: str) -> tuple[str, int]:
        """(the reading of a run that the corpus supports best, the single-byte mapping that gave it or -1).

        The first and last character are context and stay.
        """
        got = self.found.get(run)
        if got is None:
            if len(self.found) > 200_000:
                self.found.clear()
            got = self.found[run] = self._best(run)
        return got

    def _best(self, run: str) -> tuple[str, int]:
        start = self.value(run)
        top, top_value, front = run, start, [(run, 0.0)]
        for _ in range(DEPTH):
            new: dict[str, float] = {}
            for r, had in front:
                for x, weight in self.utf8(r):
                    new[x] = max(new.get(x, 0.0), had + weight)
            for x, weight in new.items():
                v = self.value(x, True) + weight
                if v > top_value + self.UTF_GAIN:
                    top, top_value = x, v
            front = list(new.items())
            if not front:
                break
        if top != run:
            return top, -1
        if sum(c > "\x7f" for c in run) >= LEAST:
            double = max(self.wide(run), key=self.mean, default=run)
            if double != run:
                return double, -1
        which, top_value = -1, start
        for k in self.different("".join(sorted({c for c in run[1:-1] if c > "\x7f"}))):
            x = run[0] + run[1:-1].translate(self.single[k]) + run[-1]
            if self.single_holds(run, x, self.mixed.get(k, 0.0)) and (v := self.value(x)) > top_value:
                top, top_value, which = x, v, k
        return top, which

    def different(self, own: str) -> list[int]:
        """The single-byte mappings that make something else of these characters, one for each outcome."""
        got = self.outcomes.get(own)
        if got is None:
            if len(self.outcomes) > 100_000:
                self.outcomes.clear()
            made = {own: -1}
            for k in sorted(range(len(self.single)), key=lambda k: k not in self.mixed):
                made.setdefault(own.translate(self.single[k]), k)
            got = self.outcomes[own] = [k for k in made.values() if k >= 0]
        return got


    def alone(self, around: str) -> str:
        """What a character that stands alone was in another single-byte encoding, itself if nothing speaks for that:
        hardly any text holds it between these neighbours, and many hold the other, pair by pair too."""
        got = self.stood.get(around)
        if got is None:
            if len(self.stood) > 200_000:
                self.stood.clear()
            c, model = around[2], self.model
            got, most, old = c, 0.0, model.place(around)
            if old <= model.rare_to:
                for t in {m[ord(c)] for m in self.single if ord(c) in m}:
                    n = model.place(around[:2] + chr(t) + around[3:])
                    better = all(model.pair(*new)[1] > max(model.pair(*was)[1], model.known_from) for new, was in ((around[1] + chr(t), around[1:3]), (chr(t) + around[3], around[2:4])))
                    if better and n > most and n >= 2 * model.known_from and math.log1p(n) - math.log1p(old) >= self.ALONE:
                        got, most = chr(t), n
            self.stood[around] = got
        return got

    def loners(self, s: str, a: int, b: int) -> str:
        """A stretch of text with its lone characters as they were."""
        out, last = [], a
        for m in CLUSTER.finditer(s, a, b):
            i = m.start()
            if m.end() == i + 1 and (not i or s[i - 1] < "\x80") and (i + 1 == len(s) or s[i + 1] < "\x80"):
                # five characters with blanks beyond the ends, as in the counts
                c = self.alone((s[max(i - 2, 0) : i].rjust(2) + s[i : i + 3]).ljust(5))
                if c != s[i]:
                    out += [s[last:i], c]
                    last = i + 1
        return "".join([*out, s[last:b]])


def mixups(model: Model) -> dict[int, float]:
    """The single-byte mappings that a whole group of texts needs, by number: how many texts with a garbled pair there
    are at most for each with the restored one.

    Where one source was decoded with the wrong code page, its pairs are frequent, but each occurs about as often beside
    the restored one as any other does. Letters that are right only meet some of the same neighbours. Which of two
    groups is the garbled one can't be seen from pairs; it is taken to be the smaller.
    """
    fix, found = Repair(model), {}
    ascii_ = np.array([c for c in range(32, 127) if not 49 <= c <= 57])
    for k, m in enumerate(fix.single):
        c = np.array(list(m))
        t = np.array(list(m.values()))
        often = model.singles[char_slot(c)] > model.rare_to
        if not often.any():
            continue
        x, y = np.concatenate([c, ascii_]), np.concatenate([t, ascii_])
        own = np.concatenate([often, np.zeros(len(ascii_), bool)])
        i, j = np.nonzero(own[:, None] | own[None, :])
        now = model.pairs[pair_slot(y[i], y[j])].astype(float)
        i, j, now = (z[now > model.rare_to] for z in (i, j, now))
        if len(now) < Repair.PROFILE:
            continue
        old = model.pairs[pair_slot(x[i], x[j])].astype(float)
        enough = now * (old.sum() / now.sum()) >= 5  # else chance decides whether the pair is there
        if enough.sum() < Repair.PROFILE:
            continue
        low, mid, high = np.quantile(old[enough] / now[enough], (0.1, 0.5, 0.9))
        if 0 < low and mid <= Repair.EVEN * low and mid < 1:  # upwards, letters that are right add to some pairs
            found[k] = float(min(high, 2 * mid))
    return found


class Sequences:
    """Where characters are a UTF-8 sequence of a known character to one of the wrong decoders, however frequent it is."""

    def __init__(self, fix: Repair):
        self.known = fix.model.singles >= fix.model.known_from
        self.known[:128] = False
        self.known[0xFEFF] = True
        #: For each length the decoders to which a character is a leading byte, and those to which it goes on; as bits.
        self.lead, self.more = {k: np.zeros(1 << 16, np.uint32) for k in (2, 3, 4)}, np.zeros(1 << 16, np.uint32)
        self.bytes = np.zeros((len(fix.back), 1 << 16), np.int32)
        for d, m in enumerate(fix.back):
            for c, b in list(m.items()):
                if b > 0xFF or c > 0xFFFF:
                    continue
                self.bytes[d, c] = b
                if b < 0xC0:
                    self.more[c] |= np.uint32(1 << d)
                elif 0xC2 <= b < 0xF5:
                    self.lead[2 if b < 0xE0 else 3 if b < 0xF0 else 4][c] |= np.uint32(1 << d)

    def pairs(self, cp: np.ndarray) -> np.ndarray:
        """Whether each character and the next belong to such a sequence."""
        out = np.zeros(len(cp), bool)
        c = np.where(cp > 0xFFFF, 0, cp)
        high = np.flatnonzero(c > 127)
        for k, lead in self.lead.items():
            at = high[(lead[c[high]] != 0) & (high < len(c) - k + 1)]
            who = lead[c[at]]
            for i in range(1, k):
                who = who & self.more[c[at + i]]
                at, who = at[who != 0], who[who != 0]
            for d in range(len(self.bytes)):
                own = at[who >> np.uint32(d) & np.uint32(1) == 1]
                if not len(own):
                    continue
                got = self.bytes[d, c[own]] & (0x7F >> k)
                for i in range(1, k):
                    got = got << 6 | self.bytes[d, c[own + i]] & 0x3F
                right = (got >= {2: 0x80, 3: 0x800, 4: 0x10000}[k]) & (got < len(self.known)) & ((got < 0xD800) | (got > 0xDFFF))
                own = own[right & self.known[np.where(right, got, 0)]]
                for i in range(k - 1):
                    out[own + i] = True
        return out


def suspects(model: Model, raw: np.ndarray, offsets: np.ndarray, floor: float, fix: Repair | None = None) -> dict[int, list[tuple[int, int]]]:
    """Runs under suspicion of each text: ranges of its characters, without ASCII at either end."""
    cp, owner = text_marks(raw, offsets)
    folded = fold(cp)
    two = np.flatnonzero((cp[:-1] > 127) | (cp[1:] > 127))
    if not len(two):
        return {}
    info, n = model.scores(folded[two], folded[two + 1])
    bad = np.where(n <= model.doubt_to, np.maximum(floor - info, Repair.RARE), floor - info)
    if fix is not None:  # no frequency exempts these
        odd = fix.sequences.pairs(cp)[two]
        for k, share in fix.mixed.items():
            to = np.arange(1 << 16)
            to[list(fix.single[k])] = list(fix.single[k].values())
            a, b = (np.where(folded[x] < 1 << 16, to[np.minimum(folded[x], 0xFFFF)], folded[x]) for x in (two, two + 1))
            now = model.pairs[pair_slot(a, b)]
            odd |= ((a != folded[two]) | (b != folded[two + 1])) & (now >= model.known_from) & (n - share * now <= model.doubt_to)
        bad = np.where(odd, np.maximum(bad, Repair.RARE), bad)
    text = owner[np.where(cp[two] > 127, two, two + 1)]
    worth = np.unique(text[bad > 0])
    begin = np.searchsorted(owner, np.arange(len(offsets) - 1))
    out: dict[int, list[tuple[int, int]]] = {}
    for t in worth.tolist():
        a, b = np.searchsorted(text, [t, t + 1])
        place = two[a:b]
        start = int(begin[t]) + (1 if t == 0 else 0)
        spans = []
        for x, y in segments(place, bad[a:b], 0.2):
            lo, hi = int(place[x]), int(place[y]) + 2
            # out to the ends of the cluster of characters beyond ASCII
            while lo > start and cp[lo - 1] > 127 and cp[lo] > 127:
                lo -= 1
            while hi < len(cp) and owner[hi] == t and cp[hi - 1] > 127 and cp[hi] > 127:
                hi += 1
            spans.append((max(lo - start, 0), hi - start))
        out[t] = spans
    return out


def repair(df: DataFrame, key: str, text: str, out: str = "restored") -> DataFrame:
    """(key, out, lost): the texts in which a wrong decoding was found, and what they were.

    ``out`` has every run restored for which a reading was found; ``lost`` tells whether characters remain that the
    wrong decoding destroyed. Null and empty texts are never found; a text delivered twice is found twice; other columns
    are left out; an empty table gives an empty table.
    """
    spark = df.sparkSession
    counts = statistics(df, text)
    handle = spark.sparkContext.broadcast((counts, mixups(Model(*counts))))
    rows = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).filter("t IS NOT NULL")
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches):
        counts, mixed = handle.value
        fix = Repair(Model(*counts), mixed)
        for batch in batches:
            raw, offsets = string_buffers(batch.column(1))
            where, what, lost = [], [], []
            for a, b in slices(offsets):
                part, off = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                if not len(part) or part.max() < 128:
                    continue
                for t, s in restored(fix, part, off):
                    where.append(a + t)
                    what.append(s)
                    lost.append("�" in s)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(where, pa.int64())), pa.array(what, pa.string()), pa.array(lost, pa.bool_())], [key, out, "lost"])

    return rows.mapInArrow(run, f"`{key}` {kind}, `{out}` string, lost boolean")


def restored(fix: Repair, raw: np.ndarray, offsets: np.ndarray) -> list[tuple[int, str]]:
    """(text, restored) of the garbled ones among texts that lie one after another in ``raw``."""
    found = []
    runs = suspects(fix.model, raw, offsets, fix.FLOOR, fix)
    marks = raw.tobytes()
    for t in range(len(offsets) - 1):
        piece = marks[offsets[t] : offsets[t + 1]]
        gone = b"\xef\xbf\xbd" in piece
        if t not in runs and not gone:
            continue
        s = piece.decode("utf-8")
        cut, last, held, fit = [], 0, set(), {}
        for a, b in runs.get(t, []):
            a, b = max(a, last), min(b, len(s))
            if a < b:
                # a character of context on either side
                run = (s[a - 1] if a else " ") + s[a:b] + (s[b] if b < len(s) else " ")
                new, which = fix.best(run)
                if which in fix.mixed and fit.setdefault(which, None) is None:
                    fit[which] = fix.fits(s, which)
                if not fit.get(which, True):
                    new, which = run, -1
                if new == run:
                    new = run[0] + fix.loners(s, a, b) + run[-1]
                cut.append((a, b, run, new, which))
                held.add(which)
                last = b
        held.discard(-1)
        whole = fix.whole([run for _, _, run, new, which in cut if which >= 0 or new == run], held) if held else {}
        singles = [b for _, b, _, _, which in cut if which >= 0]
        parts, last = [], 0
        for a, b, run, new, which in cut:
            if whole and (which >= 0 or new == run):  # one mapping made the text what it is, so one undoes it
                x = run[0] + run[1:-1].translate(whole) + run[-1]
                if fix.value(x) > fix.value(new):
                    new = x
            between = s[last:a]
            if whole and singles and singles[0] <= a <= singles[-1]:  # what looks right between such runs comes from there too
                between = fix.between(s, last, a, whole)
            if new[-1] == run[-1]:
                parts += [between, new[1:-1]]
                last = b
            else:  # the reading took the character after the run
                parts += [between, new[1:]]
                last = b + 1
        new = "".join([*parts, s[last:]])
        if new != s or gone:
            found.append((t, new))
    return found


codecs.lookup("mac-roman")  # fail early where the codecs are missing
