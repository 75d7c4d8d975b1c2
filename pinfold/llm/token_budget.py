"""Tokens per slice of a corpus under a public vocabulary (problem 5), by counting paths in a double-array trie.

Count-only Viterbi: every place of a segment holds the last token of the best path to it and that path's length. The
public vocabularies at hand are BPE, not unigram; what weighs a step there is not a score but whether two tokens can
stand side by side: a pair can if merging their bytes gives just these two. A path all of whose pairs can is the BPE
encoding, and every place has exactly one, so the counts are the tokenizer's own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from pinfold.llm.bpe import REMEMBER, WIDTH, Vocabulary, key_hash, key_words, merge, vocabulary
from pinfold.llm.encode import pieces
from pinfold.llm.pretokens import slices, token_starts
from pinfold.session import ship


class Trie:
    """A double-array trie: the child of node s by byte c is base[s] + c if check says that it belongs to s."""

    def __init__(self, ranks: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        token = [-1]
        for t, r in ranks.items():
            s = 0
            for c in t:
                nxt = children[s].get(c)
                if nxt is None:
                    nxt = children[s][c] = len(children)
                    children.append({})
                    token.append(-1)
                s = nxt
            token[s] = r
        size = 2 * len(children) + 512
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used = bytearray(size)
        used[0] = 1
        place, free = {0: 0}, 1
        todo = [0]
        for s in todo:
            kids = sorted(children[s])
            if not kids:
                continue
            while used[free]:
                free += 1
            b = max(1, free - kids[0])
            while any(used[b + c] for c in kids):
                b += 1
            at = place[s]
            base[at] = b
            for c in kids:
                child = children[s][c]
                place[child] = b + c
                used[b + c], check[b + c], value[b + c] = 1, at, token[child]
                todo.append(child)
        self.base, self.check, self.value = base, check, value


class Counts:
    """Counts tokens of texts; remembers segments and pairs of tokens between the tasks of a worker."""

    def __init__(self, vocab: Vocabulary, trie: Trie):
        self.v = vocab
        self.base, self.check, self.value = trie.base.tolist(), trie.check.tolist(), trie.value.tolist()
        self.bytes = {r: t for t, r in vocab.ranks.items()}
        self.seen: dict[bytes, int] = {}
        self.pairs: dict[int, bool] = {}

    def beside(self, a: int, b: int) -> bool:
        key = a << 20 | b
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) > 4 * REMEMBER:
                self.pairs.clear()
            got = self.pairs[key] = merge(self.bytes[a] + self.bytes[b], self.v.ranks) == [a, b]
        return got

    def path(self, piece: bytes) -> int:
        """The length of the best path through the segment."""
        base, check, value, n = self.base, self.check, self.value, len(piece)
        last, count = [-1] * (n + 1), [0] * (n + 1)
        for i in range(n):
            prev = last[i]
            if prev < 0 and i:
                continue
            s = 0
            for j in range(i, n):
                t = base[s] + piece[j]
                if check[t] != s:
                    break
                s = t
                v = value[s]
                if v >= 0 and last[j + 1] < 0 and (not i or self.beside(prev, v)):
                    last[j + 1], count[j + 1] = v, count[i] + 1
        return count[n]

    def length(self, piece: bytes) -> int:
        got = self.seen.get(piece)
        if got is None:
            if len(self.seen) >= REMEMBER:
                self.seen.clear()
            got = self.seen[piece] = self.path(piece)
        return got

    def texts(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text of a buffer."""
        out = np.zeros(len(offsets) - 1, np.int64)
        for a, b in slices(offsets):
            part, off = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            begin = token_starts(part, off, self.v.table)
            size = np.diff(np.append(begin, len(part)))
            many = np.zeros(len(begin), np.int64)
            short = np.flatnonzero(size <= WIDTH)
            words = key_words(part, begin[short], size[short])
            h = key_hash(words, size[short])
            _, one, back = np.unique(h, return_index=True, return_inverse=True)
            own = short[one]
            each = np.array([self.length(part[x : x + s].tobytes()) for x, s in zip(begin[own].tolist(), size[own].tolist())], np.int64)
            if len(short):
                many[short] = each[back]
                same = (words == words[:, one[back]]).all(0) & (size[short] == size[own[back]])
                rest = [*short[~same].tolist(), *np.flatnonzero(size > WIDTH).tolist()]  # another segment with that hash; long ones
            else:
                rest = range(len(begin))
            for i in rest:
                many[i] = self.length(part[begin[i] : begin[i] + size[i]].tobytes())
            total = np.concatenate([[0], np.cumsum(many)])
            out[a:b] = np.diff(total[np.searchsorted(begin, off)])
        return out


_COUNTS: list[tuple[object, Counts]] = []  # the last broadcast value of this worker and its counter
_TRIES: list[tuple[object, Trie]] = []  # the driver's


def path_counts(df: DataFrame, text: str, out: str, path: str | None = None) -> DataFrame:
    """The columns of ``df`` but for the text, and ``out``: the tokens of the text; 0 for null and empty ones."""
    keep = [c for c in df.columns if c != text]
    if out in keep:
        raise ValueError(f"column {out} exists")
    spark = df.sparkSession
    ship(spark)
    v = vocabulary(path)
    if not _TRIES or _TRIES[0][0] is not v:
        _TRIES[:] = [(v, Trie(v.ranks))]
    handle = spark.sparkContext.broadcast((v, _TRIES[0][1]))  # as large as the vocabulary, under 10 MB
    rows = df.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = rows.drop("__text").schema.add(out, T.LongType())

    def run(batches):
        value = handle.value
        if not _COUNTS or _COUNTS[0][0] is not value:
            _COUNTS[:] = [(value, Counts(*value))]
        counts = _COUNTS[0][1]
        for batch in batches:
            for a, b, raw, offsets in pieces(batch, len(keep)):
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(keep))), pa.array(counts.texts(raw, offsets))], [*keep, out])

    return rows.mapInArrow(run, schema)


def token_budget(df: DataFrame, key: list[str], by: list[str], text: str, stored: str, when: str, path: str | None = None) -> DataFrame:
    """(*by, items, tokens, stored_tokens) of every slice, each item counted once.

    An item's last delivery by ``when`` counts (ties: the greatest row). Slices don't tell letter case or blanks apart;
    null and empty values are one slice, null. Null and empty texts have 0 tokens and are items; a null stored number
    counts as 0. An empty table gives no slices. Each row's text is counted where it lies; only numbers are shuffled.
    """
    rows = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(key)], *[F.nullif(F.lower(F.trim(c)), F.lit("")).alias(f"b{i}") for i, c in enumerate(by)], F.col(stored).cast("bigint").alias("stored"), F.col(when).alias("at"), F.col(text).alias("text"))
    counted = path_counts(rows, "text", "n", path)
    last = counted.groupBy(*[f"k{i}" for i in range(len(key))]).agg(F.max(F.struct("at", "stored", "n", *[f"b{i}" for i in range(len(by))])).alias("x"))
    return last.groupBy(*[F.col(f"x.b{i}").alias(c) for i, c in enumerate(by)]).agg(
        F.count("*").alias("items"), F.sum("x.n").alias("tokens"), F.coalesce(F.sum("x.stored"), F.lit(0)).alias("stored_tokens")
    )
