"""Records that share most of their content (problem 1): MinHash banding, then verification on whole n-gram sets.

Texts with the same words in the same order form a class. One text of each class is signed; the signature is cut into
bands; classes that share a band's hash are candidates; a candidate pair is a link if the distinct n-grams of the two
whole texts overlap enough. The number of bands follows from the similarity, the rows of a band and the recall wanted
at exactly that similarity, above which the recall only grows.

Texts made alike meet in a band now and then though they are far from similar, and such pairs grow with the square of the
table. So each class carries the parities of its n-grams in a fixed number of cells: two classes differ in at most as many
cells as they differ in n-grams, hence a pair that differs in more cells than the similarity allows is dropped where it
meets. No similar pair is lost by it (unless 64-bit hashes of n-grams collide). Long texts fill all cells and pass.
"""

from __future__ import annotations

import math
import re
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pinfold.llm.pretokens import slices, string_buffers
from pinfold.scratch import drop, materialize, release_shuffles
from pinfold.session import ship

WORD = re.compile("[a-z0-9_]+")
#: Classes of more copies come out as a star around their smallest id instead of all their pairs, unless told otherwise.
COPIES = 256
#: Hashes of words that a worker remembers before it starts afresh; no result depends on it.
REMEMBER = 1_000_000
#: Numbers of 64 cells each that hold a text's parities; columns of the signatures.
PARITIES = ("p0", "p1", "p2")
#: Bands exchanged at a time, which bounds the disk that their rows take; no result depends on it.
BANDS_AT_ONCE = 17
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def bands_for(similarity: float, rows: int, recall: float) -> int:
    """Bands of ``rows`` hashes with which a pair of that similarity meets at least once with that probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


class _Words(dict):
    def __missing__(self, w: str) -> int:
        import xxhash

        h = self[w] = xxhash.xxh64_intdigest(w)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M[3]
    return x ^ (x >> np.uint64(29))


def parities(grams: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of distinct n-grams, the parities of their numbers in each cell as rows of int64) of texts of so many hashes each."""
    cells = 64 * len(PARITIES)
    low = np.uint64(64 - max(1, int(len(sizes)).bit_length()))
    text = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
    keys = np.sort(text << low | grams >> (np.uint64(64) - low))
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    text = (keys >> low).astype(np.int64)
    top = (keys & ((np.uint64(1) << low) - np.uint64(1))) >> (low - np.uint64(32))
    cell = (top * np.uint64(cells) >> np.uint64(32)).astype(np.int64)
    odd = (np.bincount(text * cells + cell, minlength=cells * len(sizes)) & 1).astype(np.uint8)
    return np.bincount(text, minlength=len(sizes)), np.packbits(odd.reshape(len(sizes), cells), axis=1).view(np.int64)


def sign(texts: list[str], memory: _Words, n: int, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places of the texts of at least n words, their 128-bit digests as two columns, their bands' hashes, their numbers of distinct n-grams, their parities)."""
    import xxhash

    found = [WORD.findall(t.lower()) for t in texts]
    own = [i for i, w in enumerate(found) if len(w) >= n]
    if not own:
        return np.zeros(0, np.int64), np.zeros((0, 2), np.int64), np.zeros((0, bands), np.int64), np.zeros(0, np.int64), np.zeros((0, len(PARITIES)), np.int64)
    sizes = np.array([len(found[i]) for i in own])
    flat = np.fromiter((memory[w] for i in own for w in found[i]), np.uint64, int(sizes.sum()))
    ends = np.cumsum(sizes)
    raw = flat.tobytes()
    digest = np.array([[d >> 64, d & 0xFFFFFFFFFFFFFFFF] for d in (xxhash.xxh3_128_intdigest(raw[8 * (e - s) : 8 * e]) for s, e in zip(sizes.tolist(), ends.tolist()))], np.uint64)
    grams = np.zeros(len(flat) - n + 1, np.uint64)
    for k in range(n):
        grams = _mix(grams + flat[k : len(flat) - n + 1 + k] * _M[k % 3])
    keep = np.ones(len(grams), bool)
    for k in range(1, n):
        at = ends[:-1] - k
        keep[at] = False
    grams = grams[keep]
    first = np.concatenate([[0], np.cumsum(sizes - n + 1)[:-1]])
    rng = np.random.default_rng(20240229)  # the hash functions, fixed
    factors = rng.integers(1, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 1 << 63, bands * rows, np.uint64)
    out = np.zeros((len(own), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(own), (b + 1) * 0x9E3779B9, np.uint64)
        for r in range(rows):
            k = b * rows + r
            h = _mix(h * _M[1] + np.minimum.reduceat(grams * factors[k] + shifts[k], first))
        out[:, b] = h
    return np.array(own), digest.view(np.int64), out.view(np.int64), *parities(grams, sizes - n + 1)


def signatures(df: DataFrame, text: str, n: int, bands: int, rows: int) -> DataFrame:
    """(id, raw, hi, lo, n, parities, bands) of the rows (id, text) whose text has n words or more; ``raw`` tells an id's texts apart."""
    ship(df.sparkSession)

    def run(batches):
        memory = _Words()
        for batch in batches:
            _, offsets = string_buffers(batch.column(2))
            for a, b in slices(offsets):
                if len(memory) > REMEMBER:
                    memory.clear()
                texts = batch.column(2).slice(a, b - a).to_pylist()
                own, digest, hashes, grams, odd = sign(texts, memory, n, bands, rows)
                keys = [c.slice(a, b - a).take(pa.array(own)) for c in (batch.column(0), batch.column(1))]
                each = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * bands), pa.array(hashes.ravel()))
                numbers = [pa.array(np.ascontiguousarray(c)) for c in (*digest.T, grams.astype(np.int32), *odd.T)]
                yield pa.RecordBatch.from_arrays([*keys, *numbers, each], ["id", "raw", "hi", "lo", "n", *PARITIES, "bands"])

    schema = f"id string, raw bigint, hi bigint, lo bigint, n int, {', '.join(f'{p} bigint' for p in PARITIES)}, bands array<bigint>"
    return _texts(df, text).select("id", "raw", "text").mapInArrow(run, schema)


def _texts(df: DataFrame, text: str) -> DataFrame:
    return df.select("id", F.xxhash64(text).alias("raw"), F.col(text).alias("text")).filter("text IS NOT NULL AND id IS NOT NULL")


def gram_set(text: str, n: int) -> set:
    w = WORD.findall(text.lower())
    return set(zip(*(w[k:] for k in range(n))))


def candidates(signed: DataFrame, similarity: tuple[int, int], bands: int, count: int) -> DataFrame:
    """(ca, cb), ca < cb: the classes that share a band's hash and that their sizes and parities let be similar enough."""
    num, den = similarity
    met = []
    for at in range(0, bands, BANDS_AT_ONCE):
        some = min(BANDS_AT_ONCE, bands - at)
        classes = signed.groupBy("hi", "lo").agg(F.first(F.struct("n", *PARITIES, F.slice("bands", at + 1, some).alias("bands"))).alias("one"))
        hashes = classes.select(F.col("hi").alias("c"), "one.n", *(f"one.{p}" for p in PARITIES), F.explode("one.bands").alias("b"))
        apart = " + ".join(f"bit_count(x.{p} ^ y.{p})" for p in PARITIES)
        # J >= num/den means: |A - B| + |B - A| <= (den - num) / (den + num) * (|A| + |B|)
        near = f"{den + num}L * ({apart}) <= {den - num}L * (x.n + y.n) AND {den}L * least(x.n, y.n) >= {num}L * greatest(x.n, y.n)"
        # one exchange serves both sides; hot hashes are split by the adaptive skew join
        meet = hashes.alias("x").join(hashes.alias("y"), F.expr(f"x.b = y.b AND x.c < y.c AND {near}"))
        shuffled = 2 * (20 + 8 * len(PARITIES)) * some * count  # both sides read a hash, a class, its size and parities for every band
        met.append(materialize(meet.select(F.col("x.c").alias("ca"), F.col("y.c").alias("cb")).distinct(), "met", shuffled))
        release_shuffles(signed.sparkSession)
    pairs = materialize(reduce(DataFrame.unionByName, met).distinct(), "candidates", 16 * bands * count // 4)
    for m in met:
        drop(m)
    return pairs


def links(df: DataFrame, text: str, similarity: tuple[int, int] = (3, 5), n: int = 3, rows: int = 4, recall: float = 0.99) -> tuple[DataFrame, DataFrame]:
    """(members, links) of rows (id, text).

    members: (id, hi, lo), the class of every id with a text of n words or more. links: (hi_a, lo_a, hi_b, lo_b, common,
    either), each pair of different classes whose similarity, a fraction of whole numbers, is reached, once.
    A row delivered twice is one member; an id with two different texts is a member of two classes.
    """
    num, den = similarity
    bands = bands_for(num / den, rows, recall)
    signed = materialize(signatures(df, text, n, bands, rows), "signatures")
    members = signed.select("id", "hi", "lo").distinct()
    count = signed.count()
    pairs, shuffled = candidates(signed, similarity, bands, count), 2 * 16 * bands * count
    wanted = pairs.select(F.explode(F.array("ca", "cb")).alias("hi")).distinct()
    chosen = signed.select("id", "raw", "hi", "lo").join(wanted, "hi", "left_semi").groupBy("hi", "lo").agg(F.min(F.struct("id", "raw")).alias("one")).select("hi", "lo", "one.*")
    # an id may have several texts, so the class's own is told by its hash; a row delivered twice offers it twice
    texts = materialize(_texts(df, text).join(chosen, ["id", "raw"]).groupBy("hi", "lo").agg(F.max("text").alias("text")), "texts", shuffled // 4)
    release_shuffles(df.sparkSession)
    a = texts.select(F.col("hi").alias("ca"), F.col("lo").alias("lo_a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("hi").alias("cb"), F.col("lo").alias("lo_b"), F.col("text").alias("text_b"))
    both = pairs.join(a, "ca").join(b, "cb").select(F.col("ca").alias("hi_a"), "lo_a", F.col("cb").alias("hi_b"), "lo_b", "text_a", "text_b")

    def verify(frames):
        for pdf in frames:
            sets: dict[tuple[int, int], set] = {}

            def of(key: tuple[int, int], body: str) -> set:
                if key not in sets:
                    if len(sets) > 2000:
                        sets.clear()
                    sets[key] = gram_set(body, n)
                return sets[key]

            common, either = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            for i, (ha, la, hb, lb, ta, tb) in enumerate(pdf.itertuples(index=False, name=None)):
                p, q = of((ha, la), ta), of((hb, lb), tb)
                common[i] = len(p & q)
                either[i] = len(p) + len(q) - common[i]
            ok = (den * common >= num * either) & (either > 0)
            yield pdf[["hi_a", "lo_a", "hi_b", "lo_b"]].assign(common=common, either=either)[ok]

    found = materialize(both.mapInPandas(verify, "hi_a bigint, lo_a bigint, hi_b bigint, lo_b bigint, common bigint, either bigint"), "links", shuffled // 2)
    return members, found


def duplicate_pairs(df: DataFrame, text: str, copies: int | None = COPIES, **how) -> DataFrame:
    """(id_a, id_b): the pairs of different ids whose texts are similar enough, smaller string first, once per pair.

    Null, empty and short texts (under n words) are in no pair; a row delivered twice makes no pair with itself; an
    empty table gives no pair. A class of more than ``copies`` ids (the same words throughout) comes out as pairs of its
    smallest id with each other member, and that id alone stands for it in pairs with other classes; up to ``copies`` ids,
    or if it is None, every pair comes out. ``duplicate_classes`` has the members by which the others can be told.
    """
    members, found = links(df, text, **how)
    members = materialize(members, "members")
    most = 2**62 if copies is None else copies
    sizes = members.groupBy("hi", "lo").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    many = sizes.filter("n > 1")
    within = members.join(many, ["hi", "lo"])
    star = within.filter(f"n > {most} AND id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    few = within.filter(f"n <= {most}")
    x, y = few.select("hi", "lo", F.col("id").alias("a")), few.select("hi", "lo", F.col("id").alias("b"))
    inside = x.join(y, ["hi", "lo"]).filter("a < b").select("a", "b")
    outer = members.join(sizes, ["hi", "lo"]).filter(f"n <= {most} OR id = first").select("hi", "lo", "id")
    left = outer.select(F.col("hi").alias("hi_a"), F.col("lo").alias("lo_a"), F.col("id").alias("a"))
    right = outer.select(F.col("hi").alias("hi_b"), F.col("lo").alias("lo_b"), F.col("id").alias("b"))
    across = found.join(left, ["hi_a", "lo_a"]).join(right, ["hi_b", "lo_b"]).select("a", "b")
    every = star.unionByName(inside).unionByName(across).filter("a <> b")
    return every.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()


def duplicate_classes(df: DataFrame, text: str, **how) -> DataFrame:
    """(id, class, copies, links): the class of each id with a long enough text, named by the smallest id in it, how many
    ids have its very words, and to how many other classes it is similar enough.

    Together with the pairs between the names this says all that the pairs of all ids do. An id with two texts is in two
    classes, and a class of few words, null and empty texts are in none.
    """
    members, found = links(df, text, **how)
    members = materialize(members, "members")
    sizes = members.groupBy("hi", "lo").agg(F.count("*").alias("copies"), F.min("id").alias("class"))
    ends = found.select(F.explode(F.array(F.struct(F.col("hi_a").alias("hi"), F.col("lo_a").alias("lo")), F.struct(F.col("hi_b").alias("hi"), F.col("lo_b").alias("lo")))).alias("c"))
    degree = ends.groupBy("c.hi", "c.lo").agg(F.count("*").alias("links"))
    return members.join(sizes.join(degree, ["hi", "lo"], "left"), ["hi", "lo"]).select("id", "class", "copies", F.coalesce("links", F.lit(0)).alias("links"))


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, label): the smallest node reachable over ``edges`` (a, b), for every node on an edge.

    Each round links every node's larger neighbours to its smallest one, then its smaller ones too; the edges become
    stars around the smallest node of each component in a number of rounds that grows with the logarithm of the size.
    """
    now = materialize(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a")
        new = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        new = materialize(new, "edges")
        change = new.join(now.select("a", "b"), ["a", "b"], "left_anti").limit(1).count() + now.join(new, ["a", "b"], "left_anti").limit(1).count()
        drop(now)
        now = new
        if not change:
            break
    else:
        raise RuntimeError("components didn't settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def duplicate_groups(df: DataFrame, text: str, **how) -> DataFrame:
    """(id, group, copies): each id's group, named by the smallest id in it, and the ids that have its very words.

    Every id of the table comes out once; those without a similar partner, short, empty and null texts included, are
    groups of their own.
    """
    members, found = links(df, text, **how)
    members = materialize(members, "members")
    sizes = members.groupBy("hi", "lo").agg(F.count("*").alias("copies"), F.min("id").alias("first"))
    left = sizes.select(F.col("hi").alias("hi_a"), F.col("lo").alias("lo_a"), F.col("first").alias("a"))
    right = sizes.select(F.col("hi").alias("hi_b"), F.col("lo").alias("lo_b"), F.col("first").alias("b"))
    across = found.join(left, ["hi_a", "lo_a"]).join(right, ["hi_b", "lo_b"]).select("a", "b")
    own = members.join(sizes, ["hi", "lo"])
    edges = across.unionByName(own.select(F.col("first").alias("a"), F.col("id").alias("b")))
    label = components(edges)
    copies = own.groupBy("id").agg(F.max("copies").alias("copies"))
    every = df.select("id").filter("id IS NOT NULL").distinct()
    out = every.join(label.withColumnRenamed("node", "id"), "id", "left").join(copies, "id", "left")
    return out.select("id", F.coalesce("label", "id").alias("group"), F.coalesce("copies", F.lit(1)).cast("bigint").alias("copies"))
