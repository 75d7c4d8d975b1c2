"""What changed between full snapshots of a table.

Keys get persistent ordinals. A snapshot is then a compressed bitmap of the ordinals in it, in blocks of 2^15, and a
vector of value digests aligned with the bitmap. AND-NOT of two bitmaps gives additions and removals; where both have
a bit, different digests mark changes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from pinfold.operators.ranks import number_rows
from pinfold.scratch import materialize
from pinfold.session import ship

BLOCK_BITS = 15
BLOCK = 1 << BLOCK_BITS


class Bitmap:
    """A set of ordinals within one block: a sorted list while that is smaller than the bits, else the bits."""

    __slots__ = ("array", "bits")
    LIST_TO = BLOCK // 16

    def __init__(self, array: np.ndarray | None = None, bits: np.ndarray | None = None):
        self.array, self.bits = array, bits

    @classmethod
    def of(cls, ordinals: np.ndarray) -> Bitmap:
        ordinals = np.unique(ordinals).astype(np.uint16)
        if len(ordinals) <= cls.LIST_TO:
            return cls(array=ordinals)
        flags = np.zeros(BLOCK, bool)
        flags[ordinals] = True
        return cls(bits=np.packbits(flags))

    def ordinals(self) -> np.ndarray:
        return self.array if self.bits is None else np.flatnonzero(np.unpackbits(self.bits)).astype(np.uint16)

    def _flags(self) -> np.ndarray:
        if self.bits is not None:
            return self.bits
        flags = np.zeros(BLOCK, bool)
        flags[self.array] = True
        return np.packbits(flags)

    def and_not(self, other: Bitmap) -> np.ndarray:
        if self.bits is None and other.bits is None:
            return np.setdiff1d(self.array, other.array, assume_unique=True)
        return np.flatnonzero(np.unpackbits(self._flags() & ~other._flags()))

    def both(self, other: Bitmap) -> np.ndarray:
        if self.bits is None and other.bits is None:
            return np.intersect1d(self.array, other.array, assume_unique=True)
        return np.flatnonzero(np.unpackbits(self._flags() & other._flags()))


def ordinals(keys: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(*key columns, ordinal) for the distinct keys. ``existing`` ordinals stay; new keys continue after the last one."""
    cols = keys.columns
    order = [F.col(c).asc_nulls_first() for c in cols]
    distinct = keys.distinct()
    if existing is None:
        return number_rows(distinct, order, "ordinal")
    old = existing.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(cols)], "ordinal")
    same = [F.col(c).eqNullSafe(F.col(f"__{i}")) for i, c in enumerate(cols)]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    new = distinct.join(old, cond, "left_anti")
    last = existing.agg(F.max("ordinal")).first()[0]
    return existing.select(*cols, "ordinal").unionByName(number_rows(new, order, "ordinal", start=0 if last is None else last + 1))


def changes(
    rows: DataFrame, scope: list[str], period: Column, key: str, value: Column, existing: DataFrame | None = None
) -> DataFrame:
    """(*scope, key, period_from, period_to, change): added, removed and changed keys between consecutive snapshots.

    The rows of one scope and period are that period's snapshot; a scope's periods follow each other in the order of
    their text, and only periods with rows count. A key is changed if the sets of its values differ, whatever the order
    and however often a row was delivered; a null value is the empty one. Rows whose period or key is null (or whose
    period is empty) belong to no snapshot; a null scope column is a scope of its own. A scope with one period has no
    changes; an empty table gives none. Other columns are left out, whatever their names. The digests of value sets are
    128 bits of independent hashes and the number of values.
    """
    ship(rows.sparkSession)
    s = [f"s{i}" for i in range(len(scope))]
    own = [F.col(c).alias(n) for c, n in zip(scope, s)]
    facts = rows.select(*own, period.alias("p"), F.col(key).alias("k"), F.coalesce(value, F.lit("")).alias("v")).filter("p IS NOT NULL AND p <> '' AND k IS NOT NULL").distinct()
    state = facts.groupBy(*s, "p", "k").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("v")).alias("a"), F.bit_xor(F.xxhash64(F.concat(F.lit("\x01"), "v"))).alias("b")
    )
    state = materialize(state, "snapshots")
    every = ordinals(state.select(*s, "k"), existing)
    steps = Window.partitionBy(*s).orderBy("p")
    periods = state.select(*s, "p").distinct().withColumn("i", F.row_number().over(steps) - 1).withColumn("last", F.count("*").over(Window.partitionBy(*s)) - 1)

    def same(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        r = right.withColumnsRenamed({c: f"__{c}" for c in on})
        cond = F.lit(True)
        for c in on:
            cond = cond & F.col(c).eqNullSafe(F.col(f"__{c}"))
        return left.join(r, cond).drop(*[f"__{c}" for c in on])

    placed = same(same(state, every, [*s, "k"]), periods, [*s, "p"])
    scopes = F.xxhash64(*s) if s else F.lit(0).cast("bigint")
    cells = placed.select(F.shiftright("ordinal", BLOCK_BITS).alias("block"), scopes.alias("scope"), F.col("ordinal").bitwiseAND(F.lit(BLOCK - 1)).cast("int").alias("bit"), F.col("i").cast("int").alias("i"), F.col("last").cast("int").alias("last"), "n", "a", "b")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        block, out = int(pdf["block"].iloc[0]), []
        for _, part in pdf.groupby("scope", sort=False):
            maps: dict[int, Bitmap] = {}
            vectors: dict[int, np.ndarray] = {}
            for i, one in part.groupby("i", sort=False):
                bit = one["bit"].to_numpy()
                maps[i] = Bitmap.of(bit)
                vectors[i] = np.zeros((BLOCK, 3), np.int64)
                vectors[i][bit] = one[["n", "a", "b"]].to_numpy()
            none = Bitmap.of(np.zeros(0, np.int64))
            for i in range(int(part["last"].iloc[0])):
                before, after = maps.get(i, none), maps.get(i + 1, none)
                common = before.both(after)
                if len(common):
                    common = common[(vectors[i][common] != vectors[i + 1][common]).any(1)]
                for what, which in (("added", after.and_not(before)), ("removed", before.and_not(after)), ("changed", common)):
                    if len(which):
                        out.append(pd.DataFrame({"ordinal": which.astype(np.int64) + (block << BLOCK_BITS), "i": i, "change": what}))
        return pd.concat(out) if out else pd.DataFrame({"ordinal": [], "i": [], "change": []})

    # a block holds at most 2^15 keys with their periods
    found = cells.groupBy("block").applyInPandas(compare, "ordinal bigint, i int, change string")
    named = found.join(every, "ordinal")
    ends = same(periods.select(*s, F.col("i").cast("int").alias("i"), F.col("p").alias("period_from")), periods.select(*s, (F.col("i") - 1).cast("int").alias("i"), F.col("p").alias("period_to")), [*s, "i"])
    full = same(named, ends, [*s, "i"])
    return full.select(*[F.col(n).alias(c) for c, n in zip(scope, s)], F.col("k").alias(key), "period_from", "period_to", "change")
