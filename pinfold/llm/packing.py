"""Filling containers of a fixed capacity (problem 8) by multiway differencing."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pinfold.scratch import materialize
from pinfold.session import ship

#: Items that are packed together; a group's slack is a few containers, so larger groups waste less and cost more.
GROUP = 2000


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp into ``k`` parts: the two partial partitions of the largest spread are merged, the largest part
    of one with the smallest of the other, until one is left. Gives the items of each part."""
    heap = [(-s, i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    # a partial partition: sums in descending order less the smallest, and a tree of items per part
    sums: dict[int, np.ndarray] = {}
    trees: dict[int, list] = {}

    def take(i: int) -> tuple[np.ndarray, list]:
        if i in sums:
            return sums.pop(i), trees.pop(i)
        v, t = np.zeros(k, np.int64), [None] * k
        v[0], t[0] = sizes[i], i
        return v, t

    new = len(sizes)
    while len(heap) > 1:
        (v, t), (w, u) = take(heapq.heappop(heap)[1]), take(heapq.heappop(heap)[1])
        v = v + w[::-1]
        order = np.argsort(-v, kind="stable")
        u.reverse()
        both = [(a, b) if a is not None and b is not None else (b if a is None else a) for a, b in zip(t, u)]
        v = v[order]
        sums[new], trees[new] = v - v[-1], [both[j] for j in order.tolist()]
        heapq.heappush(heap, (-int(sums[new][0]), new))
        new += 1
    parts = []
    for tree in take(heap[0][1])[1]:
        stack, part = [tree], []
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack += x
            elif x is not None:
                part.append(x)
        parts.append(part)
    return parts


def relieve(parts: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]] | None:
    """Exchanges single items (or moves one) out of parts that are too full; None if that doesn't suffice."""
    k, n = len(parts), len(sizes)
    size = np.array([*sizes, *[0] * k])  # an empty item in each part, to move against
    where = np.empty(n + k, np.int64)
    for j, p in enumerate(parts):
        where[p] = j
    where[n:] = np.arange(k)
    total = np.bincount(where, weights=size, minlength=k).astype(np.int64)
    for j in np.argsort(-total, kind="stable").tolist():
        while total[j] > capacity:
            over, best = total[j] - capacity, None
            room = (capacity - total)[where]
            for x in np.flatnonzero((where == j) & (size > 0)).tolist():
                d = size[x] - size
                ok = (d > 0) & (d <= room) & (where != j)
                enough = np.flatnonzero(ok & (d >= over))
                if len(enough):
                    y = enough[np.argmin(room[enough] - d[enough])]
                    cost = (0, int(room[y] - d[y]))
                elif ok.any():
                    some = np.flatnonzero(ok)
                    y = some[np.argmax(d[some])]
                    cost = (1, -int(d[y]))
                else:
                    continue
                if best is None or cost < best[0]:
                    best = cost, x, y
            if best is None:
                return None
            _, x, y = best
            a, b, d = where[x], where[y], size[x] - size[y]
            where[x], where[y] = b, a
            total[a] -= d
            total[b] += d
    out: list[list[int]] = [[] for _ in range(k)]
    for i in range(n):
        out[where[i]].append(i)
    return out


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers (lists of places in ``sizes``) for items that each fit alone.

    Differencing into as few windows as the total allows; windows filled up to a small tolerance are closed, the
    others are pooled and differenced anew. Where too few close, the tolerance grows, then the number of windows.
    """
    empty = [i for i, s in enumerate(sizes) if s == 0]
    pool = [i for i, s in enumerate(sizes) if s > 0]
    done: list[list[int]] = []
    tolerance, extra = max(1, capacity // 512), 0
    while pool:
        own = [sizes[i] for i in pool]
        k = min(len(pool), math.ceil(sum(own) / capacity) + extra)
        parts = differencing(own, k)
        full = [sum(own[j] for j in p) for p in parts]
        if max(full) > capacity:
            better = relieve(parts, own, capacity)
            if better is not None:
                parts, full = better, [0]
        if max(full) <= capacity:
            done += [[pool[j] for j in p] for p in parts]
            break
        close = [capacity - tolerance <= s <= capacity for s in full]
        if sum(close) < max(1, k // 20):
            if tolerance < capacity // 16:
                tolerance *= 2
            else:
                extra += 1
        done += [[pool[j] for j in p] for p, c in zip(parts, close) if c]
        pool = [pool[j] for p, c in zip(parts, close) if not c for j in p]
    if empty:
        if not done:
            done.append([])
        done[0] += empty
    return done


def containers(items: DataFrame, key: str, size: str, capacity: int, group: int = GROUP) -> DataFrame:
    """(key, piece, start, size, container): which part of each item lies in which container.

    An item of more than ``capacity`` is divided: full containers of its own, and a rest that is packed like an item.
    Any other item stays whole. Null and negative sizes count as 0; empty items lie in a container that others share
    (or in one of their own if there are no others). Repeated rows are items of their own. ``container`` is
    ``<group>-<number>``; container numbers depend on the order in which rows are read. Extra columns are left out.
    Groups are formed by row, so no key can make one large, and each is packed by one task.
    """
    spark = items.sparkSession
    ship(spark)
    n = F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0))
    kept = materialize(items.select(F.col(key).alias("key"), n.alias("n"), F.monotonically_increasing_id().alias("at")), "items")
    whole = F.greatest(F.ceil(F.col("n") / F.lit(capacity)).cast("bigint") - 1, F.lit(0))
    groups = max(1, math.ceil(kept.count() / group))
    kept = kept.withColumn("whole", whole).withColumn("g", F.pmod(F.xxhash64("at"), F.lit(groups)).cast("int"))
    full = kept.filter("whole > 0").select("key", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("whole") - 1)).alias("piece"), "at")
    full = full.select("key", F.col("piece").cast("int").alias("piece"), (F.col("piece") * capacity).alias("start"), F.lit(capacity).cast("bigint").alias("size"), F.concat(F.lit("w"), F.col("at"), F.lit("-"), F.col("piece")).alias("container"))
    rest = kept.select("key", F.col("whole").cast("int").alias("piece"), (F.col("whole") * capacity).alias("start"), (F.col("n") - F.col("whole") * capacity).alias("size"), "g", "at")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        g = int(pdf["g"].iloc[0])
        number = np.zeros(len(pdf), np.int64)
        for c, p in enumerate(pack(pdf["size"].tolist(), capacity)):
            number[p] = c
        pdf["container"] = [f"{g}-{c}" for c in number]
        return pdf[["key", "piece", "start", "size", "container"]]

    kind = rest.schema["key"].dataType.simpleString()
    # a number given here isn't merged away: the rows are small, the work on them isn't
    packed = rest.repartition(max(1, math.ceil(groups / 4)), "g").groupBy("g").applyInPandas(one, f"key {kind}, piece int, start bigint, size bigint, container string")
    both = packed.unionByName(full)
    return both.select(F.col("key").alias(key), "piece", "start", F.col("size").alias(size), "container")


def fill(packed: DataFrame, size: str, capacity: int) -> DataFrame:
    """(containers, least, used, fill) of the rows of ``containers``: how many there are, how many the total needs at
    least, the sum of sizes and its share of what the containers hold; no containers give 0, 0, 0 and null."""
    each = packed.groupBy("container").agg(F.sum(size).alias("used"))
    total = each.agg(F.count("*").alias("containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("used"))
    least = F.ceil(F.col("used") / F.lit(capacity)).cast("bigint")
    return total.select("containers", least.alias("least"), "used", F.round(F.col("used") / (F.nullif("containers", F.lit(0)) * capacity), 6).alias("fill"))
