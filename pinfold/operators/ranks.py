"""Global positions without a window over everything.

``Window.orderBy`` without a partition moves all rows into one task. Here rows are range-partitioned by the
sort key, numbered inside each partition, and shifted by the sizes of the partitions before it. What goes to
the driver is one count per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pinfold.scratch import materialize


def number_rows(df: DataFrame, order: list[Column], name: str = "pos", start: int = 0) -> DataFrame:
    """Adds ``name``: the row's position in the total order ``order``, from ``start``, without gaps.

    Ties get positions in an unspecified order, so ``order`` should end with a unique key. An empty table stays
    empty. A column called ``name`` must not exist yet.
    """
    if name in df.columns:
        raise ValueError(f"column {name} exists")
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    kept = materialize(ranged.withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__at", 33)
    sizes = {r[0]: r[1] for r in kept.groupBy(part.alias("p")).count().collect()}
    shifts, seen = {}, start
    for p in sorted(sizes):
        shifts[p], seen = seen, seen + sizes[p]
    if not shifts:
        return kept.withColumn(name, F.lit(0).cast("bigint")).drop("__at")
    lookup = F.create_map(*[F.lit(x) for kv in shifts.items() for x in kv])
    return kept.withColumn(name, lookup[part] + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at")


def percent_ranks(df: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the mid-rank percentile of ``value`` among the non-null values of its group, in 0..1.

    Equal values get equal percentiles: (rows below + half of the equal rows) / rows of the group. Null and NaN
    values get null. Counting per distinct value comes first, so repeated values never travel one by one, and the
    running count is taken over distinct values in range partitions, so that one group may hold any share of rows.
    """
    v = F.col(value).cast("double")
    ok = v.isNotNull() & ~F.isnan(v)
    keyed = materialize(df.withColumn("__v", F.when(ok, v + F.lit(0.0))), "percentiles")  # read three times
    counts = keyed.filter(F.col("__v").isNotNull()).groupBy(*group, "__v").agg(F.count("*").alias("__n"))
    placed = running_sum(counts, group, [F.col("__v")], "__n", "__below")
    total = counts.groupBy(*group).agg(F.sum("__n").alias("__all")) if group else counts.agg(F.sum("__n").alias("__all"))
    if group:
        placed = _null_safe_join(placed, total, group, "inner")
    else:
        placed = placed.crossJoin(F.broadcast(total))  # one row
    pct = placed.withColumn(name, (F.col("__below") + F.col("__n") / 2) / F.col("__all")).select(*group, "__v", name)
    return _null_safe_join(keyed, pct, [*group, "__v"], "left").drop("__v")


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    r = right.select(*[F.col(k).alias(f"__r_{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__r_{i}")) for i, k in enumerate(keys)]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return left.join(r, cond, how).drop(*[f"__r_{i}" for i in range(len(keys))])


def running_sum(df: DataFrame, group: list[str], order: list[Column], amount: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``amount`` over the earlier rows of the group (exclusive), in the given order.

    Works by range partitions over (group, order): inside each a window per (partition, group); the sums of a
    group's earlier partitions are added afterwards, from a table of one row per (partition, group).
    """
    from pyspark.sql import Window

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(g) for g in group]
    kept = materialize(df.repartitionByRange(n, *keys, *order).withColumn("__p", F.spark_partition_id()), "running")
    inside = Window.partitionBy("__p", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = kept.withColumn("__in", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    per = kept.groupBy("__p", *group).agg(F.sum(amount).alias("__s"))
    before = Window.partitionBy(*group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1) if group else Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    shift = per.withColumn("__off", F.coalesce(F.sum("__s").over(before), F.lit(0))).select("__p", *group, "__off")
    return _null_safe_join(local, shift, ["__p", *group], "inner").withColumn(name, F.col("__in") + F.col("__off")).drop("__p", "__in", "__off")
