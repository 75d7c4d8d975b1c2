"""Evaluation and operation measures."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from pinfold.operators.ranks import running_sum
from pinfold.session import ship

# The bounds of the latency histogram in seconds, the most series of a counter, bucket rate and size.
BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5]
SERIES = 512
RATE, BURST = 1.0, 30.0


def retrieval_quality(ranked: DataFrame, judged: DataFrame) -> DataFrame:
    """(query_id, recall5, recall10, ndcg10, mrr10) of ranked hits (query_id, rank, doc) against judged (query_id, doc).

    A document counts where it comes first among the first ten hits; queries without judgments are left out, those
    without hits have zeros.
    """
    j = judged.select("query_id", "doc").distinct()
    first = ranked.filter("rank <= 10").groupBy("query_id", "doc").agg(F.min("rank").alias("rank"))
    placed = first.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    hits = placed.join(j, ["query_id", "doc"]).groupBy("query_id").agg(
        F.count_if(F.col("pos") <= 5).alias("f5"), F.count("*").alias("f10"), F.sum(1 / F.log2(F.col("pos") + 1.0)).alias("dcg"), F.min("pos").alias("at")
    )
    n = j.groupBy("query_id").agg(F.count("*").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(10)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    rows = n.join(hits, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.select("query_id", zero(F.col("f5") / F.col("n")).alias("recall5"), zero(F.col("f10") / F.col("n")).alias("recall10"), zero(F.col("dcg") / ideal).alias("ndcg10"), zero(1 / F.col("at")).alias("mrr10"))


def means(rows: DataFrame, values: list[str], sets: list[list[str]], cols: list[str], digits: int = 3) -> DataFrame:
    """Means of several values by several groupings in one pass."""
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in cols]).agg(F.count("*").alias("n"), *[F.round(F.avg(v), digits).alias(v) for v in values])


def nearest_rank(rows: DataFrame, group: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """(*group, name...): the value at a 0-based place of the sorted values, without interpolation. ``places`` are
    expressions of the group's count ``n``. Counts per distinct value are accumulated over range partitions, so no group
    is sorted in one task. Null values are left out."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    placed = running_sum(counts, group, [F.col("v")], "c", "before")
    total = counts.groupBy(*group).agg(F.sum("c").alias("n"))
    both = placed.join(total, group) if group else placed.crossJoin(F.broadcast(total))
    hit = lambda at: F.max(F.when((F.col("before") <= at) & (at < F.col("before") + F.col("c")), F.col("v")))
    return both.groupBy(*group).agg(*[hit(at).alias(name) for name, at in places.items()])


def histogram(rows: DataFrame, group: list[str], seconds: Column, bounds: list[float] = BOUNDS) -> DataFrame:
    """(*group, le, n): cumulative counts up to each bound and to +Inf."""
    counts = rows.groupBy(*group).agg(*[F.count_if(seconds <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.count("*").alias("inf"))
    cells = F.array(*[F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit("+Inf").alias("le"), F.col("inf").alias("n")))
    return counts.select(*group, F.explode(cells).alias("x")).select(*group, "x.le", "x.n")


def capped_counts(rows: DataFrame, labels: list[str], most: int = SERIES) -> DataFrame:
    """Counts by labels; beyond ``most`` series (the most frequent stay, ties by label) the rest is one series 'other'."""
    counts = rows.groupBy(*labels).agg(F.count("*").alias("n"))
    keep = counts.orderBy(F.col("n").desc(), *[F.col(c).asc_nulls_first() for c in labels]).limit(most).select(*[F.col(c).alias(f"__{c}") for c in labels]).withColumn("__k", F.lit(True))
    cond = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in labels])
    marked = counts.join(keep, cond, "left")
    return marked.groupBy(*[F.when(F.col("__k"), F.col(c)).otherwise("other").alias(c) for c in labels]).agg(F.sum("n").alias("n"))


def token_bucket(rows: DataFrame, client: str, when: str, rate: float = RATE, burst: float = BURST) -> DataFrame:
    """``rows`` (client, when, and a key ``id``) with ``allowed`` and ``tokens``, the tokens left, in order of time and id.

    A client's requests come in order through one task, which holds one number per client, however many there are. Rows
    without a client or a time are refused with null tokens.
    """
    ship(rows.sparkSession)
    known = rows.filter(F.col(client).isNotNull() & F.col(when).isNotNull())
    ordered = known.select(F.col(client).cast("string").alias("client"), "id", (F.unix_micros(F.col(when).cast("timestamp")) / 1e6).alias("at"))
    ordered = ordered.repartition("client").sortWithinPartitions("client", "at", "id")

    def fold(frames):
        who, left, last = None, 0.0, 0.0
        for pdf in frames:
            ok, tokens = np.zeros(len(pdf), bool), np.zeros(len(pdf))
            for i, (c, _, at) in enumerate(pdf.itertuples(index=False, name=None)):
                if c != who:
                    who, left, last = c, burst, at
                left, last = min(burst, left + (at - last) * rate), at
                if left >= 1:
                    left, ok[i] = left - 1, True
                tokens[i] = left
            yield pd.DataFrame({"client": pdf["client"], "id": pdf["id"], "allowed": ok, "tokens": np.round(tokens, 6)})

    kind = rows.schema["id"].dataType.simpleString()
    out = ordered.mapInPandas(fold, f"client string, id {kind}, allowed boolean, tokens double")
    rest = rows.filter(F.col(client).isNull() | F.col(when).isNull()).select(F.col(client).cast("string").alias("client"), "id", F.lit(False).alias("allowed"), F.lit(None).cast("double").alias("tokens"))
    return out.unionByName(rest)


def bootstrap(diffs: DataFrame, value: str, resamples: int = 10_000, seed: int = 2027) -> DataFrame:
    """(n, mean, lo, hi): the mean of a column and its 95 % percentile interval by resampling with a fixed seed.

    Resampling n rows with replacement is drawing counts of the distinct values (rounded to 9 places), so what one task
    holds is the distinct values, not the rows.
    """
    ship(diffs.sparkSession)
    counts = diffs.filter(F.col(value).isNotNull()).groupBy(F.round(value, 9).alias("v")).agg(F.count("*").alias("c")).withColumn("g", F.lit(1))

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("v")
        v, c = pdf["v"].to_numpy(), pdf["c"].to_numpy()
        n = int(c.sum())
        m = np.sort(np.random.default_rng(seed).multinomial(n, c / n, resamples) @ v / n)
        return pd.DataFrame({"n": [n], "mean": [round(float(v @ c / n), 6)], "lo": [m[resamples * 25 // 1000]], "hi": [m[resamples * 975 // 1000]]})

    return counts.groupBy("g").applyInPandas(draw, "n bigint, mean double, lo double, hi double")
