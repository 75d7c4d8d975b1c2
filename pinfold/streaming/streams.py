"""Structured Streaming counterparts of the batch operators, each run to the end of what is there.

State is kept per key with a bound: de-duplication and windows by watermark, buckets by timeout.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pinfold.operators.orphans import OrphanState
from pinfold.scratch import drop, materialize, new_path
from pinfold.session import ship


def source(spark: SparkSession, path: str) -> DataFrame:
    """A table's files as a stream; the schema comes from what lies there."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        return reader.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())
    return reader.parquet(path)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream until all present data is processed and gives what it wrote, exactly once, to the shared folder."""
    spark = stream.sparkSession
    out, check = new_path(spark, name), new_path(spark, f"{name}-checkpoint")
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def drain_batches(stream: DataFrame, name: str, each: Callable[[DataFrame, int], None]) -> None:
    """As drain, with a function of every micro-batch."""
    check = new_path(stream.sparkSession, f"{name}-checkpoint")
    stream.writeStream.foreachBatch(each).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()


def dedupe(stream: DataFrame, key: list[str], when: str, late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark; what is older than that may come again."""
    return stream.withWatermark(when, late).dropDuplicatesWithinWatermark(key)


def windowed_counts(stream: DataFrame, when: str, labels: list[str], window: str, late: str = "1 hour") -> DataFrame:
    """Counts and sums by tumbling window and labels; in append mode a window comes out when the watermark passed it."""
    g = stream.withWatermark(when, late).groupBy(F.window(when, window).alias("w"), *labels)
    return g.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), *labels, "n", "total")


def merged_counts(stream: DataFrame, when: str, labels: list[str], value: str, window: str) -> DataFrame:
    """(start, *labels, n, total): counts and sums by window, each micro-batch merged into what is held."""
    held: list[DataFrame] = []

    def each(batch: DataFrame, number: int) -> None:
        own = batch.groupBy(F.window(when, window).alias("w"), *labels).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *labels, "n", "total")
        if held:
            own = held[0].unionByName(own).groupBy("start", *labels).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        new = materialize(own, "counts")
        if held:
            drop(held[0])
        held[:] = [new]

    drain_batches(stream, "counts", each)
    if not held:
        kinds = ", ".join(f"`{c}` {stream.schema[c].dataType.simpleString()}" for c in labels)
        return stream.sparkSession.createDataFrame([], f"start timestamp, {kinds}, n bigint, total double")
    return held[0]


def token_bucket(stream: DataFrame, client: str, when: str, rate: float, burst: float, late: str = "1 hour") -> DataFrame:
    """Requests as allowed or not, one bucket (two numbers) of state per client.

    A bucket that has been idle for as long as it takes to fill is like a new one, so its state goes as soon as the
    watermark has passed that time: the state holds the clients of the last ``late`` and that time only. Event time, not
    the clock, decides, so a run over what is there ends. Requests that come later than ``late`` are left out.
    """
    ship(stream.sparkSession)
    at = F.col(when).cast("timestamp")
    rows = stream.select(F.col(client).cast("string").alias("client"), "id", at.alias("__t"), (F.unix_micros(at) / 1e6).alias("at")).filter("client IS NOT NULL AND __t IS NOT NULL")
    idle = burst / rate

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        left, last = state.get if state.exists else (burst, None)
        pdf = pd.concat(list(frames)).sort_values(["at", "id"])
        ok, tokens = [], []
        for t in pdf["at"].tolist():
            if last is not None:
                left = min(burst, left + max(t - last, 0.0) * rate)
            last = t if last is None else max(t, last)
            ok.append(left >= 1)
            left -= 1 if ok[-1] else 0
            tokens.append(round(left, 6))
        state.update((left, last))
        state.setTimeoutTimestamp(max(int((last + idle) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"client": pdf["client"], "id": pdf["id"], "allowed": ok, "tokens": tokens})

    kind = rows.schema["id"].dataType.simpleString()
    return rows.withWatermark("__t", late).groupBy("client").applyInPandasWithState(step, f"client string, id {kind}, allowed boolean, tokens double", "tokens double, last double", "append", GroupStateTimeout.EventTimeTimeout)


def polite(requests: DataFrame, cached: DataFrame, url: str, when: str, source: str, floors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fetch, kept): which requests go out, and what is served from what was fetched before.

    ``cached`` (url, fetched_at) says when each page was fetched last, ``floors`` (source, min_interval_s) how long a source
    must be left alone between two fetches of one page. A request sooner than that is served from the cache; of several
    in a batch the earliest goes out and the others are judged by it. Requests of sources without a floor go out.
    """
    r = requests.join(floors, source, "left").join(cached.groupBy(url).agg(F.max("fetched_at").alias("fetched_at")), url, "left")
    floor = F.coalesce("min_interval_s", F.lit(0)).cast("bigint")
    before = lambda t: F.unix_micros(F.col(when)) - F.unix_micros(t) < floor * 1_000_000
    young = F.coalesce(before(F.col("fetched_at")), F.lit(False))
    judged = r.withColumn("__y", young)
    first = F.min(F.when(~F.col("__y"), F.col(when))).over(Window.partitionBy(url))
    judged = judged.withColumn("__f", first)
    sooner = F.col("__y") | ((F.col(when) > F.col("__f")) & F.coalesce(before(F.col("__f")), F.lit(False)))
    out = judged.withColumn("__s", sooner).drop("__y", "__f", "fetched_at", "min_interval_s")
    return out.filter(~F.col("__s")).drop("__s"), out.filter("__s").drop("__s")


def orphans(stream: DataFrame, start: OrphanState, report: Callable[[OrphanState, int], None]) -> OrphanState:
    """Feeds a stream of events (as of operators.orphans) into the state, one advance a micro-batch."""
    held = [start]

    def each(batch: DataFrame, number: int) -> None:
        before, held[0] = held[0], held[0].advance(batch)
        before.release(held[0])
        report(held[0], number)

    drain_batches(stream, "orphans", each)
    return held[0]


def changed_since(new: DataFrame, seen: DataFrame, key: str, body: str) -> DataFrame:
    """Rows of a fetch whose content differs from what was seen (key, digest): new, or of another digest."""
    rows = new.withColumn("digest", F.sha2(F.coalesce(F.col(body), F.lit("")).cast("binary"), 256))
    return rows.join(seen.select(key, "digest"), [key, "digest"], "left_anti")
