"""References to records that do not exist, kept as incremental keyed state.

State is two tables, both in parts by a hash of the key; a batch rewrites only the parts whose keys it touches. The parent
index holds for every key when it was first and last delivered and last deleted. The
references hold when each was last made and its state: found, or waiting as missing, deleted or late. A batch of events
touches some keys: new references probe the index, parents that arrive resolve those that wait for them, deletions
reopen them. Only references of touched keys are judged anew. All parts of the state are minima and maxima, so batches
may come in any order and twice, and rows are merged before they are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pinfold.scratch import Buckets, materialize

EVENTS = "kind string, target string, key string, ref_table string, ref_field string, season string, record string, ref_value string, at timestamp"
REF = ["ref_table", "ref_field", "season", "record", "ref_value"]
PARENTS = "target string, key string, known boolean, first_at timestamp, last_at timestamp, deleted_at timestamp"
REFS = "target string, key string, ref_table string, ref_field string, season string, record string, ref_value string, last_at timestamp, state string"


def chunk_key(value: Column) -> Column:
    """The key that a written chunk id names, null if none: split at the last '#', a decimal number after it."""
    v = F.trim(value)
    number = F.regexp_extract(v, r"#0*([0-9]+)$", 1)
    return F.when(number != "", F.concat(F.regexp_replace(v, r"#[0-9]+$", ""), F.lit("#"), number))


def symbol_key(value: Column) -> Column:
    return F.nullif(F.regexp_replace(F.trim(value), "::|#", "."), F.lit(""))


def uuid_key(value: Column) -> Column:
    return F.nullif(F.lower(F.trim(value)), F.lit(""))


@dataclass
class OrphanState:
    """The state after some batches; ``advance`` gives the state after one more, ``release`` deletes what only the older has.

    ``buckets`` is fixed when the state is made: so many parts, and tasks, there are; by default the session's number of
    shuffle partitions, more where a part would outgrow an executor.
    """

    index: Buckets
    made: Buckets
    buckets: int

    @classmethod
    def empty(cls, spark: SparkSession, buckets: int | None = None) -> OrphanState:
        return cls(Buckets(spark, PARENTS, {}), Buckets(spark, REFS, {}), buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))

    @property
    def parents(self) -> DataFrame:
        return self.index.read()

    @property
    def refs(self) -> DataFrame:
        return self.made.read()

    def bucket(self) -> Column:
        """The part of a key; references without a key are spread by what they say."""
        return F.pmod(F.xxhash64("target", F.coalesce("key", "ref_value")), F.lit(self.buckets)).cast("int")

    def advance(self, events: DataFrame) -> OrphanState:
        """Takes a batch of events (columns EVENTS; kind is parent, deletion or reference).

        A reference whose key is null names nothing and stays missing. Events without a time count for existence, not for
        order: such a parent is neither late nor deleted, such a deletion and such a reference can't be placed in time.
        """
        of = lambda kind: F.when(F.col("kind") == kind, F.col("at"))
        events = events.withColumn("bucket", self.bucket())
        changed = {bool(r.own): r.b for r in events.filter("kind = 'reference' OR key IS NOT NULL").groupBy((F.col("kind") != "reference").alias("own")).agg(F.collect_set("bucket").alias("b")).collect()}
        mine = sorted(changed.get(True, []))  # at most as many numbers as there are parts
        both = sorted({*mine, *changed.get(False, [])})
        own = events.filter("kind <> 'reference' AND key IS NOT NULL")
        new = own.groupBy("target", "key").agg(F.max(F.col("kind") == "parent").alias("known"), F.min(of("parent")).alias("first_at"), F.max(of("parent")).alias("last_at"), F.max(of("deletion")).alias("deleted_at"))
        index = self.index
        if mine:
            every = index.read(mine).unionByName(new).withColumn("ref_value", F.lit(None).cast("string")).withColumn("bucket", self.bucket()).repartition(self.buckets, "bucket")
            merged = every.groupBy("bucket", "target", "key").agg(F.max("known").alias("known"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.max("deleted_at").alias("deleted_at"))
            index = index.replaced(merged, mine, "parents")
        if not both:
            return OrphanState(index, self.made, self.buckets)
        made = events.filter("kind = 'reference'").groupBy("target", "key", *REF).agg(F.max("at").alias("last_at"))
        made = made.withColumn("state", F.lit(None).cast("string"))
        every = self.made.read(both).unionByName(made).withColumn("bucket", self.bucket()).repartition(self.buckets, "bucket")
        merged = every.groupBy("bucket", "target", "key", *REF).agg(F.max("last_at").alias("last_at"), F.max("state").alias("state"), F.max(F.col("state").isNull()).alias("new"))
        touched = new.select("target", "key").withColumn("hit", F.lit(True))
        waiting = merged.join(touched, ["target", "key"], "left")
        again = F.col("new") | F.coalesce("hit", F.lit(False))
        probe = waiting.join(index.read(both).withColumnRenamed("last_at", "parent_at"), ["target", "key"], "left")
        state = (
            F.when(~again, F.col("state"))
            .when(~F.coalesce("known", F.lit(False)), "missing")
            .when(F.coalesce(F.col("deleted_at") > F.col("parent_at"), F.lit(False)), "deleted")
            .when(F.coalesce(F.col("first_at") > F.col("last_at"), F.lit(False)), "late")
            .otherwise("found")
        )
        rows = probe.select("target", "key", *REF, "last_at", state.alias("state"), "bucket").repartition(self.buckets, "bucket")
        return OrphanState(index, self.made.replaced(rows, both, "references"), self.buckets)

    def release(self, newer: OrphanState) -> None:
        self.index.release(newer.index)
        self.made.release(newer.made)

    def orphans(self) -> DataFrame:
        return self.refs.filter("state <> 'found'").select(*REF, "state")

    def counts(self, period: str) -> DataFrame:
        """What waits now, per table and season of the reference."""
        return self.orphans().groupBy("ref_table", "ref_field", "season", "state").agg(F.count("*").alias("n")).select(F.lit(period).alias("period"), "*")


def events(chunk: DataFrame, symbol: DataFrame, vendordep: DataFrame, tombstone: DataFrame) -> DataFrame:
    """All parents, deletions and references of the four tables as events.

    Null and '' are no reference, nor is a row without a season. Rows without a key are no parents.
    """
    none = [F.lit(None).cast("string").alias(c) for c in REF]
    at = F.col("retrieved_at").alias("at")

    def parent(df: DataFrame, target: str, key: Column) -> DataFrame:
        return df.select(F.lit("parent").alias("kind"), F.lit(target).alias("target"), key.alias("key"), *none, at)

    def reference(df: DataFrame, target: str, key, table: str, field: str, record: str, value: Column) -> DataFrame:
        season = F.regexp_replace("season", r"^\s+|\s+$", "")
        rows = df.select(F.lit("reference").alias("kind"), F.lit(target).alias("target"), key(value).alias("key"), F.lit(table).alias("ref_table"), F.lit(field).alias("ref_field"), season.alias("season"), F.col(record).alias("record"), value.alias("ref_value"), at)
        return rows.filter("ref_value <> '' AND season <> ''")

    dead = {"chunk": chunk_key, "symbol": symbol_key, "vendordep": uuid_key}
    gone = reduce(lambda c, t: c.when(F.col("entity") == t, dead[t](F.col("ref_key"))), dead, F)
    conflicts = vendordep.select("uuid", "season", "retrieved_at", F.explode("conflicts.uuid").alias("other"))
    parts = [
        parent(chunk, "chunk", F.concat("doc_id", F.lit("#"), F.col("ord").cast("string"))),
        parent(symbol, "symbol", symbol_key(F.col("fqn"))),
        parent(vendordep, "vendordep", uuid_key(F.col("uuid"))),
        tombstone.select(F.lit("deletion").alias("kind"), F.col("entity").alias("target"), gone.alias("key"), *none, F.col("deleted_at").alias("at")),
        reference(symbol, "chunk", chunk_key, "symbol", "chunk_id", "fqn", F.col("chunk_id")),
        reference(symbol, "symbol", symbol_key, "symbol", "replacement", "fqn", F.col("replacement")),
        reference(conflicts, "vendordep", uuid_key, "vendordep", "conflicts", "uuid", F.col("other")),
    ]
    return reduce(DataFrame.unionByName, parts)


def replay(all_events: DataFrame, report: bool = True) -> tuple[OrphanState, DataFrame]:
    """Runs the events through the state month by month; gives the last state and the counts at each month's end, or
    without ``report`` those of the last month. What a month replaces is deleted, so the disk holds one state.

    Repeated events are merged first: one row for a key or reference and month, with its first and last time. Events
    without a time come with the first month.
    """
    spark = all_events.sparkSession
    month = F.coalesce(F.date_format("at", "yyyy-MM"), F.lit(""))
    cols = ["kind", "target", "key", *REF]
    merged = all_events.groupBy(*cols, month.alias("month")).agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    kept = materialize(merged, "events")
    both = F.explode(F.when((F.col("kind") == "parent") & (F.col("lo") < F.col("hi")), F.array("lo", "hi")).otherwise(F.array("hi")))
    months = [r[0] for r in kept.select("month").distinct().orderBy("month").collect()]
    state, reports = OrphanState.empty(spark), []
    for m in months:
        before, state = state, state.advance(kept.filter(F.col("month") == m).select(*cols, both.alias("at")))
        before.release(state)
        reports.append(materialize(state.counts(m).coalesce(1), "report") if report else state.counts(m))
    if not reports:
        return state, state.counts("")
    return state, reduce(DataFrame.unionByName, reports) if report else reports[-1]
