"""Intermediate tables in the folder that all executors share.

A table written there cuts the lineage and survives the loss of an executor. The folder is the one
the cluster names in ``spark.checkpoint.dir``; only a local session without that setting gets a
temporary folder of its own.
"""

from __future__ import annotations

import atexit
import tempfile
import time
import uuid
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="pinfold-scratch-")
    return _OWN[app]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/pinfold-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def materialize(df: DataFrame, name: str, shuffled: int = 0) -> DataFrame:
    """Writes ``df`` once and gives back a scan of what was written.

    ``shuffled`` is the estimated number of bytes that its largest exchange moves: where the session's number of shuffle
    partitions would make them larger than the size it advises, this one write uses more of them.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with shuffle_sized(spark, shuffled):
        df.write.parquet(path)
    got = spark.read.schema(df.schema).parquet(path)
    got._pinfold_path = path
    return got


@contextmanager
def shuffle_sized(spark: SparkSession, shuffled: int):
    """Enough shuffle partitions for so many bytes, at the session's advised size, while the block runs."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    advised = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64m"))
    wanted = -(-shuffled // advised)
    if wanted <= int(before):
        yield
        return
    spark.conf.set(key, str(wanted))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release_shuffles(spark: SparkSession) -> None:
    """Has Spark delete shuffle files that no plan needs any more: it does so once the driver's JVM has collected its garbage.

    The last query's are only given up by a second collection.
    """
    for pause in (0.5, 0):
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)


def drop(df: DataFrame) -> None:
    """Deletes what ``materialize`` wrote for ``df``; nothing that reads it may run afterwards."""
    path = getattr(df, "_pinfold_path", None)
    if path:
        forget(df.sparkSession, path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a path given by ``new_path``, or a part of one."""
    drop_path(spark, path)
    _WRITTEN[:] = [x for x in _WRITTEN if x[1] != path]


@dataclass(frozen=True)
class Buckets:
    """A table kept in parts by an integer column ``bucket`` of a fixed number of values, each part in a folder of its own.

    ``replaced`` writes some parts anew and gives the table with those instead; the other parts stay where they are, so
    a small change costs the parts it touches. ``release`` deletes what a newer version no longer has.
    """

    spark: SparkSession
    schema: str
    parts: dict[int, str]

    def read(self, only: list[int] | None = None) -> DataFrame:
        paths = [p for b, p in sorted(self.parts.items()) if only is None or b in only]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def replaced(self, df: DataFrame, touched: list[int], name: str) -> Buckets:
        """``df`` has all rows of the touched parts and ``bucket``, by which it should be partitioned."""
        path = new_path(self.spark, name)
        df.write.partitionBy("bucket").parquet(path)
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        found = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
        own = [f.getPath().toString() for f in found if f.isDirectory()]
        return Buckets(self.spark, self.schema, {b: p for b, p in self.parts.items() if b not in touched} | {int(p.rsplit("=", 1)[1]): p for p in own if "bucket=" in p})

    def release(self, newer: Buckets) -> None:
        for p in set(self.parts.values()) - set(newer.parts.values()):
            drop_path(self.spark, p)


def clean() -> None:
    """Deletes every intermediate table of this process. Results that read them must have been saved before."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            drop_path(spark, path)
        except Exception:  # the session may be gone at exit
            pass


atexit.register(clean)
