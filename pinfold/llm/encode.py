"""Token ids of a whole corpus under a public byte-level BPE vocabulary (problem 7)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from pinfold.llm.bpe import Encoder, Vocabulary, vocabulary
from pinfold.llm.pretokens import string_buffers
from pinfold.session import ship

#: Texts of one output batch hold about so many bytes.
OUT_BYTES = 4 << 20
_ENCODERS: dict[int, Encoder] = {}


def worker_encoder(handle) -> Encoder:
    """One encoder per Python worker and broadcast, so that merged segments are remembered between tasks."""
    key = handle._jbid if hasattr(handle, "_jbid") else id(handle)
    v: Vocabulary = handle.value
    e = _ENCODERS.get(key)
    if e is None or e.v is not v:
        e = _ENCODERS[key] = Encoder(v)
    return e


def pieces(batch: pa.RecordBatch, column: int, most: int = OUT_BYTES):
    """Row ranges of a batch whose texts hold about ``most`` bytes."""
    from pinfold.llm.pretokens import slices

    raw, offsets = string_buffers(batch.column(column))
    for a, b in slices(offsets, most):
        yield a, b, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """(key, out): the ids of every row's text, without special tokens.

    Null and empty texts get an empty list; rows with a null key and repeated rows stay rows; other columns are left
    out, whatever their names; an empty table gives an empty table. The text is encoded whole, however long.
    The vocabulary is broadcast: its size is that of the rank file (under 1 MB) and of one table by code point.
    """
    if key == out:
        raise ValueError("key and out must differ")
    spark = df.sparkSession
    ship(spark)
    handle = spark.sparkContext.broadcast(vocabulary(path))
    rows = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    schema = T.StructType([T.StructField(key, rows.schema["k"].dataType), T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches):
        enc = worker_encoder(handle)
        for batch in batches:
            for a, b, raw, offsets in pieces(batch, 1):
                flat, ends = enc.ids(raw, offsets)
                ids = pa.ListArray.from_arrays(pa.array(ends.astype("int32")), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), ids], [key, out])

    return rows.mapInArrow(run, schema)


def token_counts(df: DataFrame, key: list[str], text: str = "text", out: str = "n_tokens", path: str | None = None) -> DataFrame:
    """(*key, out): how many tokens every row's text has; 0 for null and empty texts. Otherwise as token_ids."""
    if out in key:
        raise ValueError("out must not be a key")
    spark = df.sparkSession
    ship(spark)
    handle = spark.sparkContext.broadcast(vocabulary(path))
    rows = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(key)], F.col(text).cast("string").alias("t"))
    schema = T.StructType([*[T.StructField(k, rows.schema[f"k{i}"].dataType) for i, k in enumerate(key)], T.StructField(out, T.LongType())])

    def run(batches):
        enc = worker_encoder(handle)
        for batch in batches:
            for a, b, raw, offsets in pieces(batch, len(key)):
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(key))), pa.array(enc.counts(raw, offsets))], [*key, out])

    return rows.mapInArrow(run, schema)
