"""Exact vector search: blocks of queries are sent to the stored rows, which never move.

Every task multiplies its rows with the block and keeps the k best of each query, so what is shuffled is k rows for each
query and task. A block has a fixed number of queries, so what is broadcast has a bound; more queries take more passes.
The work is rows times queries, as exact search must be.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from pinfold.session import ship

#: Queries of one pass, and how many products of a pass are held at a time.
BLOCK, PRODUCTS = 8192, 1 << 22


def matrix(column: pa.Array) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """(length of each vector, 0 for null; for each length the vectors of it in order) of a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(n)
    return n, {int(d): flat[(ends[n == d] - d)[:, None] + np.arange(d)] for d in np.unique(n) if d}


class Best:
    """The k best rows of each query of a block, of higher score, then smaller id."""

    def __init__(self, queries: int, k: int):
        self.k, self.least = k, np.full(queries, -np.inf)
        self.held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]  # place of the query, id, score

    def add(self, places: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Scores of the queries at ``places`` (rows) with the rows ``ids`` (columns)."""
        n = scores.shape[1]
        if n > self.k:  # what is below the k-th of these alone can't be among the best
            floor = np.partition(scores, n - self.k, axis=1)[:, n - self.k]
            self.least[places] = np.maximum(self.least[places], floor)
        i, j = np.nonzero(scores >= self.least[places][:, None])
        q, d, s = (np.concatenate(x) for x in zip(self.held, (places[i], ids[j], scores[i, j])))
        order = np.lexsort((d, -s, q))
        q, d, s = q[order], d[order], s[order]
        first = np.searchsorted(q, q)
        keep = np.arange(len(q)) - first < self.k
        self.held = [q[keep], d[keep], s[keep]]
        full = np.flatnonzero(np.arange(len(q)) - first == self.k - 1)
        self.least[q[full]] = np.maximum(self.least[q[full]], s[full])


def topk(rows: DataFrame, queries: DataFrame, id: str, vector: str, k: int, label: str | None = None, scale: str | None = None, block: int = BLOCK) -> DataFrame:
    """(query_id, <id>, score, rank): the k rows of the highest product with each query (query_id, vector).

    With ``label``, a column of both, a query sees the rows of its own label only, null none. With ``scale``, a column of
    both, vectors are codes, whole numbers whose products are exact, and the product is scaled by both. Rows and queries
    without an id or a vector, and vectors of another length than the query's, are left out; a query_id should be given
    once. Scores are rounded to 6 places; ties go to the smaller id. Other columns are left out; no rows or no queries
    give no rows.
    """
    spark = rows.sparkSession
    ship(spark)
    more = [c for c in (label, scale) if c]
    kind = "array<float>" if scale else "array<double>"  # codes to 127 in up to 1,000 places are exact in 24 bits
    clean = lambda df, i, v: df.select(F.col(i).cast("bigint").alias("i"), F.col(v).cast(kind).alias("v"), *more).filter("i IS NOT NULL AND v IS NOT NULL")
    asked, stored = clean(queries, "query_id", "vector"), clean(rows, id, vector)
    passes = max(1, -(-asked.count() // block))
    found = None
    for p in range(passes):
        own = asked if passes == 1 else asked.filter(F.pmod(F.xxhash64("i"), F.lit(passes)) == p)
        got = _pass(stored, own.toArrow(), id, k, label, scale)
        found = got if found is None else found.unionByName(got)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(id))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _pass(stored: DataFrame, queries: pa.Table, id: str, k: int, label: str | None, scale: str | None) -> DataFrame:
    handle = stored.sparkSession.sparkContext.broadcast(queries)  # at most a block

    def run(batches):
        asked = handle.value
        qi = asked["i"].to_numpy()
        sizes, vectors = matrix(asked["v"])
        ql = np.array(asked[label].to_pylist(), object) if label else None
        qs = asked[scale].to_numpy().astype(float) if scale else None
        at = {d: np.flatnonzero(sizes == d) for d in vectors}
        best = Best(len(qi), k)
        for batch in batches:
            ids = batch.column("i").to_numpy()
            n, own = matrix(batch.column("v"))
            rl = np.array(batch.column(label).to_pylist(), object) if label else None
            rs = batch.column(scale).to_numpy(zero_copy_only=False).astype(float) if scale else None
            for d in own.keys() & vectors.keys():
                rows = np.flatnonzero(n == d)
                for value in [None] if rl is None else {x for x in rl[rows] if x is not None}:
                    take = np.arange(len(rows)) if rl is None else np.flatnonzero(rl[rows] == value)
                    mine = np.arange(len(at[d])) if ql is None else np.flatnonzero(ql[at[d]] == value)
                    if not len(mine):
                        continue
                    step = max(1, PRODUCTS // len(mine))
                    for a in range(0, len(take), step):
                        part = take[a : a + step]
                        s = vectors[d][mine] @ own[d][part].T
                        if scale:
                            s = s.astype(float) * qs[at[d][mine]][:, None] * rs[rows[part]]
                        best.add(at[d][mine], ids[rows[part]], np.round(s, 6) + 0.0)
        q, i, s = best.held
        yield pa.RecordBatch.from_arrays([pa.array(qi[q]), pa.array(i), pa.array(s)], ["query_id", id, "score"])

    return stored.mapInArrow(run, f"query_id bigint, `{id}` bigint, score double")
