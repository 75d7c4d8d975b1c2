"""Queries over the operators of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from pinfold.llm.encode import token_counts, token_ids
from pinfold.llm.garbled import repair
from pinfold.llm.leximin import leximin
from pinfold.llm.near_duplicates import duplicate_classes, duplicate_groups, duplicate_pairs
from pinfold.llm.packing import containers, fill
from pinfold.llm.splitting import split
from pinfold.llm.token_budget import token_budget
from pinfold.session import table

CAPACITY = 2048


def _bodies(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunk").select(F.concat("doc_id", F.lit("#"), F.col("ord").cast("string")).alias("id"), "body")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return duplicate_pairs(_bodies(spark, sf), "body")


def p1_groups(spark: SparkSession, sf: str) -> DataFrame:
    return duplicate_groups(_bodies(spark, sf), "body")


def p1_classes(spark: SparkSession, sf: str) -> DataFrame:
    return duplicate_classes(_bodies(spark, sf), "body")


def p4_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return split(table(spark, sf, "chunk"), ["doc_id", "ord"], "body", "heading_path")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks that were cut: each has a piece 0."""
    return p4_pieces(spark, sf).filter("piece = 0").select("doc_id", "ord")


def p5_budget(spark: SparkSession, sf: str) -> DataFrame:
    return token_budget(table(spark, sf, "chunk"), ["doc_id", "ord"], ["library", "language", "kind"], "body", "tokens", "retrieved_at")


def p6_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """All hits, each once, by score within its query, authority of its chunk and confidence of its query.

    A confidence outside 0..1 is no confidence. Of a chunk or query delivered again the last delivery counts.
    """
    hits = table(spark, sf, "search_hit").select("query_id", "pos", "id", "score").distinct()
    last = F.max(F.struct("retrieved_at", "authority")).alias("x")
    authority = table(spark, sf, "chunk").groupBy("doc_id", "ord").agg(last).select(F.concat("doc_id", F.lit("#"), F.col("ord").cast("string")).alias("id"), F.col("x.authority").alias("authority"))
    sure = F.when(F.col("confidence").between(0, 1), F.col("confidence"))
    confidence = table(spark, sf, "search_envelope").groupBy("query_id").agg(F.max(F.struct("asked_at", sure.alias("confidence"))).alias("x")).select("query_id", F.col("x.confidence").alias("confidence"))
    rows = hits.join(authority, "id", "left").join(confidence, "query_id", "left")
    ranked = leximin(rows, {"score": ["query_id"], "authority": [], "confidence": []}, ["query_id", "pos", "id", "score"])
    return ranked.select("rank", "query_id", "pos", "id", F.round("pct_score", 9).alias("pct_score"), F.round("pct_authority", 9).alias("pct_authority"), F.round("pct_confidence", 9).alias("pct_confidence"), F.round("weakest", 9).alias("weakest"))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return token_ids(table(spark, sf, "documents"))


def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    return containers(token_counts(table(spark, sf, "documents"), ["doc_id"]), "doc_id", "n_tokens", CAPACITY)


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    return fill(p8_containers(spark, sf), "n_tokens", CAPACITY)


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return repair(table(spark, sf, "documents"), "doc_id", "text").select("doc_id")


def p9_restored(spark: SparkSession, sf: str) -> DataFrame:
    return repair(table(spark, sf, "documents"), "doc_id", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_groups": p1_groups, "p1_classes": p1_classes, "p4_found": p4_found, "p4_pieces": p4_pieces, "p5_budget": p5_budget, "p6_ranking": p6_ranking, "p7_ids": p7_ids, "p8_containers": p8_containers, "p8_fill": p8_fill, "p9_found": p9_found, "p9_restored": p9_restored}


# Brute force over every pair that shares a sequence of three words.
P1_SQL = """
WITH w AS (SELECT DISTINCT doc_id || '#' || ord AS id, regexp_extract_all(lower(body), '[a-z0-9_]+') AS w FROM chunk WHERE body IS NOT NULL),
g AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS gram FROM w WHERE len(w) >= 3),
n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
shared AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.id < b.id GROUP BY ALL)
SELECT id_a, id_b FROM shared JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE 5 * common >= 3 * (x.n + y.n - common)
"""

P4_SQL = """
SELECT DISTINCT doc_id, ord FROM chunk WHERE (strlen(body) + 3) // 4 > 650
"""

P6_SQL = """
WITH hits AS (SELECT DISTINCT query_id, pos, id, score FROM search_hit),
last_chunk AS (
  SELECT doc_id || '#' || ord AS id, authority FROM chunk
  QUALIFY row_number() OVER (PARTITION BY doc_id, ord ORDER BY retrieved_at DESC NULLS LAST, authority DESC NULLS LAST) = 1),
last_ask AS (
  SELECT query_id, CASE WHEN confidence BETWEEN 0 AND 1 THEN confidence END AS confidence FROM search_envelope
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY asked_at DESC NULLS LAST,
    CASE WHEN confidence BETWEEN 0 AND 1 THEN confidence END DESC NULLS LAST) = 1),
rows AS (
  SELECT h.*, CASE WHEN isnan(h.score) THEN NULL ELSE h.score END AS s, CAST(c.authority AS DOUBLE) AS a, e.confidence AS c
  FROM hits h LEFT JOIN last_chunk c USING (id) LEFT JOIN last_ask e USING (query_id)),
pct AS (
  SELECT *,
    CASE WHEN s IS NULL THEN 0.5::DOUBLE ELSE
      (count(s) OVER (PARTITION BY query_id ORDER BY s RANGE UNBOUNDED PRECEDING)
       - count(s) OVER (PARTITION BY query_id, s) / 2::DOUBLE) / count(s) OVER (PARTITION BY query_id) END AS ps,
    CASE WHEN a IS NULL THEN 0.5::DOUBLE ELSE
      (count(a) OVER (ORDER BY a RANGE UNBOUNDED PRECEDING) - count(a) OVER (PARTITION BY a) / 2::DOUBLE) / count(a) OVER () END AS pa,
    CASE WHEN c IS NULL THEN 0.5::DOUBLE ELSE
      (count(c) OVER (ORDER BY c RANGE UNBOUNDED PRECEDING) - count(c) OVER (PARTITION BY c) / 2::DOUBLE) / count(c) OVER () END AS pc
  FROM rows),
vec AS (SELECT *, list_sort([ps, pa, pc]) AS v FROM pct)
SELECT row_number() OVER (ORDER BY v[1] DESC, v[2] DESC, v[3] DESC, query_id NULLS FIRST, pos NULLS FIRST, id NULLS FIRST,
    score NULLS FIRST) AS rank,
  query_id, pos, id, round(ps, 9) AS pct_score, round(pa, 9) AS pct_authority, round(pc, 9) AS pct_confidence, round(v[1], 9) AS weakest
FROM vec
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_SQL, "p4_found": P4_SQL, "p6_ranking": P6_SQL}
