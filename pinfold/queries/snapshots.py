"""Queries over snapshots and references between tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pinfold.operators.orphans import events, replay
from pinfold.operators.snapshots import changes
from pinfold.queries.registry import register
from pinfold.session import table

BLANKS = r"^\s+|\s+$"


def _symbol_changes(spark: SparkSession, sf: str) -> DataFrame:
    signature = F.trim(F.regexp_replace("signature", r"\s+", " "))
    found = changes(table(spark, sf, "symbol"), ["library", "language"], F.regexp_replace("season", BLANKS, ""), "fqn", signature)
    return found.withColumnsRenamed({"period_from": "season_from", "period_to": "season_to"})


CHANGES = r"""
WITH facts AS (
  SELECT DISTINCT library, language, regexp_replace(season, '^\s+|\s+$', '', 'g') AS season, fqn,
    trim(regexp_replace(coalesce(signature, ''), '\s+', ' ', 'g')) AS signature
  FROM symbol WHERE season IS NOT NULL AND fqn IS NOT NULL),
sets AS (
  SELECT library, language, season, fqn, list_sort(list(signature)) AS signatures FROM facts
  WHERE season <> '' GROUP BY ALL),
steps AS (
  SELECT library, language, season AS season_from,
    lead(season) OVER (PARTITION BY library, language ORDER BY season) AS season_to
  FROM (SELECT DISTINCT library, language, season FROM sets))
SELECT p.library, p.language, coalesce(a.fqn, b.fqn) AS fqn, p.season_from, p.season_to,
  CASE WHEN a.fqn IS NULL THEN 'added' WHEN b.fqn IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM (
  SELECT s.*, k.fqn FROM steps s JOIN (SELECT DISTINCT library, language, fqn FROM sets) k
    ON s.library IS NOT DISTINCT FROM k.library AND s.language IS NOT DISTINCT FROM k.language
  WHERE season_to IS NOT NULL) p
LEFT JOIN sets a ON a.library IS NOT DISTINCT FROM p.library AND a.language IS NOT DISTINCT FROM p.language
  AND a.season = p.season_from AND a.fqn = p.fqn
LEFT JOIN sets b ON b.library IS NOT DISTINCT FROM p.library AND b.language IS NOT DISTINCT FROM p.language
  AND b.season = p.season_to AND b.fqn = p.fqn
WHERE (a.fqn IS NULL) <> (b.fqn IS NULL) OR (a.fqn IS NOT NULL AND b.fqn IS NOT NULL AND a.signatures <> b.signatures)
"""


@register("p2_found", CHANGES)
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _symbol_changes(spark, sf).select("library", "language", "fqn", "season_from", "season_to", "change")


@register(
    "p2_counts",
    f"SELECT library, language, season_from, season_to, change, count(*) AS n FROM ({CHANGES}) GROUP BY ALL",
)
def p2_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _symbol_changes(spark, sf).groupBy("library", "language", "season_from", "season_to", "change").agg(F.count("*").alias("n"))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return events(*(table(spark, sf, t) for t in ("chunk", "symbol", "vendordep", "tombstone")))


def _orphan_sql(months: str, upto: str) -> str:
    """The references without a record, judged by everything up to a point in time."""
    return rf"""
WITH months AS ({months}),
refs AS (
  SELECT 'symbol' AS ref_table, 'chunk_id' AS ref_field, season, fqn AS record, chunk_id AS ref_value, retrieved_at FROM symbol
  UNION ALL SELECT 'symbol', 'replacement', season, fqn, replacement, retrieved_at FROM symbol
  UNION ALL SELECT 'vendordep', 'conflicts', season, uuid, c.uuid, retrieved_at
    FROM (SELECT season, uuid, retrieved_at, unnest(conflicts) AS c FROM vendordep)),
made AS (
  SELECT m.period, ref_table, ref_field, regexp_replace(season, '^\s+|\s+$', '', 'g') AS season, record, ref_value,
    max(retrieved_at) AS last_ref
  FROM refs, months m
  WHERE ref_value <> '' AND regexp_replace(season, '^\s+|\s+$', '', 'g') <> '' AND {upto.format('retrieved_at')} GROUP BY ALL),
keyed AS (
  SELECT *, CASE ref_field WHEN 'chunk_id' THEN 'chunk' WHEN 'replacement' THEN 'symbol' ELSE 'vendordep' END AS target,
    CASE ref_field
      WHEN 'chunk_id' THEN CASE WHEN regexp_matches(trim(ref_value), '#[0-9]+$')
        THEN regexp_replace(trim(ref_value), '#0*([0-9]+)$', '#\1') END
      WHEN 'replacement' THEN regexp_replace(trim(ref_value), '::|#', '.', 'g')
      ELSE lower(trim(ref_value)) END AS key
  FROM made),
rows AS (
  SELECT 'chunk' AS target, doc_id || '#' || ord AS key, retrieved_at AS seen FROM chunk
  UNION ALL SELECT 'symbol', regexp_replace(trim(fqn), '::|#', '.', 'g'), retrieved_at FROM symbol
  UNION ALL SELECT 'vendordep', lower(trim(uuid)), retrieved_at FROM vendordep),
parents AS (SELECT m.period, target, key, min(seen) AS first_at, max(seen) AS last_at FROM rows, months m WHERE {upto.format('seen')} GROUP BY ALL),
gone AS (
  SELECT m.period, entity AS target, CASE entity
      WHEN 'chunk' THEN CASE WHEN regexp_matches(trim(ref_key), '#[0-9]+$') THEN regexp_replace(trim(ref_key), '#0*([0-9]+)$', '#\1') END
      WHEN 'symbol' THEN regexp_replace(trim(ref_key), '::|#', '.', 'g')
      ELSE lower(trim(ref_key)) END AS key, max(deleted_at) AS deleted_at
  FROM tombstone, months m WHERE {upto.format('deleted_at')} GROUP BY ALL),
judged AS (
  SELECT k.*, CASE WHEN p.key IS NULL THEN 'missing' WHEN g.deleted_at > p.last_at THEN 'deleted'
    WHEN p.first_at > k.last_ref THEN 'late' ELSE 'found' END AS state
  FROM keyed k LEFT JOIN parents p ON p.period = k.period AND p.target = k.target AND p.key = k.key
  LEFT JOIN gone g ON g.period = k.period AND g.target = k.target AND g.key = k.key)
"""


@register(
    "p3_found",
    _orphan_sql("SELECT '' AS period", "true") + "SELECT ref_table, ref_field, season, record, ref_value, state FROM judged WHERE state <> 'found'",
)
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return replay(_events(spark, sf), report=False)[0].orphans()


@register(
    "p3_report",
    _orphan_sql(
        "SELECT DISTINCT strftime(seen, '%Y-%m') AS period FROM (SELECT retrieved_at AS seen FROM chunk UNION ALL SELECT retrieved_at FROM symbol UNION ALL SELECT retrieved_at FROM vendordep UNION ALL SELECT deleted_at FROM tombstone) WHERE seen IS NOT NULL",
        "strftime({}, '%Y-%m') <= m.period",
    )
    + "SELECT period, ref_table, ref_field, season, state, count(*) AS n FROM judged WHERE state <> 'found' GROUP BY ALL",
)
def p3_report(spark: SparkSession, sf: str) -> DataFrame:
    return replay(_events(spark, sf))[1]
