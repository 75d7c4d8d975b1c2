"""Pieces that several queries share, in both languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pinfold.functions import text as T
from pinfold.session import table

#: Each chunk once, as last delivered.
CHUNKS = """(SELECT * FROM chunk QUALIFY row_number() OVER (PARTITION BY doc_id, ord
  ORDER BY retrieved_at DESC NULLS LAST, upstream_rev DESC NULLS LAST, tokens DESC NULLS LAST) = 1)"""
#: Each symbol and signature of a season once, as last delivered.
SYMBOLS = r"""(SELECT * REPLACE (regexp_replace(season, '^\s+|\s+$', '', 'g') AS season) FROM symbol
  WHERE season IS NOT NULL QUALIFY row_number() OVER (PARTITION BY library, language, fqn, signature,
  regexp_replace(season, '^\s+|\s+$', '', 'g') ORDER BY retrieved_at DESC NULLS LAST, version DESC NULLS LAST, chunk_id DESC NULLS LAST,
  replacement DESC NULLS LAST, summary DESC NULLS LAST) = 1)"""
#: Each catalog entry once, as last delivered.
CATALOG = """(SELECT * FROM vendordep QUALIFY row_number() OVER (PARTITION BY uuid, version, season
  ORDER BY retrieved_at DESC NULLS LAST, upstream_rev DESC NULLS LAST, json_url DESC NULLS LAST, raw_json DESC NULLS LAST) = 1)"""
#: A hundredth of nothing is cut: searches take every twentieth query, against all rows.
ASKED = r"""(SELECT query_id, any_value(query ORDER BY asked_at DESC, query) AS query, any_value(frc_season ORDER BY asked_at DESC, query) AS season,
  any_value(language ORDER BY asked_at DESC, query) AS language FROM search_envelope WHERE query_id % 20 = 0 GROUP BY query_id)"""
STOP = "(" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + ")"
TOK = r"'[\p{L}\p{Nd}_]+'"
# SQL of the same splits with an engine whose patterns know no look-around.
PARTS = r"""list_transform(list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(%s,
  '(\p{Ll})(\p{Lu})', '\1_\2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1_\2', 'g'), '(\p{L})(\p{Nd})', '\1_\2', 'g'), '(\p{Nd})(\p{L})', '\1_\2', 'g'), '_+', '_', 'g'), '_'),
  lambda x: x <> ''), lambda x: lower(x))"""
#: The parts of each chunk's compound identifiers, where it has any: CTEs over ch0.
EXPANDED = f"""
toks AS (SELECT doc_id, ord, unnest(t) AS tok, generate_subscripts(t, 1) AS pos FROM (
  SELECT doc_id, ord, regexp_extract_all(coalesce(symbol, '') || ' ' || coalesce(title, '') || ' ' || coalesce(body, ''), {TOK}) AS t FROM ch0)),
parts AS (SELECT doc_id, ord, tok, pos, {PARTS % 'tok'} AS p FROM toks WHERE strlen(tok) >= 3),
firsts AS (SELECT * FROM parts WHERE len(p) > 1 QUALIFY row_number() OVER (PARTITION BY doc_id, ord, lower(tok) ORDER BY pos) = 1),
expanded AS (SELECT doc_id, ord, string_agg(array_to_string(p, ' '), ' ' ORDER BY pos) AS expand FROM firsts GROUP BY ALL)"""


def last(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last delivered row of each key. A key's copies meet in one task; there are few of them by nature, and what
    one key could hold at most passes through a sort that spills."""
    w = Window.partitionBy(*key).orderBy(*[F.col(o).desc_nulls_last() for o in order])
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def chunks(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Each chunk once; only the columns asked for are read."""
    own = table(spark, sf, "chunk").select(*dict.fromkeys(["doc_id", "ord", "retrieved_at", "upstream_rev", "tokens", *columns]))
    return last(own, ["doc_id", "ord"], ["retrieved_at", "upstream_rev", "tokens"])


def symbols(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "symbol").filter("season IS NOT NULL").withColumn("season", F.regexp_replace("season", r"^\s+|\s+$", ""))
    return last(own, ["library", "language", "fqn", "signature", "season"], ["retrieved_at", "version", "chunk_id", "replacement", "summary"])


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    return last(table(spark, sf, "vendordep"), ["uuid", "version", "season"], ["retrieved_at", "upstream_rev", "json_url", "raw_json"])


def asked(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, query, season, language) of every twentieth query, as last asked."""
    rows = table(spark, sf, "search_envelope").filter("query_id % 20 = 0")
    w = Window.partitionBy("query_id").orderBy(F.col("asked_at").desc(), "query")
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").select("query_id", "query", F.col("frc_season").alias("season"), "language")
