"""Queries over part names, request labels and cut texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pinfold.functions import parts as P
from pinfold.operators import requests as R
from pinfold.queries.common import CHUNKS, chunks
from pinfold.queries.registry import register
from pinfold.session import table


def _map(names: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in names.items()) + "}"


@register("part_ids", f"""
WITH n AS (SELECT DISTINCT name, regexp_replace(lower(name), '[ _()-]', '', 'g') AS n FROM (SELECT p_name AS name FROM part UNION SELECT name FROM vendordep UNION SELECT unnest(['Kraken X60 FOC', 'NEO 550', 'foc', 'Falcon_500', 'bag']))),
f AS (SELECT name, CASE WHEN ends_with(n, 'foc') AND length(n) > 3 THEN regexp_replace(n, 'foc$', '') ELSE n END AS b, ends_with(n, 'foc') AND length(n) > 3 AS foc FROM n)
SELECT name, coalesce({_map(P.PARTS)}[b], b) || CASE WHEN foc THEN '-foc' ELSE '' END AS part FROM f""")  # fmt: skip
def part_ids(spark: SparkSession, sf: str) -> DataFrame:
    more = spark.createDataFrame([(x,) for x in ("Kraken X60 FOC", "NEO 550", "foc", "Falcon_500", "bag")], "name string")
    names = table(spark, sf, "part").select(F.col("p_name").alias("name")).union(table(spark, sf, "vendordep").select("name")).union(more).distinct()
    return names.select("name", P.part_id(F.col("name")).alias("part"))


@register("library_ids", f"""
SELECT library, coalesce({_map(P.LIBRARIES)}[n], n) AS id, count(*) AS n FROM (SELECT library, regexp_replace(lower(trim(library)), '[ _-]', '', 'g') AS n FROM chunk) GROUP BY ALL""")  # fmt: skip
def library_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunk").groupBy("library", P.library_id(F.col("library")).alias("id")).agg(F.count("*").alias("n"))


@register("request_labels", """
WITH b AS (SELECT event_id, CASE WHEN event_type = 'error' THEN 'rubbish' ELSE '{"method":"' || CASE WHEN event_type = 'view' THEN 'tools/call' WHEN event_type = 'click' THEN 'Bad Name' ELSE event_type END || '","params":{"name":"t' || (user_id % 7) || '"}}' END AS body FROM events),
m AS (SELECT event_id, CASE WHEN body = 'rubbish' THEN NULL ELSE body->>'$.method' END AS method, CASE WHEN body = 'rubbish' THEN NULL ELSE body->>'$.params.name' END AS name FROM b)
SELECT CASE WHEN coalesce(method, '') = '' THEN 'invalid' WHEN regexp_matches(method, '^[a-z0-9_/]{1,40}$') THEN method ELSE 'other' END AS method,
  CASE WHEN method = 'tools/call' AND regexp_matches(name, '^[a-z0-9_/]{1,40}$') THEN name ELSE '' END AS tool, count(*) AS n FROM m GROUP BY ALL""")  # fmt: skip
def request_labels(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "tools/call").when(F.col("event_type") == "click", "Bad Name").otherwise(F.col("event_type"))
    body = F.when(F.col("event_type") == "error", "rubbish").otherwise(F.concat(F.lit('{"method":"'), kind, F.lit('","params":{"name":"t'), (F.col("user_id") % 7).cast("string"), F.lit('"}}')))
    method, tool = R.labels(F.col("body"))
    return table(spark, sf, "events").select(body.alias("body")).groupBy(method.alias("method"), tool.alias("tool")).agg(F.count("*").alias("n"))


@register("allowed_hosts", f"SELECT host, host IN ('catalog.example') OR ends_with(host, '.corelib.example') AS ok, count(*) AS n FROM (SELECT lower(regexp_extract(source_url, '^https?://([^/:]+)', 1)) AS host FROM {CHUNKS}) GROUP BY ALL")
def allowed_hosts(spark: SparkSession, sf: str) -> DataFrame:
    h = chunks(spark, sf, "source_url").select(F.lower(F.regexp_extract("source_url", "^https?://([^/:]+)", 1)).alias("host"))
    return h.groupBy("host", R.allowed(F.col("host"), ["catalog.example", "*.corelib.example"]).alias("ok")).agg(F.count("*").alias("n"))


@register("snippets", None)
def snippets(spark: SparkSession, sf: str) -> DataFrame:
    return chunks(spark, sf, "body").filter("body IS NOT NULL").select("doc_id", "ord", P.snippet(F.col("body"), 350).alias("snippet"))


@register("body_pages", None)
def body_pages(spark: SparkSession, sf: str) -> DataFrame:
    return chunks(spark, sf, "body").filter("body <> ''").select("doc_id", "ord", F.posexplode(P.body_pages(F.col("body"), 350)).alias("page", "text"))
