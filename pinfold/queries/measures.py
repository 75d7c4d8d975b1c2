"""Queries over measures, loading steps and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pinfold.functions import sanitize as Z, text as T
from pinfold.operators import ingest as I, measures as M
from pinfold.queries.common import CHUNKS, chunks
from pinfold.queries.registry import register
from pinfold.session import table
from pinfold.streaming import streams

# Judgments stand-in: every third hit's document of a query was judged relevant.
RANKED = """
WITH h AS (SELECT query_id, pos, id, max(CASE WHEN isnan(score) THEN NULL ELSE score END) AS score, any_value(frc_season ORDER BY id, frc_season) AS season FROM search_hit GROUP BY query_id, pos, id),
ranked AS (SELECT *, regexp_replace(id, '#[0-9]+$', '') AS doc, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(score, 0) DESC, id, pos) AS rank FROM h),
judged AS (SELECT DISTINCT query_id, doc FROM ranked WHERE pos % 3 = 1),
firsts AS (SELECT query_id, doc, min(rank) AS rank FROM ranked WHERE rank <= 10 GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS p FROM firsts),
got AS (SELECT query_id, count(*) FILTER (p <= 5) AS f5, count(*) AS f10, sum(1 / log2(p + 1.0)) AS dcg, min(p) AS first FROM placed SEMI JOIN judged USING (query_id, doc) GROUP BY ALL),
want AS (SELECT query_id, count(*) AS n, list_sum(list_transform(range(1, least(count(*), 10) + 1), lambda i: 1 / log2(i + 1.0))) AS ideal FROM judged GROUP BY ALL),
quality AS (SELECT query_id, coalesce(f5 / n, 0) AS recall5, coalesce(f10 / n, 0) AS recall10, coalesce(dcg / ideal, 0) AS ndcg10, coalesce(1 / first, 0) AS mrr10 FROM want LEFT JOIN got USING (query_id))
"""


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    score = F.when(~F.isnan("score"), F.col("score"))
    h = table(spark, sf, "search_hit").groupBy("query_id", "pos", "id").agg(F.max(score).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.coalesce("score", F.lit(0.0)).desc(), "id", "pos")
    return h.withColumns({"doc": F.regexp_replace("id", r"#[0-9]+$", ""), "rank": F.row_number().over(w)})


def _quality(spark: SparkSession, sf: str) -> DataFrame:
    r = _ranked(spark, sf)
    return M.retrieval_quality(r, r.filter("pos % 3 = 1"))


@register("ir_metrics", RANKED + "SELECT query_id, round(recall5, 6) AS recall5, round(recall10, 6) AS recall10, round(ndcg10, 6) AS ndcg10, round(mrr10, 6) AS mrr10 FROM quality")
def ir_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _quality(spark, sf).select("query_id", *[F.round(c, 6).alias(c) for c in ("recall5", "recall10", "ndcg10", "mrr10")])


@register("ir_by_group", RANKED + """, env AS (SELECT query_id, any_value(language ORDER BY asked_at DESC, query) AS language, any_value(status ORDER BY asked_at DESC, query) AS status FROM search_envelope GROUP BY query_id)
SELECT language, status, count(*) AS n, round(avg(round(recall5, 9)), 3) AS recall5, round(avg(round(recall10, 9)), 3) AS recall10, round(avg(round(ndcg10, 9)), 3) AS ndcg10, round(avg(round(mrr10, 9)), 3) AS mrr10
FROM quality JOIN env USING (query_id) GROUP BY GROUPING SETS ((), (language), (status))""")  # fmt: skip
def ir_by_group(spark: SparkSession, sf: str) -> DataFrame:
    env = table(spark, sf, "search_envelope").groupBy("query_id").agg(F.min_by(F.struct("language", "status"), F.struct(-F.unix_micros("asked_at"), F.col("query"))).alias("e")).select("query_id", "e.language", "e.status")
    values = ["recall5", "recall10", "ndcg10", "mrr10"]
    rows = _quality(spark, sf).join(env, "query_id").withColumns({v: F.round(v, 9) for v in values})
    return M.means(rows, values, [[], ["language"], ["status"]], ["language", "status"])


@register("wrong_season", RANKED + """, env AS (SELECT query_id, any_value(frc_season ORDER BY asked_at DESC, query) AS pin FROM search_envelope GROUP BY query_id)
SELECT query_id, round(count(*) FILTER (season IS DISTINCT FROM pin) / count(*), 6) AS wrong5 FROM ranked JOIN env USING (query_id) WHERE rank <= 5 GROUP BY query_id""")  # fmt: skip
def wrong_season(spark: SparkSession, sf: str) -> DataFrame:
    env = table(spark, sf, "search_envelope").groupBy("query_id").agg(F.min_by(F.struct("frc_season"), F.struct(-F.unix_micros("asked_at"), F.col("query"))).alias("e")).select("query_id", F.col("e.frc_season").alias("pin"))
    season = table(spark, sf, "search_hit").groupBy("query_id", "pos", "id").agg(F.min("frc_season").alias("season"))
    rows = _ranked(spark, sf).filter("rank <= 5").join(season, ["query_id", "pos", "id"]).join(env, "query_id")
    return rows.groupBy("query_id").agg(F.round(F.count_if(~F.col("season").eqNullSafe(F.col("pin"))) / F.count("*"), 6).alias("wrong5"))


@register("latency_percentiles", """
SELECT event_type, v[n // 2 + 1] AS p50, v[CAST(floor(0.95 * (n - 1)) AS BIGINT) + 1] AS p95, v[CAST(floor(0.99 * (n - 1)) AS BIGINT) + 1] AS p99
FROM (SELECT event_type, list_sort(list(value)) AS v, count(value) AS n FROM events GROUP BY ALL)""")  # fmt: skip
def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n")
    at = {"p50": F.floor(n / 2), "p95": F.floor(0.95 * (n - 1)), "p99": F.floor(0.99 * (n - 1))}
    return M.nearest_rank(table(spark, sf, "events"), ["event_type"], "value", at)


ARMS = """(SELECT CASE WHEN event_id % 2 = 0 THEN 'with' ELSE 'without' END AS condition, strftime(ts, '%Y-%m') AS season, user_id AS task, value < 60 AS pass, (props->>'k')::INT % 4 AS errors, event_type = 'error' AS flagged, value FROM events)"""


def _arms(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.when(F.col("event_id") % 2 == 0, "with").otherwise("without").alias("condition"), F.date_format("ts", "yyyy-MM").alias("season"), F.col("user_id").alias("task"), (F.col("value") < 60).alias("pass"), (F.get_json_object("props", "$.k").cast("int") % 4).alias("errors"), (F.col("event_type") == "error").alias("flagged"), "value")


@register("arm_report", f"""
SELECT season, condition, count(*) AS runs, count(*) FILTER (pass) AS passed, count(*) FILTER (NOT pass AND flagged) AS flagged, count(*) FILTER (pass AND flagged) AS false_errors, count(*) FILTER (flagged = NOT pass) AS agrees,
  round(avg(errors), 6) AS errors FROM {ARMS} GROUP BY GROUPING SETS ((condition), (season, condition))""")  # fmt: skip
def arm_report(spark: SparkSession, sf: str) -> DataFrame:
    a, p, f = _arms(spark, sf), F.col("pass"), F.col("flagged")
    return a.groupingSets([[F.col("condition")], [F.col("season"), F.col("condition")]], F.col("season"), F.col("condition")).agg(
        F.count("*").alias("runs"), F.count_if(p).alias("passed"), F.count_if(~p & f).alias("flagged"), F.count_if(p & f).alias("false_errors"), F.count_if(f == ~p).alias("agrees"), F.round(F.avg("errors"), 6).alias("errors")
    )


def _deltas(spark: SparkSession, sf: str) -> DataFrame:
    """(task, delta) of the tasks that ran in both conditions."""
    share = lambda c: F.count_if(F.col("pass") & (F.col("condition") == c)) / F.nullif(F.count_if(F.col("condition") == c), F.lit(0))
    return _arms(spark, sf).groupBy("task").agg((share("with") - share("without")).alias("delta")).filter("delta IS NOT NULL")


@register("paired_delta", f"""
SELECT task, round(count(*) FILTER (pass AND condition = 'with') / nullif(count(*) FILTER (condition = 'with'), 0) - count(*) FILTER (pass AND condition = 'without') / nullif(count(*) FILTER (condition = 'without'), 0), 6) AS delta
FROM {ARMS} GROUP BY task HAVING delta IS NOT NULL""")  # fmt: skip
def paired_delta(spark: SparkSession, sf: str) -> DataFrame:
    return _deltas(spark, sf).select("task", F.round("delta", 6).alias("delta"))


@register("bootstrap_interval", None)
def bootstrap_interval(spark: SparkSession, sf: str) -> DataFrame:
    return M.bootstrap(_deltas(spark, sf), "delta")


@register("quality_gate", RANKED + "SELECT round(avg(recall10), 3) AS recall10, round(avg(ndcg10), 3) AS ndcg10, avg(recall10) >= 0.5 - 0.015 AND avg(ndcg10) >= 0.3 - 0.015 AS pass FROM quality")
def quality_gate(spark: SparkSession, sf: str) -> DataFrame:
    a, n = F.avg("recall10"), F.avg("ndcg10")
    return _quality(spark, sf).agg(F.round(a, 3).alias("recall10"), F.round(n, 3).alias("ndcg10"), ((a >= 0.5 - 0.015) & (n >= 0.3 - 0.015)).alias("pass"))


def _q(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


DETECTED = "coalesce(" + " OR ".join(f"regexp_matches(body, {_q(p)})" for p in Z.SUSPECT) + ", false)"


@register("confusion_counts", f"SELECT count(*) FILTER (suspect AND d) AS tp, count(*) FILTER (suspect AND NOT d) AS fn, count(*) FILTER (NOT suspect AND d) AS fp, count(*) FILTER (NOT suspect AND NOT d) AS tn FROM (SELECT suspect, {DETECTED} AS d FROM {CHUNKS})")
def confusion_counts(spark: SparkSession, sf: str) -> DataFrame:
    d, s = Z.suspect(F.col("body")), F.col("suspect")
    rows = chunks(spark, sf, "suspect", "body").select("suspect", d.alias("d"))
    d = F.col("d")
    return rows.agg(F.count_if(s & d).alias("tp"), F.count_if(s & ~d).alias("fn"), F.count_if(~s & d).alias("fp"), F.count_if(~s & ~d).alias("tn"))


@register("histogram_cumulative", "SELECT event_type, le, count(e.value) FILTER (le = '+Inf' OR e.value / 100 <= TRY_CAST(le AS DOUBLE)) AS n FROM events e, (SELECT unnest(['0.005','0.01','0.025','0.05','0.1','0.25','0.5','1','2.5','5','+Inf']) AS le) GROUP BY ALL")
def histogram_cumulative(spark: SparkSession, sf: str) -> DataFrame:
    return M.histogram(table(spark, sf, "events"), ["event_type"], F.col("value") / 100)


@register("request_counts", """
WITH c AS (SELECT event_type AS method, props->>'k' AS tool, (floor(value / 100)::INT + 1) || 'xx' AS status, count(*) AS n FROM events GROUP BY ALL),
k AS (SELECT *, row_number() OVER (ORDER BY n DESC, method, tool, status) <= 512 AS keep FROM c)
SELECT CASE WHEN keep THEN method ELSE 'other' END AS method, CASE WHEN keep THEN tool ELSE 'other' END AS tool, CASE WHEN keep THEN status ELSE 'other' END AS status, sum(n)::BIGINT AS n FROM k GROUP BY ALL""")  # fmt: skip
def request_counts(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("event_type").alias("method"), F.get_json_object("props", "$.k").alias("tool"), F.concat((F.floor(F.col("value") / 100).cast("int") + 1).cast("string"), F.lit("xx")).alias("status"))
    return M.capped_counts(e, ["method", "tool", "status"])


BUCKET = """
WITH RECURSIVE e AS (SELECT user_id::VARCHAR AS client, event_id AS id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
walk AS (
  SELECT client, id, t, i, true AS allowed, 2.0::DOUBLE AS tokens FROM e WHERE i = 1
  UNION ALL
  SELECT e.client, e.id, e.t, e.i, least(3.0, w.tokens + (e.t - w.t) * 0.00002) >= 1, least(3.0, w.tokens + (e.t - w.t) * 0.00002) - CASE WHEN least(3.0, w.tokens + (e.t - w.t) * 0.00002) >= 1 THEN 1 ELSE 0 END
  FROM walk w JOIN e ON e.client = w.client AND e.i = w.i + 1)
SELECT client, id, allowed, round(tokens, 6) AS tokens FROM walk"""


def _requests(df: DataFrame) -> DataFrame:
    return df.select("user_id", F.col("event_id").alias("id"), "ts")


@register("token_bucket", BUCKET)
def token_bucket(spark: SparkSession, sf: str) -> DataFrame:
    return M.token_bucket(_requests(table(spark, sf, "events")), "user_id", "ts", 0.00002, 3.0)


@register("stream_token_bucket", BUCKET)
def stream_token_bucket(spark: SparkSession, sf: str) -> DataFrame:
    stream = streams.token_bucket(_requests(streams.source(spark, f"{sf}/events.parquet")), "user_id", "ts", 0.00002, 3.0)
    return streams.drain(stream, "buckets")


@register("stream_dedupe", "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY ALL")
def stream_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """The table is read twice over, as a feed that repeats itself."""
    one = streams.source(spark, f"{sf}/events.parquet")
    two = one.withColumn("ts", F.col("ts").cast("timestamp")).unionByName(one.withColumn("ts", F.col("ts").cast("timestamp")))
    kept = streams.drain(streams.dedupe(two.select("event_id", "event_type", "ts"), ["event_id"], "ts", "60 days"), "deduped")
    return kept.groupBy("event_type").agg(F.count("*").alias("n"))


@register("stream_counts", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by day, merged batch by batch, so that late rows still count."""
    s = streams.source(spark, f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.merged_counts(s, "ts", ["event_type"], "value", "1 day").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@register("stream_windows", None)
def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by hour that come out once the watermark has passed them."""
    s = streams.source(spark, f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.drain(streams.windowed_counts(s, "ts", ["event_type"], "1 hour"), "windows")


V = " ".join(f"WHEN trim(coalesce({c}, '')) = '' THEN 'missing {c}'" for c in ("doc_id", "library", "version_lo", "season", "body", "source_url", "upstream_rev", "license"))
E = " ".join(f"WHEN {c} IS NULL OR {c} NOT IN ({', '.join(repr(x) for x in known)}) THEN 'unknown {c}'" for c, known in (("channel", I.CHANNELS), ("language", I.LANGUAGES), ("kind", I.KINDS), ("trust", I.TRUSTS)))


@register("validate_rejects", f"SELECT CASE {V} WHEN coalesce(ord, -1) < 0 THEN 'negative ord' WHEN retrieved_at IS NULL THEN 'missing retrieved_at' {E} WHEN NOT starts_with(source_url, 'https://') THEN 'source_url must be https' END AS error, count(*) AS n FROM chunk GROUP BY ALL")
def validate_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "chunk").groupBy(I.chunk_errors().alias("error")).agg(F.count("*").alias("n"))


@register("duplicate_keys", "SELECT uuid, version, season, count(*) AS n FROM vendordep GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "vendordep").groupBy("uuid", "version", "season").agg(F.count("*").alias("n")).filter("n > 1")


@register("upsert_last", "SELECT uuid, version, season, max(retrieved_at) AS retrieved_at, count(*) AS n FROM vendordep GROUP BY ALL")
def upsert_last(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "vendordep")
    old, new = v.filter("retrieved_at < TIMESTAMP '2026-09-01 00:00:00'"), v.filter("retrieved_at >= TIMESTAMP '2026-09-01 00:00:00'")
    key = ["uuid", "version", "season"]
    kept = I.upsert(old, new, key, [F.col("retrieved_at"), F.col("upstream_rev"), F.col("json_url"), F.col("raw_json")])
    return kept.select(*key, "retrieved_at").join(v.groupBy(*key).agg(F.count("*").alias("n")), key)


@register("upsert_first", "SELECT library, version, language, fqn, signature, min(retrieved_at) AS retrieved_at FROM symbol WHERE season IS NOT NULL GROUP BY ALL")
def upsert_first(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "symbol").filter("season IS NOT NULL")
    key = ["library", "version", "language", "fqn", "signature"]
    kept = I.upsert(s, s.limit(0), key, [F.col("retrieved_at"), F.col("season"), F.col("chunk_id"), F.col("summary"), F.col("replacement"), F.col("source_url")], "first")
    return kept.select(*key, "retrieved_at")


@register("dedupe_first", "SELECT doc_id, md5(text) AS digest FROM documents WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def dedupe_first(spark: SparkSession, sf: str) -> DataFrame:
    """The first document of each text; texts meet as digests, so bodies aren't shuffled."""
    d = table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    return d.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "digest")


@register("thread_join", f"""
WITH c AS {CHUNKS}, f AS (SELECT * FROM c WHERE lower(trim(kind)) = 'forum')
SELECT doc_id, ord, title FROM f r WHERE ord > 0 AND EXISTS (SELECT 1 FROM f t WHERE t.doc_id = r.doc_id AND t.ord = 0 AND NOT t.suspect)""")  # fmt: skip
def thread_join(spark: SparkSession, sf: str) -> DataFrame:
    """Replies whose topic was kept."""
    f = chunks(spark, sf, "kind", "suspect", "title").filter(F.lower(F.trim("kind")) == "forum")
    topics = f.filter("ord = 0 AND NOT suspect").select("doc_id")
    return f.filter("ord > 0").join(topics, "doc_id", "left_semi").select("doc_id", "ord", "title")


@register("chunk_split", None)
def chunk_split(spark: SparkSession, sf: str) -> DataFrame:
    c = chunks(spark, sf, "body").filter("body IS NOT NULL")
    return c.select("doc_id", "ord", F.posexplode(I.soft_split(F.col("body"))).alias("part", "text")).filter(T.estimate_tokens(F.col("text")) >= I.LEAST).select("doc_id", "ord", "part", T.estimate_tokens(F.col("text")).alias("tokens"))


@register("chunk_defaults", f"""
SELECT doc_id, ord, md5(CASE WHEN trim(coalesce(prefix, '')) = '' THEN array_to_string(list_filter([library, CASE WHEN coalesce(version_hi, '') = '' OR version_hi = version_lo THEN version_lo ELSE version_lo || '–' || version_hi END, title, heading_path, symbol], lambda x: coalesce(x, '') <> ''), ' › ') ELSE prefix END) AS prefix,
  CASE WHEN coalesce(tokens, 0) = 0 THEN (strlen(coalesce(body, '')) + 3) // 4 ELSE tokens END AS tokens,
  lower(coalesce(CASE WHEN contains(symbol, '#') THEN regexp_extract(symbol, '([^#]*)$', 1) ELSE regexp_extract(symbol, '([^.:]*)$', 1) END, '')) AS symbol_key FROM {CHUNKS}""")  # fmt: skip
def chunk_defaults(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.with_defaults(chunks(spark, sf, "library", "version_lo", "version_hi", "title", "heading_path", "symbol", "prefix", "body"))
    return rows.select("doc_id", "ord", F.md5(F.col("prefix").cast("binary")).alias("prefix"), "tokens", "symbol_key")


@register("build_digest", None)
def build_digest(spark: SparkSession, sf: str) -> DataFrame:
    return I.digest(chunks(spark, sf, "library", "season", "body"), ["doc_id", "ord", "library", "season", "body"])
