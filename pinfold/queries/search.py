"""Retrieval queries: each stage of the search, then the whole of it for a batch of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pinfold.functions import names as N, text as T, vectors as V
from pinfold.operators import search as S
from pinfold.operators.vectors import topk
from pinfold.plans.router import route
from pinfold.queries.common import ASKED, CHUNKS, EXPANDED, STOP, SYMBOLS, TOK, asked, chunks, last, symbols
from pinfold.queries.registry import register
from pinfold.scratch import materialize
from pinfold.session import table

KEY = ["doc_id", "ord"]
WEIGHTS = S.WEIGHTS
TERMS3 = ["encoder", "brownout", "retries"]


def _order():
    return [F.col("score").desc(), F.col("doc_id"), F.col("ord")]


def bm25_sql(queries: str, part: str = "") -> str:
    """CTEs up to ``scored`` (query_id, doc_id, ord, score); ``queries`` gives query_id and term."""
    p = f"{part}, " if part else ""
    tok = f"regexp_extract_all(strip_accents(lower(coalesce(%s, ''))), {TOK})"
    every = " UNION ALL ".join(f"SELECT doc_id, ord, {w} AS w, unnest({tok % c}) AS term FROM ch" for c, w in WEIGHTS.items())
    dl = " + ".join(f"len({tok % c})" for c in WEIGHTS)
    on = f"USING ({part})" if part else "ON true"
    return f"""
WITH ch0 AS {CHUNKS}, {EXPANDED},
ch AS (SELECT c.*, coalesce(e.expand, '') AS expand FROM ch0 c LEFT JOIN expanded e USING (doc_id, ord)), asked AS (SELECT DISTINCT query_id, term FROM ({queries})),
post AS (SELECT doc_id, ord, term, sum(w) AS f FROM ({every}) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
size AS (SELECT doc_id, ord, {p}{dl} AS dl FROM ch),
stats AS (SELECT {p}count(*) AS n, avg(dl) AS avgdl FROM size GROUP BY ALL),
placed AS (SELECT * FROM post JOIN size USING (doc_id, ord)),
df AS (SELECT {p}term, count(*) AS df FROM placed GROUP BY ALL),
idf AS (SELECT {p}term, avgdl, greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) AS idf FROM df JOIN stats {on}),
scored AS (
  SELECT query_id, doc_id, ord, round(sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM asked JOIN placed USING (term) JOIN idf USING ({p}term) GROUP BY ALL)
"""


THREE = "SELECT 0 AS query_id, unnest(['" + "','".join(TERMS3) + "']) AS term"
QUERY_TERMS = f"""SELECT query_id, term FROM (
  SELECT query_id, unnest(regexp_extract_all(strip_accents(lower(query)), {TOK})) AS term FROM {ASKED})
  WHERE term NOT IN {STOP} AND strlen(term) >= 2"""


_INDEXES: dict[tuple[str, str], S.Index] = {}


def stored_index(spark: SparkSession, sf: str) -> S.Index:
    """The index of a folder's chunks by season, written once for a session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _INDEXES:
        docs = chunks(spark, sf, "symbol", "title", "heading_path", "prefix", "body", "season", "language", "trust")
        docs = docs.withColumn("language", F.lower(F.trim("language")))
        _INDEXES[key] = S.build_index(docs, KEY, WEIGHTS, ["season"], keep=["language", "trust"], expand=("symbol", "title", "body"))
    return _INDEXES[key]


@register(
    "index_build",
    bm25_sql("SELECT 0 AS query_id, '' AS term", "season").split("post AS (")[0]
    + "every AS (" + " UNION ALL ".join(f"SELECT season, doc_id, ord, unnest(regexp_extract_all(strip_accents(lower(coalesce({c}, ''))), {TOK})) AS term FROM ch" for c in WEIGHTS) + """)
SELECT season, count(DISTINCT doc_id || '#' || ord) AS items, count(DISTINCT term) AS terms, count(*) AS occurrences FROM every GROUP BY ALL""",
)
def index_build(spark: SparkSession, sf: str) -> DataFrame:
    """What the stored index holds by season: items with any term, distinct terms, occurrences."""
    x = stored_index(spark, sf)
    each = x.items.filter("terms <> ''").groupBy("season").agg(F.count("*").alias("items"), F.sum("dl").alias("occurrences"))
    terms = x.terms.groupBy("season").agg(F.count("*").alias("terms")).withColumnRenamed("season", "s")
    return each.join(terms, F.col("season").eqNullSafe(F.col("s"))).select("season", "items", "terms", "occurrences")


def _three(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.col("id").alias("query_id"), F.array(*map(F.lit, TERMS3)).alias("terms"))


def _terms(queries: DataFrame) -> DataFrame:
    return queries.withColumn("terms", F.filter(S.terms_of(F.col("query")), lambda x: ~x.isin(T.STOPWORDS) & (F.octet_length(x) >= 2)))


@register("bm25_topk", bm25_sql(THREE) + "SELECT doc_id, ord, score FROM scored ORDER BY score DESC, doc_id, ord LIMIT 10")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    found = stored_index(spark, sf).bm25(_three(spark), [])
    return found.select("doc_id", "ord", "score").orderBy(*_order()).limit(10)


@register(
    "bm25_filtered",
    bm25_sql(THREE, "season")
    + "SELECT doc_id, ord, season, score FROM scored JOIN ch USING (doc_id, ord) WHERE lower(trim(language)) IN ('java', 'any') AND trust <> 'community' ORDER BY score DESC, doc_id, ord LIMIT 10",
)
def bm25_filtered(spark: SparkSession, sf: str) -> DataFrame:
    docs = chunks(spark, sf, "season", "language", "trust")
    found = stored_index(spark, sf).bm25(_three(spark))
    ok = docs.filter(F.lower(F.trim("language")).isin("java", "any") & (F.col("trust") != "community")).select(*KEY, "season")
    return found.join(ok, KEY).select(*KEY, "season", "score").orderBy(*_order()).limit(10)


@register(
    "bm25_batch",
    bm25_sql(QUERY_TERMS)
    + "SELECT query_id, doc_id, ord, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, ord) AS rank FROM scored QUALIFY rank <= 5",
)
def bm25_batch(spark: SparkSession, sf: str) -> DataFrame:
    found = stored_index(spark, sf).best(_terms(asked(spark, sf)), 5, [])
    return S.top(found, _order(), 5).select("query_id", *KEY, "score", "rank")


@register(
    "late_hydrate",
    bm25_sql(THREE)
    + "SELECT t.doc_id, t.ord, score, title, body FROM (SELECT * FROM scored ORDER BY score DESC, doc_id, ord LIMIT 5) t JOIN ch USING (doc_id, ord)",
)
def late_hydrate(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies are read for the page only: its few keys come first and are broadcast (at most 5)."""
    best = bm25_topk(spark, sf).orderBy(*_order()).limit(5)
    return chunks(spark, sf, "title", "body").join(F.broadcast(best), KEY).select(*KEY, "score", "title", "body")


def _dense(label: bool) -> str:
    same = "AND r.label = q.label" if label else ""
    return f"""
SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
  SELECT q.vec_id AS query_id, r.vec_id, round(list_dot_product(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 6) + 0.0 AS score
  FROM embeddings q JOIN embeddings r ON true {same} WHERE q.vec_id % 20 = 0)
QUALIFY rank <= 10"""


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf, "embeddings")
    return e, e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "label")


@register("dense_topk", _dense(False))
def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    e, q = _vectors(spark, sf)
    return topk(e, q, "vec_id", "embedding", 10)


@register("dense_topk_filtered", _dense(True))
def dense_topk_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """Only rows of the query's label: a mask within each block."""
    e, q = _vectors(spark, sf)
    return topk(e, q, "vec_id", "embedding", 10, label="label")


@register(
    "dense_quantized",
    """
WITH m AS (SELECT vec_id, embedding, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS m FROM embeddings),
q AS (SELECT vec_id, m / 127 AS scale, list_transform(embedding, lambda x: CASE WHEN m = 0 THEN 0 ELSE round(x::DOUBLE * 127 / m)::INT END) AS code FROM m)
SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
  SELECT a.vec_id AS query_id, b.vec_id, round(list_dot_product(a.code::DOUBLE[], b.code::DOUBLE[]) * a.scale * b.scale, 6) AS score
  FROM q a, q b WHERE a.vec_id % 20 = 0)
QUALIFY rank <= 10""",
)
def dense_quantized(spark: SparkSession, sf: str) -> DataFrame:
    """Products of the byte codes, times both scales."""
    e = table(spark, sf, "embeddings").select("vec_id", V.quantize(F.col("embedding")).alias("code"), V.scale(F.col("embedding")).alias("scale"))
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("code").alias("vector"), "scale")
    return topk(e, q, "vec_id", "code", 10, scale="scale")


@register(
    "rrf_fusion",
    f"""
WITH words AS (
  SELECT doc_id, len(list_filter(regexp_extract_all(strip_accents(lower(coalesce(text, ''))), {TOK}), lambda x: x = 'encoder')) AS n FROM documents),
lex AS (SELECT 0 AS query_id, doc_id AS id, row_number() OVER (ORDER BY n DESC, doc_id) AS rank FROM words WHERE n > 0 QUALIFY rank <= 50),
dense AS (SELECT 0 AS query_id, vec_id AS id, row_number() OVER (ORDER BY s DESC, vec_id) AS rank FROM (
  SELECT r.vec_id, round(list_dot_product(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 6) AS s
  FROM embeddings r, (SELECT embedding FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) q) QUALIFY rank <= 50)
SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, count(*) AS lists
FROM (SELECT * FROM lex UNION ALL SELECT * FROM dense) GROUP BY ALL""",
)
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    """A lexical and a dense list of one query, fused."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.size(F.filter(S.terms_of(F.coalesce("text", F.lit(""))), lambda x: x == "encoder")).alias("n"))
    lex = d.filter("n > 0").orderBy(F.col("n").desc(), "id").limit(S.DEPTH).withColumn("query_id", F.lit(0).cast("bigint"))
    lex = S.top(lex, [F.col("n").desc(), F.col("id")], S.DEPTH)
    e = table(spark, sf, "embeddings")
    first = e.agg(F.min_by("embedding", "vec_id").alias("vector")).withColumn("query_id", F.lit(0).cast("bigint"))
    dense = topk(e, first, "vec_id", "embedding", S.DEPTH).withColumnRenamed("vec_id", "id")
    return S.rrf(lex, dense, key=["id"])


# A hit list: what the stored hits say, each hit once with its chunk's facts.
HITS = f"""
ch AS {CHUNKS},
env AS (SELECT query_id, any_value(query ORDER BY asked_at DESC, query) AS query, any_value(frc_season ORDER BY asked_at DESC, query) AS pin,
  any_value(pin_source ORDER BY asked_at DESC, query) AS pin_source FROM search_envelope GROUP BY query_id),
hits AS (
  SELECT query_id, id, max(CASE WHEN isnan(score) THEN NULL ELSE score END) AS base, bool_or(exact_symbol) AS exact_symbol FROM search_hit GROUP BY ALL),
facts AS (
  SELECT h.query_id, h.id, coalesce(h.base, 0) AS base, coalesce(h.exact_symbol, false) AS exact_symbol, c.doc_id, c.ord, lower(trim(c.kind)) AS kind,
    c.trust, coalesce(c.suspect, false) AS suspect, c.channel, e.pin_source, e.query, c.title, c.heading_path, c.symbol, c.body, c.season, e.pin,
    regexp_matches(lower(e.query), '^(how|what)|how to') AS howto
  FROM hits h JOIN env e USING (query_id) JOIN ch c ON h.id = c.doc_id || '#' || c.ord)"""
BOOSTED = f"""
WITH {HITS},
boosted AS (
  SELECT *, round(base * CASE WHEN exact_symbol THEN 2.0 ELSE 1.0 END::DOUBLE
    * CASE WHEN trust = 'official' THEN 1.2 WHEN trust = 'vendor' THEN 1.1 ELSE 1.0 END::DOUBLE
    * CASE WHEN kind = 'code' AND howto THEN 1.2 ELSE 1.0 END::DOUBLE * CASE WHEN kind = 'api' THEN 0.5 ELSE 1.0 END::DOUBLE
    * CASE WHEN kind = 'forum' THEN 0.7 ELSE 1.0 END::DOUBLE * CASE WHEN suspect THEN 0.3 ELSE 1.0 END::DOUBLE
    * CASE WHEN channel = 'alpha' AND coalesce(pin_source, '') NOT IN ('arg', 'query') THEN 0.5 ELSE 1.0 END::DOUBLE, 9) AS score FROM facts),
diverse AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, ord) AS rank FROM (
    SELECT * FROM boosted QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, doc_id, ord) <= 2)
  QUALIFY rank <= 50)
"""


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    """Every stored hit once with the facts of its chunk and query."""
    env = table(spark, sf, "search_envelope").groupBy("query_id").agg(F.min_by(F.struct("query", "frc_season", "pin_source"), F.struct(-F.unix_micros("asked_at"), F.col("query"))).alias("e"))
    env = env.select("query_id", "e.query", F.col("e.frc_season").alias("pin"), "e.pin_source")
    score = F.when(~F.isnan("score"), F.col("score"))
    hits = table(spark, sf, "search_hit").groupBy("query_id", "id").agg(F.max(score).alias("base"), F.bool_or("exact_symbol").alias("exact_symbol"))
    at = N.parse_chunk_id(F.col("id"))
    hits = hits.withColumns({"doc_id": at["doc_id"], "ord": at["ord"], "base": F.coalesce("base", F.lit(0.0)), "exact_symbol": F.coalesce("exact_symbol", F.lit(False))})
    ch = chunks(spark, sf, "kind", "trust", "suspect", "channel", "title", "heading_path", "symbol", "body", "season").drop("tokens", "retrieved_at", "upstream_rev")
    rows = hits.join(env, "query_id").join(ch, KEY)
    return rows.withColumns({"kind": F.lower(F.trim("kind")), "suspect": F.coalesce("suspect", F.lit(False)), "howto": F.lower("query").rlike("^(how|what)|how to")})


def _boosted(spark: SparkSession, sf: str) -> DataFrame:
    f = _facts(spark, sf)
    no = F.lit(False)
    factor = S.boost({
        "symbol_hit": F.col("exact_symbol"), "named": no, "library_hit": no, "trust": F.col("trust"), "kind": F.col("kind"), "intent": F.when(F.col("howto"), "howto").otherwise("general"),
        "suspect": F.col("suspect"), "alpha_penalty": (F.col("channel") == "alpha") & ~F.coalesce("pin_source", F.lit("")).isin("arg", "query"),
    })
    return f.withColumn("score", F.round(F.col("base") * factor, 9))


@register("boosted_rank", BOOSTED + "SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, ord) AS rank FROM boosted")
def boosted_rank(spark: SparkSession, sf: str) -> DataFrame:
    return S.top(_boosted(spark, sf).select("query_id", "id", *KEY, "score"), _order(), 2**31 - 1).select("query_id", "id", "score", "rank")


def _diverse(spark: SparkSession, sf: str) -> DataFrame:
    return S.diversify(_boosted(spark, sf), ["doc_id"], _order())


@register("diversity_max2", BOOSTED + "SELECT query_id, id, score, rank FROM diverse")
def diversity_max2(spark: SparkSession, sf: str) -> DataFrame:
    return _diverse(spark, sf).select("query_id", "id", "score", "rank")


CONFIDENCE = (
    BOOSTED
    + f""",
terms AS (SELECT query_id, list_distinct(list_filter(list_transform(regexp_extract_all(query, {TOK}), lambda x: lower(x)), lambda x: x NOT IN {STOP} AND strlen(x) >= 2)) AS terms FROM env),
tops AS (
  SELECT d.query_id, pinned, max(score) FILTER (rank1 = 1) AS s1, max(score) FILTER (rank1 = 2) AS s2, bool_or(exact_symbol) FILTER (rank1 = 1) AS symbol,
    max(CASE WHEN len(terms) > 0 THEN len(list_filter(terms, lambda t: contains(lower(concat_ws(chr(10), title, heading_path, symbol, body)), t))) / len(terms) ELSE 0 END) FILTER (rank1 = 1) AS cover
  FROM (SELECT *, season IS NOT DISTINCT FROM pin AS pinned, row_number() OVER (PARTITION BY query_id, season IS NOT DISTINCT FROM pin ORDER BY rank) AS rank1 FROM diverse) d
  JOIN terms USING (query_id) GROUP BY ALL),
conf AS (
  SELECT query_id, pinned, cover, round(1 / (1 + exp(-(-3.0 + 2.0 * least(s1 / (1 / 61.0 * 1.2), 1.0) + 3.0 * cover
    + least(CASE WHEN s2 IS NULL OR s1 <= 0 THEN 0 ELSE (s1 - s2) / s1 END, 1.0) + CASE WHEN symbol THEN 1.5 ELSE 0 END))), 6) AS confidence FROM tops)
"""
)


def _confidence(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, pinned, cover, confidence) of the first hit in the pinned season and outside it."""
    d = _diverse(spark, sf).withColumn("pinned", F.col("season").eqNullSafe(F.col("pin")))
    w = Window.partitionBy("query_id", "pinned").orderBy("rank")
    two = d.withColumns({"r": F.row_number().over(w), "s2": F.lead("score").over(w)}).filter("r = 1")
    cover = S.coverage(T.content_terms(F.col("query")), *[F.col(c) for c in ("title", "heading_path", "symbol", "body")])
    gap = F.when(F.col("s2").isNull() | (F.col("score") <= 0), 0.0).otherwise((F.col("score") - F.col("s2")) / F.col("score"))
    rows = two.withColumn("cover", cover)
    return rows.select("query_id", "pinned", "cover", F.round(S.confidence(F.col("score"), F.lit(1), F.col("cover"), gap, F.col("exact_symbol")), 6).alias("confidence"))


@register("coverage_confidence", CONFIDENCE + "SELECT query_id, pinned, round(cover, 6) AS cover, confidence FROM conf")
def coverage_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return _confidence(spark, sf).withColumn("cover", F.round("cover", 6))


STATUS = (
    CONFIDENCE
    + """,
pair AS (SELECT query_id, max(confidence) FILTER (pinned) AS own, max(confidence) FILTER (NOT pinned) AS other FROM conf GROUP BY query_id),
judged AS (
  SELECT e.query_id, own, other, CASE WHEN (own IS NULL OR own < 0.35) AND other IS NOT NULL AND (own IS NULL OR other >= 0.6) THEN 'version_mismatch'
    WHEN own IS NULL THEN 'no_match' WHEN own < 0.35 THEN 'low_confidence' ELSE 'ok' END AS status
  FROM env e LEFT JOIN pair USING (query_id))
"""
)


def _status(spark: SparkSession, sf: str) -> DataFrame:
    pair = _confidence(spark, sf).groupBy("query_id").agg(F.max(F.when(F.col("pinned"), F.col("confidence"))).alias("own"), F.max(F.when(~F.col("pinned"), F.col("confidence"))).alias("other"))
    every = table(spark, sf, "search_envelope").select("query_id").distinct()
    return every.join(pair, "query_id", "left").withColumn("status", S.status(F.col("own"), F.col("other")))


@register("status_machine", STATUS + "SELECT query_id, own, other, status FROM judged")
def status_machine(spark: SparkSession, sf: str) -> DataFrame:
    return _status(spark, sf)


@register(
    "page_by_status",
    STATUS
    + """SELECT query_id, id, status, pinned, score, place FROM (
  SELECT d.query_id, d.id, j.status, d.score, d.season IS NOT DISTINCT FROM d.pin AS pinned,
    row_number() OVER (PARTITION BY d.query_id, d.season IS NOT DISTINCT FROM d.pin ORDER BY rank) AS place FROM diverse d JOIN judged j USING (query_id))
WHERE place <= CASE WHEN pinned THEN CASE status WHEN 'ok' THEN 5 WHEN 'low_confidence' THEN 3 WHEN 'version_mismatch' THEN 3 ELSE 0 END WHEN status = 'version_mismatch' THEN 5 ELSE 0 END""",
)
def page_by_status(spark: SparkSession, sf: str) -> DataFrame:
    """The hits each status shows: the pinned version's, and others' beside few of them where that is the answer."""
    d = _diverse(spark, sf).withColumn("pinned", F.col("season").eqNullSafe(F.col("pin")))
    d = d.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "pinned").orderBy("rank")))
    rows = d.join(_status(spark, sf).select("query_id", "status"), "query_id")
    return rows.filter(F.col("place") <= S.shown(F.col("status"), F.col("pinned"), 5)).select("query_id", "id", "status", "pinned", "score", "place")


@register(
    "budget_cut",
    BOOSTED
    + """SELECT query_id, id, cost, spent FROM (SELECT query_id, id, rank, (strlen(coalesce(body, '')) + 3) // 4 + 60 AS cost,
  sum((strlen(coalesce(body, '')) + 3) // 4 + 60) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS spent FROM diverse)
WHERE spent <= 2500 OR rank = 1""",
)
def budget_cut(spark: SparkSession, sf: str) -> DataFrame:
    return S.budget_cut(_diverse(spark, sf), F.col("body"), 2500, [F.col("rank")]).select("query_id", "id", "cost", "spent")


@register("page_window", BOOSTED + "SELECT query_id, id, rank FROM diverse WHERE rank BETWEEN 4 AND 6")
def page_window(spark: SparkSession, sf: str) -> DataFrame:
    return S.page(_diverse(spark, sf), 3, 3).select("query_id", "id", "rank")


IDENTS = f"""SELECT DISTINCT query_id, lower(unnest(regexp_extract_all(query, {TOK}))) AS name FROM {ASKED}"""
SEARCH = (
    bm25_sql(QUERY_TERMS, "season")
    + f""",
q AS {ASKED}, sy AS {SYMBOLS},
visible AS (SELECT doc_id, ord, season, lower(trim(language)) AS language, trust, lower(trim(kind)) AS kind, coalesce(suspect, false) AS suspect, channel FROM ch WHERE trust <> 'community'),
lex AS (
  SELECT s.query_id, s.doc_id, s.ord, row_number() OVER (PARTITION BY s.query_id ORDER BY s.score DESC, s.doc_id, s.ord) AS rank
  FROM scored s JOIN q USING (query_id) JOIN visible v USING (doc_id, ord)
  WHERE v.season = q.season AND (q.language IS NULL OR q.language = 'any' OR v.language IN (q.language, 'any')) QUALIFY rank <= 50),
named AS (
  SELECT DISTINCT i.query_id, regexp_replace(trim(s.chunk_id), '#[0-9]+$', '') AS doc_id, TRY_CAST(regexp_extract(trim(s.chunk_id), '#([0-9]{{1,9}})$', 1) AS INT) AS ord
  FROM ({IDENTS}) i JOIN q USING (query_id) JOIN sy s ON s.season = q.season
    AND lower(CASE WHEN contains(s.fqn, '#') THEN regexp_extract(s.fqn, '([^#]*)$', 1) ELSE regexp_extract(s.fqn, '([^.:]*)$', 1) END) = i.name
  WHERE regexp_matches(s.chunk_id, '#[0-9]{{1,9}}\\s*$')),
sym AS (SELECT n.query_id, n.doc_id, n.ord, row_number() OVER (PARTITION BY n.query_id ORDER BY n.doc_id, n.ord) AS rank
  FROM named n JOIN visible v USING (doc_id, ord) JOIN q USING (query_id) WHERE v.season = q.season QUALIFY rank <= 50),
fused AS (SELECT query_id, doc_id, ord, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, bool_or(hit) AS hit
  FROM (SELECT *, false AS hit FROM lex UNION ALL SELECT *, true FROM sym) GROUP BY ALL),
boosted AS (
  SELECT query_id, doc_id, ord, season, hit, round(f.score * CASE WHEN hit THEN 2.0 ELSE 1.0 END::DOUBLE
    * CASE WHEN trust = 'official' THEN 1.2 WHEN trust = 'vendor' THEN 1.1 ELSE 1.0 END::DOUBLE
    * CASE WHEN kind = 'api' THEN 0.5 ELSE 1.0 END::DOUBLE * CASE WHEN kind = 'forum' THEN 0.7 ELSE 1.0 END::DOUBLE
    * CASE WHEN suspect THEN 0.3 ELSE 1.0 END::DOUBLE, 9) AS score
  FROM fused f JOIN visible USING (doc_id, ord))
SELECT query_id, doc_id, ord, season, hit, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, ord) AS rank
FROM (SELECT * FROM boosted QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, doc_id, ord) <= 2) QUALIFY rank <= 5
"""
)


def _known(spark: SparkSession, sf: str) -> DataFrame:
    """(season, name, doc_id, ord): the chunks that symbols point to."""
    at = N.parse_chunk_id(F.trim("chunk_id"))
    return symbols(spark, sf).select("season", F.lower(N.simple_name(F.col("fqn"))).alias("name"), at["doc_id"].alias("doc_id"), at["ord"].alias("ord")).filter("ord IS NOT NULL")


def _texts(spark: SparkSession, sf: str, wanted: DataFrame) -> DataFrame:
    """The texts of the wanted chunks, a few for each query: hashes of their keys are sent to the rows, so that no other
    texts move; who joins them by key leaves out what only has the same hash."""
    texts = ["title", "heading_path", "symbol", "body"]
    few = F.broadcast(wanted.select(F.xxhash64(*KEY).alias("h")).distinct())
    rows = table(spark, sf, "chunk").select(*KEY, "retrieved_at", "upstream_rev", "tokens", *texts)
    rows = rows.withColumn("h", F.xxhash64(*KEY)).join(few, "h", "left_semi")
    return last(rows, KEY, ["retrieved_at", "upstream_rev", "tokens"]).select(*KEY, *texts)


@register("search_batch", SEARCH)
def search_batch(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: a batch of queries, each within its pinned season and language, lexical and exact symbol lists fused,
    boosted and diversified. The season restricts candidates before they are ranked, so versions never blend."""
    q = asked(spark, sf).withColumnsRenamed({"season": "pin", "language": "wanted"})
    docs = chunks(spark, sf, "season", "language", "trust", "kind", "suspect", "channel")
    visible = docs.filter("trust <> 'community'").select(*KEY, "season", F.lower(F.trim("language")).alias("language"), "trust", F.lower(F.trim("kind")).alias("kind"), F.coalesce("suspect", F.lit(False)).alias("suspect"))
    found = stored_index(spark, sf).best(_terms(q), S.DEPTH, where=F.col("trust") != "community", by={"pin": "season", "wanted": "language"}, lane=S.in_season)
    lex = S.top(found.select("query_id", *KEY, "score"), _order(), S.DEPTH)
    idents = q.select("query_id", "pin", F.explode(F.array_distinct(F.transform(T.tokens(F.col("query")), F.lower))).alias("name"))
    known = S.first_named(_known(spark, sf), visible, KEY).withColumnRenamed("season", "pin")
    sym = idents.join(known, ["pin", "name"]).select("query_id", *KEY).distinct()
    sym = S.top(sym, [F.col("doc_id"), F.col("ord")], S.DEPTH)
    lists = lex.select("query_id", *KEY, "rank", F.lit(False).alias("hit")).unionByName(sym.select("query_id", *KEY, "rank", F.lit(True).alias("hit")))
    fused = lists.groupBy("query_id", *KEY).agg(F.round(F.sum(F.lit(1.0) / (S.RRF + F.col("rank"))), 9).alias("score"), F.bool_or("hit").alias("hit"))
    no = F.lit(False)
    rows = fused.join(visible, KEY)
    factor = S.boost({"symbol_hit": F.col("hit"), "named": no, "library_hit": no, "trust": F.col("trust"), "kind": F.col("kind"), "intent": F.lit("general"), "suspect": F.col("suspect"), "alpha_penalty": no})
    boosted = rows.withColumn("score", F.round(F.col("score") * factor, 9))
    return S.diversify(boosted, ["doc_id"], _order(), k=5).select("query_id", *KEY, "season", "hit", "score", "rank")


PAGES = (
    SEARCH.split("lex AS (")[0]
    + f"""
lex AS (
  SELECT s.query_id, v.season = q.season AS pinned, s.doc_id, s.ord, row_number() OVER (PARTITION BY s.query_id, v.season = q.season ORDER BY s.score DESC, s.doc_id, s.ord) AS rank
  FROM scored s JOIN q USING (query_id) JOIN visible v USING (doc_id, ord)
  WHERE v.season IS NOT NULL AND q.season IS NOT NULL AND (q.language IS NULL OR q.language = 'any' OR v.language IN (q.language, 'any')) QUALIFY rank <= 50),
named AS (
  SELECT DISTINCT i.query_id, s.season, regexp_replace(trim(s.chunk_id), '#[0-9]+$', '') AS doc_id, TRY_CAST(regexp_extract(trim(s.chunk_id), '#([0-9]{{1,9}})$', 1) AS INT) AS ord
  FROM ({IDENTS}) i JOIN sy s
    ON lower(CASE WHEN contains(s.fqn, '#') THEN regexp_extract(s.fqn, '([^#]*)$', 1) ELSE regexp_extract(s.fqn, '([^.:]*)$', 1) END) = i.name
  WHERE regexp_matches(s.chunk_id, '#[0-9]{{1,9}}\\s*$')),
sym AS (SELECT n.query_id, v.season = q.season AS pinned, n.doc_id, n.ord, row_number() OVER (PARTITION BY n.query_id, v.season = q.season ORDER BY n.doc_id, n.ord) AS rank
  FROM named n JOIN visible v USING (doc_id, ord, season) JOIN q USING (query_id) WHERE q.season IS NOT NULL QUALIFY rank <= 50),
fused AS (SELECT query_id, pinned, doc_id, ord, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, bool_or(hit) AS hit, count(*) AS lists
  FROM (SELECT *, false AS hit FROM lex UNION ALL SELECT *, true FROM sym) GROUP BY ALL),
boosted AS (
  SELECT f.query_id, pinned, doc_id, ord, v.season, hit, lists, q.query, round(f.score * CASE WHEN hit THEN 2.0 ELSE 1.0 END::DOUBLE
    * CASE WHEN trust = 'official' THEN 1.2 WHEN trust = 'vendor' THEN 1.1 ELSE 1.0 END::DOUBLE
    * CASE WHEN kind = 'code' AND regexp_matches(lower(q.query), '^(how|what)|how to') THEN 1.2 ELSE 1.0 END::DOUBLE
    * CASE WHEN kind = 'api' THEN 0.5 ELSE 1.0 END::DOUBLE * CASE WHEN kind = 'forum' THEN 0.7 ELSE 1.0 END::DOUBLE
    * CASE WHEN suspect THEN 0.3 ELSE 1.0 END::DOUBLE * CASE WHEN channel = 'alpha' THEN 0.5 ELSE 1.0 END::DOUBLE, 9) AS score
  FROM fused f JOIN visible v USING (doc_id, ord) JOIN q USING (query_id)),
diverse AS (SELECT *, row_number() OVER (PARTITION BY query_id, pinned ORDER BY score DESC, doc_id, ord) AS rank
  FROM (SELECT * FROM boosted QUALIFY row_number() OVER (PARTITION BY query_id, pinned, doc_id ORDER BY score DESC, doc_id, ord) <= 2) QUALIFY rank <= 50),
terms AS (SELECT query_id, list_distinct(list_filter(list_transform(regexp_extract_all(query, {TOK}), lambda x: lower(x)), lambda x: x NOT IN {STOP} AND strlen(x) >= 2)) AS terms FROM q),
tops AS (
  SELECT d.query_id, pinned, max(d.score) FILTER (rank = 1) AS s1, max(d.score) FILTER (rank = 2) AS s2, bool_or(hit) FILTER (rank = 1) AS symbol, max(lists) FILTER (rank = 1) AS lists,
    max(CASE WHEN len(terms) > 0 THEN len(list_filter(terms, lambda t: contains(lower(concat_ws(chr(10), title, heading_path, symbol, body)), t))) / len(terms) ELSE 0 END) FILTER (rank = 1) AS cover
  FROM diverse d JOIN terms USING (query_id) JOIN ch USING (doc_id, ord) WHERE rank <= 2 GROUP BY ALL),
conf AS (
  SELECT query_id, pinned, round(1 / (1 + exp(-(-3.0 + 2.0 * least(s1 / (lists / 61.0 * 1.2 * CASE WHEN lists > 1 THEN 2 ELSE 1 END), 1.0) + 3.0 * cover
    + least(CASE WHEN s2 IS NULL OR s1 <= 0 THEN 0 ELSE (s1 - s2) / s1 END, 1.0) + CASE WHEN symbol THEN 1.5 ELSE 0 END))), 6) AS confidence FROM tops),
pair AS (SELECT query_id, max(confidence) FILTER (pinned) AS own, max(confidence) FILTER (NOT pinned) AS other FROM conf GROUP BY query_id),
judged AS (
  SELECT q.query_id, CASE WHEN (own IS NULL OR own < 0.35) AND other IS NOT NULL AND (own IS NULL OR other >= 0.6) THEN 'version_mismatch'
    WHEN own IS NULL THEN 'no_match' WHEN own < 0.35 THEN 'low_confidence' ELSE 'ok' END AS status FROM q LEFT JOIN pair USING (query_id))
SELECT j.query_id, j.status, d.pinned, d.rank, d.doc_id, d.ord, d.season, d.score
FROM judged j LEFT JOIN diverse d ON d.query_id = j.query_id AND
  d.rank <= CASE WHEN d.pinned THEN CASE status WHEN 'ok' THEN 5 WHEN 'low_confidence' THEN 3 WHEN 'version_mismatch' THEN 3 ELSE 0 END WHEN status = 'version_mismatch' THEN 5 ELSE 0 END
"""
)


@register("search_pages", PAGES)
def search_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The whole search of a batch in one plan: candidates of the pinned season and of the others side by side, each fused,
    boosted, diversified and judged, then the page that the status lets through. A query without hits has one row."""
    q = asked(spark, sf).withColumnsRenamed({"season": "pin", "language": "wanted"})
    docs = chunks(spark, sf, "season", "language", "trust", "kind", "suspect", "channel")
    visible = docs.filter("trust <> 'community' AND season IS NOT NULL").select(*KEY, "season", F.lower(F.trim("language")).alias("language"), "trust", F.lower(F.trim("kind")).alias("kind"), F.coalesce("suspect", F.lit(False)).alias("suspect"), "channel")
    part = ("query_id", "pinned")
    pinned = (F.col("season") == F.col("pin")).alias("pinned")
    pins = q.filter("pin IS NOT NULL")
    found = stored_index(spark, sf).best(_terms(pins), S.DEPTH, where=F.expr("trust <> 'community' AND season IS NOT NULL"), by={"pin": "season", "wanted": "language"}, lane=S.by_season, lanes=2)
    lex = S.top(found.select("query_id", (F.col("lane") == 0).alias("pinned"), *KEY, "score"), _order(), S.DEPTH, part=part)
    idents = q.select("query_id", F.explode(F.array_distinct(F.transform(T.tokens(F.col("query")), F.lower))).alias("name"))
    known = S.first_named(_known(spark, sf), visible, KEY)
    named = idents.join(known, "name").join(pins.select("query_id", "pin"), "query_id").select("query_id", pinned, *KEY).distinct()
    sym = S.top(named, [F.col("doc_id"), F.col("ord")], S.DEPTH, part=part)
    lists = lex.select(*part, *KEY, "rank", F.lit(False).alias("hit")).unionByName(sym.select(*part, *KEY, "rank", F.lit(True).alias("hit")))
    fused = lists.groupBy(*part, *KEY).agg(F.round(F.sum(F.lit(1.0) / (S.RRF + F.col("rank"))), 9).alias("score"), F.bool_or("hit").alias("hit"), F.count("*").alias("lists"))
    no = F.lit(False)
    rows = fused.join(visible, KEY).join(q.select("query_id", "query"), "query_id")
    factor = S.boost({
        "symbol_hit": F.col("hit"), "named": no, "library_hit": no, "trust": F.col("trust"), "kind": F.col("kind"), "suspect": F.col("suspect"),
        "intent": F.when(F.lower("query").rlike("^(how|what)|how to"), "howto").otherwise("general"), "alpha_penalty": F.col("channel") == "alpha",
    })
    diverse = materialize(S.diversify(rows.withColumn("score", F.round(F.col("score") * factor, 9)), ["doc_id"], _order(), part=part).select(*part, "rank", *KEY, "season", "score", "hit", "lists", "query"), "ranked")
    w = Window.partitionBy(*part).orderBy("rank")
    first = diverse.filter("rank <= 2").withColumn("s2", F.lead("score").over(w)).filter("rank = 1")
    first = first.join(_texts(spark, sf, first), KEY)
    cover = S.coverage(T.content_terms(F.col("query")), *[F.col(c) for c in ("title", "heading_path", "symbol", "body")])
    gap = F.when(F.col("s2").isNull() | (F.col("score") <= 0), 0.0).otherwise((F.col("score") - F.col("s2")) / F.col("score"))
    sure = first.select(*part, F.round(S.confidence(F.col("score"), F.col("lists"), cover, gap, F.col("hit")), 6).alias("c"))
    pair = sure.groupBy("query_id").agg(F.max(F.when(F.col("pinned"), F.col("c"))).alias("own"), F.max(F.when(~F.col("pinned"), F.col("c"))).alias("other"))
    judged = q.select("query_id").join(pair, "query_id", "left").select("query_id", S.status(F.col("own"), F.col("other")).alias("status"))
    page = diverse.select("query_id", "pinned", "rank", *KEY, "season", "score").join(judged, "query_id").filter(F.col("rank") <= S.shown(F.col("status"), F.col("pinned"), 5)).drop("status")
    return judged.join(page, "query_id", "left").select("query_id", "status", "pinned", "rank", *KEY, "season", "score")


@register("routed_queries", None)
def routed_queries(spark: SparkSession, sf: str) -> DataFrame:
    """What every query asks for."""
    r = route(table(spark, sf, "search_envelope").select("query_id", "asked_at", "query"))
    return r.select("query_id", "asked_at", "intent", F.array_join("identifiers", " ").alias("identifiers"), F.array_join("libraries", " ").alias("libraries"), "asked_season", "asked_language", "non_english")
