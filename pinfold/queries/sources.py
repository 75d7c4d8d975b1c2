"""Loaders and parsers over files made of the tables' own rows, whose contents SQL knows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pinfold.functions import names as N
from pinfold.queries.common import CHUNKS, SYMBOLS, chunks, symbols
from pinfold.queries.registry import register
from pinfold.scratch import materialize, new_path
from pinfold.session import table
from pinfold.sources import apis as A, documents as D, files as L
from pinfold.streaming import streams


@register("json_lines_read", "SELECT doc_id, lang, n_chars FROM documents")
def json_lines_read(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's facts as a line file with comments and empty lines."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    path = new_path(spark, "lines")
    line = F.concat(F.when(F.col("doc_id") % 5 == 0, "// comment\n\n").otherwise(""), F.to_json(F.struct(*d.columns)))
    d.select(line.alias("value")).write.text(path)
    return L.json_lines(spark, path, "doc_id bigint, lang string, n_chars bigint")


@register("published_tables", "SELECT library, count(*) AS n, count(DISTINCT fqn) AS names FROM symbol GROUP BY ALL")
def published_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The symbols published by library, over an older version, and read back."""
    s, root = table(spark, sf, "symbol"), new_path(spark, "store")
    L.publish({"symbol": s.limit(0)}, root)
    L.publish({"symbol": s}, root, {"symbol": ["library"]})
    found, errors = L.published(spark, root)
    if errors:
        raise RuntimeError(str(errors))
    return found["symbol"].groupBy("library").agg(F.count("*").alias("n"), F.countDistinct("fqn").alias("names"))


@register("counters_text", r"""
SELECT 'chunks_total{library="' || regexp_replace(coalesce(library, ''), '(["\\])', '\\\1', 'g') || '",kind="' || regexp_replace(coalesce(kind, ''), '(["\\])', '\\\1', 'g') || '"} ' || count(*) AS line FROM chunk GROUP BY library, kind""")  # fmt: skip
def counters_text(spark: SparkSession, sf: str) -> DataFrame:
    return L.prometheus(table(spark, sf, "chunk").groupBy("library", "kind").agg(F.count("*").alias("n")), "chunks_total", ["library", "kind"], "n")


@register("listed_links", f"SELECT DISTINCT doc_id, ord, source_url AS link FROM {CHUNKS} WHERE regexp_matches(source_url, '^https?://corelib.example/2025/') OR regexp_matches(source_url, '^https?://motorix.example/')")
def listed_links(spark: SparkSession, sf: str) -> DataFrame:
    """The pages of two hosts among the links of each chunk's own list."""
    c = chunks(spark, sf, "source_url")
    body = F.concat(F.lit("[a]("), "source_url", F.lit(") [b](https://other.example/docs/x) [a]("), "source_url", F.lit(")"))
    both = F.concat(D.listing_links(body, "corelib.example", "/2025/"), D.listing_links(body, "motorix.example", "/"))
    return c.filter("source_url IS NOT NULL").select("doc_id", "ord", F.explode(both).alias("link"))


@register("release_listing", r"""
WITH v AS (SELECT DISTINCT library, version, length(version) % 5 = 0 AS draft FROM symbol WHERE version <> ''),
s AS (SELECT *, TRY_CAST(regexp_extract(lower(version), '^([0-9]{1,9})(\.|-|$)', 1) AS INT) AS y FROM v),
t AS (SELECT *, CASE WHEN y BETWEEN 2020 AND 2039 THEN y::VARCHAR WHEN y BETWEEN 20 AND 39 THEN (y + 2000)::VARCHAR ELSE '' END AS season FROM s)
SELECT 'https://x.example/' || library AS source_url, version, season, length(library) % 2 = 0 AS breaking FROM t WHERE NOT draft AND season >= '2025'""")  # fmt: skip
def release_listing(spark: SparkSession, sf: str) -> DataFrame:
    """Each version of each library as one entry of a release listing; some are drafts by their length."""
    v = table(spark, sf, "symbol").filter("version <> ''").select("library", "version").distinct()
    entry = F.struct(
        F.concat(F.lit("v"), "version").alias("tag_name"), F.lit("n").alias("name"), F.when(F.length("library") % 2 == 0, "Removed x").otherwise("Fine").alias("body"), (F.length("version") % 5 == 0).alias("draft"),
        F.lit(False).alias("prerelease"), F.lit("2026-01-02T03:04:05Z").alias("published_at"), F.concat(F.lit("https://x.example/"), "library").alias("html_url"),
    )
    return D.releases(v.select(F.to_json(F.array(entry)).alias("body")), "any", "body").select("source_url", "version", "season", "breaking")


@register("catalog_files", """
SELECT raw_json->>'$.uuid' AS uuid, raw_json->>'$.name' AS name, raw_json->>'$.version' AS version, raw_json->>'$.frcYear' AS frc_year,
  CASE WHEN regexp_matches(raw_json->>'$.frcYear', '^20[23][0-9]([^0-9]|$)') THEN substr(raw_json->>'$.frcYear', 1, 4) ELSE '' END AS season, coalesce(json_array_length(raw_json, '$.conflictsWith'), 0)::INT AS conflicts
FROM vendordep WHERE raw_json->>'$.uuid' <> '' AND raw_json->>'$.name' <> '' AND raw_json->>'$.version' <> ''""")  # fmt: skip
def catalog_files(spark: SparkSession, sf: str) -> DataFrame:
    c = D.catalog(table(spark, sf, "vendordep").select("raw_json"), "raw_json")
    return c.select("uuid", "name", "version", "frc_year", "season", F.coalesce(F.size("conflicts"), F.lit(0)).alias("conflicts"))


@register("feed_topics", """
WITH i AS (SELECT event_id, event_id // 3 AS topic, event_id % 3 + 1 AS post, event_type FROM events), t AS (SELECT DISTINCT topic FROM i WHERE post = 1 AND event_type IN ('view', 'click'))
SELECT topic, post, CASE WHEN post = 1 THEN event_type ELSE '' END AS category, 'A & <b> ' || event_id AS title FROM i WHERE topic IN (SELECT topic FROM t)""")  # fmt: skip
def feed_topics(spark: SparkSession, sf: str) -> DataFrame:
    """Events as the items of feeds, three a topic: the kept topics and their replies."""
    e = table(spark, sf, "events")
    topic, post = F.floor(F.col("event_id") / 3).cast("string"), (F.col("event_id") % 3 + 1).cast("string")
    item = F.concat(
        F.lit("<rss><item><guid>h-"), F.when(post == "1", "topic").otherwise("post"), F.lit("-"), topic, F.lit("-"), post, F.lit("</guid><category>"), F.when(post == "1", F.col("event_type")).otherwise(""),
        F.lit("</category><title>A &amp; &lt;b&gt; "), F.col("event_id").cast("string"), F.lit("</title><link>https://h.example/t/x/"), topic, F.lit("/"), post,
        F.lit("</link><pubDate>Fri, 02 Jan 2026 03:04:05 +0000</pubDate><description>d</description></item></rss>"),
    )
    items = materialize(D.feed_items(e.select(item.alias("body")), "body", "h.example"), "feed")
    topics, replies = D.kept_replies(items, ["view", "click"])
    return topics.unionByName(replies).select("topic", "post", "category", "title")


def _escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _types(spark: SparkSession, sf: str, language: str) -> DataFrame:
    """(season, owner, members): the types of a language's tables with the names and signatures of their members."""
    s = symbols(spark, sf).filter((F.col("language") == language) & (F.col("season") != "")).select("season", "fqn", "signature").distinct()
    owner, member = F.substring_index("fqn", "#", 1), F.struct(F.substring_index("fqn", "#", -1).alias("name"), "signature")
    members = s.filter(F.col("fqn").contains("#")).groupBy("season", owner.alias("owner")).agg(F.collect_list(member).alias("members"))  # of one type and season
    types = s.filter(~F.col("fqn").contains("#")).select("season", F.col("fqn").alias("owner")).distinct()
    return types.join(members, ["season", "owner"], "left").withColumn("members", F.coalesce("members", F.array().cast("array<struct<name:string,signature:string>>")))


def _types_sql(language: str, signature: bool) -> str:
    line = ", trim(regexp_replace(signature, '\\s+', ' ', 'g')) AS signature" if signature else ""
    none = ", NULL" if signature else ""
    return f"""
WITH s AS (SELECT DISTINCT season, fqn, signature FROM {SYMBOLS} WHERE language = '{language}' AND season <> ''), t AS (SELECT DISTINCT season, fqn FROM s WHERE NOT contains(fqn, '#'))
SELECT season, fqn{none} FROM t UNION ALL SELECT season, s.fqn{line} FROM s WHERE contains(s.fqn, '#') AND (season, string_split(s.fqn, '#')[1]) IN (SELECT (season, fqn) FROM t)"""


def _joined(members: str, each) -> Column:
    return F.array_join(F.transform(members, each), "\n")


@register("javadoc_pages", "SELECT season, fqn, signature FROM (" + _types_sql("java", True) + ") x(season, fqn, signature)")
def javadoc_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A class page for every Java type of every season, read back."""
    t = _types(spark, sf, "java").withColumns({"pkg": N.package_of(F.col("owner")), "type": N.type_name(F.col("owner"))})
    detail = _joined("members", lambda m: F.concat(F.lit('<section class="detail"><h3>'), m["name"], F.lit('</h3><div class="member-signature">'), _escaped(m["signature"]), F.lit("</div></section>")))
    page = F.concat(F.lit('<div class="sub-title"><span>Package</span>&nbsp;<a href="x">'), "pkg", F.lit('</a></div><h1 class="title">Class '), "type", F.lit('</h1><div class="type-signature">public class '), "type", F.lit("</div>\n"), detail)
    got = A.read(t.select("season", page.alias("text")), "season", "text", A.javadoc)
    return got.select(F.col("path").alias("season"), "fqn", F.when(F.col("fqn").contains("#"), F.col("signature")).alias("signature"))


@register("doxygen_pages", "SELECT season, fqn FROM (" + _types_sql("cpp", False) + ") x(season, fqn)")
def doxygen_pages(spark: SparkSession, sf: str) -> DataFrame:
    t = _types(spark, sf, "cpp")
    item = _joined("members", lambda m: F.concat(F.lit('<div class="memitem"><table class="memname"><tr><td>void '), F.col("owner"), F.lit("::"), m["name"], F.lit("</td><td>(</td><td>double v</td><td>)</td></tr></table></div>")))
    page = F.concat(F.lit('<div class="title">'), "owner", F.lit(' Class Reference</div><div class="contents"><p>x.</p></div>\n'), item)
    return A.read(t.select("season", page.alias("text")), "season", "text", A.doxygen).select(F.col("path").alias("season"), "fqn")


@register("cpp_headers", "SELECT season, fqn FROM (" + _types_sql("cpp", False) + ") x(season, fqn)")
def cpp_headers(spark: SparkSession, sf: str) -> DataFrame:
    t = _types(spark, sf, "cpp").withColumn("type", F.substring_index("owner", "::", -1))
    scope = F.expr("substring(owner, 1, length(owner) - length(type) - 2)")
    body = _joined("members", lambda m: F.concat(F.lit("  /// Does it.\n  void "), m["name"], F.lit("(double v = 1.0);")))
    text = F.concat(F.lit("#pragma once\nnamespace "), scope, F.lit(" {\nclass "), "type", F.lit(" {\n public:\n"), body, F.lit("\n private:\n  int m_own;\n};\n}\n"))
    return A.read(t.select("season", text.alias("text")), "season", "text", A.cpp_header).select(F.col("path").alias("season"), "fqn")


@register("python_stubs", "SELECT season, fqn FROM (" + _types_sql("python", False) + ") x(season, fqn)")
def python_stubs(spark: SparkSession, sf: str) -> DataFrame:
    t = _types(spark, sf, "python").withColumn("type", F.substring_index("owner", ".", -1))
    module = F.expr("substring(owner, 1, length(owner) - length(type) - 1)")
    path = F.concat("season", F.lit("/"), F.replace(module, F.lit("."), F.lit("/")), F.lit(".pyi"))
    body = _joined("members", lambda m: F.concat(F.lit("    def "), m["name"], F.lit("(self, v: float = 1) -> None: ...")))
    got = A.read(t.select(path.alias("path"), F.concat(F.lit("class "), "type", F.lit(":\n    pass\n"), body).alias("text")), "path", "text", A.python_stub)
    return got.select(F.substring_index("path", "/", 1).alias("season"), F.regexp_replace("fqn", "^[0-9]+\\.", "").alias("fqn"))


@register("best_wheels", """
SELECT p_brand AS package, arg_min(f, k) AS file FROM (SELECT p_brand, f, (CASE WHEN ends_with(f, '-none-any.whl') THEN '0' WHEN regexp_matches(f, 'manylinux.*x86_64') THEN '1' ELSE '2' END) || f AS k
  FROM (SELECT p_brand, 'p' || p_partkey || CASE p_size % 4 WHEN 0 THEN '-cp312-win.whl' WHEN 1 THEN '-manylinux_2_17_x86_64.whl' WHEN 2 THEN CASE WHEN p_size > 40 THEN '-py3-none-any.whl' ELSE '-mac.whl' END ELSE '.tar.gz' END AS f FROM part) WHERE ends_with(f, '.whl')) GROUP BY ALL""")  # fmt: skip
def best_wheels(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("p_size") % 4
    end = F.when(n == 0, "-cp312-win.whl").when(n == 1, "-manylinux_2_17_x86_64.whl").when(n == 2, F.when(F.col("p_size") > 40, "-py3-none-any.whl").otherwise("-mac.whl")).otherwise(".tar.gz")
    return A.best_wheel(table(spark, sf, "part").select(F.col("p_brand").alias("package"), F.concat(F.lit("p"), F.col("p_partkey").cast("string"), end).alias("file")), "package", "file")


@register("motor_sources", "SELECT 'M' || p_partkey AS part, p_size::DOUBLE AS nominal_v, p_retailprice AS stall_torque_nm, 105.0::DOUBLE AS stall_current_a, 1.8::DOUBLE AS free_current_a, (5000 + p_size)::DOUBLE AS free_speed_rpm FROM part")
def motor_sources(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    num = lambda c: F.col(c).cast("string")
    src = F.concat(F.lit("public static DCMotor getM"), num("p_partkey"), F.lit("(int n) {\n return new DCMotor("), num("p_size"), F.lit(", "), num("p_retailprice"), F.lit(", 105, 1.8, Units.rotationsPerMinuteToRadiansPerSecond("), (F.col("p_size") + 5000).cast("string"), F.lit("));\n}"))
    got = A.motors(p.select(src.alias("text")), "text")
    return got.select("part", *[F.col("fields")[k].alias(k) for k in ("nominal_v", "stall_torque_nm", "stall_current_a", "free_current_a", "free_speed_rpm")])


@register("page_sections", f"""
SELECT doc_id || '#' || ord AS page, 0 AS ord, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS heading, 'markdown' AS kind FROM {CHUNKS} WHERE regexp_matches(title, '^[A-Za-z0-9 ,.]*[A-Za-z0-9][A-Za-z0-9 ,.]*$')
UNION ALL SELECT doc_id || '#' || ord, 0, trim(regexp_replace(title, '\\s+', ' ', 'g')), 'html' FROM {CHUNKS} WHERE regexp_matches(title, '^[A-Za-z0-9 ,.]*[A-Za-z0-9][A-Za-z0-9 ,.]*$')""")  # fmt: skip
def page_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Every chunk with a plain title as a page of one section, in both kinds of markup."""
    c = chunks(spark, sf, "title").filter(F.col("title").rlike("^[A-Za-z0-9 ,.]*[A-Za-z0-9][A-Za-z0-9 ,.]*$")).select(N.chunk_id(F.col("doc_id"), F.col("ord")).alias("page"), "title")
    md = D.page_sections(c.select("page", F.concat(F.lit("---\na: b\n---\n# "), "title", F.lit("\n\nsome text\n")).alias("text")), "page", "text")
    html = D.page_sections(c.select("page", F.concat(F.lit("<html><body><nav hidden>no</nav><h1>"), "title", F.lit("</h1><p>some text</p></body></html>")).alias("text")), "page", "text", "html")
    pick = lambda d, kind: d.select(F.col(d.columns[0]).alias("page"), "ord", F.col("heading_path").alias("heading"), F.lit(kind).alias("kind"))
    return pick(md, "markdown").unionByName(pick(html, "html"))


@register("polite_requests", """
WITH c AS (SELECT library || ' ' || kind AS url, max(added_at) AS fetched_at FROM documents WHERE added_at < TIMESTAMPTZ '2026-09-15 00:00:00+00' AND library || kind IS NOT NULL GROUP BY ALL),
r AS (SELECT d.doc_id, d.library || ' ' || d.kind AS url, d.source, d.added_at, coalesce(s.min_interval_s, 0)::BIGINT AS floor FROM documents d LEFT JOIN source_registry s USING (source) WHERE added_at >= TIMESTAMPTZ '2026-09-15 00:00:00+00' AND d.library || d.kind IS NOT NULL),
y AS (SELECT r.*, coalesce(epoch_us(r.added_at) - epoch_us(c.fetched_at) < floor * 1000000, false) AS young FROM r LEFT JOIN c USING (url)),
f AS (SELECT *, min(added_at) FILTER (NOT young) OVER (PARTITION BY url) AS first FROM y)
SELECT doc_id, url, young OR coalesce(added_at > first AND epoch_us(added_at) - epoch_us(first) < floor * 1000000, false) AS kept FROM f""")  # fmt: skip
def polite_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as requests for pages, those of some date as what was fetched before."""
    d = table(spark, sf, "documents").select("doc_id", F.concat("library", F.lit(" "), "kind").alias("url"), "source", "added_at").filter("url IS NOT NULL")
    old, new = d.filter("added_at < TIMESTAMP '2026-09-15 00:00:00'"), d.filter("added_at >= TIMESTAMP '2026-09-15 00:00:00'")
    floors = table(spark, sf, "source_registry").select("source", "min_interval_s")
    out, kept = streams.polite(new, old.select("url", F.col("added_at").alias("fetched_at")), "url", "added_at", "source", floors)
    return out.select("doc_id", "url", F.lit(False).alias("kept")).unionByName(kept.select("doc_id", "url", F.lit(True).alias("kept")))
