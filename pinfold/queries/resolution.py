"""Queries over resolution of names, rules against tables, hardware facts and small helpers of loading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pinfold.functions import names as N, parts as P
from pinfold.operators import hardware as H, projects as J, resolution as R
from pinfold.queries.common import CATALOG, CHUNKS, SYMBOLS, catalog, chunks, symbols
from pinfold.queries.registry import register
from pinfold.session import table

SEASONS = ["2023", "2024", "2025", "2026", "2027"]
_SEASONS = "(SELECT unnest(['" + "','".join(SEASONS) + "']) AS season)"
_LAST = r"regexp_extract({}, '([^.:]*)$', 1)"
_PACKAGE = r"regexp_extract(string_split({}, '#')[1], '^(.*?)(?:\.|::)[A-Z]', 1)"
_TYPES = f"types AS (SELECT DISTINCT fqn, season FROM {SYMBOLS} WHERE NOT contains(fqn, '#'))"


def _every_season(df: DataFrame) -> DataFrame:
    return df.withColumn("season", F.explode(F.array(*map(F.lit, SEASONS))))


@register("resolve_types", f"""
WITH sy AS {SYMBOLS}, {_TYPES},
refs AS (SELECT DISTINCT replacement AS name, {_PACKAGE.format('fqn')} AS package, season, {_LAST.format('replacement')} AS simple FROM sy WHERE replacement <> '' AND NOT contains(replacement, '#')),
one AS (SELECT season, {_LAST.format('fqn')} AS simple, min(fqn) AS fqn FROM types GROUP BY ALL HAVING count(*) = 1),
got AS (SELECT r.*, CASE WHEN regexp_matches(r.name, '\\.|::') THEN a.fqn END AS f1, b.fqn AS f2, c.fqn AS f3 FROM refs r
  LEFT JOIN types a ON a.fqn = r.name AND a.season = r.season
  LEFT JOIN types b ON r.package <> '' AND b.fqn = r.package || '.' || r.simple AND b.season = r.season
  LEFT JOIN one c ON c.simple = r.simple AND c.season = r.season)
SELECT name, package, season, coalesce(f1, f2, f3) AS fqn, CASE WHEN f1 IS NOT NULL THEN 'exact' WHEN f2 IS NOT NULL THEN 'package' WHEN f3 IS NOT NULL THEN 'unique' END AS how FROM got""")  # fmt: skip
def resolve_types(spark: SparkSession, sf: str) -> DataFrame:
    """What the replacements that name types mean in the season that writes them."""
    s = symbols(spark, sf)
    refs = s.filter((F.col("replacement") != "") & ~F.col("replacement").contains("#")).select(F.col("replacement").alias("name"), N.package_of(F.col("fqn")).alias("package"), "season")
    return R.resolve_types(refs, s)


@register("check_packages", f"""
WITH own AS (SELECT DISTINCT {_PACKAGE.format('fqn')} AS package, season FROM {SYMBOLS} WHERE {_PACKAGE.format('fqn')} <> ''),
refs AS (SELECT DISTINCT o.package, s.season FROM (SELECT package FROM own UNION SELECT 'no.such') o, {_SEASONS} s)
SELECT r.package, r.season, CASE WHEN EXISTS (SELECT 1 FROM own o WHERE o.package = r.package AND o.season = r.season) THEN NULL
  WHEN EXISTS (SELECT 1 FROM own o WHERE o.package = r.package) THEN CASE WHEN starts_with(r.package || '.', 'dev.corelib.') AND r.season >= '2026' THEN 'error' ELSE 'warning' END ELSE 'info' END AS severity FROM refs r""")  # fmt: skip
def check_packages(spark: SparkSession, sf: str) -> DataFrame:
    """Every package in every season."""
    s = symbols(spark, sf)
    own = s.select(N.package_of(F.col("fqn")).alias("package")).filter("package <> ''").union(spark.createDataFrame([("no.such",)], "package string")).distinct()
    return R.check_packages(_every_season(own), s, "dev.corelib.", "2026")


@register("moved_modules", f"""
WITH types AS (SELECT DISTINCT fqn, season, {_LAST.format('fqn')} AS simple, string_split(fqn, '.')[1] AS root FROM {SYMBOLS} WHERE NOT contains(fqn, '#') AND language = 'python'),
refs AS (SELECT DISTINCT t.fqn, t.simple, t.root, s.season FROM (SELECT fqn, simple, root FROM types UNION SELECT root || '.elsewhere.' || simple, simple, root FROM types) t, {_SEASONS} s),
here AS (SELECT season, simple, root, min(fqn) AS path FROM types GROUP BY ALL)
SELECT r.fqn, r.season, h.path, CASE WHEN EXISTS (SELECT 1 FROM types o WHERE o.fqn = r.fqn) THEN 'warning' ELSE 'info' END AS severity
FROM refs r JOIN here h USING (season, simple, root) WHERE NOT EXISTS (SELECT 1 FROM types t WHERE t.fqn = r.fqn AND t.season = r.season)""")  # fmt: skip
def moved_modules(spark: SparkSession, sf: str) -> DataFrame:
    """Every Python type of any season, and one submodule deeper, imported in every season."""
    s = symbols(spark, sf).filter("language = 'python'")
    t = s.filter(~F.col("fqn").contains("#")).select("fqn").distinct()
    deep = t.select(F.concat(F.substring_index("fqn", ".", 1), F.lit(".elsewhere."), N.last_segment(F.col("fqn"))).alias("fqn"))
    return R.moved_modules(_every_season(t.union(deep).distinct()), s)


# The curated replacements as rules of one step; what the last season deprecates for removal without one is a removal.
_RULES = f"""rules AS (
  SELECT DISTINCT fqn || '>' || coalesce(replacement, '') AS rule_id, library, language, CASE WHEN coalesce(replacement, '') = '' THEN 'removed' ELSE 'rename' END AS kind,
    season AS from_season, (season::INT + 1)::VARCHAR AS to_season, fqn AS from_fqn, coalesce(replacement, '') AS to_fqn
  FROM {SYMBOLS} WHERE season <> '' AND (replacement_src = 'curated' AND replacement <> '' OR removed_in <> ''))"""


def _rules(spark: SparkSession, sf: str) -> DataFrame:
    s = symbols(spark, sf).filter("season <> '' AND (replacement_src = 'curated' AND replacement <> '' OR removed_in <> '')")
    to = F.coalesce("replacement", F.lit(""))
    kind = F.when(to == "", "removed").otherwise("rename")
    return s.select(F.concat("fqn", F.lit(">"), to).alias("rule_id"), "library", "language", kind.alias("kind"), F.col("season").alias("from_season"), (F.col("season").cast("int") + 1).cast("string").alias("to_season"), F.col("fqn").alias("from_fqn"), to.alias("to_fqn")).distinct()


@register("curated_findings", f"""
WITH {_RULES}, named AS (SELECT * FROM rules WHERE kind IN ('rename', 'move', 'removed') AND from_fqn <> to_fqn),
refs AS (SELECT DISTINCT n.fqn, n.language, s.season FROM (SELECT from_fqn AS fqn, language FROM rules UNION SELECT to_fqn, language FROM rules WHERE to_fqn <> '') n, {_SEASONS} s)
SELECT r.fqn, r.language, r.season, m.rule_id, CASE WHEN m.from_fqn = r.fqn AND m.to_season < r.season THEN 'error' ELSE 'warning' END AS severity, CASE WHEN m.from_fqn = r.fqn THEN m.to_fqn ELSE m.from_fqn END AS use
FROM refs r JOIN named m ON m.language = r.language AND (m.from_fqn = r.fqn AND m.to_season <= r.season OR m.to_fqn = r.fqn AND m.from_season >= r.season)
QUALIFY row_number() OVER (PARTITION BY r.fqn, r.language, r.season ORDER BY m.rule_id, severity, use) = 1""")  # fmt: skip
def curated_findings(spark: SparkSession, sf: str) -> DataFrame:
    rules = _rules(spark, sf)
    names = rules.select(F.col("from_fqn").alias("fqn"), "language").union(rules.filter("to_fqn <> ''").select("to_fqn", "language")).distinct()
    return R.curated_findings(_every_season(names), rules)


@register("rules_of_names", f"""
WITH {_RULES}, names AS (SELECT DISTINCT fqn FROM {SYMBOLS})
SELECT 'from' AS way, n.fqn, rule_id, from_season FROM names n JOIN rules ON from_fqn = n.fqn OR starts_with(from_fqn, n.fqn || '#')
UNION ALL SELECT 'to', n.fqn, rule_id, from_season FROM names n JOIN rules ON to_fqn = n.fqn AND to_fqn <> ''""")  # fmt: skip
def rules_of_names(spark: SparkSession, sf: str) -> DataFrame:
    """The rules from each name and its members, and those to it."""
    rules, names = _rules(spark, sf), symbols(spark, sf).select("fqn")
    own, to = R.rules_from(names, rules, members=True), R.rules_to(names, rules)
    return own.select(F.lit("from").alias("way"), "fqn", "rule_id", "from_season").unionByName(to.select(F.lit("to").alias("way"), "fqn", "rule_id", "from_season"))


@register("member_rules", f"""
WITH {_RULES}, sy AS {SYMBOLS},
mapped AS (SELECT DISTINCT library AS path, fqn FROM sy WHERE season = '2024' AND NOT contains(fqn, '#')),
used AS (SELECT DISTINCT library AS path, fqn FROM sy WHERE season = '2024' AND contains(fqn, '#') AND length(fqn) % 2 = 0)
SELECT DISTINCT m.path, r.rule_id, r.from_fqn, r.to_fqn FROM mapped m JOIN rules r ON starts_with(r.from_fqn, m.fqn || '#') AND r.from_season >= '2024' AND r.to_season <= '2027'
WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.path = m.path AND u.fqn = r.from_fqn)""")  # fmt: skip
def member_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Each library as a file that maps all its types and uses some of their members."""
    own = symbols(spark, sf).filter("season = '2024'").select(F.col("library").alias("path"), "fqn").distinct()
    return R.member_rules(own, own.filter(F.col("fqn").contains("#") & (F.length("fqn") % 2 == 0)), _rules(spark, sf), "2024", "2027")


@register("check_rules", f"""
WITH {_RULES}, sy AS {SYMBOLS}, every AS (SELECT * FROM rules UNION ALL
  SELECT 'old ' || rule_id, library, language, kind, '2021', CASE WHEN length(from_fqn) % 2 = 0 THEN '2022' ELSE from_season END, from_fqn, to_fqn FROM rules),
declared AS (SELECT DISTINCT library, language, season FROM sy WHERE season <> '' UNION SELECT DISTINCT library, language, '2028' FROM sy WHERE season <> ''),
built AS (SELECT DISTINCT library, language, season FROM sy), have AS (SELECT DISTINCT library, language, season, fqn FROM sy),
firsts AS (SELECT library, language, min(season) AS first FROM declared GROUP BY ALL),
placed AS (SELECT e.*, first, (SELECT min(season) FROM declared d WHERE d.library = e.library AND d.language = e.language AND d.season >= e.to_season) AS at_season FROM every e LEFT JOIN firsts USING (library, language)),
flags AS (SELECT p.*, t0.season IS NOT NULL AS t_from, t1.season IS NOT NULL AS t_to, t2.season IS NOT NULL AS t_at, h0.fqn IS NOT NULL AS from_there, h1.fqn IS NOT NULL AS to_there, h2.fqn IS NOT NULL AS to_at, h3.fqn IS NOT NULL AS from_at,
    d0.season IS NOT NULL AS d_from, d1.season IS NOT NULL AS d_to FROM placed p
  LEFT JOIN built t0 ON (t0.library, t0.language, t0.season) = (p.library, p.language, p.from_season) LEFT JOIN built t1 ON (t1.library, t1.language, t1.season) = (p.library, p.language, p.to_season)
  LEFT JOIN built t2 ON (t2.library, t2.language, t2.season) = (p.library, p.language, p.at_season)
  LEFT JOIN have h0 ON (h0.library, h0.language, h0.season, h0.fqn) = (p.library, p.language, p.from_season, p.from_fqn) LEFT JOIN have h1 ON (h1.library, h1.language, h1.season, h1.fqn) = (p.library, p.language, p.to_season, p.to_fqn)
  LEFT JOIN have h2 ON (h2.library, h2.language, h2.season, h2.fqn) = (p.library, p.language, p.at_season, p.to_fqn) LEFT JOIN have h3 ON (h3.library, h3.language, h3.season, h3.fqn) = (p.library, p.language, p.at_season, p.from_fqn)
  LEFT JOIN declared d0 ON (d0.library, d0.language, d0.season) = (p.library, p.language, p.from_season) LEFT JOIN declared d1 ON (d1.library, d1.language, d1.season) = (p.library, p.language, p.to_season))
SELECT rule_id, library, language, CASE WHEN from_season < first THEN
    CASE WHEN at_season IS NULL THEN 'undeclared' WHEN NOT t_at THEN 'skipped' WHEN to_fqn <> '' AND NOT to_at THEN 'target missing' WHEN from_fqn <> to_fqn AND at_season > to_season AND from_at THEN 'source remains' ELSE 'ok' END
  ELSE CASE WHEN NOT d_from THEN 'undeclared' WHEN NOT t_from THEN 'skipped' WHEN NOT from_there THEN 'source missing' WHEN NOT t_to AND to_fqn <> '' AND d_to THEN 'skipped' WHEN t_to AND to_fqn <> '' AND NOT to_there THEN 'target missing' ELSE 'ok' END END AS verdict FROM flags""")  # fmt: skip
def check_rules(spark: SparkSession, sf: str) -> DataFrame:
    """The curated rules, and the same as rules from before the first table, against the tables."""
    s, rules = symbols(spark, sf), _rules(spark, sf)
    old = rules.withColumns({"rule_id": F.concat(F.lit("old "), "rule_id"), "to_season": F.when(F.length("from_fqn") % 2 == 0, "2022").otherwise(F.col("from_season")), "from_season": F.lit("2021")})
    own = s.filter("season <> ''").select("library", "language", "season").distinct()
    return R.check_rules(rules.unionByName(old), s, own.union(own.withColumn("season", F.lit("2028")).distinct()))


@register("other_symbols", f"""
WITH n AS (SELECT DISTINCT fqn, CASE WHEN contains(fqn, '#') THEN regexp_extract(fqn, '([^#]*)$', 1) ELSE {_LAST.format('fqn')} END AS simple FROM {SYMBOLS})
SELECT a.fqn, b.simple AS written, a.simple = upper(a.simple) OR contains(a.fqn, '#') AS other FROM n a JOIN (SELECT DISTINCT simple FROM n) b ON lower(a.simple) = lower(b.simple) AND a.simple <> b.simple""")  # fmt: skip
def other_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Names that differ from another's simple name in letter case only."""
    n = symbols(spark, sf).select("fqn", N.simple_name(F.col("fqn")).alias("simple")).distinct()
    w = n.select(F.col("simple").alias("written"), F.lower("simple").alias("low")).distinct()
    return n.withColumn("low", F.lower("simple")).join(w, "low").filter("simple <> written").select("fqn", "written", R.other_symbol(F.col("fqn"), F.col("written")).alias("other"))


@register("coverage_notes", f"""
WITH b AS (SELECT DISTINCT library, language, season FROM {SYMBOLS}),
w AS (SELECT l.library, g.language, s.season FROM (SELECT DISTINCT library FROM b UNION SELECT 'unheard') l, (SELECT unnest(['java', 'cpp', 'python', 'rust']) AS language) g, {_SEASONS} s)
SELECT w.*, CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.library = w.library AND b.language = w.language AND b.season = w.season) THEN 'partial'
  WHEN EXISTS (SELECT 1 FROM b WHERE b.library = w.library AND b.language = w.language) THEN 'no table of this season'
  WHEN EXISTS (SELECT 1 FROM b WHERE b.library = w.library) THEN 'no table of this language' ELSE 'not indexed' END AS note FROM w""")  # fmt: skip
def coverage_notes(spark: SparkSession, sf: str) -> DataFrame:
    s = symbols(spark, sf)
    libs = s.select("library").union(spark.createDataFrame([("unheard",)], "library string")).distinct()
    wanted = _every_season(libs.withColumn("language", F.explode(F.array(*map(F.lit, ("java", "cpp", "python", "rust"))))))
    return R.coverage_notes(wanted, s)


@register("judged_keys", f"""
WITH hits AS (SELECT DISTINCT query_id, id, regexp_replace(id, '#[0-9]+$', '') AS doc FROM search_hit WHERE regexp_matches(id, '#[0-9]{{1,9}}$')),
judged AS (SELECT query_id, list(DISTINCT CASE WHEN length(id) % 2 = 0 THEN id ELSE doc END) AS relevant FROM hits GROUP BY ALL),
known AS (SELECT doc_id AS id FROM {CHUNKS} UNION SELECT doc_id || '#' || ord FROM {CHUNKS})
SELECT h.query_id, h.id, CASE WHEN list_contains(relevant, h.id) THEN h.id ELSE doc END AS key, k.id IS NULL AS missing
FROM hits h JOIN judged USING (query_id) LEFT JOIN known k ON k.id = CASE WHEN list_contains(relevant, h.id) THEN h.id ELSE doc END""")  # fmt: skip
def judged_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The judged id that each hit satisfies, and whether the collection has it."""
    at = N.parse_chunk_id(F.col("id"))
    hits = table(spark, sf, "search_hit").select("query_id", "id", at["doc_id"].alias("doc")).filter("doc IS NOT NULL").distinct()
    judged = hits.groupBy("query_id").agg(F.collect_set(F.when(F.length("id") % 2 == 0, F.col("id")).otherwise(F.col("doc"))).alias("relevant"))
    keyed = hits.join(judged, "query_id").select("query_id", "id", R.match_key(F.col("doc"), F.col("id"), F.col("relevant")).alias("key"))
    gone = R.missing_judged(keyed.select("query_id", F.col("key").alias("id")), chunks(spark, sf)).select("query_id", F.col("id").alias("key"), F.lit(True).alias("m"))
    return keyed.join(gone, ["query_id", "key"], "left").select("query_id", "id", "key", F.coalesce("m", F.lit(False)).alias("missing"))


@register("set_digest", "SELECT substr(sha256(string_agg(b, '' ORDER BY library, b)), 1, 16) AS digest, count(*) AS shards FROM (SELECT library, md5(library || count(*) || max(season)) AS b FROM chunk GROUP BY library)")
def set_digest(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "chunk").groupBy("library").agg(F.md5(F.concat("library", F.count("*").cast("string"), F.max("season")).cast("binary")).alias("build"))
    return R.set_digest(m, "library", "build")


@register("cpp_bases", f"""
WITH types AS (SELECT DISTINCT fqn FROM {SYMBOLS} WHERE language = 'cpp' AND NOT contains(fqn, '#')),
bases AS (SELECT DISTINCT t.fqn, b.base FROM types t JOIN (SELECT string_split(fqn, '::')[1] AS root, unnest([{_LAST.format('fqn')}, array_to_string(string_split(fqn, '::')[2:], '::'), 'wpi::Elsewhere']) AS base FROM types) b ON b.root = string_split(t.fqn, '::')[1]),
cand AS (SELECT fqn, base, k, CASE WHEN k = 0 THEN base ELSE array_to_string(string_split(fqn, '::')[:k], '::') || '::' || base END AS c FROM (SELECT fqn, base, unnest(range(0, len(string_split(fqn, '::')) + 1)) AS k FROM bases)),
hit AS (SELECT fqn, base, arg_max(c, k) AS c FROM cand JOIN (SELECT fqn AS c FROM types) USING (c) WHERE c <> fqn GROUP BY ALL)
SELECT base, count(*) AS n, count(c) AS known, md5(string_agg(fqn || coalesce(c, base), ',' ORDER BY fqn)) AS digest FROM bases LEFT JOIN hit USING (fqn, base) GROUP BY ALL""")  # fmt: skip
def cpp_bases(spark: SparkSession, sf: str) -> DataFrame:
    """Every type of a namespace as a possible base of the others, written by its last name and from inside the namespace."""
    t = symbols(spark, sf).filter("language = 'cpp'").filter(~F.col("fqn").contains("#")).select("fqn").distinct()
    parts = F.split("fqn", "::")
    written = F.explode(F.array(N.last_segment(F.col("fqn")), F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), "::"), F.lit("wpi::Elsewhere")))
    b = t.select(parts[0].alias("root"), written.alias("base")).distinct()
    bases = t.withColumn("root", parts[0]).join(b, "root").select("fqn", "base")
    got = R.resolve_bases(t, bases)
    each = F.array_join(F.array_sort(F.collect_list(F.struct("fqn", F.concat("fqn", "resolved").alias("x")))).getField("x"), ",")
    return got.groupBy("base").agg(F.count("*").alias("n"), F.count(F.when(F.col("resolved") != F.col("base"), 1)).alias("known"), F.md5(each.cast("binary")).alias("digest"))


@register("page_urls", r"""
WITH d AS (SELECT d.doc_id, r.base_url, CASE WHEN d.doc_id % 7 = 0 THEN coalesce(d.library, 'x') || '/index' WHEN d.doc_id % 11 = 0 THEN 'index' ELSE coalesce(d.library, 'x') || '/Page' || d.doc_id END AS stem,
  CASE WHEN d.doc_id % 13 = 0 THEN '/slug/' || d.doc_id END AS slug, ['html', 'dir', 'plain'][d.doc_id % 3 + 1] AS style, d.doc_id % 2 = 0 AS lower FROM documents d JOIN source_registry r ON r.source = d.source),
p AS (SELECT *, CASE WHEN lower THEN lower(stem) ELSE stem END AS p FROM d), q AS (SELECT *, rtrim(regexp_replace(p, 'index$', ''), '/') AS bare FROM p)
SELECT doc_id, CASE WHEN slug IS NOT NULL THEN rtrim(base_url, '/') || slug ELSE base_url || CASE style WHEN 'html' THEN p || '.html' WHEN 'dir' THEN CASE WHEN bare <> '' THEN bare || '/' ELSE '' END ELSE bare END END AS url FROM q""")  # fmt: skip
def page_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Made file names of every document as pages of its source's site."""
    d = table(spark, sf, "documents").join(table(spark, sf, "source_registry").select("source", "base_url"), "source")
    n, lib = F.col("doc_id"), F.coalesce("library", F.lit("x"))
    stem = F.when(n % 7 == 0, F.concat(lib, F.lit("/index"))).when(n % 11 == 0, "index").otherwise(F.concat(lib, F.lit("/Page"), n.cast("string")))
    slug = F.when(n % 13 == 0, F.concat(F.lit("/slug/"), n.cast("string")))
    style = F.element_at(F.array(F.lit("html"), F.lit("dir"), F.lit("plain")), (n % 3 + 1).cast("int"))
    return d.select("doc_id", R.page_url(F.col("base_url"), stem, slug, style, n % 2 == 0).alias("url"))


@register("forum_posts", f"""
WITH f AS (SELECT doc_id, ord, library, language AS category, CASE WHEN length(title) % 3 = 0 THEN '' ELSE regexp_extract(title, '^(\\w+)', 1) END AS creator FROM {CHUNKS} WHERE lower(trim(kind)) = 'forum')
SELECT doc_id, ord, CASE lower(category) WHEN 'java' THEN 'java' WHEN 'c/c++' THEN 'cpp' WHEN 'python' THEN 'python' ELSE 'any' END AS language,
  library || CASE WHEN coalesce(category, '') <> '' THEN ' › ' || category ELSE '' END || CASE WHEN ord + 1 > 1 THEN ' › reply #' || (ord + 1) || CASE WHEN coalesce(creator, '') <> '' THEN ' by @' || creator ELSE '' END
    WHEN coalesce(creator, '') <> '' THEN ' › @' || creator ELSE '' END AS heading FROM f""")  # fmt: skip
def forum_posts(spark: SparkSession, sf: str) -> DataFrame:
    f = chunks(spark, sf, "library", "language", "title", "kind").filter(F.lower(F.trim("kind")) == "forum")
    creator = F.when(F.length("title") % 3 == 0, "").otherwise(F.regexp_extract("title", r"^([A-Za-z0-9_]+)", 1))
    return f.select("doc_id", "ord", R.forum_language(F.col("language")).alias("language"), R.forum_heading(F.col("library"), F.col("language"), F.col("ord") + 1, creator).alias("heading"))


@register("embed_texts", f"SELECT doc_id, ord, md5(concat_ws(chr(10), nullif(prefix, ''), nullif(body, ''))) AS digest FROM {CHUNKS}")
def embed_texts(spark: SparkSession, sf: str) -> DataFrame:
    return chunks(spark, sf, "prefix", "body").select("doc_id", "ord", F.md5(R.embed_text(F.col("prefix"), F.col("body")).cast("binary")).alias("digest"))


@register("vectors_fit", """
WITH r AS (SELECT label, count(*) + label % 2 AS rows FROM embeddings GROUP BY label UNION ALL SELECT -1, 5)
SELECT r.label, count(e.vec_id) AS vectors, coalesce(bool_and(len(e.embedding) = 64) AND count(e.vec_id) = max(r.rows), false) AS fits FROM r LEFT JOIN embeddings e ON e.label = r.label GROUP BY r.label""")  # fmt: skip
def vectors_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Labels as shards; every second one says that it has a row more than there are vectors."""
    e = table(spark, sf, "embeddings")
    rows = e.groupBy("label").agg((F.count("*") + F.col("label") % 2).alias("rows")).union(spark.sql("SELECT -1, 5L"))
    return R.vectors_fit(e, "label", "embedding", 64, rows)


@register("half_floats", """
SELECT DISTINCT bits, CASE WHEN bits >= 32768 THEN -1 ELSE 1 END * CASE WHEN e = 0 THEN f * power(2::DOUBLE, -24) WHEN e = 31 THEN CASE WHEN f = 0 THEN 'inf'::DOUBLE ELSE 'nan'::DOUBLE END ELSE (1024 + f) * power(2::DOUBLE, e - 25) END AS value
FROM (SELECT bits, (bits // 1024) % 32 AS e, bits % 1024 AS f FROM (SELECT (l_orderkey * 7 + l_linenumber) % 65536 AS bits FROM lineitem))""")  # fmt: skip
def half_floats(spark: SparkSession, sf: str) -> DataFrame:
    bits = table(spark, sf, "lineitem").select(((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 65536).alias("bits")).distinct()
    return bits.select("bits", R.half(F.col("bits")).alias("value"))


# Parts as hardware rows: two sources each, some of one season only.
_HW = """hw AS (
  SELECT replace(lower(p_name), ' ', '') AS part, p_name AS name, lower(p_type) AS category, lower(replace(p_brand, '#', '')) || '-' || p_partkey AS source,
    CASE p_size % 3 WHEN 0 THEN 'all' WHEN 1 THEN '2026' ELSE '2025' END AS season, p_retailprice AS kg FROM part)"""


def _hardware(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    season = F.when(F.col("p_size") % 3 == 0, H.ALWAYS).when(F.col("p_size") % 3 == 1, "2026").otherwise("2025")
    source = F.concat(F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), F.lit("-"), F.col("p_partkey").cast("string"))
    return p.select(F.replace(F.lower("p_name"), F.lit(" "), F.lit("")).alias("part"), F.col("p_name").alias("name"), F.lower("p_type").alias("category"), source.alias("source"), season.alias("season"), F.create_map(F.lit("mass_kg"), "p_retailprice").alias("fields"))


@register("hardware_category", f"""
WITH {_HW} SELECT part, source, season, row_number() OVER (ORDER BY category, part, source, season) AS place FROM hw WHERE category = 'economy' AND season IN ('2026', 'all')""")  # fmt: skip
def hardware_category(spark: SparkSession, sf: str) -> DataFrame:
    return H.select(_hardware(spark, sf), "2026", "economy").select("part", "source", "season", "place")


ASKED_PARTS = ["Small Widget", "cold_widget", "small widget", "no such part", "LARGE (bolt)"]


@register("hardware_parts", f"""
WITH {_HW}, asked AS (SELECT replace(replace(replace(replace(lower(part), ' ', ''), '_', ''), '(', ''), ')', '') AS part, min(pos) AS pos FROM (SELECT unnest({ASKED_PARTS}) AS part, generate_subscripts({ASKED_PARTS}, 1) AS pos) GROUP BY 1),
s AS (SELECT hw.*, row_number() OVER (ORDER BY pos, category, part, source, season) AS place FROM hw JOIN asked USING (part) WHERE season IN ('2025', 'all'))
SELECT part, arg_min(name, place) AS name, arg_min(category, place) AS category, min(place) AS place, count(*) AS sources, string_agg(source || ' ' || season, ', ' ORDER BY place) AS rows FROM s GROUP BY part
UNION ALL SELECT part, NULL, NULL, NULL, 0, NULL FROM asked WHERE part NOT IN (SELECT part FROM hw)""")  # fmt: skip
def hardware_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts asked for by name, each with its sources' rows in order; unknown ones without any."""
    specs = _hardware(spark, sf)
    asked = spark.createDataFrame(list(enumerate(ASKED_PARTS, 1)), "pos int, part string")
    got = H.grouped(H.select(specs, "2025", asked=asked))
    rows = F.array_join(F.transform("rows", lambda r: F.concat(r["source"], F.lit(" "), r["season"])), ", ")
    known = got.select("part", "name", "category", "place", F.size("rows").cast("bigint").alias("sources"), rows.alias("rows"))
    none = H.unknown(specs, asked).select(P.part_id(F.col("part")).alias("part")).distinct()
    return known.unionByName(none.select("part", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("category"), F.lit(None).cast("bigint").alias("place"), F.lit(0).cast("bigint").alias("sources"), F.lit(None).cast("string").alias("rows")))


@register("hardware_errors", f"""
WITH {_HW} SELECT CASE WHEN part = '' THEN 'missing part' WHEN coalesce(category, '') = '' THEN 'missing category' WHEN kg < 905 THEN 'missing fields' WHEN kg > 1500 THEN 'field without a unit' WHEN season = 'all' THEN 'source_url must be https' END AS error, count(*) AS n FROM hw GROUP BY ALL""")  # fmt: skip
def hardware_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of which some lack fields, a unit or a citation."""
    kg = F.col("fields")["mass_kg"]
    empty = F.create_map().cast("map<string,double>")
    rows = _hardware(spark, sf).withColumns({"license": F.lit("CC0-1.0"), "trust": F.lit("vendor"), "source_url": F.when(F.col("season") == H.ALWAYS, "ftp://x").otherwise("https://x"), "kg": kg})
    rows = rows.withColumn("fields", F.when(F.col("kg") < 905, empty).when(F.col("kg") > 1500, F.create_map(F.lit("mass"), "kg")).otherwise(F.col("fields")))
    return rows.groupBy(H.spec_errors().alias("error")).agg(F.count("*").alias("n"))


@register("project_pins", f"""
WITH c AS (SELECT * FROM {CATALOG}), p AS (SELECT uuid AS project, max(season) AS s, length(min(name)) % 4 AS k FROM c GROUP BY uuid),
v AS (SELECT project, k, s || CASE WHEN k = 2 THEN '.1.1-beta-2' ELSE '.1.1' END AS version, s FROM p WHERE k < 4),
d AS (SELECT uuid AS project, 'vendordeps/' || version || '-' || season || '.json' AS path, raw_json->>'$.name' AS name, raw_json->>'$.version' AS version, coalesce(raw_json->>'$.frcYear', '') AS year FROM c),
e AS (SELECT d.*, CASE WHEN regexp_matches(year, '^20[23][0-9]([^0-9]|$)') THEN substr(year, 1, 4) ELSE '' END AS declared FROM d),
g AS (SELECT project, string_agg(concat_ws(' ', e.name, e.version), ', ' ORDER BY path) AS installed, string_agg(CASE WHEN declared <> '' AND declared <> v.s AND k <> 3 AND regexp_matches(v.s, '^20[23][0-9]') THEN path || ': declares ' || year END, ', ' ORDER BY path) AS years FROM e JOIN v USING (project) GROUP BY ALL)
SELECT project, CASE WHEN k = 3 THEN '' ELSE v.version END AS version, CASE WHEN k = 3 THEN '' ELSE regexp_extract(v.version, '^(20[23][0-9])', 1) END AS season, CASE k WHEN 3 THEN '' WHEN 2 THEN 'beta' ELSE 'stable' END AS channel,
  CASE k WHEN 0 THEN 'java' WHEN 1 THEN 'cpp' WHEN 2 THEN 'python' ELSE 'java' END AS language, installed, concat_ws(', ', CASE WHEN k = 3 THEN 'build.gradle.kts: version not found' END, years) AS warnings FROM v JOIN g USING (project)""")  # fmt: skip
def project_pins(spark: SparkSession, sf: str) -> DataFrame:
    """Each library of the catalog as a project with its versions installed: pinned in the build file, in the properties, by
    Python, or nowhere."""
    c = catalog(spark, sf)
    p = c.groupBy(F.col("uuid").alias("project")).agg(F.max("season").alias("s"), (F.length(F.min("name")) % 4).alias("k"))
    version = F.concat("s", F.when(F.col("k") == 2, ".1.1-beta-2").otherwise(".1.1"))
    plugin = 'plugins { id "edu.wpi.first.GradleRIO"'
    file = lambda path, *text: F.struct(F.lit(path).alias("path"), F.concat(*text).alias("text"))
    own = (
        F.when(F.col("k") == 0, F.array(file("build.gradle", F.lit(f'{plugin} version "'), version, F.lit('" }')), file("build.gradle.kts", F.lit("nothing"))))
        .when(F.col("k") == 1, F.array(file("build.gradle", F.lit(f"{plugin} }}")), file("gradle.properties", F.lit("a=b\nwpilibVersion = "), version, F.lit("\n")), file("src/main/cpp/a.cpp", F.lit(""))))
        .when(F.col("k") == 2, F.array(file("pyproject.toml", F.lit('[tool]\nrobotpy_version = "'), version, F.lit('"\n'))))
        .otherwise(F.array(file("build.gradle.kts", F.lit('id("org.wpilib.GradleRIO")'))))
    )
    files = p.select("project", F.explode(own).alias("f")).select("project", "f.*")
    deps = c.select(F.col("uuid").alias("project"), F.concat(F.lit("vendordeps/"), "version", F.lit("-"), "season", F.lit(".json")).alias("path"), F.col("raw_json").alias("text"))
    got = J.detect(files.unionByName(deps))
    return got.select("project", "version", "season", "channel", "language", F.array_join("installed", ", ").alias("installed"), F.array_join("warnings", ", ").alias("warnings"))
