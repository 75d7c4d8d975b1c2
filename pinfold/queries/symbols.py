"""Symbol, catalog and release queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pinfold.functions import names as N, text as T
from pinfold.operators import facts as X, symbols as S
from pinfold.queries.common import CATALOG, CHUNKS, SYMBOLS, TOK, catalog, chunks, symbols
from pinfold.queries.registry import register
from pinfold.queries.texts import VORDER
from pinfold.session import table

SIMPLE = "CASE WHEN contains(%s, '#') THEN regexp_extract(%s, '([^#]*)$', 1) ELSE regexp_extract(%s, '([^.:]*)$', 1) END"
OWNER = "CASE WHEN contains(%s, '#') THEN regexp_extract(string_split(%s, '#')[1], '([^.:]*)$', 1) ELSE '' END"


def _s(c: str) -> str:
    return SIMPLE.replace("%s", c)


def _o(c: str) -> str:
    return OWNER.replace("%s", c)


MEMBER = r"CASE WHEN contains(name, '#') THEN name ELSE regexp_replace(name, '(?:\.|::)([A-Za-z_]\w*)$', '#\1') END"
LOOKUP = rf"""
WITH sy AS {SYMBOLS},
ids AS (SELECT DISTINCT trim(replacement) AS query_id, trim(replacement) AS name FROM symbol WHERE trim(replacement) <> ''
  UNION SELECT lower({_s('fqn')}), lower({_s('fqn')}) FROM sy UNION SELECT {_o('fqn')} || '#' || {_s('fqn')}, {_o('fqn')} || '#' || {_s('fqn')} FROM sy WHERE contains(fqn, '#')),
every AS (
  SELECT query_id, name, 0 AS stage, fqn, signature, season, kind FROM ids JOIN sy ON fqn = name WHERE regexp_matches(name, '\.|::')
  UNION ALL SELECT query_id, name, 1, fqn, signature, season, kind FROM ids JOIN sy ON fqn = {MEMBER} WHERE regexp_matches(name, '\.|::') AND NOT contains(name, '#')
  UNION ALL SELECT query_id, name, 2, fqn, signature, season, kind FROM ids JOIN sy ON lower({_o('fqn')}) = lower({_o('name')}) AND lower({_s('fqn')}) = lower({_s('name')}) WHERE contains(name, '#')
  UNION ALL SELECT query_id, name, 3, fqn, signature, season, kind FROM ids JOIN sy ON lower({_s('fqn')}) = lower({_s('name')}) WHERE NOT contains(name, '#')),
firsts AS (SELECT *, stage < 2 OR {_s('fqn')} = {_s('name')} AS exact FROM every QUALIFY stage = min(stage) OVER (PARTITION BY query_id)),
kept AS (SELECT *, NOT exact AS case_mismatch FROM firsts QUALIFY exact OR NOT bool_or(exact) OVER (PARTITION BY query_id))
SELECT query_id, stage, fqn, signature, season, case_mismatch, row_number() OVER (PARTITION BY query_id ORDER BY case_mismatch, season DESC NULLS LAST,
  CASE WHEN kind = 'class' THEN 0 ELSE 1 END, fqn, signature NULLS FIRST) AS place FROM kept QUALIFY place <= 8"""


@register("symbol_lookup", LOOKUP)
def symbol_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Replacements as they are written, simple names in lower case, and Type#member forms."""
    sy = symbols(spark, sf)
    simple, owner = N.simple_name(F.col("fqn")), N.owner_name(F.col("fqn"))
    written = table(spark, sf, "symbol").select(F.trim("replacement").alias("name")).filter("name <> ''")
    ids = written.union(sy.select(F.lower(simple))).union(sy.filter(F.col("fqn").contains("#")).select(F.concat(owner, F.lit("#"), simple))).distinct().withColumn("query_id", F.col("name"))
    return S.lookup(ids, sy)


@register(
    "symbol_lookup_case",
    f"""
WITH sy AS (SELECT DISTINCT fqn, {_s('fqn')} AS simple FROM {SYMBOLS}), q AS (SELECT DISTINCT simple AS name FROM sy UNION SELECT lower(simple) FROM sy),
found AS (SELECT name, fqn, simple = name AS exact FROM q JOIN sy ON lower(simple) = lower(name))
SELECT name, fqn, NOT exact AS case_mismatch FROM found QUALIFY exact OR NOT bool_or(exact) OVER (PARTITION BY name)""",
)
def symbol_lookup_case(spark: SparkSession, sf: str) -> DataFrame:
    sy = symbols(spark, sf).select("fqn", N.simple_name(F.col("fqn")).alias("simple")).distinct()
    q = sy.select(F.col("simple").alias("name")).union(sy.select(F.lower("simple"))).distinct()
    found = q.join(sy, F.lower("simple") == F.lower("name"))
    return S.case_policy(found, ["name"], F.col("simple") == F.col("name")).select("name", "fqn", "case_mismatch")


@register("prefix_members", f"WITH sy AS (SELECT DISTINCT fqn FROM {SYMBOLS}) SELECT t.fqn AS owner, count(*) AS members FROM sy t JOIN sy m ON starts_with(m.fqn, t.fqn || '#') GROUP BY ALL")
def prefix_members(spark: SparkSession, sf: str) -> DataFrame:
    """Members by their owner's name: the prefix up to '#' is a key."""
    sy = symbols(spark, sf).select("fqn").distinct()
    m = sy.filter(F.col("fqn").contains("#")).select(F.substring_index("fqn", "#", 1).alias("owner"))
    return m.join(sy.withColumnRenamed("fqn", "owner"), "owner", "left_semi").groupBy("owner").agg(F.count("*").alias("members"))


@register("package_exists", f"""
WITH sy AS (SELECT DISTINCT fqn FROM {SYMBOLS}), p AS (SELECT DISTINCT regexp_extract(string_split(fqn, '#')[1], '^(.*?)(?:\\.|::)[A-Z]', 1) AS package FROM sy)
SELECT package, EXISTS (SELECT 1 FROM sy WHERE fqn >= package || '.' AND fqn < package || '/') AS dotted FROM p WHERE package <> ''""")  # fmt: skip
def package_exists(spark: SparkSession, sf: str) -> DataFrame:
    sy = symbols(spark, sf).select("fqn").distinct()
    p = sy.select(N.package_of(F.col("fqn")).alias("package")).distinct().filter("package <> ''")
    heads = sy.select(F.explode(F.expr("transform(filter(sequence(1, length(fqn)), i -> substring(fqn, i, 1) = '.'), i -> substring(fqn, 1, i - 1))")).alias("package")).distinct().withColumn("dotted", F.lit(True))
    return p.join(heads, "package", "left").select("package", F.coalesce("dotted", F.lit(False)).alias("dotted"))


@register("unique_prefix_suffix", f"""
WITH n AS (SELECT DISTINCT lower(name) AS name FROM {CATALOG}),
q AS (SELECT DISTINCT substr(name, 1, 4) AS query FROM n UNION SELECT right(name, 3) FROM n UNION SELECT name FROM n),
m AS (SELECT query, 1 AS r, name FROM q JOIN n ON name = query UNION ALL SELECT query, 2, name FROM q JOIN n ON starts_with(name, query)
  UNION ALL SELECT query, 3, name FROM q JOIN n ON ends_with(name, query) AND NOT ends_with(name, '-foc')),
u AS (SELECT query, r, min(name) AS name FROM m GROUP BY ALL HAVING count(*) = 1)
SELECT query, name, CASE r WHEN 1 THEN 'exact' WHEN 2 THEN 'prefix' ELSE 'suffix' END AS how FROM u QUALIFY row_number() OVER (PARTITION BY query ORDER BY r) = 1""")  # fmt: skip
def unique_prefix_suffix(spark: SparkSession, sf: str) -> DataFrame:
    n = catalog(spark, sf).select(F.lower("name").alias("name")).distinct()
    q = n.select(F.expr("substring(name, 1, 4)").alias("query")).union(n.select(F.expr("right(name, 3)"))).union(n.select("name")).distinct()
    return S.unique_affix(q, n)


@register("library_prefix", f"""
WITH p AS (SELECT DISTINCT library, regexp_extract(fqn, '^([a-z]+\\.[a-z]+)', 1) AS prefix FROM {SYMBOLS} WHERE regexp_matches(fqn, '^[a-z]+\\.[a-z]+')),
q AS (SELECT prefix, library, length(prefix) AS n FROM p UNION SELECT regexp_extract(prefix, '^[a-z]+') || '.', min(library), 0 FROM p GROUP BY ALL),
v AS (SELECT DISTINCT fqn AS value FROM {SYMBOLS})
SELECT value, q.library FROM v JOIN q ON starts_with(value, prefix) QUALIFY row_number() OVER (PARTITION BY value ORDER BY length(prefix) DESC, q.library DESC) = 1""")  # fmt: skip
def library_prefix(spark: SparkSession, sf: str) -> DataFrame:
    sy = symbols(spark, sf).select("library", "fqn")
    p = sy.select("library", F.regexp_extract("fqn", r"^([a-z]+\.[a-z]+)", 1).alias("prefix")).filter("prefix <> ''").distinct()
    short = p.groupBy(F.concat(F.regexp_extract("prefix", "^[a-z]+", 0), F.lit(".")).alias("prefix")).agg(F.min("library").alias("library"))
    return S.longest_prefix(sy.select(F.col("fqn").alias("value")), p.select("prefix", "library").union(short.select("prefix", "library")))


# Two seasons of one library and language, each symbol once.
PAIR = f"""sy AS {SYMBOLS}, scope AS (SELECT library, language FROM sy WHERE season IN ('2025', '2026') GROUP BY ALL HAVING count(DISTINCT season) = 2),
o AS (SELECT DISTINCT fqn FROM sy JOIN scope USING (library, language) WHERE season = '2025'), n AS (SELECT DISTINCT fqn FROM sy JOIN scope USING (library, language) WHERE season = '2026')"""


def _pair(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    sy = symbols(spark, sf).filter(F.col("season").isin("2025", "2026"))
    scope = sy.groupBy("library", "language").agg(F.countDistinct("season").alias("n")).filter("n = 2").select("library", "language")
    own = sy.join(scope, ["library", "language"])
    return own.filter("season = '2025'"), own.filter("season = '2026'")


@register("diff_removed", f"WITH {PAIR} SELECT fqn FROM o ANTI JOIN n USING (fqn)")
def diff_removed(spark: SparkSession, sf: str) -> DataFrame:
    return S.diff(*_pair(spark, sf))[0]


@register("diff_added", f"WITH {PAIR} SELECT fqn FROM n ANTI JOIN o USING (fqn)")
def diff_added(spark: SparkSession, sf: str) -> DataFrame:
    return S.diff(*_pair(spark, sf))[1]


TYPED = r"regexp_extract(string_split(%s, '#')[1], '(?:^|\.|::)([A-Z].*)$', 1)"
PACKED = r"regexp_extract(string_split(%s, '#')[1], '^(.*?)(?:\.|::)[A-Z]', 1)"


@register("diff_mapped", f"""
WITH {PAIR}, gone AS (SELECT fqn FROM o ANTI JOIN n USING (fqn)), fresh AS (SELECT fqn FROM n ANTI JOIN o USING (fqn)),
a AS (SELECT fqn AS from_fqn, {TYPED % 'fqn'} AS t, list_reverse(string_split(replace({PACKED % 'fqn'}, '::', '.'), '.')) AS p FROM gone WHERE NOT contains(fqn, '#')),
b AS (SELECT fqn AS to_fqn, {TYPED % 'fqn'} AS t, list_reverse(string_split(replace({PACKED % 'fqn'}, '::', '.'), '.')) AS q FROM fresh WHERE NOT contains(fqn, '#')),
pairs AS (SELECT *, len(list_filter(range(1, len(p) + 1), lambda i: p[1:i] = q[1:i])) AS shared FROM a JOIN b USING (t) WHERE t <> ''),
best AS (SELECT from_fqn, to_fqn FROM pairs QUALIFY count(*) OVER (PARTITION BY from_fqn) = 1 OR (shared >= 1
  AND shared = max(shared) OVER (PARTITION BY from_fqn) AND count(*) OVER (PARTITION BY from_fqn, shared) = 1)),
members AS (SELECT g.fqn AS from_fqn, to_fqn || '#' || regexp_extract(g.fqn, '([^#]*)$', 1) AS to_fqn FROM gone g JOIN best ON string_split(g.fqn, '#')[1] = best.from_fqn WHERE contains(g.fqn, '#'))
SELECT * FROM best UNION ALL SELECT from_fqn, to_fqn FROM members SEMI JOIN n ON to_fqn = n.fqn""")  # fmt: skip
def diff_mapped(spark: SparkSession, sf: str) -> DataFrame:
    return S.diff(*_pair(spark, sf))[2]


# Every step from one season to the next of each library and language, each symbol once.
KEY = "library, language, season_from, season_to"
STEPS = rf"""sy AS (SELECT DISTINCT lower(trim(coalesce(library, ''))) AS library, lower(trim(coalesce(language, ''))) AS language, season, fqn FROM {SYMBOLS} WHERE season <> '' AND fqn IS NOT NULL),
st AS (SELECT * FROM (SELECT library, language, season AS season_to, lag(season) OVER (PARTITION BY library, language ORDER BY season) AS season_from FROM (SELECT DISTINCT library, language, season FROM sy)) WHERE season_from IS NOT NULL),
o AS (SELECT st.*, fqn FROM st JOIN sy USING (library, language) WHERE season = season_from), n AS (SELECT st.*, fqn FROM st JOIN sy USING (library, language) WHERE season = season_to),
gone AS (SELECT * FROM o ANTI JOIN n USING ({KEY}, fqn)), fresh AS (SELECT * FROM n ANTI JOIN o USING ({KEY}, fqn)),
a AS (SELECT {KEY}, fqn AS from_fqn, {TYPED % 'fqn'} AS t, list_reverse(string_split(replace({PACKED % 'fqn'}, '::', '.'), '.')) AS p FROM gone WHERE NOT contains(fqn, '#')),
b AS (SELECT {KEY}, fqn AS to_fqn, {TYPED % 'fqn'} AS t, list_reverse(string_split(replace({PACKED % 'fqn'}, '::', '.'), '.')) AS q FROM fresh WHERE NOT contains(fqn, '#')),
pairs AS (SELECT *, len(list_filter(range(1, len(p) + 1), lambda i: p[1:i] = q[1:i])) AS shared FROM a JOIN b USING ({KEY}, t) WHERE t <> ''),
best AS (SELECT {KEY}, from_fqn, to_fqn FROM pairs QUALIFY count(*) OVER (PARTITION BY {KEY}, from_fqn) = 1 OR (shared >= 1
  AND shared = max(shared) OVER (PARTITION BY {KEY}, from_fqn) AND count(*) OVER (PARTITION BY {KEY}, from_fqn, shared) = 1)),
members AS (SELECT g.library, g.language, g.season_from, g.season_to, g.fqn AS from_fqn, to_fqn || '#' || regexp_extract(g.fqn, '([^#]*)$', 1) AS to_fqn FROM gone g JOIN best b
  ON g.library = b.library AND g.language = b.language AND g.season_to = b.season_to AND string_split(g.fqn, '#')[1] = b.from_fqn WHERE contains(g.fqn, '#')),
steps AS (SELECT {KEY}, 'removed' AS change, fqn, NULL AS to_fqn FROM gone UNION ALL SELECT {KEY}, 'added', fqn, NULL FROM fresh UNION ALL SELECT {KEY}, 'mapped', from_fqn, to_fqn FROM best
  UNION ALL SELECT {KEY}, 'mapped', from_fqn, to_fqn FROM members m WHERE EXISTS (SELECT 1 FROM n WHERE n.library = m.library AND n.language = m.language AND n.season_to = m.season_to AND n.fqn = m.to_fqn))"""  # fmt: skip


@register("diff_steps", f"WITH {STEPS} SELECT {KEY}, change, fqn, to_fqn FROM steps")
def diff_steps(spark: SparkSession, sf: str) -> DataFrame:
    """What each library lost, got and moved in each language at each step from one of its seasons to the next."""
    plain = lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))).alias(c)
    sy = symbols(spark, sf).filter("season <> '' AND fqn IS NOT NULL").select(plain("library"), plain("language"), "season", "fqn").distinct()
    key = ("library", "language", "season_from", "season_to")
    steps = X.grouped_versions(sy).withColumnRenamed("before", "season_from").withColumnRenamed("season", "season_to").filter("season_from IS NOT NULL").select(*key)
    side = lambda s: sy.withColumnRenamed("season", s).join(steps, ["library", "language", s])
    removed, added, mapped = S.diff(side("season_from"), side("season_to"), key)
    none = F.lit(None).cast("string").alias("to_fqn")
    rows = [removed.select(*key, F.lit("removed").alias("change"), "fqn", none), added.select(*key, F.lit("added").alias("change"), "fqn", none)]
    return rows[0].unionByName(rows[1]).unionByName(mapped.select(*key, F.lit("mapped").alias("change"), F.col("from_fqn").alias("fqn"), "to_fqn"))


@register("diff_counts", f"WITH {STEPS} SELECT {KEY}, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'mapped') AS mapped FROM steps GROUP BY ALL")
def diff_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The steps at which something changed; the counts of diff_report and that of mapped names."""
    count = lambda c: F.count_if(F.col("change") == c).alias(c)
    return diff_steps(spark, sf).groupBy("library", "language", "season_from", "season_to").agg(count("removed"), count("added"), count("mapped"))


RULES = f"(SELECT fqn, max(replacement) AS to_fqn FROM {SYMBOLS} WHERE replacement_src = 'upstream' AND replacement <> '' GROUP BY fqn)"


def _rules(spark: SparkSession, sf: str) -> DataFrame:
    return symbols(spark, sf).filter("replacement_src = 'upstream' AND replacement <> ''").groupBy("fqn").agg(F.max("replacement").alias("to_fqn"))


@register("rule_override", f"SELECT coalesce(r.to_fqn, s.replacement) AS replacement, CASE WHEN r.to_fqn IS NOT NULL THEN 'curated' ELSE replacement_src END AS source, count(*) AS n FROM {SYMBOLS} s LEFT JOIN {RULES} r USING (fqn) GROUP BY ALL")
def rule_override(spark: SparkSession, sf: str) -> DataFrame:
    done = S.override(symbols(spark, sf), _rules(spark, sf))
    return done.groupBy("replacement", F.col("replacement_src").alias("source")).agg(F.count("*").alias("n"))


@register("reverse_replacement", f"""
WITH sy AS (SELECT DISTINCT fqn, replace(replace(trim(replacement), '::', '.'), '#', '.') AS r FROM {SYMBOLS} WHERE replacement <> '')
SELECT t.fqn AS target, sy.fqn AS replaced FROM (SELECT DISTINCT fqn FROM {SYMBOLS}) t JOIN sy ON r = replace(replace(t.fqn, '::', '.'), '#', '.')
QUALIFY row_number() OVER (PARTITION BY t.fqn ORDER BY sy.fqn) <= 5""")  # fmt: skip
def reverse_replacement(spark: SparkSession, sf: str) -> DataFrame:
    sy = symbols(spark, sf)
    r = sy.filter("replacement <> ''").select(F.col("fqn").alias("replaced"), N.dotted(F.trim("replacement")).alias("k")).distinct()
    t = sy.select(F.col("fqn").alias("target")).distinct().withColumn("k", N.dotted(F.col("target")))
    w = Window.partitionBy("target").orderBy("replaced")
    return t.join(r, "k").withColumn("n", F.row_number().over(w)).filter("n <= 5").select("target", "replaced")


HOPS = f"""
WITH RECURSIVE sy AS {SYMBOLS}, seasons AS (SELECT season, row_number() OVER (ORDER BY season) AS i FROM (SELECT DISTINCT season FROM sy WHERE season <> '')),
rows AS (SELECT i, fqn, min(CASE WHEN replacement_src = 'curated' THEN nullif(trim(replacement), '') END) AS curated,
  min(CASE WHEN coalesce(replacement_src, '') <> 'curated' THEN nullif(trim(replacement), '') END) AS repl FROM sy JOIN seasons USING (season) GROUP BY ALL),
owners AS (SELECT i, fqn AS owner, coalesce(curated, repl) AS owner_to FROM rows WHERE NOT contains(fqn, '#') AND coalesce(curated, repl) IS NOT NULL),
walk AS (
  SELECT fqn AS start, fqn, 'start' AS via, 1::BIGINT AS i FROM rows WHERE i = 1
  UNION ALL
  SELECT start, CASE WHEN via = 'unresolved' THEN fqn ELSE coalesce(curated, same, repl, owner_to || '#' || regexp_extract(fqn, '([^#]*)$', 1), fqn) END,
    CASE WHEN via = 'unresolved' THEN via WHEN curated IS NOT NULL THEN 'curated' WHEN same IS NOT NULL THEN 'same' WHEN repl IS NOT NULL THEN 'replacement' WHEN owner_to IS NOT NULL THEN 'owner' ELSE 'unresolved' END, i + 1
  FROM (SELECT w.*, r.curated, r.repl, t.fqn AS same, o.owner_to FROM walk w LEFT JOIN rows r ON r.i = w.i AND r.fqn = w.fqn
    LEFT JOIN (SELECT DISTINCT i, fqn FROM rows) t ON t.i = w.i + 1 AND t.fqn = w.fqn
    LEFT JOIN owners o ON o.i = w.i AND contains(w.fqn, '#') AND o.owner = string_split(w.fqn, '#')[1] WHERE w.i < (SELECT max(i) FROM seasons)))
SELECT start, season, fqn, via FROM walk JOIN seasons USING (i)"""


@register("migration_hops", HOPS)
def migration_hops(spark: SparkSession, sf: str) -> DataFrame:
    sy = symbols(spark, sf).filter("season <> ''")
    r = F.nullif(F.trim("replacement"), F.lit(""))
    cur = F.col("replacement_src") == "curated"
    t = sy.select("season", "fqn", F.when(cur, r).alias("curated"), F.when(~F.coalesce(cur, F.lit(False)), r).alias("replacement"))
    seasons = [x[0] for x in t.select("season").distinct().orderBy("season").collect()]  # one value a year
    if not seasons:
        return t.select(F.col("fqn").alias("start"), "season", "fqn", F.lit("").alias("via"))
    names = t.filter(F.col("season") == seasons[0]).select(F.col("fqn").alias("start"), "fqn").distinct()
    return S.hops(names, t, seasons)


@register("hierarchy_walk", f"""
WITH RECURSIVE e AS (SELECT DISTINCT fqn AS child, replace(replace(trim(replacement), '::', '.'), '#', '.') AS parent FROM (SELECT replace(replace(fqn, '::', '.'), '#', '.') AS fqn, replacement FROM {SYMBOLS}) WHERE replacement <> ''),
walk AS (SELECT child AS node, parent AS ancestor, 1 AS depth FROM e UNION SELECT node, parent, depth + 1 FROM walk JOIN e ON ancestor = child WHERE depth < 8)
SELECT node, ancestor, min(depth) AS depth FROM walk WHERE node <> ancestor GROUP BY ALL""")  # fmt: skip
def hierarchy_walk(spark: SparkSession, sf: str) -> DataFrame:
    """What each symbol was replaced by, and what that was replaced by, and so on."""
    e = symbols(spark, sf).filter("replacement <> ''").select(N.dotted(F.col("fqn")).alias("child"), N.dotted(F.trim("replacement")).alias("parent"))
    return S.ancestors(e)


SUPER = r"(?:extends|implements)\s+([A-Z]\w*)"


@register("supertypes", f"""
WITH RECURSIVE sy AS (SELECT DISTINCT season, fqn, {_s('fqn')} AS simple, signature FROM {SYMBOLS} WHERE NOT contains(fqn, '#')),
e AS (SELECT DISTINCT season || '/' || simple AS child, season || '/' || unnest(regexp_extract_all(signature, '{SUPER}', 1)) AS parent FROM sy),
walk AS (SELECT child AS node, parent AS ancestor, 1 AS depth FROM e UNION SELECT node, parent, depth + 1 FROM walk JOIN e ON ancestor = child WHERE depth < 8)
SELECT node, ancestor, min(depth) AS depth FROM walk WHERE node <> ancestor GROUP BY ALL""")  # fmt: skip
def supertypes(spark: SparkSession, sf: str) -> DataFrame:
    """The types that a type extends or implements, by simple name within a season."""
    sy = symbols(spark, sf).filter(~F.col("fqn").contains("#")).select("season", N.simple_name(F.col("fqn")).alias("simple"), "signature").distinct()
    e = sy.select(F.concat_ws("/", "season", "simple").alias("child"), "season", F.explode(F.regexp_extract_all("signature", F.lit(SUPER), F.lit(1))).alias("p"))
    return S.ancestors(e.select("child", F.concat_ws("/", "season", "p").alias("parent")))


@register("symbol_chunk", f"""
WITH sy AS (SELECT DISTINCT fqn, trim(chunk_id) AS id FROM {SYMBOLS} WHERE regexp_matches(trim(chunk_id), '#[0-9]{{1,9}}$'))
SELECT fqn, id, title FROM (SELECT fqn, id, regexp_replace(id, '#[0-9]+$', '') AS doc_id, regexp_extract(id, '#([0-9]+)$', 1)::INT AS ord FROM sy) JOIN {CHUNKS} USING (doc_id, ord)""")  # fmt: skip
def symbol_chunk(spark: SparkSession, sf: str) -> DataFrame:
    at = N.parse_chunk_id(F.col("id"))
    s = symbols(spark, sf).select("fqn", F.trim("chunk_id").alias("id")).distinct().select("fqn", "id", at["doc_id"].alias("doc_id"), at["ord"].alias("ord")).filter("ord IS NOT NULL")
    return s.join(chunks(spark, sf, "title"), ["doc_id", "ord"]).select("fqn", "id", "title")


@register("policy_anti", f"SELECT library, count(*) AS n FROM {CHUNKS} WHERE library NOT IN (SELECT library FROM {CHUNKS} WHERE license IS NULL OR license = '' OR regexp_matches(lower(license), 'prohibit|proprietary|user')) GROUP BY ALL")
def policy_anti(spark: SparkSession, sf: str) -> DataFrame:
    ch = chunks(spark, sf, "library", "license")
    bad = ch.filter((F.coalesce("license", F.lit("")) == "") | F.lower("license").rlike("prohibit|proprietary|user")).select("library").distinct()
    return ch.join(bad, "library", "left_anti").groupBy("library").agg(F.count("*").alias("n"))


@register("license_union", "SELECT license FROM chunk UNION SELECT license FROM symbol UNION SELECT license FROM source_registry UNION SELECT 'catalog' ORDER BY 1")
def license_union(spark: SparkSession, sf: str) -> DataFrame:
    parts = [table(spark, sf, t).select("license") for t in ("chunk", "symbol", "source_registry")]
    return parts[0].union(parts[1]).union(parts[2]).union(spark.range(1).select(F.lit("catalog"))).distinct().orderBy(F.col("license").asc_nulls_last())


@register("shard_meta", """
SELECT library, count(DISTINCT (season, channel)) AS pairs, coalesce(max(season) FILTER (channel = 'stable'), max(season)) AS default_season, max(season) AS newest, max(retrieved_at) AS built FROM chunk GROUP BY library""")  # fmt: skip
def shard_meta(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "chunk")
    pairs = rows.select("library", "season", "channel").distinct().groupBy("library").agg(F.count("*").alias("pairs"))
    other = rows.groupBy("library").agg(F.coalesce(F.max(F.when(F.col("channel") == "stable", F.col("season"))), F.max("season")).alias("default_season"), F.max("season").alias("newest"), F.max("retrieved_at").alias("built"))
    return pairs.join(other, "library")


@register("season_pairs", f"SELECT library, language, season, lag(season) OVER (PARTITION BY library, language ORDER BY season) AS before FROM (SELECT DISTINCT library, language, season FROM {SYMBOLS} WHERE season <> '')")
def season_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return X.grouped_versions(symbols(spark, sf).filter("season <> ''"))


@register("whats_new", f"""
WITH c AS {CATALOG} SELECT uuid, name, version, retrieved_at FROM c WHERE season = '2026' AND channel = 'stable' AND retrieved_at > TIMESTAMPTZ '2026-08-01 00:00:00+00'
ORDER BY retrieved_at DESC, name, uuid, version LIMIT 20""")  # fmt: skip
def whats_new(spark: SparkSession, sf: str) -> DataFrame:
    c = catalog(spark, sf).filter("season = '2026' AND channel = 'stable' AND retrieved_at > TIMESTAMP '2026-08-01 00:00:00'")
    return X.newest(c.select("uuid", "name", "version", "retrieved_at"), "retrieved_at", ["name", "uuid", "version"], 20)


# A project per season's odd day: what was installed is any catalog row, its version perhaps another season's.
INSTALLED = f"(SELECT 'p' || (ascii(substr(name, 1, 1)) % 7) AS project, uuid, version, frc_year AS year FROM {CATALOG} UNION SELECT 'p0', 'no-such-id', '1.0.0', '2026')"


def _installed(spark: SparkSession, sf: str) -> DataFrame:
    c = catalog(spark, sf).select(F.concat(F.lit("p"), (F.ascii("name") % 7).cast("string")).alias("project"), "uuid", "version", F.col("frc_year").alias("year"))
    return c.union(spark.range(1).select(F.lit("p0"), F.lit("no-such-id"), F.lit("1.0.0"), F.lit("2026"))).distinct()


@register("catalog_check", f"""
WITH c AS {CATALOG}, k AS {VORDER}, best AS (SELECT uuid, version AS latest FROM c JOIN k ON version = v WHERE season = '2026'
  QUALIFY row_number() OVER (PARTITION BY uuid ORDER BY core DESC, release DESC, kind DESC, n DESC, pre DESC, version DESC) = 1),
o AS (SELECT v, rank() OVER (ORDER BY core, release, kind, n, pre) AS place FROM k)
SELECT i.project, i.uuid, i.version, latest, CASE WHEN NOT EXISTS (SELECT 1 FROM c WHERE c.uuid = i.uuid) THEN 'unknown'
  WHEN CASE WHEN regexp_matches(year, '^20[23][0-9]([^0-9]|$)') THEN substr(year, 1, 4) ELSE '' END <> '2026' OR latest IS NULL THEN 'wrong_year'
  WHEN a.place < b.place THEN 'outdated' WHEN a.place > b.place THEN 'newer_than_catalog' ELSE 'ok' END AS status
FROM {INSTALLED} i LEFT JOIN best USING (uuid) LEFT JOIN o a ON a.v = i.version LEFT JOIN o b ON b.v = latest""")  # fmt: skip
def catalog_check(spark: SparkSession, sf: str) -> DataFrame:
    return X.check(_installed(spark, sf), catalog(spark, sf), "2026")


@register("conflict_pairs", f"""
WITH c AS {CATALOG}, d AS (SELECT DISTINCT uuid, lower(trim(x.uuid)) AS other FROM (SELECT uuid, unnest(conflicts) AS x FROM c) WHERE x.uuid <> ''),
i AS (SELECT DISTINCT project, uuid FROM {INSTALLED})
SELECT DISTINCT a.project, a.uuid, d.other FROM i a JOIN d USING (uuid) JOIN i b ON a.project = b.project AND lower(b.uuid) = d.other WHERE lower(a.uuid) <> d.other""")  # fmt: skip
def conflict_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return X.conflicts(_installed(spark, sf), catalog(spark, sf))


@register("catalog_resolve", f"""
WITH own AS (SELECT DISTINCT uuid, name, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS norm,
  regexp_replace(lower(regexp_replace(file_name, '-?[0-9][0-9.]*(?:-[a-z0-9-]+)?\\.json$|\\.json$', '')), '[^a-z0-9]', '', 'g') AS stem FROM {CATALOG}),
q AS (SELECT DISTINCT name AS query FROM own UNION SELECT substr(name, 1, 4) FROM own UNION SELECT upper(uuid) FROM own UNION SELECT 'nothing here'),
k AS (SELECT query, regexp_replace(lower(query), '[^a-z0-9]', '', 'g') AS key FROM q),
exact AS (SELECT DISTINCT query, uuid, name FROM k JOIN own ON lower(trim(query)) = lower(uuid) OR key = norm OR key = stem),
part AS (SELECT DISTINCT query, uuid, name FROM k JOIN own ON key <> '' AND contains(norm, key) WHERE query NOT IN (SELECT query FROM exact)),
g AS (SELECT query, count(DISTINCT uuid) AS n, min(uuid) AS one, count(DISTINCT uuid) FILTER (NOT contains(lower(name), 'replay')) AS m,
  min(uuid) FILTER (NOT contains(lower(name), 'replay')) AS rl, array_to_string(list_sort(list(DISTINCT name)), ', ') AS names FROM (SELECT * FROM exact UNION ALL SELECT * FROM part) GROUP BY query)
SELECT q.query, CASE WHEN n = 1 THEN one WHEN m = 1 THEN rl END AS uuid, CASE WHEN CASE WHEN n = 1 THEN one WHEN m = 1 THEN rl END IS NULL THEN names END AS candidates FROM q LEFT JOIN g USING (query)""")  # fmt: skip
def catalog_resolve(spark: SparkSession, sf: str) -> DataFrame:
    c = catalog(spark, sf)
    q = c.select(F.col("name").alias("query")).union(c.select(F.expr("substring(name, 1, 4)"))).union(c.select(F.upper("uuid"))).union(spark.range(1).select(F.lit("nothing here"))).distinct()
    return X.resolve(q, c)


@register("hardware_pivot", """
SELECT p_brand, p_type, max(p_retailprice) FILTER (r_name = 'AFRICA') AS "AFRICA", max(p_retailprice) FILTER (r_name = 'AMERICA') AS "AMERICA", max(p_retailprice) FILTER (r_name = 'ASIA') AS "ASIA",
  max(p_retailprice) FILTER (r_name = 'EUROPE') AS "EUROPE", max(p_retailprice) FILTER (r_name = 'MIDDLE EAST') AS "MIDDLE EAST"
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")  # fmt: skip
def hardware_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """A value per part kind from each source, side by side."""
    t = {n: table(spark, sf, n) for n in ("lineitem", "part", "supplier", "nation", "region")}
    rows = t["lineitem"].join(t["part"], F.col("l_partkey") == F.col("p_partkey")).join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey")).join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    return X.pivot(rows, ["p_brand"], "p_type", "r_name", F.col("p_retailprice"), ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"])


@register("hardware_group", """
SELECT p_brand, s_suppkey, count(DISTINCT p_partkey) AS parts, round(avg(p_retailprice), 6) AS price FROM (SELECT DISTINCT p_brand, p_partkey, p_retailprice, s_suppkey
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey) GROUP BY ALL""")  # fmt: skip
def hardware_group(spark: SparkSession, sf: str) -> DataFrame:
    li, p, s = (table(spark, sf, n) for n in ("lineitem", "part", "supplier"))
    rows = li.select("l_partkey", "l_suppkey").distinct().join(p, F.col("l_partkey") == F.col("p_partkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy("p_brand", "s_suppkey").agg(F.count("p_partkey").alias("parts"), F.round(F.avg("p_retailprice"), 6).alias("price"))


@register("diff_report", f"""
WITH f AS (SELECT DISTINCT library, language, season, fqn FROM {SYMBOLS} WHERE season <> ''), p AS (SELECT library, language, season, lag(season) OVER (PARTITION BY library, language ORDER BY season) AS before
  FROM (SELECT DISTINCT library, language, season FROM f))
SELECT p.library, p.language, p.before AS season_from, p.season AS season_to,
  (SELECT count(*) FROM f o WHERE o.library = p.library AND o.language = p.language AND o.season = p.before AND NOT EXISTS (SELECT 1 FROM f n WHERE n.library = p.library AND n.language = p.language AND n.season = p.season AND n.fqn = o.fqn)) AS removed,
  (SELECT count(*) FROM f n WHERE n.library = p.library AND n.language = p.language AND n.season = p.season AND NOT EXISTS (SELECT 1 FROM f o WHERE o.library = p.library AND o.language = p.language AND o.season = p.before AND n.fqn = o.fqn)) AS added
FROM p WHERE before IS NOT NULL""")  # fmt: skip
def diff_report(spark: SparkSession, sf: str) -> DataFrame:
    """Removed and added names per step, from one pass: a name's seasons tell the steps at which it came and went."""
    f = symbols(spark, sf).filter("season <> ''").select("library", "language", "season", "fqn").distinct()
    key = ["library", "language"]
    steps = X.grouped_versions(f).withColumnRenamed("before", "season_from").withColumnRenamed("season", "season_to")
    forward = f.join(steps.select(*key, F.col("season_from").alias("season"), "season_to"), [*key, "season"]).select(*key, F.col("season").alias("season_from"), "season_to", "fqn")
    backward = f.join(steps.select(*key, F.col("season_to").alias("season"), "season_from").filter("season_from IS NOT NULL"), [*key, "season"]).select(*key, "season_from", F.col("season").alias("season_to"), "fqn")
    both = forward.withColumn("w", F.lit(1)).unionByName(backward.withColumn("w", F.lit(2)))
    sides = both.groupBy(*key, "season_from", "season_to", "fqn").agg(F.sum("w").alias("w"))
    return sides.groupBy(*key, "season_from", "season_to").agg(F.count_if(F.col("w") == 1).alias("removed"), F.count_if(F.col("w") == 2).alias("added"))
