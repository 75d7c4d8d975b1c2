"""What written names mean in a season: types, packages, modules, curated rules; all of it as equi-joins.

A rule is (rule_id, library, language, kind, from_season, to_season, from_fqn, to_fqn); to_fqn is '' for what was removed.
Rules and references are data, so nothing here loops over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pinfold.functions import names as N

#: Kinds of rules by which a name stops being right.
NAMING = ("rename", "move", "removed")


def types_of(symbols: DataFrame) -> DataFrame:
    """(fqn, season): the names that are no members, each once."""
    return symbols.filter(~F.col("fqn").contains("#") & F.col("season").isNotNull()).select("fqn", "season").distinct()


def resolve_types(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(name, package, season, fqn, how) of references (name, package, season).

    A qualified name is itself, if the season has it; else its last segment in the package that refers to it; else the
    one type of that simple name in the season. ``fqn`` and ``how`` are null where none of them, or several, match.
    """
    r = refs.select("name", "package", "season").distinct().withColumn("simple", N.last_segment(F.col("name")))
    t = types_of(symbols)
    exact = t.select(F.col("fqn").alias("name"), "season", F.col("fqn").alias("f1"))
    near = t.select(F.col("fqn").alias("near"), "season", F.col("fqn").alias("f2"))
    one = t.groupBy("season", N.last_segment(F.col("fqn")).alias("simple")).agg(F.count("*").alias("n"), F.min("fqn").alias("f3")).filter("n = 1").drop("n")
    written = F.col("name").rlike(r"\.|::")
    rows = r.withColumn("near", F.when(F.col("package") != "", F.concat("package", F.lit("."), "simple")))
    rows = rows.join(exact, ["name", "season"], "left").join(near, ["near", "season"], "left").join(one, ["season", "simple"], "left")
    whole = F.when(written, F.col("f1"))
    how = F.when(whole.isNotNull(), "exact").when(F.col("f2").isNotNull(), "package").when(F.col("f3").isNotNull(), "unique")
    return rows.select("name", "package", "season", F.coalesce(whole, "f2", "f3").alias("fqn"), how.alias("how"))


def check_packages(refs: DataFrame, symbols: DataFrame, old_root: str, moved_in: str) -> DataFrame:
    """(package, season, severity) of references (package, season): null where the season has the package; a package of
    other seasons only is an error under ``old_root`` from season ``moved_in`` on, else a warning; others are info."""
    own = symbols.filter(F.col("season").isNotNull()).select(N.package_of(F.col("fqn")).alias("package"), "season").filter("package <> ''").distinct()
    r = refs.select("package", "season").distinct()
    rows = r.join(own.withColumn("here", F.lit(True)), ["package", "season"], "left").join(own.select("package").distinct().withColumn("there", F.lit(True)), "package", "left")
    old = F.concat("package", F.lit(".")).startswith(old_root) & (F.col("season") >= moved_in)
    severity = F.when(F.col("here"), F.lit(None)).when(F.col("there"), F.when(old, "error").otherwise("warning")).otherwise("info")
    return rows.select("package", "season", severity.alias("severity"))


def moved_modules(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """(fqn, season, path, severity) of references (fqn, season) that the season lists at another path under the same
    root: a warning where another season lists the path as written, else info. The first path by name is given."""
    t = types_of(symbols)
    root = F.substring_index("fqn", ".", 1)
    here = t.groupBy("season", N.last_segment(F.col("fqn")).alias("simple"), root.alias("root")).agg(F.min("fqn").alias("path"))
    r = refs.select("fqn", "season").distinct().join(t, ["fqn", "season"], "left_anti")
    rows = r.withColumns({"simple": N.last_segment(F.col("fqn")), "root": root}).join(here, ["season", "simple", "root"])
    other = t.select("fqn").distinct().withColumn("other", F.lit(True))
    return rows.join(other, "fqn", "left").select("fqn", "season", "path", F.when(F.col("other"), "warning").otherwise("info").alias("severity"))


def curated_findings(refs: DataFrame, rules: DataFrame) -> DataFrame:
    """(fqn, language, season, rule_id, severity, use): the first rule by id that speaks against a reference.

    A name that a rule changed in an earlier season is an error, in this season a warning, and so is a name that a rule
    only introduces later.
    """
    r = refs.select("fqn", "language", "season").distinct()
    m = rules.filter(F.col("kind").isin(*NAMING) & (F.col("from_fqn") != F.col("to_fqn")))
    gone = r.join(m.withColumnRenamed("from_fqn", "fqn"), ["fqn", "language"]).filter("to_season <= season")
    gone = gone.select(*r.columns, "rule_id", F.when(F.col("to_season") < F.col("season"), "error").otherwise("warning").alias("severity"), F.col("to_fqn").alias("use"))
    later = r.join(m.withColumnRenamed("to_fqn", "fqn"), ["fqn", "language"]).filter("from_season >= season AND fqn <> ''")
    later = later.select(*r.columns, "rule_id", F.lit("warning").alias("severity"), F.col("from_fqn").alias("use"))
    first = F.min(F.struct("rule_id", "severity", "use")).alias("x")
    return gone.unionByName(later).groupBy(*r.columns).agg(first).select(*r.columns, "x.*")


def rules_from(names: DataFrame, rules: DataFrame, members: bool = False) -> DataFrame:
    """The rules whose source is a name (fqn), and with ``members`` those on its members."""
    at = F.substring_index("from_fqn", "#", 1) if members else F.col("from_fqn")
    own = rules.withColumn("fqn", at)
    if members:  # a name that is itself a member has no members
        own = own.unionByName(rules.filter(F.col("from_fqn").contains("#")).withColumn("fqn", F.col("from_fqn")))
    return names.select("fqn").distinct().join(own, "fqn")


def rules_to(names: DataFrame, rules: DataFrame) -> DataFrame:
    return names.select("fqn").distinct().join(rules.filter("to_fqn <> ''").withColumn("fqn", F.col("to_fqn")), "fqn")


def member_rules(mapped: DataFrame, used: DataFrame, rules: DataFrame, season: str, target: str) -> DataFrame:
    """(path, rule_id, from_fqn, to_fqn): for each type (path, fqn) that a file maps, the rules between two seasons on its
    members that the file (path, fqn) doesn't use itself, each once."""
    on = rules.filter(F.col("from_fqn").contains("#") & (F.col("from_season") >= season) & (F.col("to_season") <= target)).withColumn("fqn", F.substring_index("from_fqn", "#", 1))
    rows = mapped.filter(~F.col("fqn").contains("#")).select("path", "fqn").distinct().join(on, "fqn").select("path", "rule_id", "from_fqn", "to_fqn").distinct()
    return rows.join(used.select("path", F.col("fqn").alias("from_fqn")), ["path", "from_fqn"], "left_anti").select("path", "rule_id", "from_fqn", "to_fqn")


def check_rules(rules: DataFrame, symbols: DataFrame, declared: DataFrame) -> DataFrame:
    """(rule_id, language, library, verdict): what the tables say of each rule.

    ``declared`` has the (library, language, season) for which a table is meant to be. A rule from before the first of
    these is checked at the first one from its target season on. Verdicts: ok, skipped (a table wasn't built), undeclared,
    source missing, target missing, source remains.
    """
    key = ["library", "language"]
    built = symbols.select(*key, "season").distinct()
    have = symbols.select(*key, "season", "fqn").distinct()
    seasons = declared.select(*key, "season").distinct().groupBy(*key).agg(F.array_sort(F.collect_set("season")).alias("ss"))
    rows = rules.join(seasons, key, "left").withColumn("ss", F.coalesce("ss", F.array().cast("array<string>")))
    old = (F.size("ss") > 0) & (F.col("from_season") < F.try_element_at("ss", F.lit(1)))
    rows = rows.withColumns({"old": old, "at": F.try_element_at(F.filter("ss", lambda s: s >= F.col("to_season")), F.lit(1))})

    def known(df: DataFrame, season: str, name: str, out: str) -> DataFrame:
        there = have.select(*key, F.col("season").alias(season), F.col("fqn").alias(name)).withColumn(out, F.lit(True))
        return df.join(there, [*key, season, name], "left")

    def table(df: DataFrame, season: str, out: str) -> DataFrame:
        return df.join(built.select(*key, F.col("season").alias(season)).withColumn(out, F.lit(True)), [*key, season], "left")

    for season, out in (("from_season", "t_from"), ("to_season", "t_to"), ("at", "t_at")):
        rows = table(rows, season, out)
    for season, name, out in (("from_season", "from_fqn", "from_there"), ("to_season", "to_fqn", "to_there"), ("at", "to_fqn", "to_at"), ("at", "from_fqn", "from_at")):
        rows = known(rows, season, name, out)
    aims = F.col("to_fqn") != ""
    no = lambda c: F.col(c).isNull()
    historical = (
        F.when(no("at"), "undeclared").when(no("t_at"), "skipped").when(aims & no("to_at"), "target missing")
        .when((F.col("from_fqn") != F.col("to_fqn")) & (F.col("at") > F.col("to_season")) & ~no("from_at"), "source remains").otherwise("ok")
    )
    current = (
        F.when(~F.array_contains("ss", F.col("from_season")), "undeclared").when(no("t_from"), "skipped").when(no("from_there"), "source missing")
        .when(no("t_to") & aims & F.array_contains("ss", F.col("to_season")), "skipped").when(~no("t_to") & aims & no("to_there"), "target missing").otherwise("ok")
    )
    return rows.select("rule_id", *key, F.when(F.col("old"), historical).otherwise(current).alias("verdict"))


def other_symbol(fqn: Column, written: Column) -> Column:
    """Whether a match in another letter case is another symbol: an all-capitals constant, or a member where none is named."""
    simple = N.simple_name(fqn)
    return (simple == F.upper(simple)) | (fqn.contains("#") & ~written.contains("#"))


def coverage_notes(wanted: DataFrame, symbols: DataFrame) -> DataFrame:
    """(library, language, season, note) for each wanted slice: partial, or why there is no table for it."""
    built = symbols.filter(F.col("season").isNotNull()).select("library", "language", "season").distinct()
    flag = lambda cols, out: built.select(*cols).distinct().withColumn(out, F.lit(True))
    rows = wanted.select("library", "language", "season").distinct()
    for cols, out in ((["library", "language", "season"], "a"), (["library", "language"], "b"), (["library"], "c")):
        rows = rows.join(flag(cols, out), cols, "left")
    note = F.when(F.col("a"), "partial").when(F.col("b"), "no table of this season").when(F.col("c"), "no table of this language").otherwise("not indexed")
    return rows.select("library", "language", "season", note.alias("note"))


def match_key(doc_id: Column, chunk_id: Column, relevant: Column) -> Column:
    """The judged id that a hit satisfies: its chunk's where that was judged, else its document's."""
    return F.when(F.array_contains(relevant, chunk_id), chunk_id).otherwise(doc_id)


def missing_judged(judged: DataFrame, docs: DataFrame) -> DataFrame:
    """The judged ids (query_id, id) that name neither a document nor a chunk (doc_id, ord) of the collection."""
    known = docs.select(F.col("doc_id").alias("id")).union(docs.select(N.chunk_id(F.col("doc_id"), F.col("ord")))).distinct()
    return judged.select("query_id", "id").distinct().join(known, "id", "left_anti").select("query_id", "id")


def set_digest(manifest: DataFrame, name: str, build: str) -> DataFrame:
    """(digest, shards): 16 hex digits over the build ids in the order of the names; a manifest has a row a shard."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct(name, build))), lambda x: x[build])
    return manifest.agg(F.substring(F.sha2(F.array_join(ids, ""), 256), 1, 16).alias("digest"), F.count("*").alias("shards"))


def resolve_bases(types: DataFrame, bases: DataFrame) -> DataFrame:
    """(fqn, base, resolved): what a base as written names, looked up from the innermost scope of the type outwards.

    ``types`` has every fqn of the table; ``bases`` (fqn, base). A base that no scope holds stays as written.
    """
    parts = F.split("fqn", "::")
    scopes = bases.select("fqn", "base").distinct().select("fqn", "base", F.posexplode(F.sequence(F.lit(0), F.size(parts))).alias("__p", "k"))
    path = F.array_join(F.slice(F.split("fqn", "::"), F.lit(1), F.col("k")), "::")
    cand = scopes.withColumn("cand", F.when(F.col("k") == 0, F.col("base")).otherwise(F.concat(path, F.lit("::"), "base"))).filter("cand <> fqn")
    hit = cand.join(types.select(F.col("fqn").alias("cand")).distinct(), "cand").groupBy("fqn", "base").agg(F.max_by("cand", "k").alias("hit"))
    return bases.select("fqn", "base").distinct().join(hit, ["fqn", "base"], "left").select("fqn", "base", F.coalesce("hit", "base").alias("resolved"))


def page_url(base: Column, stem: Column, slug: Column, style: Column, lower: Column) -> Column:
    """The published page of a file: a slug from the root, else the stem as .html, as a folder, or plain without index."""
    p = F.when(lower, F.lower(stem)).otherwise(stem)
    bare = F.regexp_replace(F.regexp_replace(p, "index$", ""), "/$", "")
    folder = F.when(bare != "", F.concat(bare, F.lit("/"))).otherwise("")
    by_style = F.concat(base, F.when(style == "html", F.concat(p, F.lit(".html"))).when(style == "dir", folder).otherwise(bare))
    return F.when(F.coalesce(slug, F.lit("")).startswith("/"), F.concat(F.regexp_replace(base, "/$", ""), slug)).otherwise(by_style)


def forum_language(category: Column) -> Column:
    c = F.lower(category)
    return F.when(c == "java", "java").when(c == "c/c++", "cpp").when(c == "python", "python").otherwise("any")


def forum_heading(site: Column, category: Column, number: Column, creator: Column) -> Column:
    """Site, category, and whose topic or which reply it is."""
    by = F.when(F.coalesce(creator, F.lit("")) != "", F.concat(F.lit("@"), creator))
    reply = F.when(number > 1, F.concat_ws(" by ", F.concat(F.lit("reply #"), number.cast("string")), by)).otherwise(by)
    return F.concat_ws(" › ", site, F.nullif(category, F.lit("")), reply)


def embed_text(prefix: Column, body: Column) -> Column:
    """What is embedded of a chunk: its prefix, a line break, its body; an absent part leaves no line."""
    return F.concat_ws("\n", F.nullif(prefix, F.lit("")), F.nullif(body, F.lit("")))


def vectors_fit(vectors: DataFrame, shard: str, vector: str, dims: int, rows: DataFrame) -> DataFrame:
    """(<shard>, vectors, fits): whether a shard's vectors may be searched: all of the query's length, one for each row.

    ``rows`` has (<shard>, rows); a shard of other counts, or without vectors, has no dense list.
    """
    n = F.coalesce(F.size(vector), F.lit(-1))
    own = vectors.groupBy(shard).agg(F.count("*").alias("vectors"), F.min(n == dims).alias("same"))
    both = rows.join(own, shard, "left")
    return both.select(shard, F.coalesce("vectors", F.lit(0)).alias("vectors"), F.coalesce(F.col("same") & (F.col("vectors") == F.col("rows")), F.lit(False)).alias("fits"))


def half(bits: Column) -> Column:
    """The number that 16 bits are in half precision, subnormal ones and infinities too; NaN for what is none."""
    b = bits.cast("int").bitwiseAND(F.lit(0xFFFF))
    e, f = F.shiftright(b, 10).bitwiseAND(F.lit(31)), b.bitwiseAND(F.lit(1023)).cast("double")
    size = F.when(e == 0, f * 2.0**-24).when(e == 31, F.when(f == 0, float("inf")).otherwise(float("nan"))).otherwise((1 + f / 1024) * F.pow(F.lit(2.0), e - 15))
    return F.when(b >= 0x8000, -size).otherwise(size)


