"""Loading steps: validation with a side output, keyed upserts, chunking, default columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pinfold.functions import text as T

# What the enumerations may hold, the sizes of a chunk.
CHANNELS, LANGUAGES = ["stable", "beta", "alpha"], ["java", "cpp", "python", "any"]
KINDS, TRUSTS = ["prose", "code", "api", "release", "rule", "forum"], ["official", "vendor", "community"]
MOST, LEAST = 650, 12


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def chunk_errors() -> Column:
    """The first rule that a chunk breaks, null if none."""
    out = F
    for c in ("doc_id", "library", "version_lo", "season", "body", "source_url", "upstream_rev", "license"):
        out = out.when(_blank(c), f"missing {c}")
    out = out.when(F.coalesce(F.col("ord"), F.lit(-1)) < 0, "negative ord").when(F.col("retrieved_at").isNull(), "missing retrieved_at")
    for c, known in (("channel", CHANNELS), ("language", LANGUAGES), ("kind", KINDS), ("trust", TRUSTS)):
        out = out.when(~F.coalesce(F.col(c).isin(known), F.lit(False)), f"unknown {c}")
    return out.when(~F.col("source_url").startswith("https://"), "source_url must be https")


def symbol_errors() -> Column:
    out = F
    for c in ("fqn", "library", "version", "season", "kind", "signature", "source_url", "upstream_rev", "license"):
        out = out.when(_blank(c), f"missing {c}")
    out = out.when(F.col("retrieved_at").isNull(), "missing retrieved_at")
    return out.when(~F.coalesce(F.col("language").isin(LANGUAGES[:3]), F.lit(False)), "unknown language").when(~F.col("source_url").startswith("https://"), "source_url must be https")


def split_valid(rows: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    """(good, rejected): rejected rows keep the rule they broke in ``error``."""
    marked = rows.withColumn("error", error)
    return marked.filter("error IS NULL").drop("error"), marked.filter("error IS NOT NULL")


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: list[Column], keep: str = "last") -> DataFrame:
    """One row per key: the last in order (a replace) or the first (a plain insert that skips duplicates)."""
    every = old.unionByName(new)
    o = [c.desc_nulls_last() if keep == "last" else c.asc_nulls_first() for c in order]
    return every.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*o))).filter("__n = 1").drop("__n")


def soft_split(c: Column, most: int = MOST) -> Column:
    """Paragraphs gathered up to a size, never parted inside a fence; one large paragraph stays whole. An array."""
    paras = F.split(c, "\n\n")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"), F.lit(False).alias("fence"))

    def step(acc: Column, p: Column) -> Column:
        odd = F.regexp_count(p, F.lit("```")) % 2 == 1
        full = (acc["cur"] != "") & ~acc["fence"] & (T.estimate_tokens(F.concat(acc["cur"], p)) > most)
        out = F.when(full, F.array_append(acc["out"], F.trim(acc["cur"], F.lit(" \n\t\r")))).otherwise(acc["out"])
        cur = F.when(full | (acc["cur"] == ""), p).otherwise(F.concat(acc["cur"], F.lit("\n\n"), p))
        return F.struct(out.alias("out"), cur.alias("cur"), (acc["fence"] != odd).alias("fence"))

    done = F.aggregate(paras, start, step, lambda a: F.when(a["cur"] != "", F.array_append(a["out"], F.trim(a["cur"], F.lit(" \n\t\r")))).otherwise(a["out"]))
    return F.when(T.estimate_tokens(c) <= most, F.array(c)).otherwise(done)


def variants(blocks: Column) -> Column:
    """A section once per code language in its blocks (an array of struct lang, text; lang '' is shared): an array of
    struct(lang, text), languages in order; 'any' if there is no code."""
    langs = F.array_sort(F.array_distinct(F.filter(F.transform(blocks, lambda b: b["lang"]), lambda x: x != "")))
    text = lambda lang: F.trim(F.array_join(F.transform(F.filter(blocks, lambda b: (b["lang"] == "") | (b["lang"] == lang)), lambda b: b["text"]), "\n\n"), F.lit(" \n\t\r"))
    each = F.transform(langs, lambda lang: F.struct(lang.alias("lang"), text(lang).alias("text")))
    return F.when(F.size(langs) == 0, F.array(F.struct(F.lit("any").alias("lang"), text(F.lit("")).alias("text")))).otherwise(each)


def with_defaults(rows: DataFrame) -> DataFrame:
    """The columns that a load derives: prefix from library, version, title, heading and symbol where it is empty, tokens
    where it is 0, expand, symbol_key."""
    from pinfold.functions import names as N

    full = lambda *c: F.array_join(F.filter(F.array(*[F.coalesce(x, F.lit("")) for x in c]), lambda x: x != ""), " › ")
    prefix = F.when(_blank("prefix"), full(F.col("library"), N.span(F.col("version_lo"), F.col("version_hi")), F.col("title"), F.col("heading_path"), F.col("symbol"))).otherwise(F.col("prefix"))
    return rows.withColumns({
        "prefix": prefix,
        "tokens": F.when(F.coalesce("tokens", F.lit(0)) == 0, T.estimate_tokens(F.coalesce("body", F.lit("")))).otherwise(F.col("tokens")),
        "expand": T.expand(F.col("symbol"), F.col("title"), F.col("body")),
        "symbol_key": F.lower(F.coalesce(N.simple_name(F.col("symbol")), F.lit(""))),
    })


def digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(digest, n): 32 hex digits that don't depend on the order of rows, from sums of row hashes."""
    h = lambda salt: F.sum(F.xxhash64(F.lit(salt), *columns).cast("decimal(38,0)"))
    return rows.agg(F.count("*").alias("n"), h(1).alias("a"), h(2).alias("b")).select(F.substring(F.sha2(F.concat_ws("|", F.col("n").cast("string"), F.col("a").cast("string"), F.col("b").cast("string")), 256), 1, 32).alias("digest"), "n")
