"""Reading of line files and sets of tables, and writing that swaps whole versions."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; empty lines and lines that begin with '/' are skipped, any other bad line fails the read."""
    lines = spark.read.text(path).filter((F.trim("value") != "") & ~F.col("value").startswith("/"))
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("x")).select("x.*")


def judged_queries(spark: SparkSession, path: str) -> DataFrame:
    """Judged queries; ids must be unique, and a query and a relevant item be there."""
    q = json_lines(spark, path, "id string, query string, season string, language string, bucket string, split string, relevant array<string>")
    bad = q.filter((F.coalesce("id", F.lit("")) == "") | (F.coalesce("query", F.lit("")) == "") | (F.size(F.coalesce("relevant", F.array().cast("array<string>"))) == 0))
    twice = q.groupBy("id").count().filter("count > 1")
    if bad.limit(1).count() or twice.limit(1).count():
        raise ValueError("judged queries need a unique id, a query and a relevant item")
    return q


def publish(tables: dict[str, DataFrame], root: str, partition_by: dict[str, list[str]] | None = None) -> str:
    """Writes all tables into a new version folder and then points ``current`` to it; readers see the old or the new one
    whole. Gives the version."""
    version = uuid.uuid4().hex
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        w = df.write
        if by := (partition_by or {}).get(name):
            w = w.partitionBy(*by)
        w.parquet(f"{root}/versions/{version}/{name}")
    jvm = spark.sparkContext._jvm
    fs_path = jvm.org.apache.hadoop.fs.Path
    fs = fs_path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(fs_path(f"{root}/current.tmp"), True)
    out.write(bytearray(json.dumps({"version": version, "tables": sorted(tables)}).encode()))
    out.close()
    how = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(how, 1)
    over[0] = how.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs_path(root).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs_path(f"{root}/current.tmp"), fs_path(f"{root}/current"), over)  # readers meet the old or the new one
    return version


def published(spark: SparkSession, root: str, names: list[str] | None = None) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """(tables of the current version, errors by table): a table that can't be read is reported, not hidden."""
    meta = json.loads("".join(r[0] for r in spark.read.text(f"{root}/current").collect()))
    found, errors = {}, {}
    for n in names or meta["tables"]:
        try:
            found[n] = spark.read.parquet(f"{root}/versions/{meta['version']}/{n}")
        except Exception as e:
            errors[n] = str(e).split("\n")[0]
    return found, errors


def prometheus(counts: DataFrame, name: str, labels: list[str], value: str) -> DataFrame:
    """Counters in text form, one line a series."""
    parts = [F.concat(F.lit(f'{c}="'), F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r'(["\\])', r"\\$1"), F.lit('"')) for c in labels]
    return counts.select(F.concat(F.lit(f"{name}{{"), F.concat_ws(",", *parts), F.lit("} "), F.col(value).cast("string")).alias("line")).orderBy("line")


def explode_rules(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """One row per rule and language. Ids must be unique and kebab-case, seasons four digits and rising, targets within the
    sources' languages, citations https; a target may be missing only for removed and behavior."""
    import re

    rows, seen = [], set()
    for r in rules:
        if not re.fullmatch(r"[a-z0-9]+(-[a-z0-9]+)*", r["id"]) or r["id"] in seen:
            raise ValueError(f"rule id {r['id']!r}")
        seen.add(r["id"])
        a, b, src, dst = r["from_season"], r["to_season"], r.get("from", {}), r.get("to", {})
        if not (re.fullmatch(r"20\d\d", a) and re.fullmatch(r"20\d\d", b) and a < b):
            raise ValueError(f"seasons of {r['id']}")
        if not set(dst) <= set(src) or not r.get("citation", "").startswith("https://"):
            raise ValueError(f"languages or citation of {r['id']}")
        if r["kind"] not in ("removed", "behavior") and not dst:
            raise ValueError(f"target of {r['id']}")
        rows += [(r["id"], r.get("library"), lang, a, b, r["kind"], name, dst.get(lang, ""), r.get("notes", ""), r["citation"], bool(r.get("verified"))) for lang, name in sorted(src.items())]
    kinds = "rule_id string, library string, language string, from_season string, to_season string, kind string, from_fqn string, to_fqn string, notes string, citation string, verified boolean"
    return spark.createDataFrame(rows, kinds)


