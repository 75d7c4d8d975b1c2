"""Catalog and release facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pinfold.functions import text as T, versions as V


def newest(rows: DataFrame, when: str, order: list[str], k: int) -> DataFrame:
    return rows.orderBy(F.col(when).desc(), *order).limit(k)


def resolve(asked: DataFrame, catalog: DataFrame) -> DataFrame:
    """(query, uuid, candidates): the catalog entry that each written name means.

    The uuid, or the normalized name or file stem; else names that hold the query. One candidate, or one whose name doesn't
    speak of a replay, is the answer; else uuid is null and ``candidates`` lists the names.
    """
    own = catalog.select("uuid", "name", T.norm(F.col("name")).alias("norm"), T.norm(F.regexp_replace("file_name", r"-?[0-9][0-9.]*(?:-[a-z0-9-]+)?\.json$|\.json$", "")).alias("stem")).distinct()
    q = asked.select("query").distinct().withColumn("key", T.norm(F.col("query")))
    exact = q.join(own, (F.lower(F.trim("query")) == F.lower("uuid"))).select("query", "uuid", "name")
    exact = exact.unionByName(q.join(own, F.col("key") == F.col("norm")).select("query", "uuid", "name")).unionByName(q.join(own, F.col("key") == F.col("stem")).select("query", "uuid", "name")).distinct()
    rest = q.filter("key <> ''").join(exact.select("query").distinct(), "query", "left_anti")
    cut = own.select("uuid", "name", "norm").distinct().select("uuid", "name", F.explode(F.expr("flatten(transform(sequence(1, length(norm)), i -> transform(sequence(1, length(norm) - i + 1), n -> substring(norm, i, n))))")).alias("key")).distinct()
    part = rest.join(cut, "key").select("query", "uuid", "name").distinct()
    every = exact.unionByName(part)
    real = ~F.lower("name").contains("replay")
    g = every.groupBy("query").agg(F.countDistinct("uuid").alias("n"), F.min("uuid").alias("one"), F.countDistinct(F.when(real, F.col("uuid"))).alias("m"), F.min(F.when(real, F.col("uuid"))).alias("real"), F.array_join(F.sort_array(F.collect_set("name")), ", ").alias("names"))
    uuid = F.when(F.col("n") == 1, F.col("one")).when(F.col("m") == 1, F.col("real"))
    return q.select("query").join(g.select("query", uuid.alias("uuid"), F.when(uuid.isNull(), F.col("names")).alias("candidates")), "query", "left")


def check(installed: DataFrame, catalog: DataFrame, season: str) -> DataFrame:
    """``installed`` (project, uuid, version, year) with a status of each: unknown, wrong_year, outdated,
    newer_than_catalog or ok; and the latest version of the season."""
    own = catalog.filter(F.col("season") == season)
    best = own.groupBy("uuid").agg(F.max_by("version", F.struct(V.version_key(F.col("version")), "version")).alias("latest"))
    known = catalog.select("uuid").distinct().withColumn("known", F.lit(True))
    rows = installed.join(known, "uuid", "left").join(best, "uuid", "left")
    mine, top = V.version_key(F.col("version")), V.version_key(F.col("latest"))
    status = (
        F.when(F.col("known").isNull(), "unknown")
        .when((V.declared_season(F.col("year")) != season) | F.col("latest").isNull(), "wrong_year")
        .when(mine < top, "outdated")
        .when(mine > top, "newer_than_catalog")
        .otherwise("ok")
    )
    return rows.select("project", "uuid", "version", "latest", status.alias("status"))


def conflicts(installed: DataFrame, catalog: DataFrame) -> DataFrame:
    """(project, uuid, other): installed pairs of which one declares a conflict with the other, in any version."""
    declared = catalog.select("uuid", F.explode("conflicts.uuid").alias("other")).filter("other <> ''").select("uuid", F.lower(F.trim("other")).alias("other")).distinct()
    mine = installed.select("project", "uuid").distinct()
    theirs = mine.select("project", F.lower("uuid").alias("other"))
    return mine.join(declared, "uuid").join(theirs, ["project", "other"]).filter("lower(uuid) <> other").distinct().select("project", "uuid", "other")


def pivot(rows: DataFrame, key: list[str], field: str, source: str, value: Column, sources: list[str]) -> DataFrame:
    """One row per key and field, one column per source; sources are never merged."""
    return rows.groupBy(*key, field).pivot(source, sources).agg(F.max(value))


def default_season(rows: DataFrame) -> DataFrame:
    """(default_season, newest): the newest season with a stable channel, if none the newest, and the newest of all."""
    stable = F.max(F.when(F.col("channel") == "stable", F.col("season")))
    return rows.agg(F.coalesce(stable, F.max("season")).alias("default_season"), F.max("season").alias("newest"))


def grouped_versions(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("library", "language").orderBy("season")
    return rows.select("library", "language", "season").distinct().withColumn("before", F.lag("season").over(w))
