"""Hardware facts: rows (part, name, category, source, season, fields, ...), several sources a part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pinfold.functions import parts as P, text as T

#: Season of rows that hold in all of them.
ALWAYS = "all"
REQUIRED = ("part", "name", "category", "source", "season", "source_url", "license", "trust")


def spec_errors() -> Column:
    """What is wrong with a hardware row, null if nothing: a required column is empty, it has no fields, a field's name
    doesn't end in its unit, or its citation isn't https."""
    out = F.when(F.lit(False), "")
    for c in REQUIRED:
        out = out.when(F.coalesce(F.col(c), F.lit("")) == "", f"missing {c}")
    bad = F.exists(F.map_keys("fields"), lambda k: ~T.valid_key(k))
    return out.when(F.coalesce(F.size("fields"), F.lit(0)) < 1, "missing fields").when(bad, "field without a unit").when(~F.col("source_url").startswith("https://"), "source_url must be https")


def repeated_specs(specs: DataFrame) -> DataFrame:
    """(part, source, n): the parts that one source gives more than once."""
    return specs.groupBy("part", "source").agg(F.count("*").alias("n")).filter("n > 1")


def select(specs: DataFrame, season: str = "", category: str = "", asked: DataFrame | None = None) -> DataFrame:
    """The rows of the asked parts (pos, part), in the order asked, or without any of a category or all, by category and
    part; within a part by source and season. Adds ``place``, from 1. A season keeps its rows and those of all seasons.

    Names are asked for as people write them; a part asked twice counts where it was asked first.
    """
    rows = specs.filter(F.col("season").isin(season, ALWAYS)) if season else specs
    if asked is None:
        found = (rows.filter(F.col("category") == category) if category else rows).withColumn("pos", F.lit(0))
    else:
        want = asked.select(P.part_id(F.col("part")).alias("part"), "pos").groupBy("part").agg(F.min("pos").alias("pos"))
        found = rows.join(want, "part")
    from pinfold.operators.ranks import number_rows

    return number_rows(found, [F.col(c) for c in ("pos", "category", "part", "source", "season")], "place", 1).drop("pos")


def unknown(specs: DataFrame, asked: DataFrame) -> DataFrame:
    """The asked parts (pos, part) that no row is about, as written."""
    return asked.withColumn("id", P.part_id(F.col("part"))).join(specs.select(F.col("part").alias("id")).distinct(), "id", "left_anti").select("pos", "part")


def grouped(selected: DataFrame) -> DataFrame:
    """(part, name, category, place, rows): one row a part with its rows in order; name and place of the first."""
    each = F.array_sort(F.collect_list(F.struct("place", "source", "season", "fields")), lambda a, b: (a["place"] - b["place"]).cast("int"))
    return selected.groupBy("part").agg(F.min_by("name", "place").alias("name"), F.min_by("category", "place").alias("category"), F.min("place").alias("place"), each.alias("rows"))
