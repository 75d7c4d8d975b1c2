"""The order of versions as a sortable struct.

Numbers compare as numbers, missing ones as 0; a release follows its pre-releases; alpha, then beta and unknown tags,
then rc; then the pre-release's number, then its text.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Segments that are compared; shorter versions are padded, so that 26.1 and 26.1.0 are equal.
SEGMENTS = 6


def _clean(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), "^v", "")


def core(c: Column) -> Column:
    """The leading numeric segments."""
    head = F.substring_index(_clean(c), "-", 1)
    return F.transform(F.split(F.regexp_extract(head, r"^(?:[0-9]{1,9})(?:\.[0-9]{1,9})*(?=\.|$)", 0), r"\."), lambda x: F.when(x != "", x).cast("int"))


def prerelease(c: Column) -> Column:
    """What follows the first '-', else the first segment that is no number; '' for a release."""
    v = _clean(c)
    after = F.when(v.contains("-"), F.regexp_replace(v, "^[^-]*-", "")).otherwise("")
    head = F.substring_index(v, "-", 1)
    odd = F.try_element_at(F.filter(F.split(head, r"\."), lambda x: ~x.rlike("^[0-9]{1,9}$")), F.lit(1))
    return F.when(after != "", after).otherwise(F.coalesce(odd, F.lit("")))


def version_key(c: Column) -> Column:
    """struct(core, release, rank, n, text): compares as the versions do; null for null."""
    pre = prerelease(c)
    kind = F.substring_index(pre, "-", 1)
    tail = F.when(pre.contains("-"), F.regexp_extract(pre, r"^[^-]*-([0-9]{0,9})", 1)).otherwise("")
    stem = F.when(tail == "", F.regexp_extract(kind, r"^([^0-9]+)", 1)).otherwise(kind)
    number = F.when(tail == "", F.regexp_extract(kind, r"^[^0-9]+([0-9]{1,9})$", 1)).otherwise(tail)
    name = F.when(stem == "", kind).otherwise(stem)
    rank = F.when(name == "alpha", 0).when(name == "rc", 2).otherwise(1)
    nums = F.filter(core(c), lambda x: x.isNotNull())
    padded = F.slice(F.concat(nums, F.array_repeat(F.lit(0), SEGMENTS)), 1, SEGMENTS)
    release = F.when(pre == "", 1).otherwise(0)
    return F.when(
        c.isNotNull(),
        F.struct(padded.alias("core"), release.alias("release"), F.when(pre == "", 0).otherwise(rank).alias("rank"), F.when(number == "", 0).otherwise(number.cast("int")).alias("n"), pre.alias("text")),
    )


def season(c: Column) -> Column:
    """The season that a version implies: 2020-2039, or 20-39 of the two-digit scheme; '' if none."""
    y = F.try_element_at(core(c), F.lit(1))
    return F.when(y.between(2020, 2039), y.cast("string")).when(y.between(20, 39), (y + 2000).cast("string")).otherwise("")


def season_for(library: Column, c: Column, early: tuple[str, ...] = ("phoenix5", "phoenix6")) -> Column:
    """As season; libraries that number the next season's previews from minor 50 on belong to the next one."""
    y, minor = F.try_element_at(core(c), F.lit(1)), F.try_element_at(core(c), F.lit(2))
    return F.when(library.isin(*early) & y.between(20, 39) & (minor >= 50), (y + 2001).cast("string")).otherwise(season(c))


def declared_season(c: Column) -> Column:
    """The leading year 2020-2039 of a declared year, unless another digit follows; '' if none."""
    y = F.regexp_extract(c, r"^(20[23][0-9])(?![0-9])", 1)
    return F.coalesce(y, F.lit(""))


def channel(version: Column, prerelease_flag: Column) -> Column:
    v = F.lower(version)
    return F.when(v.contains("alpha"), "alpha").when(v.rlike("beta|rc|pre") | prerelease_flag, "beta").otherwise("stable")
