"""Identity and naming of chunks and symbols as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def chunk_id(doc_id: Column, ord: Column) -> Column:
    return F.concat(doc_id, F.lit("#"), ord.cast("string"))


def parse_chunk_id(c: Column) -> Column:
    """struct(doc_id, ord), split at the last '#'; null unless a non-negative number follows it."""
    n = F.regexp_extract(c, r"#([0-9]{1,9})$", 1)
    return F.when(n != "", F.struct(F.regexp_replace(c, r"#[0-9]+$", "").alias("doc_id"), n.cast("int").alias("ord")))


def span(lo: Column, hi: Column) -> Column:
    """One version, or two with a dash between."""
    return F.when((hi == "") | hi.isNull() | (hi == lo), lo).otherwise(F.concat(lo, F.lit("–"), hi))


def last_segment(c: Column) -> Column:
    return F.substring_index(F.substring_index(c, "::", -1), ".", -1)


def simple_name(c: Column) -> Column:
    """A member's name after the last '#', else the last segment."""
    return F.when(c.contains("#"), F.substring_index(c, "#", -1)).otherwise(last_segment(c))


def owner_name(c: Column) -> Column:
    """The simple name of the type that a member belongs to, '' for what is no member."""
    return F.when(c.contains("#"), last_segment(F.substring_index(c, "#", 1))).otherwise("")


def member_form(c: Column) -> Column:
    """a.b.T.m or ns::T::m as a.b.T#m or ns::T#m; others as they are."""
    return F.when(c.contains("#"), c).otherwise(F.regexp_replace(c, r"(?:\.|::)([A-Za-z_]\w*)$", "#$1"))


def dotted(c: Column) -> Column:
    return F.regexp_replace(c, "::|#", ".")


def name_is(c: Column, name: Column) -> Column:
    """The name is the whole, its member form, or its end after a dot; letter case counts."""
    return (c == name) | (c == member_form(name)) | F.endswith(dotted(c), F.concat(F.lit("."), dotted(name)))


def type_name(c: Column) -> Column:
    """From the first segment that begins with a capital."""
    return F.regexp_extract(F.substring_index(c, "#", 1), r"(?:^|\.|::)([A-Z].*)$", 1)


def package_of(c: Column) -> Column:
    """What comes before the type name."""
    t = F.substring_index(c, "#", 1)
    return F.regexp_extract(t, r"^(.*?)(?:\.|::)[A-Z]", 1)


def last_package(c: Column) -> Column:
    return last_segment(package_of(c))
