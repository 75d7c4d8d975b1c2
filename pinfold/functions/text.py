"""Text functions as Column expressions, so that they stay inside generated code."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, functions as F

# The words that carry no content in a query.
STOPWORDS = """
a an and are as at be by can do does for from get how i if in into is it
me my of on or should the this to use using what when where which why with you your need want make
set up example examples way best
""".split()
# Fixed value: UTF-8 bytes that count as one token.
BYTES_PER_TOKEN = 4

WORD = r"[\p{L}\p{Nd}_]+"
COMPOUND = r"_|\p{Ll}\p{Lu}|\p{Lu}\p{Lu}\p{Ll}|\p{L}\p{Nd}|\p{Nd}\p{L}"
HUMP = r"_+|(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|(?<=\p{L})(?=\p{Nd})|(?<=\p{Nd})(?=\p{L})"


def tokens(c: Column | str) -> Column:
    """Runs of letters, decimal digits and underscores, case kept; null for null."""
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def split_ident(c: Column) -> Column:
    """The lower-cased parts of a compound identifier; null for one of under 3 bytes or of a single part."""
    parts = F.filter(F.split(c, HUMP), lambda x: x != "")
    return F.when((F.octet_length(c) >= 3) & (F.size(parts) > 1), F.transform(parts, F.lower))


def first_by(a: Column, key, kind: str = "string") -> Column:
    """The elements of an array whose key hasn't come before, in order. Each key is worked out once."""
    none = F.struct(F.array().cast("array<string>").alias("k"), F.array().cast(f"array<{kind}>").alias("x"))
    pairs = F.transform(a, lambda x: F.struct(key(x).alias("k"), x.alias("x")))
    add = lambda acc, p: F.when(F.array_contains(acc["k"], p["k"]), acc).otherwise(F.struct(F.array_append(acc["k"], p["k"]).alias("k"), F.array_append(acc["x"], p["x"]).alias("x")))
    return F.aggregate(pairs, none, add, lambda acc: acc["x"])


def expand(*texts: Column) -> Column:
    """The parts of every distinct compound identifier in the texts, one string; '' if there are none."""
    all_tokens = F.array_distinct(F.flatten(F.array(*[F.coalesce(tokens(t), F.array().cast("array<string>")) for t in texts])))
    compound = F.filter(all_tokens, lambda x: x.rlike(COMPOUND) & (F.octet_length(x) >= 3))
    distinct = first_by(compound, F.lower)
    parts = F.transform(distinct, lambda x: F.filter(F.split(x, HUMP), lambda y: y != ""))
    return F.lower(F.array_join(F.flatten(F.filter(parts, lambda p: F.size(p) > 1)), " "))


def query_tokens(c: Column) -> Column:
    """What a query searches for: its distinct tokens but for stop words and single characters that are no digit."""
    ok = lambda x: ~F.lower(x).isin(STOPWORDS) & ((F.octet_length(F.lower(x)) >= 2) | F.lower(x).rlike("^[0-9]$"))
    return first_by(F.filter(tokens(c), ok), F.lower)


def match_string(c: Column) -> Column:
    """The match expression of a query: quoted terms joined by OR, a compound identifier also as the phrase of its parts."""
    quote = lambda x: F.concat(F.lit('"'), x, F.lit('"'))

    def group(x: Column) -> Column:
        parts = split_ident(x)
        phrase = F.array_join(F.transform(parts, quote), " ")
        return F.when(parts.isNull(), quote(F.lower(x))).otherwise(F.concat(F.lit("("), quote(F.lower(x)), F.lit(" OR ("), phrase, F.lit("))")))

    return F.array_join(F.transform(query_tokens(c), group), " OR ")


def content_terms(c: Column) -> Column:
    """Distinct lower-cased tokens of two bytes or more that are no stop words."""
    return F.array_distinct(F.filter(F.transform(tokens(c), F.lower), lambda x: ~x.isin(STOPWORDS) & (F.octet_length(x) >= 2)))


def estimate_tokens(c: Column) -> Column:
    return F.floor((F.octet_length(c) + BYTES_PER_TOKEN - 1) / BYTES_PER_TOKEN).cast("int")


def norm(c: Column) -> Column:
    """Letters a-z and digits of the lower-cased text."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


@cache
def _accents() -> tuple[str, str]:
    """Letters that decompose into one letter and marks, and that letter, by the Unicode decomposition rule."""
    a, b = [], []
    for cp in [*range(0xC0, 0xD800), *range(0xF900, 0xFB00)]:
        if 0xAC00 <= cp < 0xD7A4:
            continue  # composed syllables aren't accents
        c = chr(cp)
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.category(x).startswith("M"))
        if base != c and len(base) == 1:
            a.append(c)
            b.append(base)
    return "".join(a), "".join(b)


def fold(c: Column) -> Column:
    """Lower case without accents or other marks; ASCII texts have none, and skip the table."""
    marked = F.translate(F.regexp_replace(F.lower(c), r"\p{M}+", ""), *_accents())
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(marked)


def slug(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))


def humanize(c: Column) -> Column:
    return F.initcap(F.regexp_replace(c, "[-_]+", " "))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def first_sentence(c: Column) -> Column:
    """Up to the first full stop with a blank after it, at most 320 characters."""
    flat = collapse(c)
    head = F.regexp_extract(flat, r"^(.*?\.)(?: |$)", 1)
    return F.substring(F.when(head != "", head).otherwise(flat), 1, 320)


def doxygen_escape(c: Column) -> Column:
    """The file name of a C++ name: '_' doubled, ':' as _1, capitals as '_' and the small letter."""
    x = F.regexp_replace(F.regexp_replace(c, "_", "__"), ":", "_1")
    return F.lower(F.regexp_replace(x, "([A-Z])", "_$1"))


def literal_kind(c: Column) -> Column:
    """What kind of literal an argument is."""
    t = F.trim(c)
    return (
        F.when(t.rlike(r'^"(?:[^"\\]|\\.)*"$'), "String")
        .when(t.rlike(r"^'(?:[^'\\]|\\.)'$"), "char")
        .when(t.isin("true", "false"), "boolean")
        .when(t == "null", "null")
        .when(t.rlike(r"^[-+]?\d[\d_]*[lL]?$"), "int")
        .when(t.rlike(r"^[-+]?(?:\d+\.\d*|\.\d+|\d+(?=[eEfFdD]))(?:[eE][-+]?\d+)?[fFdD]?$"), "float")
        .otherwise("other")
    )


def code_language(c: Column) -> Column:
    """java, cpp, python or '' by telling lines."""
    return (
        F.when(c.rlike(r"(?m)^\s*(import\s+(static\s+)?[a-z][\w.]*;|package\s+[\w.]+;|public\s+(final\s+)?(class|interface|enum)\s)"), "java")
        .when(c.rlike(r"(?m)^\s*#include\s*[<\"]|\bstd::|::\w+"), "cpp")
        .when(c.rlike(r"(?m)^\s*(from\s+\w[\w.]*\s+import\s|import\s+\w[\w.]*\s*$|def\s+\w+\(|class\s+\w+.*:\s*$)"), "python")
        .otherwise("")
    )


def fence_language(c: Column) -> Column:
    """The language that a fence's info string names, '' if none of the three."""
    x = F.lower(F.trim(c))
    return F.when(x == "java", "java").when(x.isin("cpp", "c++", "cc", "hpp", "h", "cxx"), "cpp").when(x.isin("python", "py", "python3"), "python").otherwise("")


def non_english(c: Column) -> Column:
    """A tenth of the letters or more isn't ASCII."""
    letters = F.regexp_count(c, F.lit(r"\p{L}"))
    return (letters > 0) & (F.regexp_count(c, F.lit(r"[\p{L}&&[^\x00-\x7F]]")) * 10 >= letters)


def is_identifier(c: Column) -> Column:
    """Looks like the name of something in code: qualified, camel case, a capital with a digit, or with underscores."""
    return c.rlike(r"::|#|^\w+(\.\w+){2,}$|^[A-Z]\w*\.\w+$|\p{Ll}\p{Lu}|^\p{Lu}\w*\d|\w_\w")


def valid_key(c: Column) -> Column:
    """A measured quantity's name must end in its unit."""
    return c.rlike(r"^[a-z][a-z0-9]*(_[a-z0-9]+)*_(v|a|w|nm|rpm|kg|g|mm|m|s|ms|hz|deg|rad|ohm|kv|ratio|count)$")


def breaking(c: Column) -> Column:
    return c.rlike(r"(?i)\bbreaking\b|\bremoved\b|\bdeprecat|\brenamed\b|\bno longer\b|\bmigrat")


def front_matter(c: Column) -> Column:
    """The flat key: value pairs of a leading block between --- lines, as a map."""
    block = F.regexp_extract(c, r"(?s)^---\r?\n(.*?)\r?\n---\r?(?:\n|$)", 1)
    return F.when(block != "", F.str_to_map(block, F.lit(r"\r?\n"), F.lit(r":\s*")))


def head_lines(c: Column, most: int = 600) -> Column:
    """The first non-empty lines that fit in ``most`` bytes together, and an ellipsis if any was left out."""
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    start = F.struct(F.lit("").alias("s"), F.lit(False).alias("cut"))

    def step(acc: Column, x: Column) -> Column:
        joined = F.when(acc["s"] == "", x).otherwise(F.concat(acc["s"], F.lit("\n"), x))
        over = acc["cut"] | (F.octet_length(joined) > most)
        return F.struct(F.when(over, acc["s"]).otherwise(joined).alias("s"), over.alias("cut"))

    return F.aggregate(lines, start, step, lambda acc: F.when(acc["cut"], F.concat(acc["s"], F.lit("…"))).otherwise(acc["s"]))
