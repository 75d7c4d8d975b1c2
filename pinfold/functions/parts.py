"""Names of parts and libraries, and texts cut to a budget."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Names that people use for parts and libraries.
PARTS = {
    "kraken": "krakenx60", "x60": "krakenx60", "krakenx60": "krakenx60", "x44": "krakenx44", "krakenx44": "krakenx44",
    "falcon": "falcon500", "falcon500": "falcon500", "vortex": "neovortex", "neovortex": "neovortex", "sparkflexvortex": "neovortex",
    "neo": "neo", "neov11": "neo", "neov1.1": "neo", "neo2.0": "neo2", "neov2": "neo2", "neo550": "neo550", "550": "neo550",
    "775": "vex775pro", "775pro": "vex775pro", "vex775pro": "vex775pro", "redline": "775redline", "775redline": "775redline",
    "cim": "cim", "minicim": "minicim", "bag": "bag", "minion": "minion", "pulsar": "thriftypulsar", "romi": "romibuiltin",
    "pigeon": "ctrepigeon2", "pigeon2": "ctrepigeon2", "pigeon2.0": "ctrepigeon2", "canandgyro": "reduxcanandgyro",
    "borongyro": "reduxcanandgyro", "boron": "reduxcanandgyro", "throughbore": "revthroughborev2",
    "throughboreencoder": "revthroughborev2", "tbe": "revthroughborev2", "maxswerve": "revmaxswerve",
}
LIBRARIES = {
    "all": "", "wpilib": "wpilib", "allwpilib": "wpilib", "gradlerio": "wpilib", "phoenix": "phoenix6", "phoenix6": "phoenix6", "ctre": "phoenix6", "rev": "revlib", "revlib": "revlib",
    "photon": "photonvision", "photonlib": "photonvision", "photonvision": "photonvision", "pathplanner": "pathplannerlib", "pathplannerlib": "pathplannerlib", "choreo": "choreolib",
    "choreolib": "choreolib", "akit": "advantagekit", "advantagekit": "advantagekit", "yagsl": "yagsl",
}


def _alias(c: Column, names: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(table, c), c)


def part_id(c: Column) -> Column:
    """Lower case without blanks, dashes and brackets, by its usual name; a trailing foc becomes -foc."""
    n = F.regexp_replace(F.lower(c), "[ _()-]", "")
    foc = n.endswith("foc") & (F.length(n) > 3)
    return F.concat(_alias(F.when(foc, F.regexp_replace(n, "foc$", "")).otherwise(n), PARTS), F.when(foc, "-foc").otherwise(""))


def library_id(c: Column) -> Column:
    return _alias(F.regexp_replace(F.lower(F.trim(c)), "[ _-]", ""), LIBRARIES)


def cut(text: str | None, most: int) -> str | None:
    """At most ``most`` tokens of four bytes, ended at a paragraph, else a sentence or line, of the last quarter; an open
    fence is closed, and an ellipsis tells that something is missing."""
    raw = (text or "").encode()
    limit = most * 4
    if text is None or limit <= 0 or len(raw) <= limit:
        return text
    head = raw[:limit].decode("utf-8", "ignore").encode()
    floor = len(head) * 3 // 4
    at = head.rfind(b"\n\n", floor)
    if at < 0:
        at = max(head.rfind(b".", floor), head.rfind(b"\n", floor)) + 1 or len(head)
    out = head[:at].decode("utf-8", "ignore").rstrip(" \t\n")
    return out + ("\n```" if out.count("```") % 2 else "") + " …"


def snippet(c: Column, most: int) -> Column:
    """``cut`` as a column; texts within the limit don't change."""
    return F.pandas_udf(lambda s: s.map(lambda x: cut(x, most)), T.StringType())(c)


def pages(text: str | None, most: int) -> list[str]:
    """A body as the pages that paging through it gives."""
    out, rest = [], text or ""
    while rest:
        page = cut(rest, most)
        out.append(page)
        if page == rest:
            break
        took = page.removesuffix(" …").removesuffix("\n```")
        rest = rest[max(len(took), 1) :]
    return out


def body_pages(c: Column, most: int) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: pages(x, most))

    return F.pandas_udf(run, T.ArrayType(T.StringType()))(c)


def factory(want: Column, names: Column, language: Column) -> Column:
    """The name in another language that a factory's name means: equal without case (and without get), else the only one
    of at least four letters that it ends with."""
    low = F.lower(want)
    key = F.when(language == "java", low).otherwise(F.regexp_replace(low, "^get", ""))
    same = F.filter(names, lambda n: F.lower(n) == key)
    ends = F.filter(names, lambda n: (F.length(n) >= 4) & F.endswith(key, F.lower(n)))
    return F.when(F.size(same) > 0, same[0]).when(F.size(ends) == 1, ends[0])


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
