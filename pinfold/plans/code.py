"""References of source files to API elements, and what is wrong with them in a season.

One vectorized pass extracts the references of every file; all lookups are joins over all files at once.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from pinfold.functions import names as N, versions as V
from pinfold.session import ship

Ref = tuple[str, int, int, bool, int]  # symbol, line, column, member, arguments or -1
REFS = "path string, symbol string, line int, col int, member boolean, args int"


def blank(code: str) -> str:
    """Java or C++ without comments and the insides of literals, at the same places."""
    keep = lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0][0] == "/" else m[0][0] + re.sub(r"[^\n]", " ", m[0][1:-1]) + m[0][-1]
    return re.sub(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", keep, code, flags=re.S)


def _arguments(src: str, at: int) -> int:
    """How many arguments the call whose parenthesis opens at ``at`` has; -1 if it doesn't close."""
    depth, commas, empty = 0, 0, True
    for c in src[at:]:
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if not depth:
                return 0 if empty else commas + 1
        elif c == "," and depth == 1:
            commas += 1
        if depth and not c.isspace() and not (c == "(" and depth == 1):
            empty = False
    return -1


def java_refs(code: str, roots: tuple[str, ...]) -> Iterator[Ref]:
    src = blank(code)
    here = lambda i: (src.count("\n", 0, i) + 1, i - src.rfind("\n", 0, i))
    types: dict[str, str] = {}
    for m in re.finditer(r"(?m)^[ \t]*import\s+(static\s+)?([\w.]+)(\.\*)?\s*;", src):
        if m[3] or not m[2].startswith(roots):
            continue
        if m[1]:
            owner, _, name = m[2].rpartition(".")
            yield (f"{owner}#{name}", *here(m.start(2)), True, -1)
        else:
            types[m[2].rpartition(".")[2]] = m[2]
            yield (m[2], *here(m.start(2)), False, -1)
    known: dict[str, set[str]] = {}
    for m in re.finditer(r"\b([A-Z]\w*)(?:<[^<>;]*>)?\s+([a-z_]\w*)\s*(?=[=;,)])", src):
        known.setdefault(m[2], set()).add(types.get(m[1], ""))
    for m in re.finditer(r"\b([A-Za-z_]\w*)\s*\.\s*([A-Za-z_]\w*)\s*(\()?", src):
        held = known.get(m[1])
        fqn = next(iter(held)) if held and len(held) == 1 else types.get(m[1], "") if not held else ""
        if fqn:
            yield (f"{fqn}#{m[2]}", *here(m.start(2)), True, _arguments(src, m.start(3)) if m[3] else -1)
    for m in re.finditer(r"\bnew\s+([A-Z]\w*)\s*(?:<[^<>]*>)?\s*(\()", src):
        if m[1] in types:
            yield (f"{types[m[1]]}#{m[1]}", *here(m.start(1)), True, _arguments(src, m.start(2)))
    if roots:
        for m in re.finditer(r"(?<![\w.])((?:" + "|".join(re.escape(r.rstrip(".:")) for r in roots) + r")(?:\.[a-z_]\w*)*\.[A-Z]\w*)", src):
            if not re.match(r"[ \t]*(import|package)\b", src[src.rfind("\n", 0, m.start()) + 1 :]):
                yield (m[1], *here(m.start()), False, -1)


def cpp_refs(code: str, roots: tuple[str, ...]) -> Iterator[Ref]:
    src = blank(code)
    for m in re.finditer(r"(?<![\w:])([A-Za-z_]\w*(?:::[A-Za-z_]\w*)+)\s*(\()?", src):
        parts = m[1].split("::")
        at = next((i for i, p in enumerate(parts) if p[0].isupper()), None)
        if parts[0] in {r.rstrip(":") for r in roots} and at is not None:
            place = (src.count("\n", 0, m.start()) + 1, m.start() - src.rfind("\n", 0, m.start()))
            owner = "::".join(parts[: at + 1])
            yield (owner, *place, False, -1)
            if at + 1 < len(parts):
                yield (f"{owner}#{parts[at + 1]}", *place, True, _arguments(src, m.start(2)) if m[2] else -1)


def python_refs(code: str, roots: tuple[str, ...]) -> Iterator[Ref]:
    tree = ast.parse(code)
    heads = {r.rstrip(".") for r in roots}
    names: dict[str, str] = {}
    vars_: dict[str, set[str]] = {}

    def dotted(n) -> str:
        if isinstance(n, ast.Name):
            return names.get(n.id, n.id)
        return f"{dotted(n.value)}.{n.attr}" if isinstance(n, ast.Attribute) else "?"

    for n in ast.walk(tree):
        if isinstance(n, ast.ImportFrom) and n.module and n.module.split(".")[0] in heads:
            for a in n.names:
                if a.name != "*":
                    names[a.asname or a.name] = f"{n.module}.{a.name}"
                    yield (f"{n.module}.{a.name}", n.lineno, n.col_offset + 1, False, -1)
        elif isinstance(n, ast.Import):
            names |= {a.asname: a.name for a in n.names if a.asname and a.name.split(".")[0] in heads}
    for n in ast.walk(tree):
        if isinstance(n, (ast.Assign, ast.AnnAssign)) and isinstance(n.value, ast.Call):
            for t in n.targets if isinstance(n, ast.Assign) else [n.target]:
                vars_.setdefault(ast.unparse(t), set()).add(dotted(n.value.func))
    calls = {id(n.func): len(n.args) + len(n.keywords) for n in ast.walk(tree) if isinstance(n, ast.Call)}
    for n in ast.walk(tree):
        if not isinstance(n, ast.Attribute):
            continue
        held = vars_.get(ast.unparse(n.value))
        owner = next(iter(held)) if held and len(held) == 1 else dotted(n.value)
        last = owner.rpartition(".")[2]
        if owner.split(".")[0] in heads:
            if last[:1].isupper() and not n.attr.startswith("_"):
                yield (f"{owner}#{n.attr}", n.lineno, n.col_offset + 1, True, calls.get(id(n), -1))
            elif n.attr[:1].isupper():
                yield (f"{owner}.{n.attr}", n.lineno, n.col_offset + 1, False, -1)


PARSERS = {"java": java_refs, "cpp": cpp_refs, "python": python_refs}


def references(files: DataFrame, path: str, code: str, language: str, roots: list[str]) -> DataFrame:
    """REFS of every file (columns path, code and its language), each symbol where it comes first. ``roots`` are the
    packages, namespaces or modules that are indexed. Files that can't be parsed, null and empty ones give none."""
    ship(files.sparkSession)
    r = tuple(roots)

    def run(frames):
        for pdf in frames:
            rows = []
            for p, text, lang in pdf.itertuples(index=False, name=None):
                seen = set()
                try:
                    found = sorted(PARSERS[lang](text or "", r), key=lambda x: x[1:3]) if lang in PARSERS else []
                except (SyntaxError, ValueError, RecursionError):
                    found = []
                for x in found:
                    if x[0] not in seen:
                        seen.add(x[0])
                        rows.append((p, *x))
            yield pd.DataFrame(rows, columns=["path", "symbol", "line", "col", "member", "args"])

    return files.select(F.col(path).alias("p"), F.col(code).alias("c"), F.col(language).alias("l")).mapInPandas(run, REFS)


def arity(signature) -> tuple:
    """(least, most) arguments of a signature as columns; most is null for variable ones, both null if there are none."""
    inner = F.regexp_extract(signature, r"\((.*)\)", 1)
    flat = F.regexp_replace(F.regexp_replace(inner, r"<[^<>]*>", ""), r"\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}", "")
    parts = F.filter(F.transform(F.split(flat, ","), lambda x: F.trim(x)), lambda x: (x != "") & ~x.isin("self", "/", "*"))
    varies = F.exists(parts, lambda x: x.contains("...") | x.startswith("*"))
    least = F.size(F.filter(parts, lambda x: ~x.contains("=") & ~x.contains("...") & ~x.startswith("*")))
    has = signature.contains("(")
    return F.when(has, least), F.when(has & ~varies, F.size(parts))


def verify(refs: DataFrame, symbols: DataFrame, season: str) -> DataFrame:
    """(path, line, col, symbol, severity, what, fix): what is wrong with references in a season.

    A symbol that is there is fine unless all its overloads are deprecated (warning) or none takes that many arguments
    (warning; nothing is said if a signature can't be read). One of another season only is an error if a counterpart is
    known, else a warning for a type; of a member that may be inherited nothing is said unless another season has it. What
    no season knows is information. A table of types without this season says nothing.
    """
    s = symbols.select("fqn", "season", "signature", "deprecated_in", "replacement")
    least, most = arity(F.col("signature"))
    own = s.filter(F.col("season") == season).select("fqn", F.coalesce("deprecated_in", F.lit("")).alias("gone"), F.nullif("replacement", F.lit("")).alias("to"), least.alias("least"), most.alias("most"), F.col("signature").contains("...").alias("open"))
    r = refs.select("path", "line", "col", "member", "args", F.col("symbol").alias("fqn"))
    fits = F.col("least").isNull() | (F.col("args") < 0) | ((F.col("args") >= F.col("least")) & (F.col("most").isNull() | (F.col("args") <= F.col("most"))))
    here = r.join(own, "fqn", "left").groupBy("path", "line", "col", "member", "args", "fqn").agg(
        F.bool_or(F.col("gone").isNotNull()).alias("there"), F.bool_and(F.col("gone") != "").alias("deprecated"), F.max("to").alias("to"), F.bool_or(fits).alias("fits")
    )
    other = s.filter(F.col("season") != season).groupBy("fqn").agg(F.max_by(F.nullif("replacement", F.lit("")), "season").alias("moved"), F.max("season").alias("seen"))
    rows = here.join(other, "fqn", "left")
    target = s.filter(F.col("season") == season).select(F.col("fqn").alias("moved")).distinct().withColumn("target", F.lit(True))
    rows = rows.join(target, "moved", "left")
    there = F.coalesce("there", F.lit(False))
    what = (
        F.when(there & F.coalesce("deprecated", F.lit(False)), "deprecated")
        .when(there & F.col("member") & ~F.coalesce("fits", F.lit(True)), "arguments")
        .when(there, None)
        .when(F.col("seen").isNotNull() & F.col("target"), "moved")
        .when(F.col("seen").isNotNull(), "other_season")
        .when(F.col("member"), None)
        .otherwise("unknown")
    )
    severity = F.when(F.col("what").isin("deprecated", "arguments"), "warning").when(F.col("what") == "moved", "error").when(F.col("what") == "other_season", F.when(F.col("member"), "error").otherwise("warning")).otherwise("info")
    found = rows.withColumn("what", what).filter("what IS NOT NULL")
    return found.select("path", "line", "col", F.col("fqn").alias("symbol"), severity.alias("severity"), "what", F.when(F.col("what") == "moved", F.col("moved")).when(F.col("what") == "deprecated", F.col("to")).alias("fix"))


def capped(findings: DataFrame, installed: DataFrame, symbols: DataFrame) -> DataFrame:
    """Errors about a library whose installed version (library, version) isn't the indexed one are warnings."""
    indexed = symbols.select("library", "version", F.col("fqn").alias("symbol")).distinct()
    own = installed.select("library", F.col("version").alias("installed"))
    skew = indexed.join(own, "library").filter(V.version_key(F.col("version")) != V.version_key(F.col("installed"))).select("symbol").distinct().withColumn("skew", F.lit(True))
    return findings.join(skew, "symbol", "left").withColumn("severity", F.when(F.col("skew") & (F.col("severity") == "error"), "warning").otherwise(F.col("severity"))).drop("skew")


def summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("path").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.count_if(F.col("severity") == "info").alias("notes"))


def migrate(refs: DataFrame, symbols: DataFrame, rules: DataFrame, start: str, target: str) -> DataFrame:
    """(path, line, symbol, to, via): where each reference goes from one season to another, hop by hop; what doesn't
    change is left out."""
    from pinfold.operators.symbols import hops

    seasons = sorted(x[0] for x in symbols.select("season").distinct().collect() if x[0] and start <= x[0] <= target)
    seasons = [start, *[x for x in seasons if start < x < target], target]
    r = F.nullif(F.trim("replacement"), F.lit(""))
    rule = rules.select(F.col("from_season").alias("season"), F.col("from_fqn").alias("fqn"), F.nullif("to_fqn", F.lit("")).alias("curated"))
    table = symbols.select("season", "fqn", r.alias("replacement")).join(rule, ["season", "fqn"], "full")
    names = refs.select(F.col("symbol").alias("start"), F.col("symbol").alias("fqn")).distinct()
    last = hops(names, table.select("season", "fqn", "curated", "replacement"), seasons).filter(F.col("season") == target)
    return refs.join(last.withColumnRenamed("start", "symbol"), "symbol").filter("fqn <> symbol OR via = 'unresolved'").select("path", "line", "symbol", F.col("fqn").alias("to"), "via")


def first_per_line(refs: DataFrame) -> DataFrame:
    w = Window.partitionBy("path", "line").orderBy("col", "symbol")
    return refs.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def owners(refs: DataFrame) -> DataFrame:
    return refs.select("path", N.owner_name(F.col("symbol")).alias("owner")).filter("owner <> ''").distinct()
