"""API elements out of generated pages, headers and stubs, and measured parts out of source files.

Every parser takes one file's text and gives rows (fqn, kind, signature, summary, deprecated, replacement, bases); the
reader runs it over a table of files in vectorized Python.
"""

from __future__ import annotations

import ast
import html as _html
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pinfold.session import ship

Row = tuple[str, str, str, str, bool, str, list[str]]
ROW = "path string, fqn string, kind string, signature string, summary string, deprecated boolean, replacement string, bases array<string>"


def read(files: DataFrame, path: str, text: str, parser: Callable[[str, str], Iterator[Row]]) -> DataFrame:
    """ROW of every file. A file that the parser can't read gives no rows; null and empty files neither."""
    ship(files.sparkSession)

    def run(frames):
        for pdf in frames:
            rows = []
            for p, body in pdf.itertuples(index=False, name=None):
                try:
                    rows += [(p, *r) for r in parser(p or "", body or "")]
                except (SyntaxError, ValueError, RecursionError):
                    continue
            yield pd.DataFrame(rows, columns=["path", "fqn", "kind", "signature", "summary", "deprecated", "replacement", "bases"])

    return files.select(F.col(path).alias("p"), F.col(text).alias("t")).mapInPandas(run, ROW)


def _sentence(s: str) -> str:
    s = re.sub(r"\s+", " ", s).strip()
    m = re.match(r"(.*?\.)(?: |$)", s)
    return (m[1] if m else s)[:320]


def python_stub(path: str, text: str) -> Iterator[Row]:
    """Classes, members, overloads and functions of a Python module or stub; the module's name comes from its path."""
    module = re.sub(r"(/__init__)?\.pyi?$", "", path).strip("/").replace("/", ".")
    tree = ast.parse(text)

    def note(node) -> tuple[str, bool, str]:
        doc = ast.get_docstring(node) or ""
        dep = any("deprecated" in ast.unparse(d) for d in getattr(node, "decorator_list", [])) or bool(re.search(r"(?i)\bdeprecated\b", doc))
        m = re.search(r"(?i)use :?\w*:?`?~?([\w.]+)`? instead", doc)
        return _sentence(doc), dep, m[1] if m else ""

    def function(node, owner: str, inside: bool) -> Row:
        text, dep, repl = note(node)
        sig = f"def {node.name}({ast.unparse(node.args)})" + (f" -> {ast.unparse(node.returns)}" if node.returns else "")
        kind = "constructor" if node.name == "__init__" else "method" if inside else "function"
        return (f"{owner}{'#' if inside else '.'}{node.name}", kind, sig, text, dep, repl, [])

    def walk(body, owner: str) -> Iterator[Row]:
        for n in body:
            if isinstance(n, ast.ClassDef):
                text, dep, repl = note(n)
                bases = [ast.unparse(b) for b in n.bases]
                name = f"{owner}.{n.name}"
                yield (name, "class", f"class {n.name}" + (f"({', '.join(bases)})" if bases else ""), text, dep, repl, bases)
                for m in n.body:
                    if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef)) and (not m.name.startswith("_") or m.name == "__init__"):
                        yield function(m, name, True)
                    elif isinstance(m, ast.AnnAssign) and isinstance(m.target, ast.Name):
                        yield (f"{name}#{m.target.id}", "field", f"{m.target.id}: {ast.unparse(m.annotation)}", "", False, "", [])
                yield from walk([c for c in n.body if isinstance(c, ast.ClassDef)], name)
            elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) and not n.name.startswith("_"):
                yield function(n, owner, False)

    yield from walk(tree.body, module)


def _plain(s: str) -> str:
    return re.sub(r"\s+", " ", _html.unescape(re.sub(r"<[^>]+>", "", s))).replace("\xa0", " ").replace("​", "").strip()


def javadoc(path: str, text: str) -> Iterator[Row]:
    """A class page: the type with what it extends, and its members with deprecation and replacement."""
    pkg = _plain(m[1]) if (m := re.search(r'class="sub-title"[^>]*>.*?Package.*?<a[^>]*>(.*?)</a>', text, re.S)) else ""
    head = re.search(r'<h1[^>]*class="title"[^>]*>(?:Class|Interface|Enum(?: Class)?|Record(?: Class)?|Annotation Interface)\s+(.*?)</h1>', text, re.S)
    if not head:
        return
    name = re.sub(r"<.*", "", _plain(head[1]))
    fqn = f"{pkg}.{name}" if pkg else name
    sig = _plain(m[1]) if (m := re.search(r'class="type-signature"[^>]*>(.*?)</div>', text, re.S)) else f"class {name}"
    kind = "interface" if re.search(r"\binterface\b", sig) else "enum" if re.search(r"\benum\b", sig) else "class"

    def dep(block: str) -> tuple[bool, str]:
        d = re.search(r'class="deprecation-(?:block|comment)"[^>]*>(.*?)</div>\s*(?:</div>)?', block, re.S)
        code = d and re.search(r"<code>(.*?)</code>", d[1], re.S)
        return bool(d), _plain(code[1]) if code else ""

    def doc(block: str) -> str:
        m = re.search(r'<div class="block">(.*?)</div>', block, re.S)
        return _sentence(_plain(m[1])) if m else ""

    intro = text[head.end() :].split('<section class="detail"', 1)[0]
    gone, to = dep(intro.split('class="summary"', 1)[0])
    bases = [b.strip() for m in re.finditer(r"\b(?:extends|implements)\s+([\w.<>, ]+?)(?=\s+(?:implements|permits)\b|$)", sig) for b in re.sub(r"<[^>]*>", "", m[1]).split(",")]
    yield (fqn, kind, sig, doc(intro), gone, to, bases)
    for block in text.split('<section class="detail"')[1:]:
        member = re.search(r"<h3>(.*?)</h3>", block, re.S)
        s = re.search(r'class="member-signature"[^>]*>(.*?)</div>', block, re.S)
        if member and s:
            own = _plain(member[1])
            gone, to = dep(block)
            line = _plain(s[1])
            yield (f"{fqn}#{own}", "constructor" if own == name else "method" if "(" in line else "field", line, doc(block), gone, to, [])


def doxygen(path: str, text: str) -> Iterator[Row]:
    """A class page of C++ documentation: the class, its bases, its members."""
    head = re.search(r'<div class="title">\s*([\w:]+)(?:&lt;.*?)?\s+(Class|Struct)(?: Template)? Reference', text, re.S)
    if not head:
        return
    fqn = head[1]
    bases = [_plain(x) for m in re.finditer(r"Inherits\s+(.*?)\.</p>", text, re.S) for x in re.split(r",| and ", m[1]) if _plain(x)]
    brief = re.search(r'<div class="contents">.*?<p>(.*?)</p>', text, re.S)
    yield (fqn, "class", f"{head[2].lower()} {fqn}" + (f" : {', '.join(bases)}" if bases else ""), _sentence(_plain(brief[1])) if brief else "", "deprecated" in text.split('class="memitem"', 1)[0].lower(), "", bases)
    for block in text.split('class="memitem"')[1:]:
        m = re.search(r'<table class="memname">(.*?)</table>', block, re.S)
        if not m:
            continue
        line = re.sub(r"\s*([(),])\s*", r"\1", _plain(m[1])).replace(",", ", ")
        own = re.search(r"([~\w]+|operator\W+)\s*(?:\(|$)", line.split(fqn + "::", 1)[-1])
        if own:
            d = re.search(r'class="deprecated".*?<dd>(.*?)</dd>', block, re.S)
            link = d and re.search(r"<a[^>]*>(.*?)</a>", d[1], re.S)
            doc = re.search(r'<div class="memdoc">\s*<p>(.*?)</p>', block, re.S)
            name = own[1].strip()
            yield (f"{fqn}#{name}", "constructor" if name == fqn.rsplit("::", 1)[-1] else "method" if "(" in line else "field", line, _sentence(_plain(doc[1])) if doc else "", bool(d), _plain(link[1]) if link else "", [])


_CPP = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|[A-Za-z_]\w*|::|->|\d[\w.']*|\S", re.S)


def cpp_header(path: str, text: str) -> Iterator[Row]:
    """Namespaces, classes, public members and free functions of a header, by one pass over its tokens.

    Bodies, private parts, macros and templates' parameters are skipped; a declaration keeps the comment before it.
    """
    toks: list[tuple[str, str]] = []
    comment = ""
    for m in _CPP.finditer(re.sub(r"(?m)^[ \t]*#(?:[^\n\\]|\\.|\\\n)*", "", text)):
        t = m[0]
        if t.startswith(("//", "/*")):
            comment = t if t.startswith("/*") else f"{comment}\n{t}" if comment.startswith("//") else t
            continue
        toks.append((t, comment))
        comment = ""
    n = len(toks)

    def skip(i: int, a: str, b: str) -> int:
        depth = 0
        while i < n:
            depth += (toks[i][0] == a) - (toks[i][0] == b)
            i += 1
            if not depth:
                return i
        return n

    def note(c: str) -> tuple[str, bool, str]:
        body = re.sub(r"(?m)^\s*(?:/\*\*?|\*/|\*|//[/!]?<?)\s?|\*/\s*$", "", c).strip()
        d = re.search(r"[@\\]deprecated\s+(.*?)(?=\n\s*\n|[@\\]\w|\Z)", body, re.S)
        use = re.search(r"[Uu]se\s+([\w:~]+)", d[1]) if d else None
        brief = re.split(r"[@\\](?:param|return|deprecated|see|tparam|throws)\b", body, maxsplit=1)[0]
        return _sentence(re.sub(r"[@\\](?:brief|ref)\s+", "", brief)), bool(d), use[1] if use else ""

    def scan(i: int, scope: list[str], cls: str, public: bool) -> Iterator[Row | int]:
        start, said = i, ""
        while i < n:
            t, c = toks[i]
            said = c or said
            if t == "}":
                yield i + 1
                return
            if t == ";":
                words = [x for x, _ in toks[start:i]]
                if public and "(" in words and words[0] not in ("using", "typedef", "friend", "static_assert", "return"):
                    yield from declaration(words, scope, cls, said)
                elif cls and public and words and words[0] not in ("using", "typedef", "friend", "enum", "class", "struct"):
                    names = [x for x in words if re.fullmatch(r"[A-Za-z_]\w*", x)]
                    cut = words.index("=") if "=" in words else words.index("{") if "{" in words else len(words)
                    names = [x for x in words[:cut] if re.fullmatch(r"[A-Za-z_]\w*", x)]
                    if len(names) > 1:
                        yield ("::".join(scope) + f"#{names[-1]}", "field", " ".join(words[:cut]), *note(said), [])
                i += 1
                start, said = i, ""
            elif t in ("public", "protected", "private") and cls and i + 1 < n and toks[i + 1][0] == ":":
                public = t == "public"
                i += 2
                start, said = i, ""
            elif t == "namespace" and i == start:
                j = i + 1
                name = []
                while j < n and toks[j][0] not in ("{", ";", "="):
                    name.append(toks[j][0])
                    j += 1
                if j < n and toks[j][0] == "{":
                    for r in scan(j + 1, [*scope, *[x for x in name if x not in ("::", "inline")]], "", True):
                        if isinstance(r, int):
                            j = r
                        else:
                            yield r
                i = start = j if j > i + 1 else j + 1
                said = ""
            elif t == "template" and i + 1 < n and toks[i + 1][0] == "<":
                i = skip(i + 1, "<", ">")
            elif t == "enum" and i == start:
                while i < n and toks[i][0] not in ("{", ";"):
                    i += 1
                if i < n and toks[i][0] == "{":
                    i = skip(i, "{", "}")
            elif t in ("class", "struct") and i == start or t in ("class", "struct") and toks[i - 1][0] in (">", "typedef"):
                j = i + 1
                head = []
                while j < n and toks[j][0] not in ("{", ";", "("):
                    head.append(toks[j][0])
                    j += 1
                if j < n and toks[j][0] == "{":
                    cut = head.index(":") if ":" in head else len(head)
                    names = [x for x in head[:cut] if re.fullmatch(r"[A-Za-z_]\w*", x) and x not in ("final", "alignas")]
                    name = names[-1] if names else ""
                    bases = [b.strip() for b in re.sub(r"<[^<>]*>", "", " ".join(x for x in head[cut + 1 :] if x not in ("public", "protected", "private", "virtual"))).replace(" :: ", "::").split(",") if b.strip()]
                    inner = [*scope, name]
                    if public and name:
                        yield ("::".join(inner), "class", f"{t} {name}" + (f" : {', '.join(bases)}" if bases else ""), *note(said), bases)
                    for r in scan(j + 1, inner, name, t == "struct"):
                        if isinstance(r, int):
                            j = r
                        elif public:
                            yield r
                    i = start = j
                    said = ""
                else:
                    i = j
            elif t == "{":
                words = [x for x, _ in toks[start:i]]
                if public and "(" in words:
                    yield from declaration(words, scope, cls, said)
                i = skip(i, "{", "}")
                if "(" in words or not words:
                    start, said = i, ""
            elif t == "(":
                i = skip(i, "(", ")")
            else:
                i += 1

    def declaration(words: list[str], scope: list[str], cls: str, said: str) -> Iterator[Row]:
        k = words.index("(")
        if not k or not re.fullmatch(r"[A-Za-z_]\w*", words[k - 1]) or words[k - 1] in ("if", "for", "while", "switch"):
            return
        name = ("~" if k > 1 and words[k - 2] == "~" else "") + words[k - 1]
        depth, end = 0, k
        for end in range(k, len(words)):
            depth += (words[end] == "(") - (words[end] == ")")
            if not depth:
                break
        text_ = " ".join(words[: end + 1])
        text_ = re.sub(r"\s*(::|[(),&*<>])\s*", r"\1", text_).replace(",", ", ")
        owner = "::".join(scope)
        kind = ("constructor" if name == cls else "method") if cls else "function"
        summary, dep, to = note(said)
        yield (f"{owner}#{name}" if cls else f"{owner}::{name}" if owner else name, kind, text_, summary, dep or "deprecated" in words, to, [])

    i = 0
    while i < n:
        was = i
        for r in scan(i, [], "", True):
            if isinstance(r, int):
                i = r
            else:
                yield r
        if i == was:
            break


def wheel_rank(name: Column) -> Column:
    """How good a wheel's platform is: pure, then common Linux, then any; null for what is no wheel."""
    return F.when(~name.endswith(".whl"), None).when(name.endswith("-none-any.whl"), 0).when(name.rlike("manylinux.*x86_64"), 1).otherwise(2)


def best_wheel(files: DataFrame, package: str, name: str) -> DataFrame:
    """The best wheel of each package, ties by name."""
    return files.withColumn("__r", wheel_rank(F.col(name))).filter("__r IS NOT NULL").groupBy(package).agg(F.min_by(name, F.struct("__r", name)).alias(name))


def motors(files: DataFrame, text: str) -> DataFrame:
    """(part, fields) of motor constants in Java source: get<Name>(…) { return new DCMotor(v, nm, a, a, rpm …) }."""
    pattern = r"(?s)static\s+DCMotor\s+get(\w+)\s*\([^)]*\)\s*\{.*?new\s+DCMotor\(\s*([-\d.]+)\s*,\s*([-\d.]+)\s*,\s*([-\d.]+)\s*,\s*([-\d.]+)\s*,[^;]*?([-\d.]+)\s*\)"
    names = ["nominal_v", "stall_torque_nm", "stall_current_a", "free_current_a", "free_speed_rpm"]
    found = files.select(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.struct(*[F.regexp_extract(x, pattern, i).alias(f"g{i}") for i in range(1, 7)])).alias("m"))
    rows = found.select(F.explode("m").alias("m")).select("m.*")
    cells = [x for i, n in enumerate(names, 2) for x in (F.lit(n), F.col(f"g{i}").cast("double"))]
    return rows.select(F.col("g1").alias("part"), F.create_map(*cells).alias("fields"))
