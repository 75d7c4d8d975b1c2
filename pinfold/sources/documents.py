"""Pages into sections: Markdown, HTML, feeds, listings. Parsers run in vectorized Python, one page at a time; the rest
are Column expressions."""

from __future__ import annotations

import html as _html
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pinfold.session import ship

SECTION = "url string, ord int, heading_path string, language string, text string"
_HEAD = re.compile(r"^ {0,3}(#{1,6})\s+(.*?)[ #]*$")
_CODE = {"java": "java", "c++": "cpp", "cpp": "cpp", "cxx": "cpp", "cc": "cpp", "h": "cpp", "hpp": "cpp", "python": "python", "py": "python", "python3": "python"}


def normalize(text: str) -> str:
    """Dialects to plain Markdown: front matter, imports and components go; tabs become fences with their language,
    admonitions become bold words."""
    text = re.sub(r"\A---\r?\n.*?\r?\n---\r?\n", "", text.replace("\r\n", "\n"), flags=re.S)
    out, fence, tab = [], False, ""
    for line in text.split("\n"):
        if re.match(r"\s*(```|~~~)", line):
            fence = not fence
            if fence and tab and line.strip() in ("```", "~~~"):
                line = f"```{tab}"
            out.append(line)
            continue
        if fence:
            out.append(line)
            continue
        if re.match(r"\s*(import|export)\s.+from\s+['\"]", line) or re.fullmatch(r"\s*</?[A-Z]\w*[^>]*>\s*|\s*:::\s*|\s*\{%\s*end\w+\s*%\}\s*", line):
            if m := re.search(r"(?:label|title|value)=[\"']([^\"']+)[\"']", line):
                tab = _CODE.get(m[1].strip().lower(), "")
            continue
        if m := re.match(r"\s*(?:===|:::tab)\s+\"?([\w+ ]+)\"?\s*$|\s*\{%\s*tab\s+title=\"([^\"]+)\"\s*%\}", line):
            tab = _CODE.get((m[1] or m[2]).strip().lower(), "")
            continue
        if m := re.match(r"\s*(?:!!!|:::|\{%\s*hint\s+style=\")\s*\"?(\w+)\"?", line):
            out.append(f"**{m[1].capitalize()}**")
            continue
        if _HEAD.match(line):
            tab = ""
        out.append(line)
    return "\n".join(out)


def sections(text: str) -> list[tuple[str, list[tuple[str, str]]]]:
    """(heading path, blocks) of a Markdown page; a block is (language of its code or '', text)."""
    stack: list[tuple[int, str]] = []
    out: list[tuple[str, list[tuple[str, str]]]] = [("", [])]
    held: list[str] = []
    fence = lang = ""

    def flush(language: str = "") -> None:
        if body := "\n".join(held).strip("\n"):
            out[-1][1].append((language, body))
        held.clear()

    for line in text.split("\n"):
        mark = re.match(r" {0,3}(```+|~~~+)\s*([\w+-]*)", line)
        if fence:
            held.append(line)
            if mark and mark[1].startswith(fence) and not mark[2]:
                flush(lang)
                fence = ""
        elif mark:
            flush()
            fence, lang = mark[1], _CODE.get(mark[2].lower(), "")
            held.append(line)
        elif m := _HEAD.match(line):
            flush()
            while stack and stack[-1][0] >= len(m[1]):
                stack.pop()
            stack.append((len(m[1]), re.sub(r"[*_`]|\[([^]]*)\]\([^)]*\)", r"\1", m[2]).strip()))
            out.append((" › ".join(t for _, t in stack), []))
        else:
            held.append(line)
    flush(lang if fence else "")
    return [s for s in out if s[1]]


class _Page(HTMLParser):
    """An HTML page as Markdown; hidden elements and scripts are left out."""

    VOID = {"br", "img", "hr", "meta", "link", "input", "source", "wbr", "col"}
    SKIP = {"script", "style", "template", "noscript", "nav", "head", "svg"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.stack: list[tuple[str, bool]] = []
        self.pre = 0

    def hidden(self) -> bool:
        return bool(self.stack) and self.stack[-1][1]

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        style = (a.get("style") or "").replace(" ", "").lower()
        hide = self.hidden() or tag in self.SKIP or "hidden" in a or "display:none" in style or "visibility:hidden" in style or "font-size:0" in style
        if tag not in self.VOID:
            self.stack.append((tag, hide))
        if hide:
            return
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "pre":
            self.pre += 1
            m = re.search(r"(?:language|lang|highlight)-(\w+\+*)", a.get("class") or "")
            self.out.append(f"\n\n```{m[1] if m else ''}\n")
        elif tag in ("p", "div", "section", "ul", "ol", "table", "article", "blockquote", "dl"):
            self.out.append("\n\n")
        elif tag in ("li", "dd"):
            self.out.append("\n- ")
        elif tag in ("tr", "br", "dt"):
            self.out.append("\n")
        elif tag in ("td", "th"):
            self.out.append(" | ")
        elif tag == "code" and not self.pre:
            self.out.append("`")

    def handle_endtag(self, tag):
        if not any(t == tag for t, _ in self.stack):
            return
        hide = self.hidden()
        while self.stack and self.stack.pop()[0] != tag:
            pass
        if hide:
            return
        if tag == "pre" and self.pre:
            self.pre -= 1
            self.out.append("\n```\n\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6", "p"):
            self.out.append("\n\n")

    def handle_data(self, data):
        if not self.hidden():
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data))


def html_to_markdown(text: str) -> str:
    p = _Page()
    p.feed(re.sub(r"<!--.*?-->", "", text, flags=re.S))
    p.close()
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", "".join(p.out))).strip()


def page_sections(pages: DataFrame, url: str, text: str, kind: str = "markdown") -> DataFrame:
    """(url, ord, heading_path, language, text): each section once per code language in it, 'any' if there is none.

    Null and empty pages give no sections; repeated pages give theirs again.
    """
    ship(pages.sparkSession)

    def run(frames):
        for pdf in frames:
            rows = []
            for u, body in pdf.itertuples(index=False, name=None):
                if not body:
                    continue
                n = 0
                for path, blocks in sections(normalize(body) if kind == "markdown" else html_to_markdown(body)):
                    for lang in sorted({b for b, _ in blocks if b}) or ["any"]:
                        rows.append((u, n, path, lang, "\n\n".join(t for b, t in blocks if b in ("", lang)).strip()))
                        n += 1
            yield pd.DataFrame(rows, columns=["url", "ord", "heading_path", "language", "text"])

    return pages.select(F.col(url).alias("u"), F.col(text).alias("t")).mapInPandas(run, SECTION)


def listing_links(body: Column, host: str, prefix: str) -> Column:
    """Links of a link list to pages of one host under a path, once each, in order."""
    links = F.regexp_extract_all(body, F.lit(r"\]\((https?://[^)\s]+)\)"), F.lit(1))
    own = F.filter(links, lambda x: (F.parse_url(x, F.lit("HOST")) == host) & F.coalesce(F.parse_url(x, F.lit("PATH")).startswith(prefix), F.lit(False)))
    return F.array_sort(F.array_distinct(own))


RELEASE = "array<struct<tag_name:string,name:string,body:string,draft:boolean,prerelease:boolean,published_at:string,html_url:string>>"


def releases(listing: DataFrame, library: str, body: str, tag_prefix: str = "", since: str = "2025") -> DataFrame:
    """(library, version, season, channel, published_at, breaking, title, summary, source_url) of JSON release listings.

    Drafts, other tags, rows without a date or an https address and seasons before ``since`` are left out.
    """
    from pinfold.functions import text as T, versions as V

    r = listing.select(F.explode(F.from_json(body, RELEASE)).alias("r")).select("r.*")
    version = F.regexp_replace(F.expr(f"substring(tag_name, {len(tag_prefix) + 1})"), "^v", "")
    rows = r.filter(~F.coalesce("draft", F.lit(False)) & F.col("tag_name").startswith(tag_prefix) & F.col("html_url").startswith("https://")).withColumn("version", version)
    rows = rows.withColumns({"published": F.try_to_timestamp("published_at"), "season": V.season(F.col("version"))}).filter(F.col("published").isNotNull() & (F.col("season") >= since))
    return rows.select(F.lit(library).alias("library"), "version", "season", V.channel(F.col("version"), F.coalesce("prerelease", F.lit(False))).alias("channel"), F.col("published").alias("published_at"), T.breaking(F.coalesce("body", F.lit(""))).alias("breaking"), F.coalesce("name", "tag_name").alias("title"), T.head_lines(F.coalesce("body", F.lit(""))).alias("summary"), F.col("html_url").alias("source_url"))


CATALOG = "name string, uuid string, version string, frcYear string, fileName string, jsonUrl string, mavenUrls array<string>, conflictsWith array<struct<uuid:string,errorMessage:string,offlineFileName:string>>"


def catalog(files: DataFrame, body: str) -> DataFrame:
    """Catalog rows of JSON files; addresses that aren't https are blanked, files without uuid, name or version are left out."""
    from pinfold.functions import versions as V

    c = files.select(F.from_json(body, CATALOG).alias("c"), F.col(body).alias("raw_json")).select("c.*", "raw_json").filter("uuid <> '' AND name <> '' AND version <> ''")
    year = F.col("frcYear")
    https = F.when(F.col("jsonUrl").startswith("https://"), F.col("jsonUrl")).otherwise("")
    return c.select("uuid", "name", "version", V.declared_season(F.coalesce(year, F.lit(""))).alias("season"), year.alias("frc_year"), F.col("fileName").alias("file_name"), https.alias("json_url"), F.col("mavenUrls").alias("maven_urls"), F.col("conflictsWith").alias("conflicts"), F.coalesce(F.json_array_length(F.get_json_object("raw_json", "$.javaDependencies")), F.lit(0)).alias("java_deps"), F.coalesce(F.json_array_length(F.get_json_object("raw_json", "$.cppDependencies")), F.lit(0)).alias("cpp_deps"), "raw_json")


_ITEM = re.compile(r"<item\b.*?</item>", re.S)


def feed_items(feeds: DataFrame, body: str, host: str) -> DataFrame:
    """(guid, topic, post, category, title, link, published, html) of RSS feeds, each guid once; items of another host,
    without a date or whose id and path disagree are left out."""
    ship(feeds.sparkSession)

    def field(item: str, tag: str) -> str:
        m = re.search(rf"<{tag}\b[^>]*>(.*?)</{tag}>", item, re.S)
        raw = m[1].strip() if m else ""
        return raw[9:-3] if raw.startswith("<![CDATA[") else _html.unescape(raw)

    def run(frames):
        for pdf in frames:
            rows = []
            for (text,) in pdf.itertuples(index=False, name=None):
                for m in _ITEM.finditer(text or ""):
                    link = field(m[0], "link")
                    at = re.fullmatch(rf"https://{re.escape(host)}/t/[^/]+/(\d+)(?:/(\d+))?", link)
                    if at:
                        rows.append((field(m[0], "guid"), int(at[1]), int(at[2] or 1), field(m[0], "category"), field(m[0], "title"), link, field(m[0], "pubDate"), field(m[0], "description")))
            yield pd.DataFrame(rows, columns=["guid", "topic", "post", "category", "title", "link", "published", "html"])

    items = feeds.select(body).mapInPandas(run, "guid string, topic bigint, post bigint, category string, title string, link string, published string, html string")
    dated = items.withColumn("published", F.coalesce(F.try_to_timestamp(F.regexp_replace("published", "^[A-Za-z]{3}, *", ""), F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp("published")))
    agree = F.regexp_extract("guid", r"-(?:topic|post)-(\d+)", 1).cast("bigint")
    ok = dated.filter(F.col("published").isNotNull() & (agree == F.col("topic")))
    from pyspark.sql import Window

    return ok.withColumn("__n", F.row_number().over(Window.partitionBy("guid").orderBy("published", "link"))).filter("__n = 1").drop("__n")


def kept_replies(items: DataFrame, categories: list[str]) -> tuple[DataFrame, DataFrame]:
    """(topics in the categories, replies whose topic was kept)."""
    topics = items.filter((F.col("post") == 1) & F.col("category").isin(categories))
    return topics, items.filter("post > 1").join(topics.select("topic"), "topic", "left_semi")
