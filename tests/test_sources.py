"""Loaders and parsers on small inputs written by hand."""

import json

import pytest
from pyspark.sql import functions as F

from pinfold.sources import apis as A, documents as D, files as L


def _df(spark, *texts):
    return spark.createDataFrame([(f"u{i}", t) for i, t in enumerate(texts)], "path string, text string")


def test_json_lines_skip_comments_and_fail_on_rubbish(spark, tmp_path):
    good = tmp_path / "a.jsonl"
    good.write_text('// comment\n\n{"a": 1, "b": "x"}\n{"a": 2}\n')
    assert [tuple(r) for r in L.json_lines(spark, str(good), "a int, b string").collect()] == [(1, "x"), (2, None)]
    bad = tmp_path / "b.jsonl"
    bad.write_text("{rubbish\n")
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        L.json_lines(spark, str(bad), "a int").collect()


def test_judged_queries_need_unique_ids(spark, tmp_path):
    p = tmp_path / "q.jsonl"
    p.write_text('{"id": "1", "query": "q", "relevant": ["d"]}\n{"id": "1", "query": "r", "relevant": ["d"]}\n')
    with pytest.raises(ValueError):
        L.judged_queries(spark, str(p))


def test_publish_swaps_versions_and_reports_what_is_missing(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    one = L.publish({"t": spark.range(2)}, root)
    two = L.publish({"t": spark.range(5)}, root)
    found, errors = L.published(spark, root, ["t", "gone"])
    assert one != two and found["t"].count() == 5 and list(errors) == ["gone"]


def test_counters_as_text(spark):
    df = spark.createDataFrame([("a", 'x"y', 3)], "m string, t string, n int")
    assert L.prometheus(df, "requests_total", ["m", "t"], "n").first()[0] == 'requests_total{m="a",t="x\\"y"} 3'


def test_rules_are_checked_and_exploded(spark):
    rule = {"id": "move-x", "library": "l", "kind": "renamed", "from_season": "2026", "to_season": "2027", "from": {"java": "a.X", "cpp": "a::X"}, "to": {"java": "b.X"}, "citation": "https://x.example"}
    assert [(r.language, r.to_fqn) for r in L.explode_rules(spark, [rule]).orderBy("language").collect()] == [("cpp", ""), ("java", "b.X")]
    for broken in ({"id": "Bad Id"}, {"to_season": "2025"}, {"citation": "http://x"}, {"to": {"python": "z"}}, {"to": {}}):
        with pytest.raises(ValueError):
            L.explode_rules(spark, [rule | broken])


PAGE = """---
title: x
---
import Tabs from 'tabs'

# Top

intro

=== "Java"
```
int a;
```
=== "Python"
```python
a = 1
```

## Sub *one*

!!! note
text
"""


def test_markdown_sections_by_language(spark):
    got = [(r.ord, r.heading_path, r.language, r.text) for r in D.page_sections(_df(spark, PAGE, None, ""), "path", "text").orderBy("ord").collect()]
    assert [(o, h, lang) for o, h, lang, _ in got] == [(0, "Top", "java"), (1, "Top", "python"), (2, "Top › Sub one", "any")]
    assert "int a;" in got[0][3] and "a = 1" not in got[0][3] and "intro" in got[1][3] and "**Note**" in got[2][3] and "title:" not in got[0][3]


def test_html_leaves_out_what_is_hidden(spark):
    page = '<html><head><title>t</title></head><body><!-- secret --><h1>Top</h1><p style="display: none">no</p><div hidden>no</div><p>yes <code>f()</code></p><pre class="language-java">int a;</pre><script>no</script></body></html>'
    (r,) = D.page_sections(_df(spark, page), "path", "text", "html").collect()
    assert r.heading_path == "Top" and r.language == "java" and "yes `f()`" in r.text and "no" not in r.text and "secret" not in r.text


def test_listing_links(spark):
    text = "[a](https://h.example/docs/b) [b](https://h.example/docs/a) [c](https://other.example/docs/c) [d](https://h.example/blog) [a](https://h.example/docs/b)"
    assert _df(spark, text).select(D.listing_links(F.col("text"), "h.example", "/docs/")).first()[0] == ["https://h.example/docs/a", "https://h.example/docs/b"]


def test_releases(spark):
    row = lambda tag, **k: {"tag_name": tag, "name": tag, "body": "Removed x\n\nmore", "draft": False, "prerelease": False, "published_at": "2026-01-02T03:04:05Z", "html_url": "https://x.example"} | k
    rows = [row("v2026.1.1"), row("v2026.1.2", draft=True), row("v2026.2.0-beta-1"), row("v2024.1.1"), row("v2026.3.0", published_at="never"), row("v2026.4.0", html_url="http://x")]
    got = [(r.version, r.season, r.channel, r.breaking) for r in D.releases(_df(spark, json.dumps(rows)), "lib", "text").orderBy("version").collect()]
    assert got == [("2026.1.1", "2026", "stable", True), ("2026.2.0-beta-1", "2026", "beta", True)]


def test_catalog_files(spark):
    c = {"name": "N", "uuid": "u", "version": "1", "frcYear": "2026", "jsonUrl": "http://x", "javaDependencies": [{}, {}], "conflictsWith": [{"uuid": "w"}]}
    got = D.catalog(_df(spark, json.dumps(c), json.dumps({"name": "N"}), "rubbish", None), "text").collect()
    assert [(r.uuid, r.season, r.json_url, r.java_deps, r.cpp_deps, r.conflicts[0].uuid) for r in got] == [("u", "2026", "", 2, 0, "w")]


def test_feeds_keep_replies_of_kept_topics(spark):
    item = lambda kind, topic, post, cat, when="Fri, 02 Jan 2026 03:04:05 +0000": f"<item><guid>h-{kind}-{topic}-{post}</guid><category>{cat}</category><title><![CDATA[T & U]]></title><link>https://h.example/t/x/{topic}/{post}</link><pubDate>{when}</pubDate><description>&lt;p&gt;d&lt;/p&gt;</description></item>"
    feed = "<rss>" + item("topic", 1, 1, "java") + item("topic", 2, 1, "fun") + item("post", 1, 2, "") + item("post", 2, 2, "") + item("post", 1, 3, "", "no date") + item("topic", 1, 1, "java") + "</rss>"
    items = D.feed_items(_df(spark, feed, None), "text", "h.example")
    topics, replies = D.kept_replies(items, ["java"])
    assert [(r.topic, r.title, r.html) for r in topics.collect()] == [(1, "T & U", "<p>d</p>")] and [(r.topic, r.post) for r in replies.collect()] == [(1, 2)]


def _api(spark, parser, *texts):
    return {r.fqn: r for r in A.read(_df(spark, *texts), "path", "text", parser).collect()}


def test_python_stub(spark):
    text = '''
class Motor(Base):
    """Drives. More."""
    speed: float
    def __init__(self, port: int) -> None: ...
    def set(self, v: float) -> None:
        """Deprecated. Use :meth:`drive` instead."""
    def _own(self): ...
def free(a, b=1): ...
'''
    got = _api(spark, A.python_stub, text, "class Broken(", None)
    assert set(got) == {"u0.Motor", "u0.Motor#speed", "u0.Motor#__init__", "u0.Motor#set", "u0.free"}
    assert got["u0.Motor"].bases == ["Base"] and got["u0.Motor"].summary == "Drives." and got["u0.Motor#set"].deprecated and got["u0.Motor#set"].replacement == "drive"


def test_javadoc(spark):
    page = """<div class="sub-title"><span>Package</span>&nbsp;<a href="x">a.b</a></div><h1 class="title">Class Motor&lt;T&gt;</h1>
<div class="type-signature">public class <b>Motor</b> extends Base&lt;T&gt; implements Runnable</div><div class="deprecation-block">Deprecated. use <code>New</code></div><div class="block">Drives it. And more.</div>
<section class="detail" id="x"><h3>set</h3><div class="member-signature">public void set(double v)</div><div class="block">Sets.</div></section>
<section class="detail"><h3>kMax</h3><div class="member-signature">public static final int kMax</div></section>"""
    got = _api(spark, A.javadoc, page, "<p>nothing</p>")
    assert set(got) == {"a.b.Motor", "a.b.Motor#set", "a.b.Motor#kMax"}
    t = got["a.b.Motor"]
    assert t.deprecated and t.replacement == "New" and t.bases == ["Base", "Runnable"] and t.summary == "Drives it." and got["a.b.Motor#kMax"].kind == "field"


def test_doxygen(spark):
    page = """<div class="title">ns::Motor Class Reference</div><div class="contents"><p>Drives.</p><p>Inherits <a>ns::Base</a>.</p>
<div class="memitem"><table class="memname"><tr><td>void ns::Motor::Set</td><td>(</td><td>double v</td><td>)</td></tr></table><div class="memdoc"><p>Sets.</p><dl class="deprecated"><dd>Use <a>Drive()</a>.</dd></dl></div></div></div>"""
    got = _api(spark, A.doxygen, page)
    assert got["ns::Motor"].bases == ["ns::Base"] and got["ns::Motor#Set"].deprecated and got["ns::Motor#Set"].replacement == "Drive()"


def test_cpp_header(spark):
    text = """
#pragma once
#define X(a) \\
  a
namespace ns::inner {
/** Drives. Slowly. */
class Motor final : public Base<int>, private Other {
 public:
  explicit Motor(int port) : m_port{port} { run(); }
  /// Sets it. @deprecated Use Drive instead.
  virtual void Set(double v, std::vector<int> xs = {}) = 0;
  static constexpr int kMax = 3;
 private:
  void Hidden();
  int m_port;
};
template <typename T> T Free(const T& x) { return x; }
enum class Mode { kA, kB };
struct Plain { int a; };
}
"""
    got = _api(spark, A.cpp_header, text, "{{{", "class")
    assert {"ns::inner::Motor", "ns::inner::Motor#Motor", "ns::inner::Motor#Set", "ns::inner::Free", "ns::inner::Plain", "ns::inner::Plain#a"} <= set(got)
    assert not any("Hidden" in k or "m_port" in k or "kA" in k for k in got)
    assert got["ns::inner::Motor"].bases == ["Base", "Other"] and got["ns::inner::Motor#Set"].deprecated and got["ns::inner::Motor#Set"].replacement == "Drive"


def test_wheels_and_motors(spark):
    w = spark.createDataFrame([("p", "p-1-cp312-win.whl"), ("p", "p-1-py3-none-any.whl"), ("q", "q-1-manylinux_2_17_x86_64.whl"), ("q", "q-1-mac.whl"), ("p", "p-1.tar.gz")], "package string, file string")
    assert {tuple(r) for r in A.best_wheel(w, "package", "file").collect()} == {("p", "p-1-py3-none-any.whl"), ("q", "q-1-manylinux_2_17_x86_64.whl")}
    src = "public static DCMotor getNEO(int n) {\n return new DCMotor(12, 2.6, 105, 1.8, Units.rotationsPerMinuteToRadiansPerSecond(5676), n);\n}".replace(", n)", ")").replace("(5676)", "5676")
    got = A.motors(_df(spark, src), "text").collect()
    assert [(r.part, r.fields["stall_torque_nm"], r.fields["free_speed_rpm"]) for r in got] == [("NEO", 2.6, 5676.0)]
