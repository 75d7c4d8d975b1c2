"""Names, rules, projects, hardware, the stored index and polite fetching on hand-made rows, edge cases included."""

import datetime as dt

from pyspark.sql import functions as F

from pinfold.operators import hardware as H, projects as J, resolution as R, search as S
from pinfold.streaming import streams

SYM = "library string, language string, season string, fqn string, extra string"
RULE = "rule_id string, library string, language string, kind string, from_season string, to_season string, from_fqn string, to_fqn string"


def _symbols(spark):
    rows = [("l", "java", "1", "a.X", None), ("l", "java", "1", "a.X", "again"), ("l", "java", "1", "b.Y", None), ("l", "java", "1", "c.Y", None), ("l", "java", "2", "n.X", None), ("l", "java", "1", "a.X#m", None), ("l", "java", None, "a.Z", None)]
    return spark.createDataFrame(rows, SYM)


def test_types_packages_and_modules(spark):
    s = _symbols(spark)
    refs = spark.createDataFrame([("a.X", "q", "1"), ("Y", "b", "1"), ("Y", "q", "1"), ("X", "q", "1"), ("z.X", None, "2"), (None, "a", "1"), ("Z", "", "1")], "name string, package string, season string")
    got = {(r.name, r.package): (r.fqn, r.how) for r in R.resolve_types(refs, s).collect()}
    assert got == {("a.X", "q"): ("a.X", "exact"), ("Y", "b"): ("b.Y", "package"), ("Y", "q"): (None, None), ("X", "q"): ("a.X", "unique"), ("z.X", None): ("n.X", "unique"), (None, "a"): (None, None), ("Z", ""): (None, None)}
    p = spark.createDataFrame([("a", "1"), ("a", "2"), ("n", "1"), ("no", "1"), (None, None)], "package string, season string")
    got = {(r.package, r.season): r.severity for r in R.check_packages(p, s, "a.", "2").collect()}
    assert got == {("a", "1"): None, ("a", "2"): "error", ("n", "1"): "warning", ("no", "1"): "info", (None, None): "info"}
    m = spark.createDataFrame([("a.sub.X", "1"), ("a.X", "1"), ("a.X", "2"), (None, "1")], "fqn string, season string")
    assert [tuple(r) for r in R.moved_modules(m, s).collect()] == [("a.sub.X", "1", "a.X", "info")]
    assert R.resolve_types(refs.limit(0), s).count() == 0 and R.check_packages(p, s.limit(0), "a.", "2").filter("severity = 'info'").count() == 5


def test_rules(spark):
    rules = spark.createDataFrame([("1", "l", "java", "rename", "1", "2", "a.X", "n.X"), ("2", "l", "java", "removed", "1", "2", "b.Gone", ""), ("3", "l", "java", "move", "1", "2", "a.X#m", "n.X#m"), ("4", "l", "java", "rename", "1", "2", "b.Y", "n.None"), ("5", "l", "java", "rename", "0", "1", "o.X", "a.X"), ("6", "x", "java", "rename", "1", "2", "p", "q")], RULE)
    declared = spark.createDataFrame([("l", "java", "1"), ("l", "java", "2"), ("x", "java", "1")], "library string, language string, season string")
    got = {r.rule_id: r.verdict for r in R.check_rules(rules, _symbols(spark), declared).collect()}
    assert got == {"1": "ok", "2": "source missing", "3": "target missing", "4": "target missing", "5": "ok", "6": "skipped"}
    refs = spark.createDataFrame([("a.X", "java", "2"), ("a.X", "java", "3"), ("n.X", "java", "1"), ("n.X", "java", "2"), (None, "java", "2")], "fqn string, language string, season string")
    found = {(r.fqn, r.season): (r.rule_id, r.severity, r.use) for r in R.curated_findings(refs, rules.filter("rule_id <> '5'")).collect()}
    assert found == {("a.X", "2"): ("1", "warning", "n.X"), ("a.X", "3"): ("1", "error", "n.X"), ("n.X", "1"): ("1", "warning", "a.X")}
    names = spark.createDataFrame([("a.X",), ("a.X#m",), (None,), ("a.X",)], "fqn string")
    assert sorted((r.fqn, r.rule_id) for r in R.rules_from(names, rules, True).collect()) == [("a.X", "1"), ("a.X", "3"), ("a.X#m", "3")]
    assert [r.rule_id for r in R.rules_to(names, rules).collect()] == ["5"] and R.rules_from(names, rules).count() == 2
    files = spark.createDataFrame([("f", "a.X"), ("g", "a.X"), ("g", "a.X#m")], "path string, fqn string")
    assert [tuple(r) for r in R.member_rules(files, files, rules, "1", "2").collect()] == [("f", "3", "a.X#m", "n.X#m")]


def test_half_precision(spark):
    import numpy as np

    bits = list(range(0, 65536, 7)) + [0x7C00, 0xFC00, 0x8000, 1]
    got = [r[0] for r in spark.createDataFrame([(b,) for b in bits], "b int").select(R.half(F.col("b"))).collect()]
    np.testing.assert_array_equal(np.array(got), np.array(bits, np.uint16).view(np.float16).astype(float))


def test_projects(spark):
    plugin = 'plugins { id "edu.wpi.first.GradleRIO"'
    rows = [
        ("g", "build.gradle", plugin + ' version "2026.1.1" }'), ("g", "vendordeps/a.json", '{"name": "N", "version": "1", "frcYear": 2025}'), ("g", "vendordeps/b.json", "rubbish"), ("g", "vendordeps/sub/c.json", "{}"), ("g", "vendordeps/a.json", '{"name": "N", "version": "1", "frcYear": 2025}'),
        ("s", "build.gradle", plugin + " }"), ("s", "settings.gradle.kts", plugin + ' version "2027.0.0-alpha-2" }'), ("s", "src/main/include/x.h", None),
        ("n", "build.gradle.kts", None), ("p", "pyproject.toml", 'robotpy_version = "2026.2.1.0"\n'), ("none", "readme", "x"), (None, "build.gradle", plugin), ("x", None, plugin),
    ]
    got = {r.project: tuple(r)[1:] for r in J.detect(spark.createDataFrame(rows, "project string, path string, text string")).collect()}
    assert got == {
        "g": ("2026.1.1", "2026", "stable", "java", ["N 1"], ["vendordeps/a.json: declares 2025", "vendordeps/b.json: invalid JSON"]),
        "s": ("2027.0.0-alpha-2", "2027", "alpha", "cpp", [], []), "n": ("", "", "", "java", [], ["build.gradle.kts: plugin not found"]), "p": ("2026.2.1.0", "2026", "stable", "python", [], []),
    }


def test_hardware(spark):
    rows = [("neo", "NEO", "motor", "b", "all", {"m_kg": 1.0}), ("neo", "NEO", "motor", "a", "2026", {"m_kg": 1.1}), ("neo", "NEO", "motor", "c", "2025", {"m_kg": 1.2}), ("bag", "BAG", "motor", "a", "all", None)]
    df = spark.createDataFrame(rows, "part string, name string, category string, source string, season string, fields map<string,double>")
    asked = spark.createDataFrame([(1, "NEO"), (2, "no such"), (3, "bag"), (4, "neo"), (5, None)], "pos int, part string")
    got = [(r.part, r.source, r.place) for r in H.select(df, "2026", asked=asked).orderBy("place").collect()]
    assert got == [("neo", "a", 1), ("neo", "b", 2), ("bag", "a", 3)]
    assert [(r.part, r.source) for r in H.select(df, category="motor").orderBy("place").collect()] == [("bag", "a"), ("neo", "a"), ("neo", "b"), ("neo", "c")]
    assert sorted(str(r.part) for r in H.unknown(df, asked).collect()) == ["None", "no such"] and H.repeated_specs(df).count() == 0


def test_the_stored_index_ranks_as_a_search_does(spark):
    rows = [(1, "motor", "the motor runs", "a"), (2, None, "Mötor motor motor", "a"), (3, "", None, "a"), (4, "x", "y motor", "b"), (5, "motor", "runs", None)]
    docs = spark.createDataFrame(rows, "id int, title string, body string, season string")
    q = spark.createDataFrame([(0, ["motor", "runs"]), (1, ["absent"]), (2, [])], "query_id int, terms array<string>")
    w = {"title": 4.0, "body": 1.0}
    stored = S.build_index(docs, ["id"], w, ["season"])
    for part in (["season"], []):
        assert sorted(map(tuple, stored.bm25(q, part).collect())) == sorted(map(tuple, S.bm25(docs, q, ["id"], w, part).collect()))
    assert S.build_index(docs.limit(0), ["id"], w, ["season"]).bm25(q).count() == 0


def test_polite_fetching(spark):
    t = lambda s: dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s)
    r = spark.createDataFrame([("u", t(5), "s"), ("u", t(12), "s"), ("u", t(14), "s"), ("u", t(30), "s"), ("v", t(1), "free"), ("w", t(1), "s")], "url string, at timestamp, source string")
    out, kept = streams.polite(r, spark.createDataFrame([("u", t(0))], "url string, fetched_at timestamp"), "url", "at", "source", spark.createDataFrame([("s", 10)], "source string, min_interval_s int"))
    assert sorted((x.url, x.at) for x in out.collect()) == [("u", t(12)), ("u", t(30)), ("v", t(1)), ("w", t(1))]
    assert sorted((x.url, x.at) for x in kept.collect()) == [("u", t(5)), ("u", t(14))]
