"""Router decisions, code references, verification, migration and the engine's statuses."""

import pytest

from pinfold.functions import versions as V
from pinfold.plans import code as C
from pinfold.plans.engine import Engine, decode_cursor, decode_pin, encode_cursor, encode_pin
from pinfold.plans.router import route
from pinfold.queries.common import catalog, chunks, symbols

SYM = "fqn string, library string, version string, season string, language string, kind string, signature string, deprecated_in string, replacement string, chunk_id string"


ROUTED = {  # text: what is expected of it
    "How do I configure current limits and inversion on a TalonFX?": {"intent": "howto", "identifiers": ["TalonFX"], "libraries": ["phoenix6"]},
    "migrate from 2026 to 2027": {"asked_season": "2027"},
    "REVLib 2024 or older": {"asked_season": "", "libraries": ["revlib"]},
    "what changed in 2027": {"asked_season": "2027"},
    "phoenix 5 vs phoenix 6 talonfx": {"libraries": ["phoenix5"]},
    "frc::SwerveDrive Set": {"asked_language": "cpp"},
    "com.a.b.Motor": {"asked_language": "java", "identifiers": ["com.a.b.Motor"]},
    "SwerveDriveKinematics": {"intent": "symbol"},
    "NullPointerException on enable": {"intent": "troubleshoot"},
    "motor için nasıl": {"non_english": True},
    "motor": {"non_english": False, "identifiers": [], "libraries": []},
    "": {"intent": "general", "asked_season": "", "asked_language": "", "non_english": False},
    None: {"intent": "general", "identifiers": []},
}


def test_routes(spark):
    got = {r.query: r for r in route(spark.createDataFrame([(t,) for t in ROUTED], "query string")).collect()}
    for text, want in ROUTED.items():
        assert {k: got[text][k] for k in want} == want, text


VERSIONS = ["26.0.0", "26.1.0", "26.1.3", "26.2.0", "26.70.0-alpha-2", "27.0.0-alpha-5", "27.0.0-alpha-6", "27.0.0-beta-1", "27.0.0-rc-1", "27.0.0", "2026.0.5", "v2026.1.1", "2026.1.26", "2026.1.26.1", "2026.3.4"]


def test_version_order(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, v) for i, v in enumerate(VERSIONS)], "i int, v string")
    assert [r.i for r in df.orderBy(V.version_key(F.col("v"))).collect()] == list(range(len(VERSIONS)))
    one = spark.createDataFrame([("v2026.3.4", "2026.3.4"), ("26.1", "26.1.0")], "a string, b string")
    assert all(r[0] for r in one.select(V.version_key(F.col("a")) == V.version_key(F.col("b"))).collect())
    got = spark.createDataFrame([(v,) for v in ("26.1.0", "v2026.3.4", "5.36.0", "0.4.0-beta", "Dev", "")], "v string").select(V.season(F.col("v"))).collect()
    assert [r[0] for r in got] == ["2026", "2026", "", "", "", ""]


JAVA = """package x;
import a.b.Motor; // import a.b.Comment;
class R {
  private final Motor m = new Motor(3);
  String s = "a.b.InString";
  void f() { m.set(1, 2); m.gone(); Motor.start(); a.c.Other o; }
}"""


def test_references(spark):
    files = spark.createDataFrame([("J", JAVA, "java"), ("P", "from lib.x import Motor as M\nm = M(1)\nm.set(2)\n", "python"), ("C", "lib::Motor m; /* lib::No */ lib::Motor::Create(1);", "cpp"), ("bad", "def (", "python"), ("none", None, "java")], "path string, code string, language string")
    got = {}
    for r in C.references(files, "path", "code", "language", ["a.", "lib"]).collect():
        got.setdefault(r.path, set()).add((r.symbol, r.line, r.args))
    assert got["J"] == {("a.b.Motor", 2, -1), ("a.b.Motor#Motor", 4, 1), ("a.b.Motor#set", 6, 2), ("a.b.Motor#gone", 6, 0), ("a.b.Motor#start", 6, 0), ("a.c.Other", 6, -1)}
    assert got["P"] == {("lib.x.Motor", 1, -1), ("lib.x.Motor#set", 3, 1)} and got["C"] == {("lib::Motor", 1, -1), ("lib::Motor#Create", 1, 1)} and set(got) == {"J", "P", "C"}


def _symbols(spark):
    row = lambda fqn, season, sig="", dep="", to="", lib="l", v="1": (fqn, lib, v, season, "java", "class", sig, dep, to, "")
    return spark.createDataFrame([row("a.b.Motor", "2026", to="n.Motor"), row("n.Motor", "2027"), row("a.b.Motor#set", "2026", "void set(double v, int... xs)"), row("n.Motor#set", "2027", "void set(double v)"), row("a.b.Old", "2026", dep="2025", to="a.b.Motor"), row("a.b.Gone", "2026")], SYM)


def test_verify_and_migrate(spark):
    refs = spark.createDataFrame([("J", "a.b.Motor", 1, 1, False, -1), ("J", "a.b.Gone", 2, 1, False, -1), ("J", "n.Motor#set", 3, 1, True, 2), ("J", "n.Motor#other", 4, 1, True, 0), ("J", "z.Unknown", 5, 1, False, -1)], C.REFS)
    got = {(r.symbol, r.severity, r.what, r.fix) for r in C.verify(refs, _symbols(spark), "2027").collect()}
    assert got == {("a.b.Motor", "error", "moved", "n.Motor"), ("a.b.Gone", "warning", "other_season", None), ("n.Motor#set", "warning", "arguments", None), ("z.Unknown", "info", "unknown", None)}
    own = {(r.symbol, r.what) for r in C.verify(spark.createDataFrame([("J", "a.b.Motor#set", 1, 1, True, 5), ("J", "a.b.Old", 2, 1, False, -1)], C.REFS), _symbols(spark), "2026").collect()}
    assert own == {("a.b.Old", "deprecated")}
    rules = spark.createDataFrame([("2026", "a.b.Gone", "n.Rule")], "from_season string, from_fqn string, to_fqn string")
    moved = {(r.symbol, r.to, r.via) for r in C.migrate(spark.createDataFrame([("J", s, 1, 1, False, -1) for s in ("a.b.Motor", "a.b.Gone", "a.b.Motor#set", "z.Z")], C.REFS), _symbols(spark), rules, "2026", "2027").collect()}
    assert moved == {("a.b.Motor", "n.Motor", "replacement"), ("a.b.Gone", "n.Rule", "curated"), ("a.b.Motor#set", "n.Motor#set", "owner"), ("z.Z", "z.Z", "unresolved")}


def test_engine(spark, sf):
    cols = ("symbol", "title", "heading_path", "prefix", "body", "season", "language", "trust", "library", "kind", "channel", "suspect")
    e = Engine(spark, chunks(spark, sf, *cols), symbols(spark, sf), catalog(spark, sf))
    title, season = e.chunk.filter("trust = 'official' AND length(body) > 300").select("title", "season").first()
    status, hits = e.search(title, season=season)
    assert status in ("ok", "low_confidence") and 0 < hits.count() <= 5 and {r.season for r in hits.select("season").collect()} == {season}
    assert e.search("xqzzyv wjkqq")[0] == "no_match" and e.manifest().count() > 0
    with pytest.raises(ValueError):
        e.search(" ")
    one = e.chunk.select("doc_id", "ord").first()
    assert e.fetch(f"x://chunk/{one.doc_id}#{one.ord}").count() == 1 and e.fetch("nonsense").count() == 0


def test_handles():
    assert decode_pin(encode_pin({"season": "2026"})) == {"season": "2026"} and decode_cursor(encode_cursor("q", "d", 5), "q", "d") == 5
    with pytest.raises(ValueError):
        decode_cursor(encode_cursor("q", "d", 5), "q", "other")
