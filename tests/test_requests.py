"""Labels, addresses, hosts, outcomes, part names and cut texts."""

import json

from pyspark.sql import functions as F

from pinfold.functions import parts as P
from pinfold.operators import ingest as I, requests as R


def test_addresses_and_hosts(spark):
    df = spark.createDataFrame([("10.0.0.1", "1.1.1.1, 2.2.2.2, 10.0.0.9"), ("10.0.0.1", "bad, 10.0.0.2"), ("9.9.9.9", "1.1.1.1"), ("10.0.0.1", None)], "peer string, fwd string")
    assert [r[0] for r in df.select(R.client_address(F.col("peer"), F.col("fwd"), ["10."])).collect()] == ["2.2.2.2", "10.0.0.1", "9.9.9.9", "10.0.0.1"]
    hosts = spark.createDataFrame([("A.x.example.",), ("x.example",), ("b.example",), ("yb.example",)], "h string")
    assert [r[0] for r in hosts.select(R.allowed(F.col("h"), ["*.x.example", "B.example"])).collect()] == [True, False, True, False]


def test_outcomes(spark):
    use = lambda *names: json.dumps({"type": "assistant", "message": {"content": [{"type": "tool_use", "name": n} for n in names] + [{"type": "text"}]}})
    lines = [json.dumps({"type": "system", "subtype": "init", "model": "m"}), use("own_a", "b"), "rubbish", use("own_a"), json.dumps({"type": "result", "num_turns": 3, "total_cost_usd": 0.5, "is_error": False, "usage": {"input_tokens": 5, "cache_read_input_tokens": 2, "output_tokens": 7}})]
    df = spark.createDataFrame([("r", i, x) for i, x in enumerate(lines)] + [("s", 0, "{}")], "run string, n int, line string")
    got = {r.run: r for r in R.outcomes(df, "run", "n", "line", "own_").collect()}
    r = got["r"]
    assert (r.model, r.turns, r.cost, r.input_tokens, r.output_tokens, r.own_calls, r.tool_calls) == ("m", 3, 0.5, 7, 7, 2, {"own_a": 2, "b": 1}) and got["s"].own_calls == 0
    c = spark.createDataFrame([("a/B.java:3: error: x\n  B.java:1: error: no\n", True), ("crash", True), ("", False)], "o string, f boolean")
    assert [x[0] for x in c.select(R.compile_errors(F.col("o"), F.col("f"))).collect()] == [1, 1, 0]


def test_part_names(spark):
    df = spark.createDataFrame([("Kraken X60 FOC",), ("neo_550",), ("foc",), ("Falcon (500)",)], "n string")
    assert [r[0] for r in df.select(P.part_id(F.col("n"))).collect()] == ["krakenx60-foc", "neo550", "foc", "falcon500"]
    f = spark.createDataFrame([("getKrakenX60Foc", ["KrakenX60", "KrakenX60FOC"], "cpp"), ("getAndymarkRs775_125", ["RS775_125", "CIM"], "cpp"), ("getX", [], "java")], "w string, ns array<string>, l string")
    assert [r[0] for r in f.select(P.factory(F.col("w"), F.col("ns"), F.col("l"))).collect()] == ["KrakenX60FOC", "RS775_125", None]


def test_cut_texts():
    text = ("word " * 30 + ".\n\n") * 40
    out = P.cut(text, 100)
    assert len(out.encode()) <= 404 and out.endswith(" …") and P.cut("short", 100) == "short" and P.cut(None, 5) is None and P.cut("```\n" + "x\n" * 900, 50).count("```") == 2
    assert "".join(p.removesuffix(" …") for p in P.pages("é" * 3000, 100)) == "é" * 3000 and P.pages("", 5) == []


def test_soft_split_and_variants(spark):
    text = "\n\n".join(["p" * 900, "```\n" + "a\n\n" * 500 + "```", "q" * 1500, "r"])
    (parts,) = spark.createDataFrame([(text,)], "t string").select(I.soft_split(F.col("t"))).first()
    assert all(p.count("```") % 2 == 0 for p in parts) and len(parts) > 1 and "".join(parts).replace("\n", "") == text.replace("\n", "")
    blocks = spark.createDataFrame([([("", "both"), ("python", "p"), ("java", "j")],), ([("", "only")],)], "b array<struct<lang:string,text:string>>")
    got = [[tuple(v) for v in r[0]] for r in blocks.select(I.variants(F.col("b"))).collect()]
    assert got == [[("java", "both\n\nj"), ("python", "both\n\np")], [("any", "only")]]
