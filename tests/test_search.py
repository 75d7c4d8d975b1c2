"""Search stages on hand-made rows, brute force for vectors, edge cases."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from pinfold.functions import text as T, vectors as V
from pinfold.operators import measures as M, search as S, symbols as Y
from pinfold.operators.vectors import Best, topk


def _docs(spark, rows):
    return spark.createDataFrame(rows, "id int, title string, body string, season string")


def test_bm25_by_hand(spark):
    docs = _docs(spark, [(1, "motor", "the motor runs", "a"), (2, None, "Mötor motor motor", "a"), (3, "", None, "a"), (4, "x", "y", "b")])
    q = spark.createDataFrame([(0, ["motor"]), (1, ["absent"]), (2, [])], "query_id int, terms array<string>")
    got = {r.id: r.score for r in S.bm25(docs, q, ["id"], {"title": 4.0, "body": 1.0}, ["season"]).collect()}
    n, df, avg = 3, 2, (4 + 3 + 0) / 3
    idf = max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6)
    want = {1: (5.0, 4), 2: (3.0, 3)}
    assert got == {i: round(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avg)), 6) for i, (f, dl) in want.items()}
    assert S.bm25(docs.limit(0), q, ["id"], {"body": 1.0}).count() == 0


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(8).round(3).tolist()) for i in range(300)] + [(900, None), (901, [1.0]), (902, [])]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    q = df.filter("id < 40 AND id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("vector"))
    got = {}
    for r in topk(df, q, "id", "v", 5, block=1).collect():
        got.setdefault(r.query_id, []).append((-r.score, r.id))
    m = np.array([v for _, v in rows[:300]])
    for k, hits in got.items():
        s = np.round(m @ m[k], 6)
        assert sorted(hits) == sorted((-s[i], i) for i in np.lexsort((np.arange(300), -s))[:5])


def test_best_of_many_batches():
    rng = np.random.default_rng(4)
    scores, best = rng.integers(0, 6, (3, 500)) / 2, Best(3, 7)  # many ties
    for a in range(0, 500, 60):
        best.add(np.arange(3), np.arange(500)[a : a + 60], scores[:, a : a + 60])
    q, i, s = best.held
    for k in range(3):
        want = np.lexsort((np.arange(500), -scores[k]))[:7]
        assert i[q == k].tolist() == want.tolist() and s[q == k].tolist() == scores[k][want].tolist()


def test_vectors_of_a_label_and_edge_cases(spark):
    rows = [(1, [1.0, 0.0], "a", "x"), (2, [0.5, 0.0], "a", "x"), (3, [2.0, 0.0], "b", "x"), (4, None, "a", "x"), (None, [9.0, 0.0], "a", "x"), (5, [1.0], "a", "x"), (6, [3.0, 0.0], None, "x"), (7, [1.0, 0.0], "a", "x")]
    df = spark.createDataFrame(rows, "id int, v array<double>, label string, score string")
    q = df.filter("id IN (1, 6)").select(F.col("id").alias("query_id"), F.col("v").alias("vector"), "label")
    got = [(r.query_id, r.id, r.score, r["rank"]) for r in topk(df, q, "id", "v", 2, label="label").orderBy("rank").collect()]
    assert got == [(1, 1, 1.0, 1), (1, 7, 1.0, 2)]
    assert topk(df.limit(0), q, "id", "v", 2).count() == 0 and topk(df, q.limit(0), "id", "v", 2).count() == 0


def test_quantized_codes(spark):
    r = spark.createDataFrame([([0.5, -1.0, 0.0, 0.004],), ([0.0, 0.0],)], "v array<double>").select(V.quantize(F.col("v")).alias("c"), V.scale(F.col("v")).alias("s")).collect()
    assert r[0].c == [64, -127, 0, 1] and r[0].s == 1 / 127 and r[1].c == [0, 0] and r[1].s == 0


def test_fusion_and_diversity(spark):
    a = spark.createDataFrame([(0, "x", 1), (0, "y", 2)], "query_id int, id string, rank int")
    b = spark.createDataFrame([(0, "y", 1), (1, "x", 1)], "query_id int, id string, rank int")
    got = {(r.query_id, r.id): (r.score, r.lists) for r in S.rrf(a, b, key=["id"]).collect()}
    assert got[0, "y"] == (round(1 / 61 + 1 / 62, 9), 2) and got[0, "x"] == (round(1 / 61, 9), 1)
    hits = spark.createDataFrame([(0, "d", i, 10.0 - i) for i in range(5)] + [(0, "e", 0, 1.0)], "query_id int, doc string, ord int, score double")
    kept = S.diversify(hits, ["doc"], [F.col("score").desc(), F.col("doc"), F.col("ord")]).orderBy("rank").collect()
    assert [(r.doc, r.ord) for r in kept] == [("d", 0), ("d", 1), ("e", 0)]


def test_statuses(spark):
    rows = [(0.5, 0.9, "ok"), (0.2, 0.9, "version_mismatch"), (0.2, 0.5, "low_confidence"), (None, 0.1, "version_mismatch"), (None, None, "no_match"), (0.1, None, "low_confidence")]
    df = spark.createDataFrame(rows, "own double, other double, want string")
    assert df.filter(S.status(F.col("own"), F.col("other")) != F.col("want")).count() == 0


def test_identifiers(spark):
    rows = [("TalonFXConfiguration", "talon fx configuration"), ("kMaxRPM_2", "k max rpm 2"), ("CANSparkMax", "can spark max"), ("NEO550", "neo 550"), ("motor", None), ("ID", None), ("", None), (None, None), ("__a__b", "a b")]
    df = spark.createDataFrame(rows, "t string, want string")
    assert df.filter(~F.array_join(T.split_ident(F.col("t")), " ").eqNullSafe(F.col("want"))).count() == 0
    q = spark.createDataFrame([("How do I configure a TalonFX?", '"configure" OR ("talonfx" OR ("talon" "fx"))'), ("the a of", ""), ("motion magic motion", '"motion" OR "magic"'), ('a" OR "b" 7', '"7"')], "q string, want string")
    assert [r[0] for r in q.filter(T.match_string(F.col("q")) != F.col("want")).select(T.match_string(F.col("q"))).collect()] == []
    e = spark.createDataFrame([("TalonFX talonFX config", "TalonFX")], "a string, b string").select(T.expand(F.col("a"), F.col("b"), F.lit(None).cast("string"))).first()[0]
    assert e == "talon fx"


def test_package_moves_and_ties(spark):
    df = lambda *names: spark.createDataFrame([(n,) for n in names], "fqn string")
    old = df("edu.first.math.Pose2d", "edu.first.math.Pose2d#getX", "edu.first.Timer", "stay.Same", "edu.first.math.Gone#x")
    new = df("org.lib.math.Pose2d", "org.lib.math.Pose2d#getX", "org.lib.a.Timer", "org.lib.b.Timer", "stay.Same")
    removed, added, mapped = Y.diff(old, new)
    assert removed.count() == 4 and added.count() == 4
    assert {tuple(r) for r in mapped.collect()} == {("edu.first.math.Pose2d", "org.lib.math.Pose2d"), ("edu.first.math.Pose2d#getX", "org.lib.math.Pose2d#getX")}


def test_ancestors_with_a_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("a", "b"), ("x", "x")], "child string, parent string")
    got = {(r.node, r.ancestor): r.depth for r in Y.ancestors(e).collect()}
    assert got == {("a", "b"): 1, ("a", "c"): 2, ("b", "c"): 1, ("b", "a"): 2, ("c", "a"): 1, ("c", "b"): 2, ("d", "a"): 1, ("d", "b"): 2, ("d", "c"): 3}


def test_token_bucket_by_hand(spark):
    import datetime as dt

    at = lambda s: dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s)
    rows = [("c", 1, at(0)), ("c", 2, at(0)), ("c", 3, at(0)), ("c", 4, at(1)), ("d", 5, at(0)), (None, 6, at(0)), ("c", 7, None)]
    df = spark.createDataFrame(rows, "client string, id int, ts timestamp")
    got = {r.id: (r.allowed, r.tokens) for r in M.token_bucket(df, "client", "ts", 1.0, 2.0).collect()}
    assert got == {1: (True, 1.0), 2: (True, 0.0), 3: (False, 0.0), 4: (True, 0.0), 5: (True, 1.0), 6: (False, None), 7: (False, None)}


def test_nearest_rank(spark):
    rng = random.Random(2)
    vals = [("a", rng.randrange(20)) for _ in range(101)] + [("b", 5), ("a", None)]
    n = F.col("n")
    got = {r.g: (r.p50, r.p95) for r in M.nearest_rank(spark.createDataFrame(vals, "g string, v int"), ["g"], "v", {"p50": F.floor(n / 2), "p95": F.floor(0.95 * (n - 1))}).collect()}
    s = sorted(v for g, v in vals if g == "a" and v is not None)
    assert got == {"a": (s[50], s[95]), "b": (5, 5)}
