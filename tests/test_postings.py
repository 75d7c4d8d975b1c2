"""The stored index: terms by the column functions, the best items by brute force, nothing of an item moved."""

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as e
from pinfold.functions import text as T
from pinfold.operators import postings as P, search as S


def test_terms_equal_the_column_functions(spark):
    texts = ["the motor runs at 40 V", "Mötor É éclair naïve", "TalonFXConfig kMaxRPM_2 talonFXconfig NEO550 _a_ __x__y", "m² ½ Ⅷ x²y", "ΑΣ ΑΣ'Α İstanbul ǅ", "", None, "😀a𝐀b ａＢ 中文字 ٣٤"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    want = {r.i: (r.a, r.b) for r in df.select("i", S.terms_of(F.col("t")).alias("a"), S.terms_of(T.expand(F.col("t"))).alias("b")).collect()}
    tokens = P.Tokens()
    for i, t in enumerate(texts):
        raw, own = tokens.terms(t)
        assert own == (want[i][0] or []), t
        assert tokens.expanded(raw) == (want[i][1] or []), t


def test_the_best_items_of_several_segments(monkeypatch):
    rng = random.Random(5)
    words, seasons = [f"w{i}" for i in range(30)], ["a", "b", None]
    docs = [(f"d{rng.randrange(40)}", i, rng.choice(seasons), [rng.choice(words[: rng.choice((3, 30))]) for _ in range(rng.randrange(1, 9))]) for i in range(400)]
    docs += [("same", i, "a", ["w1", "w2"]) for i in range(40)]  # ties
    rng.shuffle(docs)
    vocabulary = pa.array([f"w{i}" for i in range(0, 30, 2)] + ["w1"])
    of = {t: i for i, t in enumerate(vocabulary.to_pylist())}
    weights = {(s,): (np.array([rng.random() for _ in of]), 4.0) for s in seasons if s}
    asked = [np.array(sorted({rng.randrange(len(of)) for _ in range(5)})) for _ in range(12)]
    known = [(rng.choice("ab"),) for _ in asked]
    lane = lambda q, d: int(q != d)
    schema = pa.schema([("doc", pa.string()), ("ord", pa.int32())])
    names = ["doc", "ord", "season", "dl", "terms", "f"]
    batches = []
    for a in range(0, len(docs), 50):
        own = [(d, o, s, len(w), " ".join(c := dict.fromkeys(w)), np.array([float(w.count(t)) for t in c]).tobytes()) for d, o, s, w in docs[a : a + 50]]
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.binary()]
        batches.append(pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*own), kinds)], names))
    monkeypatch.setattr(P, "SEGMENT", 150)
    handle = SimpleNamespace(value=(np.arange(len(asked)), asked, known, vocabulary, weights))
    got = {}
    for b in P.ranker(["doc", "ord"], ["season"], ["season"], lane, 2, 6, schema, handle)(batches):
        for r in b.to_pylist():
            got.setdefault((r["query_id"], r["lane"]), []).append((-r["score"], r["doc"], r["ord"]))
    want = {}
    for q, terms in enumerate(asked):
        for d, o, s, w in docs:
            if s:
                f = {of[t]: w.count(t) for t in w if t in of}
                parts = [weights[s,][0][t] * f[t] * 2.2 / (f[t] + 1.2 * (0.25 + 0.75 * len(w) / 4.0)) for t in terms if t in f]
                if parts:
                    want.setdefault((q, lane(known[q], (s,))), []).append((-round(sum(parts), 6), d, o))
    assert got == {k: sorted(v)[:6] for k, v in want.items()}


def test_the_best_are_those_of_every_score(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["motor", None, "spool"]), " ".join(rng.choice(["motor", "spool", "arm", "GearBox", "x"]) for _ in range(rng.randrange(6))), rng.choice(["a", "b", None])) for i in range(300)]
    docs = spark.createDataFrame(rows, "id int, title string, body string, season string")
    q = spark.createDataFrame([(0, ["motor", "arm"]), (1, ["gear"]), (2, []), (3, ["absent"]), (4, ["x", "x", "spool"])], "query_id int, terms array<string>")
    w = {"title": 4.0, "body": 1.0, "expand": 2.5}
    x = S.build_index(docs, ["id"], w, ["season"], expand=("title", "body"))
    every = S.bm25(docs.withColumn("expand", T.expand(F.col("title"), F.col("body"))), q, ["id"], w, [])
    order = [F.col("score").desc(), F.col("id")]
    got, want = (sorted(tuple(r) for r in S.top(d.select("query_id", "id", "score"), order, 7).collect()) for d in (x.best(q, 7, []), every))
    assert got == want and {r[0] for r in want} == {0, 1, 4}
    assert x.best(q.limit(0), 7).count() == 0


def test_a_batch_moves_only_the_best(spark, sf):
    plan = e.queries()["bm25_batch"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan


def test_lanes_and_names():
    assert [S.by_season(("2026", "java"), x) for x in (("2026", "java"), ("2025", "any"), (None, "java"), ("2026", "cpp"), ("2026", None))] == [0, 1, None, None, None]
    assert S.by_season((None, "java"), ("2026", "java")) is None and S.by_season(("2026", None), ("2025", None)) == 1 and S.by_season(("2026", "any"), ("2026", "cpp")) == 0


def test_a_name_of_many_items_gives_its_first(spark):
    named = spark.createDataFrame([("a", "get", f"d{i:03}", 0) for i in range(200)] * 2 + [("b", "get", "d001", 0), ("a", "set", "d005", 0)], "season string, name string, doc_id string, ord int")
    visible = spark.createDataFrame([(f"d{i:03}", 0, "a") for i in range(3, 200)] + [("d300", 0, None)], "doc_id string, ord int, season string")
    got = sorted(tuple(r) for r in S.first_named(named, visible, ["doc_id", "ord"], 4).select("season", "name", "doc_id").collect())
    assert got == [("a", "get", f"d{i:03}") for i in range(3, 7)] + [("a", "set", "d005")]


def test_pages_move_only_the_best(spark, sf, monkeypatch):
    from pinfold.queries import search as Q

    plans, write = [], Q.materialize
    monkeypatch.setattr(Q, "materialize", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    last = e.queries()["search_pages"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plans[0] and "body" not in plans[0]
    assert "BroadcastHashJoin [h#" in last  # texts of the wanted chunks only


def test_a_search_moves_only_the_best(spark, sf):
    plan = e.queries()["search_batch"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "idf" not in plan
