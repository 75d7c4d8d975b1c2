"""Snapshot changes, orphan references and distributed ranks on hand-made rows, edge cases included."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pinfold.operators import orphans as O
from pinfold.operators import snapshots as S
from pinfold.operators.ranks import number_rows, percent_ranks, running_sum

ROWS = "lib string, lang string, season string, k string, v string, change string, ordinal int"


def _changes(spark, rows, existing=None):
    df = spark.createDataFrame(rows, ROWS)
    out = S.changes(df, ["lib", "lang"], F.trim("season"), "k", F.trim(F.regexp_replace("v", r"\s+", " ")), existing)
    return sorted(map(tuple, out.collect()), key=str)


def test_changes_between_consecutive_seasons(spark):
    rows = [
        ("a", "j", "1", "x", "s  1", "clash", 1), ("a", "j", " 1", "x", "s 1 ", None, 2),  # one value, written twice
        ("a", "j", "2", "x", "s 1", None, None), ("a", "j", "2", "y", "t", None, None),
        ("a", "j", "4", "x", "s 2", None, None), ("a", "j", "4", "Y", "t", None, None),  # 3 has no rows; case counts
        ("b", "j", "1", "only", "v", None, None),  # one snapshot
        ("a", None, "1", "n", None, None, None), ("a", None, "2", "n", "", None, None),  # null scope; null value is empty
        ("a", "j", None, "z", "v", None, None), ("a", "j", "1", None, "v", None, None), ("a", "j", " ", "w", "v", None, None),
    ]
    assert _changes(spark, rows) == [
        ("a", "j", "Y", "2", "4", "added"),
        ("a", "j", "x", "2", "4", "changed"),
        ("a", "j", "y", "1", "2", "added"),
        ("a", "j", "y", "2", "4", "removed"),
    ]


def test_changes_of_an_empty_table(spark):
    assert _changes(spark, []) == []


def test_changes_against_brute_force_over_several_blocks(spark, monkeypatch):
    rng = random.Random(5)
    rows = [("a", "j", str(p), f"k{i}", f"v{rng.randrange(3)}", None, None) for p in range(4) for i in range(300) if rng.random() < 0.7]
    sets = {}
    for _, _, p, k, v, _, _ in rows:
        sets.setdefault(p, {}).setdefault(k, set()).add(v)
    want = []
    for p, q in zip("012", "123"):
        for k in {*sets[p], *sets[q]}:
            if k not in sets[p]:
                want.append(("a", "j", k, p, q, "added"))
            elif k not in sets[q]:
                want.append(("a", "j", k, p, q, "removed"))
            elif sets[p][k] != sets[q][k]:
                want.append(("a", "j", k, p, q, "changed"))
    assert _changes(spark, rows) == sorted(want, key=str)


def test_ordinals_persist(spark):
    old = S.ordinals(spark.createDataFrame([("b",), ("d",)], "k string"))
    new = S.ordinals(spark.createDataFrame([("a",), ("b",), ("d",), (None,)], "k string"), old)
    got = {r.k: r.ordinal for r in new.collect()}
    assert got["b"] == 0 and got["d"] == 1 and sorted(got.values()) == [0, 1, 2, 3]


def test_bitmaps_agree_with_sets():
    rng = np.random.default_rng(1)
    for n, m in ((0, 5), (50, 60), (5000, 40), (20000, 21000)):
        a, b = rng.choice(S.BLOCK, n, False), rng.choice(S.BLOCK, m, False)
        x, y = S.Bitmap.of(a), S.Bitmap.of(b)
        assert set(x.and_not(y).tolist()) == set(a.tolist()) - set(b.tolist())
        assert set(x.both(y).tolist()) == set(a.tolist()) & set(b.tolist())
        assert set(x.ordinals().tolist()) == set(a.tolist())


def _t(day):
    return dt.datetime(2026, 1 + day // 28, 1 + day % 28)


def _orphans(spark, events):
    state, report = O.replay(spark.createDataFrame(events, O.EVENTS))
    return {(r.record, r.ref_value): r.state for r in state.orphans().collect()}, report


def _parent(key, day):
    return ("parent", "chunk", key, None, None, None, None, None, None if day is None else _t(day))


def _gone(key, day):
    return ("deletion", "chunk", key, None, None, None, None, None, _t(day))


def _ref(record, key, day, value=None):
    return ("reference", "chunk", key, "symbol", "chunk_id", "2026", record, value or str(key), _t(day))


def test_orphans_wait_resolve_and_reopen(spark):
    events = [
        _ref("never", "d#0", 1), _ref("late", "d#1", 1), _parent("d#1", 40), _ref("again", "d#1", 1), _ref("again", "d#1", 50),
        _parent("d#2", 1), _gone("d#2", 30), _ref("deleted", "d#2", 2), _parent("d#3", 1), _gone("d#3", 2), _parent("d#3", 60), _ref("back", "d#3", 5),
        _ref("nothing", None, 1, "no chunk"), _parent("d#4", None), _ref("timeless", "d#4", 3), _ref("never", "d#0", 1),
    ]
    state, report = _orphans(spark, events)
    assert state == {("never", "d#0"): "missing", ("late", "d#1"): "late", ("deleted", "d#2"): "deleted", ("nothing", "no chunk"): "missing"}
    january = {(r.state, r.n) for r in report.filter("period = '2026-01'").collect()}
    assert january == {("deleted", 1), ("missing", 4)}  # d#3 was deleted then, d#1 hadn't arrived


def test_orphans_of_nothing(spark):
    state, report = _orphans(spark, [])
    assert state == {} and report.count() == 0


def test_written_forms_of_keys(spark):
    df = spark.createDataFrame([("a#b#007",), (" a#1 ",), ("a#",), ("a#-1",), ("a",), ("",), (None,)], "v string")
    got = [r[0] for r in df.select(O.chunk_key(F.col("v"))).collect()]
    assert got == ["a#b#7", "a#1", None, None, None, None, None]
    one = spark.createDataFrame([(" ns::T#m ",)], "v string").select(O.symbol_key(F.col("v")), O.uuid_key(F.lit(" AB-c "))).first()
    assert tuple(one) == ("ns.T.m", "ab-c")


def test_events_take_no_reference_from_null_empty_or_seasonless_rows(spark):
    ts = "retrieved_at timestamp"
    chunk = spark.createDataFrame([("d", 0, _t(1))], f"doc_id string, ord int, {ts}")
    symbol = spark.createDataFrame([("A", "2026", "d#0", "", _t(1)), ("B", None, "d#9", "X", _t(1)), ("C", " 2026 ", None, "Z", _t(1))], f"fqn string, season string, chunk_id string, replacement string, {ts}")
    vend = spark.createDataFrame([("u", "2026", None, _t(1)), ("w", "2026", [("U", None, None), (None, None, None), ("", None, None)], _t(1))], f"uuid string, season string, conflicts array<struct<uuid:string,errorMessage:string,offlineFileName:string>>, {ts}")
    tomb = spark.createDataFrame([], "entity string, ref_key string, deleted_at timestamp, reason string")
    refs = O.events(chunk, symbol, vend, tomb).filter("kind = 'reference'").select("record", "season", "ref_value").collect()
    assert sorted(map(tuple, refs)) == [("A", "2026", "d#0"), ("C", "2026", "Z"), ("w", "2026", "U")]
    assert {(r.record, r.state) for r in O.replay(O.events(chunk, symbol, vend, tomb))[0].orphans().collect()} == {("C", "missing")}


def test_number_rows_is_a_total_numbering(spark):
    df = spark.createDataFrame([(i * 7919 % 1000,) for i in range(1000)], "v int")
    got = number_rows(df, [F.col("v").desc()], start=1).collect()
    assert {r.v: r.pos for r in got} == {v: 1000 - v for v in range(1000)}
    assert number_rows(df.limit(0), [F.col("v")]).count() == 0
    with pytest.raises(ValueError):
        number_rows(df, [F.col("v")], "v")


def test_percentiles_of_ties_nulls_and_nan(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 3.0), ("a", None), ("a", float("nan")), (None, 5.0)], "g string, v double")
    got = sorted((str(r.g), str(r.v), r.p) for r in percent_ranks(df, ["g"], "v", "p").collect())
    assert got == [("None", "5.0", 0.5), ("a", "1.0", 1 / 3), ("a", "1.0", 1 / 3), ("a", "3.0", 2.5 / 3), ("a", "None", None), ("a", "nan", None)]


def test_running_sum_over_range_partitions(spark):
    rows = [(g, i, i % 5) for g in "ab" for i in range(200)]
    df = spark.createDataFrame(rows, "g string, i int, n int")
    got = {(r.g, r.i): r.s for r in running_sum(df, ["g"], [F.col("i")], "n", "s").collect()}
    assert all(got[g, i] == sum(j % 5 for j in range(i)) for g in "ab" for i in range(200))
