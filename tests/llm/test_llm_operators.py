"""The text operators against libraries, brute force and round trips, edge cases included."""

import datetime as dt

import random
import string

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pinfold.llm import bpe, garbled, leximin, near_duplicates as nd, packing, splitting, token_budget as tb
from pinfold.llm.encode import token_counts, token_ids
from pinfold.llm.pretokens import slices, string_buffers

ODD = [
    None, "", " ", "   ", "\n", "\r\n\r\n", "a", "don't I'd've 'tis ''s x's\n's  's", "a  b   \n\n  c", "\t\tx", "é1½²x  '", "'", "''", "'r", "'re", "'rest", " 're",
    "!'s", "a'll'", "\x1c\x85a\xa0b", "汉字テスト🤖👩‍🔧", "x" * 5000, " " * 300 + "a", "‘’'s", "ABC123 def_ghi", "é", "﻿bom", "FrameBuilderHandle" * 3, "नमस्ते", "<|endoftext|>",
]


def fuzz(n, seed):
    rng = random.Random(seed)
    letters = "ab AB1 '.\n\tsdtmrevl éж汉🤖½ \xa0_-"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


# ---- encoding (problem 7) and counts


def test_ids_equal_the_library(reference):
    texts = [x or "" for x in ODD] + fuzz(500, 1)
    assert bpe.encode_all(texts, bpe.vocabulary()) == reference(texts)


def test_hash_is_minimal_and_perfect():
    v = bpe.vocabulary()
    assert sorted(v.ids.tolist()) == sorted(r for t, r in v.ranks.items() if len(t) <= bpe.WIDTH) and len(v.ids) == v.n


def test_ids_of_every_row(spark, reference):
    rows = [(i, x, "clash") for i, x in enumerate(ODD)] + [(None, "null key", None), (3, "again", None), (3, "again", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted(((r.doc_id, list(r.ids)) for r in token_ids(df).collect()), key=str)
    assert got == sorted(zip([r[0] for r in rows], reference([r[1] for r in rows])), key=str)
    assert token_ids(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        token_ids(df, key="ids")


def test_slices_cover_all_texts():
    off = np.array([0, 0, 5, 100, 100, 120])
    assert [(a, b) for a, b in slices(off, 10)] == [(0, 2), (2, 3), (3, 4), (4, 5)] or sum(b - a for a, b in slices(off, 10)) == 5


def test_path_counts_equal_the_tokenizer(reference):
    v = bpe.vocabulary()
    texts = [x or "" for x in ODD] + fuzz(400, 2)
    got = tb.Counts(v, tb.Trie(v.ranks)).texts(*string_buffers(pa.array(texts)))
    assert got.tolist() == [len(x) for x in reference(texts)]


def test_trie_holds_the_vocabulary():
    v = bpe.vocabulary()
    t = tb.Trie(v.ranks)
    for piece in random.Random(3).sample(sorted(v.ranks), 500):
        s = 0
        for c in piece:
            n = t.base[s] + c
            assert t.check[n] == s
            s = n
        assert t.value[s] == v.ranks[piece]


def test_token_budget_counts_each_item_once(spark, reference):
    at = lambda d: dt.datetime(2026, 1, d)
    rows = [
        ("d", 0, " Lib", "java", "prose", "one two", 5, at(1)), ("d", 0, "lib", "JAVA", "prose", "one two three", None, at(2)),  # delivered again
        ("d", 1, "lib", None, "", None, 3, at(1)), ("d", 2, "lib", "", None, "", None, at(1)),
    ]
    df = spark.createDataFrame(rows, "doc_id string, ord int, library string, language string, kind string, body string, tokens int, retrieved_at timestamp")
    run = lambda d: tb.token_budget(d, ["doc_id", "ord"], ["library", "language", "kind"], "body", "tokens", "retrieved_at")
    got = sorted(map(tuple, run(df).collect()), key=str)
    assert got == sorted([("lib", "java", "prose", 1, len(reference(["one two three"])[0]), 0), ("lib", None, None, 2, 0, 3)], key=str)
    assert run(df.limit(0)).count() == 0


# ---- near duplicates (problem 1)


def brute_pairs(rows, n=3):
    sets = {i: nd.gram_set(t, n) for i, t in rows if t}
    ids = sorted(i for i, s in sets.items() if s)
    out = set()
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            c = len(sets[a] & sets[b])
            if 5 * c >= 3 * (len(sets[a]) + len(sets[b]) - c):
                out.add((a, b))
    return out


def edited(rng, words, k):
    w = list(words)
    for _ in range(k):
        w[rng.randrange(len(w))] = "".join(rng.choice(string.ascii_lowercase) for _ in range(5))
    return w


def corpus(seed):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice(string.ascii_lowercase) for _ in range(4)) for _ in range(500)]
    rows = []
    for f in range(25):
        base = [rng.choice(vocab) for _ in range(120)]
        for k in range(4):
            rows.append((f"f{f}#{k}", " ".join(edited(rng, base, rng.randrange(6)))))
    rows += [(f"x#{i}", " ".join(rng.choice(vocab) for _ in range(60))) for i in range(60)]
    rows += [("e#0", None), ("e#1", ""), ("e#2", "two words"), ("e#3", "just three words"), ("e#4", "Just, three WORDS!"), ("e#5", "z " * 20000)]
    return rows


def test_pairs_against_brute_force(spark):
    rows = corpus(1)
    df = spark.createDataFrame([(*r, "clash") for r in rows + rows[:7]], "id string, body string, hi string")  # some delivered twice
    got = [tuple(r) for r in nd.duplicate_pairs(df, "body").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(rows)
    assert nd.duplicate_pairs(df.limit(0), "body").count() == 0


def test_bands_follow_from_the_recall():
    b = nd.bands_for(0.6, 4, 0.99)
    assert 1 - (1 - 0.6**4) ** b >= 0.99 > 1 - (1 - 0.6**4) ** (b - 1)


def test_many_copies_come_out_as_a_star(spark):
    rows = [(f"c#{i}", "the very same words here") for i in range(9)] + [(f"d#{i}", "other words that are the same") for i in range(3)]
    got = {tuple(r) for r in nd.duplicate_pairs(spark.createDataFrame(rows, "id string, body string"), "body", copies=5).collect()}
    assert got == {("c#0", f"c#{i}") for i in range(1, 9)} | {("d#0", "d#1"), ("d#0", "d#2"), ("d#1", "d#2")}


def test_groups_are_the_components(spark):
    rows = corpus(2)
    got = {r.id: r.group for r in nd.duplicate_groups(spark.createDataFrame(rows, "id string, body string"), "body").collect()}
    label = {i: i for i, _ in rows}
    pairs = brute_pairs(rows)
    for _ in range(10):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert got == label


# ---- splitting (problem 4)


def texts_to_split():
    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choice("abcdefgé") for _ in range(6)) for _ in range(n))
    para = "\n\n".join(f"## Part {i}\n\n{words(60)}. {words(50)}.\n\n```java\n{words(30)}\n```" for i in range(12))
    return [para, "é" * 5000, "a " * 5000, "😀" * 3000, "\n" * 4000, "```\n" + "x=1\n" * 2000 + "```\n", "a" * 2599 + "é" * 3, words(2000), "。".join(words(5) for _ in range(300))]


@pytest.mark.parametrize("text", texts_to_split())
def test_pieces_keep_the_limits_and_the_text(text):
    got = splitting.cuts(text, 2600, 240)
    assert "".join(text[o:b] for _, o, b in got) == text and len(got) > 1
    for s, o, b in got:
        assert len(text[s:b].encode()) <= 2600 and len(text[s:o].encode()) <= 240 and s <= o < b


def test_cuts_prefer_headings_to_the_middle():
    text = texts_to_split()[0]
    assert all(text[b:].startswith("## ") for _, _, b in splitting.cuts(text, 2600, 240)[:-1])


def test_split_of_a_table(spark):
    big = texts_to_split()[0]
    rows = [("d", 0, big, "A › B", dt.datetime(2026, 1, 1)), ("d", 0, big, "A › B", dt.datetime(2026, 2, 1)), ("d", 1, "short", "A", None), ("d", 2, None, None, None), ("d", 3, "", "", None), ("d", 4, "y" * 9000, None, None)]
    df = spark.createDataFrame(rows, "doc_id string, ord int, body string, heading_path string, retrieved_at timestamp").withColumns({"text": F.lit("clash"), "piece": F.lit(1)})
    got = splitting.split(df, ["doc_id", "ord"], "body", "heading_path").orderBy("ord", "piece").collect()
    assert {r.ord for r in got} == {0, 4}
    own = [r for r in got if r.ord == 0]
    assert "".join(r.text[r.shared :] for r in own) == big and all(r.tokens <= 650 and r.tokens == -(-len(r.text.encode()) // 4) for r in own)
    assert own[0].heading_path.startswith("A › B › Part 0") and [r.piece for r in own] == list(range(len(own)))
    assert splitting.split(df.limit(0), ["doc_id", "ord"], "body", "heading_path").count() == 0


# ---- one ranking (problem 6)


def test_leximin_against_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([None, float("nan"), 0.0, rng.random() * 10 ** rng.randrange(6)]), rng.choice([None, 1, 2, 900]), rng.choice("ab")) for i in range(80)]
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "id int, s double, a int, g string")
    got = [r.id for r in leximin.leximin(df, {"s": ["g"], "a": []}, ["id"]).orderBy("rank").collect()]

    def pct(v, pool):
        pool = [x for x in pool if x is not None and x == x]
        return 0.5 if v is None or v != v else (sum(x < v for x in pool) + sum(x == v for x in pool) / 2) / len(pool)

    key = lambda r: (tuple(-x for x in sorted([pct(r[1], [q[1] for q in rows if q[3] == r[3]]), pct(r[2], [q[2] for q in rows])])), r[0])
    assert got == [r[0] for r in sorted(rows, key=key)]
    with pytest.raises(ValueError):
        leximin.leximin(df.withColumn("rank", F.lit(1)), {"s": []}, ["id"])
    assert leximin.leximin(df.limit(0), {"s": ["g"], "a": []}, ["id"]).count() == 0


def test_scale_decides_nothing(spark):
    rows = [(i, float((i * 37) % 50), float((i * 11) % 50)) for i in range(50)]
    a = spark.createDataFrame(rows, "id int, s double, t double")
    order = lambda d: [r.id for r in leximin.leximin(d, {"s": [], "t": []}, ["id"]).orderBy("rank").collect()]
    assert order(a) == order(a.withColumn("s", F.exp(F.col("s")) * 1e6))


# ---- containers (problem 8)


def test_pack_holds_everything_once():
    rng = random.Random(8)
    for n in (1, 2, 30, 500):
        sizes = [rng.choice([0, 1, rng.randrange(2049), 2048]) for _ in range(n)]
        got = packing.pack(sizes, 2048)
        assert sorted(i for p in got for i in p) == list(range(n)) and all(sum(sizes[i] for i in p) <= 2048 for p in got)
    sizes = [rng.randrange(1, 900) for _ in range(1000)]
    assert sum(sizes) / (2048 * len(packing.pack(sizes, 2048))) > 0.97
    assert packing.pack([], 10) == [] and packing.pack([0, 0], 10) == [[0, 1]]


def test_containers_of_a_table(spark):
    rows = [(1, 5000), (2, 2048), (3, 2049), (4, 0), (5, None), (6, -3), (None, 100), (7, 30), (7, 30)] + [(100 + i, 300 + i) for i in range(40)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, n bigint, container string")
    got = packing.containers(df, "doc_id", "n", 2048).collect()
    total = {}
    for r in got:
        total[r.container] = total.get(r.container, 0) + r.n
    assert max(total.values()) <= 2048 and sum(total.values()) == sum(max(r[1] or 0, 0) for r in rows)
    assert sorted((r.piece, r.start, r.n) for r in got if r.doc_id == 1) == [(0, 0, 2048), (1, 2048, 2048), (2, 4096, 904)]
    assert len([r for r in got if r.doc_id == 2]) == 1 and len([r for r in got if r.doc_id == 3]) == 2 and len([r for r in got if r.doc_id == 7]) == 2
    assert packing.containers(df.limit(0), "doc_id", "n", 2048).count() == 0
    used = sum(max(r[1] or 0, 0) for r in rows)
    (f,) = packing.fill(packing.containers(df, "doc_id", "n", 2048), "n", 2048).collect()
    assert (f.containers, f.least, f.used, f.fill) == (len(total), -(-used // 2048), used, round(used / (2048 * len(total)), 6))
    assert tuple(packing.fill(packing.containers(df.limit(0), "doc_id", "n", 2048), "n", 2048).first()) == (0, 0, 0, None)


def test_large_items_are_exchanged_too():
    rng = random.Random(5)
    sizes = [rng.randrange(250, 700) for _ in range(2000)]  # over 400 windows
    got = packing.pack(sizes, 2048)
    assert sorted(i for p in got for i in p) == list(range(2000)) and all(sum(sizes[i] for i in p) <= 2048 for p in got)
    assert sum(sizes) / (2048 * len(got)) > 0.98


# ---- near duplicates of one id, and of many (problem 1)

WORDS = [f"w{i:03}" for i in range(200)]


def test_each_class_keeps_its_own_text(spark):
    a, b = " ".join(WORDS[:40]), " ".join(WORDS[100:140])
    rows = [("x", a), ("x", b), ("y", a + " more"), ("w", b + " more"), ("x", a)]
    df = spark.createDataFrame(rows, "id string, body string")
    assert {tuple(r) for r in nd.duplicate_pairs(df, "body").collect()} == {("w", "x"), ("x", "y")}


def test_classes_and_pairs_of_many_copies(spark):
    a = " ".join(WORDS[:30])
    rows = [(f"k{i}", a) for i in range(6)] + [("near", a + " more"), ("far", " ".join(WORDS[60:90])), ("short", "two words"), ("none", None)]
    df = spark.createDataFrame(rows, "id string, body string")
    got = {r.id: (r["class"], r.copies, r.links) for r in nd.duplicate_classes(df, "body").collect()}
    assert got == {**{f"k{i}": ("k0", 6, 1) for i in range(6)}, "near": ("near", 1, 1), "far": ("far", 1, 0)}
    pairs = lambda **how: {tuple(r) for r in nd.duplicate_pairs(df, "body", **how).collect()}
    ids = [f"k{i}" for i in range(6)] + ["near"]
    assert pairs(copies=None) == pairs() == {(x, y) for x in ids for y in ids if x < y}
    assert pairs(copies=5) == {("k0", y) for y in ids[1:]}
    assert nd.duplicate_classes(df.limit(0), "body").count() == 0


def test_texts_made_alike_are_dropped_where_they_meet(spark, monkeypatch):
    """They share a fifth of their n-grams, meet in some band and grew with the square of the table."""
    rng = random.Random(5)
    frame = WORDS[:42]
    rows = [(f"t{i}", " ".join(frame + [f"{rng.randrange(10**6)}" for _ in range(60)])) for i in range(300)]
    rows += [(i + "+", body + " more") for i, body in rows[:20]]
    written = {}
    write = nd.materialize

    def counted(df, name, *how):
        written[name] = write(df, name, *how)
        return written[name]

    monkeypatch.setattr(nd, "materialize", counted)
    got = {tuple(r) for r in nd.duplicate_pairs(spark.createDataFrame(rows, "id string, body string"), "body").collect()}
    assert got == {(f"t{i}", f"t{i}+") for i in range(20)}
    assert written["candidates"].count() < 60


def test_parities_differ_in_no_more_cells_than_the_texts_in_grams():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 400, np.uint64) * np.uint64(2)
    sets = [rng.choice(pool, int(k), replace=True) for k in rng.integers(1, 300, 60)]
    sizes = np.array([len(x) for x in sets])
    n, odd = nd.parities(np.concatenate(sets), sizes)
    assert n.tolist() == [len({*x.tolist()}) for x in sets]
    alone = [nd.parities(x, np.array([len(x)])) for x in sets]  # the other texts of a slice don't matter
    assert [x[0] for x, _ in alone] == n.tolist() and all((p[0] == q).all() for (_, p), q in zip(alone, odd))
    for i, x in enumerate(sets):
        for k, y in enumerate(sets):
            differ = sum(int(v).bit_count() for v in (odd[i] ^ odd[k]).view(np.uint64))
            assert differ <= len({*x.tolist()} ^ {*y.tolist()}) and (i != k or differ == 0)


# ---- garbled text (problem 9)

CLEAN = [
    ("de", "Für größere Lasten genügt der Prüfstand, außerdem heißt der Läufer übersteuert und die Messung läuft unabhängig vom Zähler."),
    ("fr", "Réglez d’abord le contrôleur, puis vérifiez l’arrêt. Où placer le délai ? Le relâchement est déjà réglé à côté du système."),
    ("tr", "Güç düşünce eşik kapalı hâle gelir ve açı değişmez. Bizim şanzıman ısınıyor; ışığı yanıp sönüyor, ölçüm sağlam görünüyor."),
    ("ru", "Если датчик становится ложным, проверьте редуктор и привод, затем запустите сигнал. Наш датчик греется, почему?"),
    ("pt", "ATENÇÃO: A CONFIGURAÇÃO NÃO É AUTOMÁTICA. A rotação do ímã é lida após o começo; o padrão está atrás. IRMÃ, ROMÃ, SÃO."),
    ("is", "Það er ekki víst að ýta sé þéttur. Þegar armur verður hægur þá þarf að mæla aftur, síðan ræsing."),
    ("en", "It’s safe to wait – usually – at 45° or 20 °C, expect ±3 µs “high”. cost 5 € ½ ¾ ™ √2 ≈ π «x» ÂGE, ÎLE, CÔTÉ ├── src │ └── main"),
]
WRONGS = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "mac-roman"), ("utf-8", "cp1251")]


def clean_corpus(n=80):
    rng = random.Random(9)
    out = []
    for i in range(n):
        for lang, t in CLEAN:
            if lang == "is" and i % 8:
                continue  # a rare language, whose letters are what another one garbles to
            s = t.split(". ")
            rng.shuffle(s)
            out.append(". ".join(s) + f" {i}")
    return out


def spoil(text, right, wrong):
    table = garbled._decoder(wrong)
    return "".join(table[b] for b in text.encode(right))


def test_garbled_texts_are_found_and_restored(spark):
    good = clean_corpus()
    bad = {}
    for k, (right, wrong) in enumerate(WRONGS):
        for j in (0, 1, 4, 6):
            bad[10_000 + 10 * k + j] = (spoil(CLEAN[j][1], right, wrong), CLEAN[j][1])
    bad[20_000] = (spoil(spoil(CLEAN[1][1], "utf-8", "cp1252"), "utf-8", "cp1252"), CLEAN[1][1])  # twice
    bad[20_001] = (spoil(CLEAN[2][1], "cp1254", "cp1252"), CLEAN[2][1])
    bad[20_002] = (spoil(CLEAN[3][1], "koi8-r", "latin-1"), CLEAN[3][1])
    bad[20_003] = ("A good start. " + spoil("Prüfen Sie die Länge", "utf-8", "cp1252") + " and a good end.", "A good start. Prüfen Sie die Länge and a good end.")
    rows = [(i, t, "clash") for i, t in enumerate(good)] + [(i, t, None) for i, (t, _) in bad.items()]
    rows += [(30_000, "gen�gt", None), (30_001, "ï»¿misread", None), (30_002, "﻿intact", None), (30_003, "caf&#233; &#195;&#169;", None), (30_004, None, None), (30_005, "", None), (30_006, "\xa0", None), (30_007, "é", None), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lost string")
    got = {r.doc_id: r for r in garbled.repair(df, "doc_id", "text").collect()}
    assert set(got) == {*bad, 30_000, 30_001}
    assert {i for i, (_, want) in bad.items() if got[i].restored != want} <= {20_001, 20_002}
    assert got[30_000].lost and not got[30_001].lost and got[30_001].restored == "﻿misread"
    assert garbled.repair(df.limit(0), "doc_id", "text").count() == 0


def test_a_frequent_garble_is_found(spark):
    rows = [(i, f"plain words, number {i}") for i in range(1_700)]
    rows += [(5_000 + i, f"about 2{i} °C within {i} µs, expect ±3{i} of it") for i in range(60)]
    bad = {9_000 + i: (f"heat it up to {i} Â°C", f"heat it up to {i} °C") for i in range(30)}
    bad |= {9_100 + i: (f"after {i} Âµs more", f"after {i} µs more") for i in range(30)}
    bad |= {9_200 + i: (f"expect Â±3{i} here", f"expect ±3{i} here") for i in range(30)}
    df = spark.createDataFrame(rows + [(i, t) for i, (t, _) in bad.items()], "doc_id bigint, text string")
    assert len(bad) / 3 > 0.005 * df.count()  # more texts than those up to which a pair is looked at anyway
    got = {r.doc_id: r.restored for r in garbled.repair(df, "doc_id", "text").collect()}
    assert got == {i: want for i, (_, want) in bad.items()}


def test_a_word_that_is_always_garbled_and_a_lone_character_are_found(spark):
    rows = [(i, f"Déjà réglé, même après {i} séances; it is naïve. It’s as high as {i}.") for i in range(400)]
    bad = {9_000 + i: (spoil(f"café-{i} → naïve", "utf-8", "cp1252"), f"café-{i} → naïve") for i in range(3)}  # no text has it intact
    bad[9_100] = ("Itís as plain as that.", "It’s as plain as that.")
    rows += [(1_000 + i, f"El límite está aquí, así sí es típico, número {i}.") for i in range(200)]
    df = spark.createDataFrame(rows + [(8_000, "Un artístico.")] + [(i, t) for i, (t, _) in bad.items()], "doc_id bigint, text string")
    assert {r.doc_id: r.restored for r in garbled.repair(df, "doc_id", "text").collect()} == {i: want for i, (_, want) in bad.items()}


@pytest.mark.parametrize("lang, right, wrong", [("tr", "cp1254", "cp1252"), ("ru", "cp1251", "cp1252")])
def test_a_source_with_the_wrong_code_page_is_found(spark, lang, right, wrong):
    rng = random.Random(3)
    words = next(t for x, t in CLEAN if x == lang).replace(".", "").split()
    text = lambda i: " ".join(rng.sample(words, 12)) + f" {i}"
    rows = list(enumerate(clean_corpus())) + [(2_000 + i, text(i)) for i in range(300)]
    bad = {5_000 + i: text(i) for i in range(150)}
    df = spark.createDataFrame(rows + [(i, spoil(t, right, wrong)) for i, t in bad.items()], "doc_id bigint, text string")
    got = {r.doc_id: r.restored for r in garbled.repair(df, "doc_id", "text").collect()}
    assert not set(got) - set(bad)  # Icelandic and the clean texts stay
    assert len(got) >= 0.95 * len(bad) and sum(got[i] == bad[i] for i in got) >= 0.9 * len(got)


def test_one_mapping_is_chosen_over_all_runs():
    pairs, singles, places = (np.zeros(n, np.float32) for n in (garbled.PAIRS, garbled.SINGLES, garbled.PLACES))
    a, b = (np.array([ord(c) for c in x]) for x in (" é ğ ", "é ğ x"))
    pairs[garbled.pair_slot(a, b)] = 100
    singles[[ord(c) for c in " éğ"]] = 100
    fix = garbled.Repair(garbled.Model(pairs, singles, places, 1_000))
    at = [k for k, m in enumerate(fix.single) if m.get(ord("Θ")) == ord("é")]  # é in cp1252, read as cp437
    runs = [" Θ "] * 60 + [" ≡ "]  # the second is ğ only in some of the encodings that have é there
    got = fix.whole(runs, set(at))
    assert got[ord("Θ")] == ord("é") and got[ord("≡")] == ord("ğ")


def test_segments_are_the_maximal_ones():
    at = np.arange(9)
    score = np.array([-1, 2, -1, 3, -5, 2, -1, 1, 4.0])
    assert garbled.segments(at, score, 0.1) == [(1, 3), (5, 8)]


