"""Folding of all texts against brute force."""

import unicodedata
from collections import defaultdict

from pinfold.queries import registry

ROWS = [
    ("en", "Caf\u00e9 na\u00efve \U0001f916 r\u00e9sum\u00e9 \u2192 cafe"), (" EN ", "plain x_1"), ("ru", "\u0419\u043e\u0434 \u0438 \u0401\u043b\u043a\u0430 \u0438\u043e\u0434"), ("ja", "\u30ac\u30b9 \u6f22\u5b57 \u30ab\u30b9"),
    ("el", "\u03ac\u03bb\u03c6\u03b1 \u03b1\u03bb\u03c6\u03b1"), ("ko", "\ud55c\uad6d\uc5b4"), (None, "e\u0301t\u00e9"), ("en", None), ("en", ""),
]


def bare(c):
    if "\uac00" <= c <= "\ud7a3":
        return c  # composed syllables aren't accents
    return "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.category(x).startswith("M"))


def words(text):
    folded = "".join(bare(c) for c in text.lower())
    return "".join(c if c == "_" or unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd" else " " for c in folded).split()


def test_texts_of_every_script_are_counted(spark, tmp_path):
    spark.createDataFrame(ROWS, "lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = defaultdict(list)
    for lang, text in ROWS:
        if text:
            want[lang.strip().lower() if lang else None] += words(text)
    got = {(r.lang, r.n, r.terms) for r in registry.queries()["fold_tokens_all"](spark, str(tmp_path)).collect()}
    assert got == {(k, len(v), len(set(v))) for k, v in want.items()}
