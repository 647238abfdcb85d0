"""Consistent forms of text that looks the same."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from stratafold.llm.lookalike import canonical, canonical_text, same_look_classes, same_look_pairs

SAME = [
    ("résumé.txt", "résumé.txt"),
    ("IMG 1.jpg", "ＩＭＧ 1．ｊｐｇ"),
    ("scan 2", "s​c﻿an ２"),
    ("office", "oﬃce"),
    ("doc", "ԁοс"),
    ("Копія", "Koпія"),
    ("ї", "ï"),
    ("ї", "ї"),
    ("ạ̇", "ạ̇"),
    ("Å", "Å"),
    ("가", "가"),
    ("", "​"),
    ("e­́", "é"),
    ("a\u2011b", "a\u2010b"),
    ("Ӏ", "I"),
    ("ѵօᎪ", "voA"),
    ("\U0001d400\U0001d7ce", "A0"),
    ("ℓ", "l"),
    ("ⲢꓝꓮᎢ", "PFAT"),
    ("Սոօ", "Uno"),
]
DIFFERENT = [("a", "A"), ("e", "é"), ("a.b", "a_b"), ("a b", "a_b"), ("x2", "x²"), ("o", "0"), ("l", "1"), ("к", "k"), ("n", "ñ"), ("a-b", "a–b"), ("м", "m"), ("З", "3"), ("a\u2010b", "a-b"), ("α", "a"), ("I", "l")]


@pytest.mark.parametrize("a,b", SAME)
def test_same(a, b):
    assert canonical_text(a) == canonical_text(b)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_different(a, b):
    assert canonical_text(a) != canonical_text(b)


def test_joiners_stay_where_they_show():
    assert canonical_text("می‌خواهم") != canonical_text("میخواهم")
    assert canonical_text("a‌b") == "ab"


def test_column_equals_function_and_is_stable(spark):
    r = random.Random(5)
    pool = "abcXYZ012 ._-/éïżЇїйКопіяκοΜ̣́̈​‍ 　ﬁ漢かﾊﾟ゙ＡＢ１．가가😀ا‌ب"
    texts = ["".join(r.choice(pool) for _ in range(r.randrange(0, 40))) for _ in range(1500)] + ["", None, "é" * 50_000, "a" * 100_000 + "́"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    forms = {x["k"]: x["f"] for x in df.select("k", canonical(F.col("t")).alias("f")).collect()}
    for k, t in enumerate(texts):
        assert forms[k] == (None if t is None else canonical_text(t))
        if t:
            assert canonical_text(forms[k]) == forms[k] and unicodedata.is_normalized("NFC", forms[k])


def brute(rows):
    out = set()
    rows = sorted(set(rows), key=str)
    for g1, i, t in rows:
        for g2, j, u in rows:
            if None not in (i, j, t, u) and g1 == g2 and i < j and t != u and canonical_text(t) == canonical_text(u):
                out.add((g1, i, j))
    return out


def test_pairs_against_brute_force(spark):
    r = random.Random(8)
    words = [w for pair in SAME + DIFFERENT for w in pair]
    rows = [(r.choice([1, 2, None]), k, r.choice(words)) for k in range(250)]
    rows += rows[:20] + [(1, None, "a"), (1, 999, None)]
    df = spark.createDataFrame([(*x, "c", "d") for x in rows], "g int, i bigint, t string, id string, f string")
    found = [tuple(x) for x in same_look_pairs(df, "i", "t", "g").collect()]
    assert len(found) == len(set(found)) and set(found) == brute(rows)


def test_equal_texts_of_a_hot_key_make_no_pairs(spark):
    df = spark.range(3000).select(F.col("id"), F.lit("same text").alias("t"))
    assert same_look_pairs(df, "id", "t").count() == 0
    more = df.union(spark.createDataFrame([(5000, "same text")], "id bigint, t string"))
    assert same_look_pairs(more, "id", "t").count() == 3000
    assert same_look_pairs(df.limit(0), "id", "t").count() == 0


def test_supplement_ideographs_marks_and_emoji_style(spark):
    same = [("\U0002f800", "\u4e3d"), ("x\U0002fa1dy", "x\U0002a600y"), ("\u0627\u061c\u0628", "\u0627\u0628"), ("a\ufe0fb", "ab"), ("1\ufe0f", "1"), ("a\ufe0f\u200db", "ab")]
    kept = ["\u2764\ufe0f", "1\ufe0f\u20e3", "\u2764\ufe0f\u200d\U0001f525"]
    df = spark.createDataFrame([(t,) for t in [*(x for p in same for x in p), *kept]], "t string")
    form = dict(df.select("t", canonical(F.col("t"))).collect())
    for a, b in same:
        assert canonical_text(a) == canonical_text(b) == b == form[a] == form[b]
    for t in kept:
        assert canonical_text(t) == form[t] == t


def test_every_code_point(spark):
    """Canonically equivalent text has one form, JVM and Python agree, forms are stable and composed."""
    points = [chr(c) for c in range(0x20, 0x110000) if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    plain = [p for p in points if not 0xAC00 <= ord(p) <= 0xD7A3 and not 0x3400 <= ord(p) <= 0x9FFF and not 0x20000 <= ord(p) < 0x2F800 and ord(p) < 0x30000]
    hangul = points[0:0] + [chr(c) for c in range(0xAC00, 0xD7A4, 97)] + ["\u3400", "\u9fff", "\U00020000", "\U0002a6df", "\U00031350"]
    for p in [*plain, *hangul]:
        form = canonical_text(f"x{p}y")
        assert form == canonical_text("x" + unicodedata.normalize("NFD", p) + "y") == canonical_text("x" + unicodedata.normalize("NFC", p) + "y"), hex(ord(p))
        assert canonical_text(form) == form and unicodedata.is_normalized("NFC", form), hex(ord(p))
    texts = [f"x{p}y" for p in [*plain, *hangul]]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    wrong = [t for t, f in df.select("t", canonical(F.col("t"))).collect() if f != canonical_text(t)]
    assert wrong == []


def test_classes(spark):
    rows = [(1, 1, "office"), (1, 2, "oﬃce"), (1, 2, "oﬃce"), (2, 3, "oﬃce"), (1, 4, "other"), (1, None, "office"), (1, 5, None)]
    df = spark.createDataFrame(rows, "g int, i bigint, t string")
    assert sorted(tuple(r) for r in same_look_classes(df, "i", "t", "g").collect()) == [(1, "office", "office", 1), (1, "office", "oﬃce", 2)]


def test_two_texts_held_by_many(spark):
    df = spark.range(2_000).select("id", F.when(F.col("id") % 2 == 0, "office").otherwise("oﬃce").alias("t"))
    assert same_look_pairs(df, "id", "t").count() == 1_000_000
