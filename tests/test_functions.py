import random

import pytest
from pyspark.sql import functions as F

from stratafold.functions import hashing as H
from stratafold.functions import paths as P
from stratafold.functions import text as X


def column(spark, values, kind, f):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r["o"] for r in df.select("k", f(F.col("v")).alias("o")).orderBy("k").collect()]


def test_paths(spark):
    v = ["/a/b/c.TAR.gz", "/x", "name", "", None, "/a/.hid", "/a/.b.txt", "/"]
    assert column(spark, v, "string", P.dirname) == ["/a/b", "/", "", "", None, "/a", "/a", "/"]
    assert column(spark, v, "string", P.basename) == ["c.TAR.gz", "x", "name", "", None, ".hid", ".b.txt", ""]
    assert column(spark, v, "string", P.extension) == [".gz", "", "", "", None, "", ".txt", ""]
    assert column(spark, ["/a/b/c", "/a", None], "string", P.ancestors) == [["/a", "/a/b"], [], None] or column(spark, ["/a/b/c", "/a"], "string", P.ancestors) == [["/a", "/a/b"], []]
    assert column(spark, ["/a/b", "/ab", "/a"], "string", lambda c: P.is_under(c, F.lit("/a"))) == [True, False, True]
    assert column(spark, ["/a/b", "/ab"], "string", lambda c: P.rebase(c, F.lit("/a"), F.lit("/z"))) == ["/z/b", None]
    assert column(spark, ["/a/b/c", "/a"], "string", lambda c: P.relative(c, F.lit("/a"))) == ["b/c", None]


def test_nfc_and_folding(spark):
    assert column(spark, ["e\u0301", "plain", None, "Straße", "\u1100\u1161"], "string", P.nfc) == ["é", "plain", None, "Straße", "가"]
    assert column(spark, ["ÉTÉ", "Straße", None, "ABC"], "string", P.casefold) == ["été", "strasse", None, "abc"]


def test_categories(spark):
    v = ["/a/x.JPG", "/a/.jpg", "/a/y.tar.gz", "/a/z.tsv", "/a/App.app/", "/a/none", None]
    assert column(spark, v, "string", X.category) == ["image", "image", "archive", "other", "application", "other", None]
    assert column(spark, v, "string", X.report_category) == ["image", "other", "archive", "document", "other", "other", None]


def test_messages(spark):
    v = ["x: Permission denied", "/a: stale", "EIO at /b", "fskit: no such file", "No such file", "odd", None]
    titles = ["Немає доступу", "Файл змінився", "Помилка носія", "Драйвер не відкриває файл", "Елемент зник", "Помилка читання", None]
    assert column(spark, v, "string", X.problem_title) == titles
    assert column(spark, ["/My Files/a.txt: denied", "no path", "open '/x/y' failed", None], "string", X.first_path) == ["/My Files/a.txt", None, "/x/y", None]


def test_sizes(spark):
    v = [0, 1023, 1024, 1536, 13568, 5 * 1024**4, None]
    assert column(spark, v, "bigint", X.report_bytes) == ["0 B", "1023 B", "1.00 KB", "1.50 KB", "13.25 KB", "5.00 TB", None]
    assert column(spark, v, "bigint", X.human_bytes) == ["0 Б", "1023 Б", "1.0 КБ", "1.5 КБ", "13.2 КБ", "5.0 ТБ", None]
    assert column(spark, [1234567, None], "bigint", X.exact_amount) == ["1 234 567", None]
    assert column(spark, [12.0, 90.0, 7200.0, -1.0], "double", X.remaining_text) == ["~12 с", "~2 хв", "~2.0 год", "~1 с"]
    assert column(spark, ["Читаю · /a/b · МіБ", "Читаю · 3", None], "string", X.phase_label) == ["Читаю", None, None]


def test_one_decimal(spark):
    r = random.Random(4)
    v = [0.0, 0.05, 0.15, 0.25, 0.35, 1.95, 1.45, 2.0 - 1e-12, 9.95, 1e6 + 0.05, *(r.random() * 100 for _ in range(200)), *(k / 20 for k in range(400))]
    assert column(spark, v, "double", X.one_decimal) == [f"{x:.1f}" for x in v]


def test_safe_text(spark):
    assert column(spark, ["=1+1", " \t-x", "ok", "", None], "string", X.csv_safe) == ["'=1+1", "' \t-x", "ok", "", None]
    assert column(spark, ["<a href=\"x\">'&"], "string", X.html_escape) == ["&lt;a href=&quot;x&quot;&gt;&#x27;&amp;"]
    cases = ["see /Users/me/secret file.txt: bad", "token=abc123, next", "Authorization: Bearer a.b", "mail me@x.org now", r"C:\Users\me", "a/b stays", None]
    assert column(spark, cases, "string", X.redact) == ["see <PATH>: bad", "token=<REDACTED>, next", "Authorization=<REDACTED> <REDACTED>", "mail <EMAIL> now", "<PATH>", "a/b stays", None]
    more = {
        "file://localhost/x/y z": "<PATH>", "at \\\\host\\share": "at <PATH>", "~/notes, done": "<PATH>, done", "(/opt/a/b)": "(<PATH>)", "http://x.org/a": "http://x.org/a",
        "API-key: 'a b' rest": "API-key=<REDACTED> rest", 'password="x y"': "password=<REDACTED>", "bearer abc==": "Bearer <REDACTED>", "/": "/", "/tmp/a b: c": "<PATH>: c", "x@y": "x@y",
        "": "", "D:/data|x": "<PATH>|x", "cookie=": "cookie=",
    }
    assert dict(zip(more, column(spark, list(more), "string", X.redact))) == more


@pytest.mark.parametrize("limit", [0, 4, 5, 6, 7, 8, 20])
def test_truncation_keeps_characters_whole(spark, limit):
    texts = ["añb漢字😀c", "short", "", None]
    for t, o in zip(texts, column(spark, texts, "string", lambda c: X.truncate_utf8(c, limit, "~"))):
        if t is None or len(t.encode()) <= limit:
            assert o == t
        else:
            assert o.endswith("~") and t.startswith(o[:-1]) and len(o.encode()) <= max(1, limit) and "�" not in o


def test_versions(spark):
    ordered = ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.2.0", "1.10.0", "2.0.0+b"]
    shuffled = random.Random(1).sample(ordered, len(ordered))
    df = spark.createDataFrame([(v,) for v in shuffled], "v string")
    assert [r["v"] for r in df.orderBy(X.semver_key(F.col("v"))).collect()] == ordered
    assert column(spark, ["1.0", "01.0.0", "1.0.0-01", "x", None], "string", lambda c: X.semver_key(c).isNull()) == [True] * 5


def test_addresses_and_storage(spark):
    assert column(spark, ["https://x.org/a", "http://x.org", "https://u@x.org", "https://x.org/#f", "https://", None], "string", X.https_url) == [True, False, False, False, False, False]
    g = 1 << 30
    df = spark.createDataFrame([(500 * g, 20 * g), (500 * g, 2 * g), (500 * g, g // 4), (32 * g, g)], "t bigint, f bigint")
    assert [r[0] for r in df.select(X.storage_level(F.col("t"), F.col("f"))).collect()] == ["sufficient", "low", "critical", "low"]


def test_perceptual_hashes(spark):
    up, down = [list(range(72)), list(range(72, 0, -1))]
    assert column(spark, [up, down, [1], None], "array<int>", lambda c: H.dhash(c, 9, 8)) == [0, -1, None, None]
    r = random.Random(3)
    grid = [r.randrange(256) for _ in range(81)]
    rows = [grid[k * 9 : k * 9 + 9] for k in range(9)]
    turned = [list(x) for x in zip(*rows[::-1])]
    mirrored = [x[::-1] for x in rows]
    flat = [sum(g, []) for g in (rows, turned, mirrored, [x[::-1] for x in turned])]
    assert len(set(column(spark, flat, "array<int>", H.canonical_hash))) == 1
    assert column(spark, [None, [1, 2]], "array<int>", H.canonical_hash) == [None, None]
    df = spark.createDataFrame([(0, -1), (5, 6)], "a bigint, b bigint")
    assert [x[0] for x in df.select(H.hamming(F.col("a"), F.col("b"))).collect()] == [64, 2]
