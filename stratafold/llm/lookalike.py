"""Problem 1: one consistent form for text that looks the same in different characters."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratafold.operators.skew import expand_pairs
from stratafold.session import cut, release, spread

# Letters of other scripts drawn like a Latin letter, by script in two rows: the letters, and what they look like. After
# the public confusables data of the Unicode standard, as far as the usual fonts draw the two alike.
LOOKALIKES = {
    "Cyrillic": ("АВЕЅІЈКМНОРСТУХҮӀѴԌԚԜаеѕіјорсухһԁԛԝѵ", "ABESIJKMHOPCTYXYIVGQWaesijopcyxhdqwv"),
    "Greek": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳονϲ", "ABEZHIKMNOPTYXCjovc"),
    "Armenian": ("ՍՏՕհոսցօզյ", "USOhnugoqj"),
    "Cherokee": ("ᎠᎡᎢᎥᎪᎫᎬᎳᎷᎻᏀᏃᏙᏚᏞᏟᏢᏦ", "DRTiAJEWMHGZVSLCPK"),
    "Coptic": ("ⲎⲔⲘⲚⲞⲢⲤⲦⲬⲟⲣⲥ", "HKMNOPCTXopc"),
    "Lisu": ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),
    "Latin": ("ɡ", "g"),
}
# Code point ranges of characters whose compatibility form looks like themselves (besides the wide and
# narrow forms and all spaces): Latin digraphs, dot leaders, Roman numerals, Latin ligatures.
_SAME_LOOK = ((0x132, 0x133), (0x1C4, 0x1CC), (0x1F1, 0x1F3), (0x2024, 0x2026), (0x2160, 0x217F), (0xFB00, 0xFB06))
# Joiners, which change the look of the joining scripts and of emoji, and the ranges of those.
_JOINERS = "\u200c\u200d"
_JOINING = "\u0600-\u08ff\u0900-\u0dff\u0e80-\u109f\u1780-\u18af\ufb50-\ufdff\ufe70-\ufefc\u2600-\u27bf\u2b00-\u2bff\ufe0f\U0001f000-\U0001faff"


#: Gaps that the JVM's quick-check class bridges, below U+0590 and beyond; stable text that it takes for unstable is settled in Python all the same.
COARSE = (64, 512)


def _letters() -> dict[str, str]:
    return {x: y for those, like in LOOKALIKES.values() for x, y in zip(those, like, strict=True)}


@lru_cache(maxsize=1)
def tables() -> tuple[dict[str, str], set[str], list[str]]:
    """By rule from the Unicode data of Python: (map, unstable, dropped).

    ``map``: characters with a canonical form of their own that depends on no neighbour, and this form, one to a few
    characters. ``unstable``: what may combine or reorder with a neighbour (quick check No or
    Maybe, combining classes, jamo). ``dropped``: characters without any look.
    """
    letters = _letters()
    change: dict[str, str] = {}
    maybe: set[str] = set()
    dropped: list[str] = []
    for code in range(0x110000):
        if 0xD800 <= code <= 0xDFFF or 0xE000 <= code <= 0xF8FF or code >= 0xF0000 or 0x20000 <= code < 0x2F800 or 0x2FA20 <= code <= 0x323AF:
            continue
        c = chr(code)
        kind = unicodedata.category(c)
        if kind == "Cn":
            continue
        if kind == "Cf" or 0xFE00 <= code <= 0xFE0E or 0xE0100 <= code <= 0xE01EF or code in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x3164, 0xFFA0):
            if c not in _JOINERS and (code == 0x61C or not 0x600 <= code <= 0x8FF) and not 0x110BD <= code <= 0x1D17A:
                dropped.append(c)
            continue
        form = c
        tag = unicodedata.decomposition(c)
        if kind == "Zs":
            form = " "
        elif tag.startswith(("<wide>", "<narrow>", "<noBreak>", "<font>")) or any(a <= code <= b for a, b in _SAME_LOOK):
            form = unicodedata.normalize("NFKC", c)
        plain = unicodedata.normalize("NFD", form)
        form = unicodedata.normalize("NFC", "".join(letters.get(x, x) for x in plain))
        if form != c:
            change[c] = form
        if unicodedata.combining(c) or (tag and tag[0] != "<" and form == c and not unicodedata.is_normalized("NFC", c)):
            maybe.add(c)
        if tag and tag[0] != "<" and " " in tag and unicodedata.is_normalized("NFC", c):
            maybe.add(chr(int(tag.split()[1], 16)))
    maybe |= {chr(x) for x in (*range(0x1100, 0x1113), *range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    return change, maybe, dropped


def _as_class(chars: Iterable[str], gap: tuple[int, int] = (1, 1)) -> str:
    """A regular expression class body of code point ranges; ranges up to ``gap`` apart become one, which makes the
    class larger than ``chars`` and faster to match."""
    codes = sorted(map(ord, chars))
    out, i = [], 0
    while i < len(codes):
        j = i
        while j + 1 < len(codes) and codes[j + 1] <= codes[j] + gap[codes[j] >= 0x590]:
            j += 1
        out.append(f"\\x{{{codes[i]:x}}}" + (f"-\\x{{{codes[j]:x}}}" if j > i else ""))
        i = j + 1
    return "".join(out)


@lru_cache(maxsize=1)
def _patterns():
    change, maybe, dropped = tables()
    python = lambda body: regex.sub(r"\\x\{(\w+)\}", lambda m: f"\\U{int(m[1], 16):08x}", body)
    drop = regex.compile(f"[{python(_as_class(dropped))}]+")
    # a segment: the character before, all that may combine with it, up to the next stable character
    segment = regex.compile(f"(?s).?[{python(_as_class(maybe))}]+")
    joiner = regex.compile(f"(?<![{_JOINING}])[{_JOINERS}]|[{_JOINERS}](?![{_JOINING}])")
    # the emoji style shows after an emoji, and on the keys that U+20E3 makes
    style = regex.compile(r"(?<!\p{Emoji})\ufe0f|(?<=[0-9#*])\ufe0f(?!\u20e3)")
    single = str.maketrans({k: v for k, v in change.items()})
    letters = str.maketrans(_letters())
    return drop, style, joiner, segment, single, letters


def canonical_text(text: str) -> str:
    """The consistent form of ``text``.

    Characters without a look go (joiners stay within scripts and emoji whose look they change, U+FE0F after emoji); every space is a plain
    space; wide, narrow, non-breaking and mathematical forms, ligatures and the letters of ``LOOKALIKES`` become what they look like.
    Left apart are letters that only resemble each other (α and a, ρ and p, к and k), letters and digits (O and 0, l and 1, З and 3),
    the hyphen U+2010 and the ASCII one, and capital I and small l. The
    quick-check properties then isolate the segments that are not surely composed; only those are normalized, each with
    the character before it, and spliced between the unchanged rest. Case, accents, punctuation and digits stay.
    """
    drop, style, joiner, segment, single, letters = _patterns()
    text = joiner.sub("", style.sub("", drop.sub("", text))).translate(single)
    if unicodedata.is_normalized("NFC", text) and segment.search(text) is None:
        return text

    def settle(m) -> str:
        return unicodedata.normalize("NFC", unicodedata.normalize("NFD", m[0]).translate(letters)).translate(single)

    return segment.sub(settle, text)


def canonical(text: Column) -> Column:
    """:func:`canonical_text` as a column: null for null.

    The JVM settles all text without unstable segments by one translation; only the rest, told by the quick-check class, goes
    to Python in Arrow batches.
    """
    change, maybe, dropped = tables()
    single = {k: v for k, v in change.items() if len(v) == 1}
    longer = [k for k, v in change.items() if len(v) > 1]
    unstable = text.rlike(f"[{_as_class({*maybe, *longer, *_JOINERS, "\ufe0f"}, gap=COARSE)}]")
    keys = "".join(single)

    @F.arrow_udf(T.StringType())
    def settle(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else canonical_text(t) for t in texts.to_pylist()], type=pa.string())

    other = text.rlike(r"[^\x00-\x7f]")
    easy = F.when(other, F.translate(text, keys + "".join(dropped), "".join(single[k] for k in keys))).otherwise(text)
    return F.coalesce(settle(F.when(other & unstable, text)), easy)


def same_look_classes(rows: DataFrame, ident: str, text: str, *within: str) -> DataFrame:
    """``(*within, form, text, id)``: the distinct entries whose text looks like a different text of another entry, with the
    consistent form they share. ``within`` columns must be equal (null equals null).

    Rows with a null id or text are no entries; repeated rows count once; other columns are ignored. Forms are made once and
    written with their hashes. The forms with more than one distinct text are told by an aggregation of hashes that combines
    on the map side, so a text in very many rows is no hot spot; only their rows are read again. The result is a written table.
    """
    keys = list(within)
    entries = spread(rows.select(*keys, F.col(ident).alias("id"), F.col(text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL"))
    form = canonical(F.col("text"))
    formed = entries.withColumn("form", form).withColumn("k", F.xxhash64(*keys, "form"))
    # a form equal to the text isn't written twice
    formed = cut(formed.withColumn("form", F.when(F.col("form") != F.col("text"), F.col("form"))))
    marks = formed.select("k", F.xxhash64("text").alias("h"), F.hash("text").alias("g"))
    varied = marks.groupBy("k").agg(F.min("h").alias("a"), F.max("h").alias("b"), F.min("g").alias("c"), F.max("g").alias("d"))
    varied = varied.where("a <> b OR c <> d").select("k")
    found = cut(formed.join(varied, "k", "left_semi").select(*keys, F.coalesce("form", "text").alias("form"), "text", "id").distinct())
    release(formed)
    return found


def same_look_pairs(rows: DataFrame, ident: str, text: str, *within: str) -> DataFrame:
    """``(*within, id_a, id_b)``, id_a < id_b: the pairs of entries whose texts differ and have the same consistent form, from
    :func:`same_look_classes`. Distinct texts are paired first, then their entries in blocks, so that texts which very many
    entries hold are spread over all tasks; equal texts are never paired.
    """
    keys = list(within)
    suspects = same_look_classes(rows, ident, text, *within)
    texts = suspects.select(*keys, "form", "text").distinct().withColumn("t", F.monotonically_increasing_id())
    texts = cut(texts)
    left, right = texts.withColumnRenamed("t", "a"), texts.select(*[F.col(c).alias(f"r_{c}") for c in [*keys, "form"]], F.col("t").alias("b"))
    match = F.col("form") == F.col("r_form")
    for c in keys:
        match = match & F.col(c).eqNullSafe(F.col(f"r_{c}"))
    pairs = left.join(right, match).where("a < b").select("a", "b", *keys)
    named = texts.select(*[F.col(c).alias(f"r_{c}") for c in keys], F.col("text").alias("r_text"), "t")
    held = F.col("text") == F.col("r_text")
    for c in keys:
        held = held & F.col(c).eqNullSafe(F.col(f"r_{c}"))
    members = suspects.join(named, held).select(F.col("t").alias("g"), F.col("id").alias("m"))
    both = expand_pairs(pairs, members).where("m <> n")
    return both.select(*keys, F.least("m", "n").alias("id_a"), F.greatest("m", "n").alias("id_b")).distinct()
