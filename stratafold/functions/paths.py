"""Column expressions on POSIX paths. Null in gives null out; an empty path has empty parts."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dirname(path: Column) -> Column:
    """The part before the last ``/``; ``/`` for entries of the root, empty without a ``/``."""
    head = F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)
    return F.when((head == "") & path.startswith("/"), "/").otherwise(head)


def basename(path: Column) -> Column:
    """The part after the last ``/``."""
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """The last suffix of the name with its dot, lower case. Leading dots start no suffix, as with ``splitext``."""
    return F.lower(F.regexp_extract(basename(path), r"(?s)^\.*[^.].*(\.[^.]*)$", 1))


def is_under(path: Column, root: Column) -> Column:
    """``path`` is ``root`` or lies below it, by whole components."""
    base = F.when(root == "/", F.lit("")).otherwise(root)
    return (path == root) | path.startswith(F.concat(base, F.lit("/")))


def depth(path: Column) -> Column:
    """Number of components."""
    return F.size(F.filter(F.split(path, "/"), lambda x: x != ""))


def ancestors(path: Column, include_self: bool = False) -> Column:
    """All proper ancestors of an absolute path from the top down, without the root ``/``; with itself if asked."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    count = F.size(parts) if include_self else F.size(parts) - 1
    return F.when(count >= 1, F.transform(F.sequence(F.lit(1), count), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, k), "/")))).otherwise(
        F.array().cast("array<string>")
    )


def relative(path: Column, root: Column) -> Column:
    """``path`` below ``root``; null if it isn't."""
    start = F.when(root == "/", 1).otherwise(F.length(root) + 1)
    return F.when(is_under(path, root) & (path != root), F.substring(path, start + 1, F.length(path)))


def rebase(path: Column, old: Column, new: Column) -> Column:
    """``path`` moved from the root ``old`` to ``new``; null if it isn't under ``old``."""
    return F.when(is_under(path, old), F.concat(new, F.substring(path, F.length(old) + 1, F.length(path))))


def volume(path: Column) -> Column:
    """The external volume a path lies on, else ``/``."""
    name = F.regexp_extract(path, r"^(/Volumes/[^/]+)(?:/|$)", 1)
    return F.when(name == "", "/").otherwise(name)


@F.arrow_udf(T.StringType())
def _nfc(values: pa.Array) -> pa.Array:
    return pa.array([None if v is None else unicodedata.normalize("NFC", v) for v in values.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def _fold(values: pa.Array) -> pa.Array:
    return pa.array([None if v is None else unicodedata.normalize("NFC", v).casefold() for v in values.to_pylist()], pa.string())


def nfc(text: Column) -> Column:
    """Unicode NFC. ASCII and text without combining marks stays in the JVM; only the rest goes to Python in batches."""
    loose = text.rlike(r"[\x{0300}-\x{036f}\x{0483}-\x{0487}\x{0591}-\x{1fff}\x{2126}-\x{212b}\x{2adc}\x{3099}-\x{309a}\x{f900}-\x{faff}\x{fb1d}-\x{fb4e}\x{fe20}-\x{fe2f}\x{10000}-\x{10ffff}]")
    return F.coalesce(_nfc(F.when(loose, text)), text)


def casefold(text: Column) -> Column:
    """Case folding of the NFC form; ASCII stays in the JVM."""
    ascii_only = text.rlike(r"^[\x00-\x7f]*$")
    return F.coalesce(_fold(F.when(~ascii_only, text)), F.lower(text))
