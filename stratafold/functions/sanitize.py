"""JSON documents without paths, credentials and addresses."""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratafold.functions.text import SENSITIVE

# Parts of key names whose values are never shown, and what stands in for what is left out.
SENSITIVE_KEYS = ["password", "passwd", "secret", "token", "apikey", "authorization", "cookie", "privatekey"]
CUT, DEEP, LONG, HIDDEN, PATH, ODD = "<collection-truncated>", "<max-depth>", "<oversized-text-omitted>", "<REDACTED>", "<PATH>", "<non-finite-number>"


@dataclass(frozen=True)
class Limits:
    """What a report holds at most; None is no limit. ``nodes`` counts values in reading order, ``depth`` the levels below the
    top, ``items`` the entries of one list or object, ``text`` and ``key`` the bytes of one text or key name."""

    depth: int | None = 10
    nodes: int | None = 2_000
    items: int | None = 2_000
    text: int | None = 4_096
    key: int | None = 512


#: No value is left out for its size.
WHOLE = Limits(None, None, None, None, None)
_RULES = [(re.compile(p, re.ASCII), r.replace("$1", r"\1")) for p, r in SENSITIVE]
_PATH = re.compile(r"(~/|file://|\\\\|/|[A-Za-z]:[\\/])")
_SECRET = re.compile("|".join(SENSITIVE_KEYS))


def _over(n: int, limit: int | None) -> bool:
    return limit is not None and n > limit


def clean_text(text: str, most: int | None = Limits.text) -> str:
    """Text without sensitive parts; a marker for one longer than ``most`` bytes."""
    if _over(len(text.encode("utf-8", "replace")), most):
        return LONG
    for pattern, replacement in _RULES:
        text = pattern.sub(replacement, text)
    return text


def _leaf(value: Any, limits: Limits) -> Any:
    match value:
        case str():
            return PATH if _PATH.match(value) else clean_text(value, limits.text)
        case float() if not math.isfinite(value):
            return ODD
        case _:
            return value


def _opened(value: Any, limits: Limits) -> tuple[Any, list]:
    """A container of the same kind for ``value``, and its slots that are still to be filled, in reading order."""
    entries = list(value.items() if isinstance(value, dict) else enumerate(value))
    kept = entries if limits.items is None else entries[: limits.items]
    more = len(kept) < len(entries)
    if isinstance(value, list):
        return [None] * len(kept) + [CUT] * more, kept
    named = {clean_text(k, limits.key): v for k, v in kept}
    secret = {k for k in named if _SECRET.search(re.sub(r"[\W_]", "", k.casefold()))}
    shell = {k: HIDDEN if k in secret else None for k in named} | ({CUT: True} if more else {})
    return shell, [(k, v) for k, v in named.items() if k not in secret]


def clean_value(document: Any, limits: Limits = Limits()) -> Any:
    """``document`` with every value replaced by what may be shown of it.

    An explicit list of open slots replaces recursion, so depth costs no stack: each slot names its container, its place in it, the
    raw value and its level, and the next in reading order is at the end. Keys that become equal keep the last value.
    """
    top: list = [None]
    open_slots, read = [(top, 0, document, 0)], 0
    while open_slots:
        holder, place, value, level = open_slots.pop()
        read += 1
        if _over(read, limits.nodes):
            holder[place] = CUT
        elif _over(level, limits.depth):
            holder[place] = DEEP
        elif isinstance(value, (dict, list)):
            holder[place], slots = _opened(value, limits)
            open_slots += [(holder[place], k, v, level + 1) for k, v in reversed(slots)]
        else:
            holder[place] = _leaf(value, limits)
    return top[0]


def clean_json(text: str | None, limits: Limits = Limits()) -> str | None:
    """A sanitized JSON document; what isn't JSON is taken as one text."""
    if text is None:
        return None
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        value = text
    return json.dumps(clean_value(value, limits), ensure_ascii=False, sort_keys=True)


def sanitize_json(text: Column, limits: Limits = Limits()) -> Column:
    """:func:`clean_json` as a column, in Arrow batches."""

    @F.arrow_udf(T.StringType())
    def clean(values: pa.Array) -> pa.Array:
        return pa.array([clean_json(v, limits) for v in values.to_pylist()], pa.string())

    return clean(text)
