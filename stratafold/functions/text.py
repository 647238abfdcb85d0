"""Scalar functions on names, messages and figures. Null in gives null out unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratafold.functions.paths import extension

# Suffixes of each category, tested in this order.
CATEGORIES = {
    "image": [".avif", ".bmp", ".gif", ".heic", ".heif", ".ico", ".jpeg", ".jpg", ".png", ".psd", ".raw", ".svg", ".tif", ".tiff", ".webp"],
    "video": [".3gp", ".avi", ".flv", ".m2ts", ".m4v", ".mkv", ".mov", ".mp4", ".mpeg", ".mpg", ".mts", ".webm", ".wmv"],
    "audio": [".aac", ".aiff", ".alac", ".flac", ".m4a", ".mp3", ".ogg", ".opus", ".wav", ".wma"],
    "document": [
        ".csv", ".doc", ".docx", ".epub", ".key", ".md", ".numbers", ".ods", ".odt", ".pages", ".pdf", ".ppt", ".pptx", ".rtf", ".tex", ".txt", ".xls", ".xlsx",
    ],
    "archive": [".7z", ".bz2", ".dmg", ".gz", ".iso", ".rar", ".tar", ".tgz", ".xz", ".zip"],
    "application": [".app", ".bundle", ".framework", ".kext", ".pkg", ".plugin", ".xcodeproj"],
}
# Further suffixes that only reports know.
REPORT_EXTRA = {"document": [".odf", ".tsv"], "archive": [".tbz", ".txz"]}
# Labels of the report categories.
LABELS = {
    "image": "Images", "video": "Video", "audio": "Audio", "document": "Documents", "archive": "Archives",
    "application": "Applications & packages", "other": "Other", "folder": "Folders",
}
# The same labels in Ukrainian, as views show them.
LABELS_UK = {
    "image": "Зображення", "video": "Відео", "audio": "Аудіо", "document": "Документи", "archive": "Архіви",
    "application": "Програми й пакети", "other": "Інше", "folder": "Папки", "all": "Усі категорії",
}
# What to do about each kind of problem.
ADVICE = {
    "Немає доступу": "Перевірте Full Disk Access і права доступу до теки.",
    "Файл змінився": "Повторіть сканування після завершення запису файла.",
    "Помилка носія": "Перевірте диск у Disk Utility та повторіть сканування.",
    "Драйвер не відкриває файл": "macOS-драйвер exFAT (fskit) перелічує файл, але не відкриває. Файл цілий — скопіюйте його з диска через інший комп'ютер (Windows/Linux) або сторонній драйвер (Paragon).",
    "Елемент зник": "Оновіть результати: файл переміщено або видалено.",
    "Помилка читання": "Відкрийте шлях у Finder, перевірте носій і повторіть сканування.",
}
# What a message must contain, in this order, and the title of its kind.
PROBLEMS = [
    (["permission", "denied", "дозвол"], "Немає доступу"),
    (["stale", "змінив"], "Файл змінився"),
    (["input/output", "i/o", "eio"], "Помилка носія"),
    (["fskit"], "Драйвер не відкриває файл"),
    (["not found", "no such"], "Елемент зник"),
]
OTHER_PROBLEM = "Помилка читання"
# Roots whose paths may hold spaces in running text, and names of credentials.
HOME_ROOTS = ["Users", "home", "Volumes", "private", "tmp"]
CREDENTIALS = ["password", "passwd", "token", "api_key", "authorization", "cookie"]


def _sensitive() -> list[tuple[str, str]]:
    """(pattern, replacement) by how far a secret reaches in running text: to the end of the line or a quote, to the end of
    the phrase, to the end of the word. The wider reaches come first, so that no tail of a path is left over."""
    line, phrase, word = (f"[^\\r\\n\"'<>{more}]" for more in ("", ":,;)\\]}", "\\s:,;()\\[\\]{}"))
    alone, fresh = r"(?<!\w)", r"(?<![\w:/])"
    step = f"/(?:(?!/){word})+"
    names = "|".join(n.replace("_", "[-_]?") for n in CREDENTIALS)
    roots = "|".join(HOME_ROOTS)
    return [
        (rf"(?i)\bfile:/{{2}}(?:localhost)?(?=/){line}{{2,}}", "<PATH>"),
        (rf"(?i){alone}(?:[a-z]:(?=[/\\])|\\(?=\\))[/\\](?:(?!\|){line})+", "<PATH>"),
        (rf"{alone}~/{phrase}+", "<PATH>"),
        (rf"{fresh}/(?=(?:{roots})/(?!/){phrase}){phrase}+", "<PATH>"),
        (rf"{fresh}(?:{step})+", "<PATH>"),
        (r"(?i)\bbearer\s+[\w.~+/-]+=*", "Bearer <REDACTED>"),
        (rf"(?i)\b({names})\s*[=:]\s*(?:([\"'])(?s:.*?)\2|[^,;\s]+)", "$1=<REDACTED>"),
        (r"(?i)(?<![\w.%+-])[\w.%+-]+@(?:[a-z0-9-]*\.)+[a-z]{2,}", "<EMAIL>"),
    ]


#: Expressions for sensitive text and what stands in for it, applied in this order.
SENSITIVE = _sensitive()


def _first(cases: list[tuple[Column, str]], otherwise: str) -> Column:
    head, *rest = cases
    chain = reduce(lambda c, x: c.when(x[0], x[1]), rest, F.when(*head))
    return chain.otherwise(otherwise)


def category(path: Column) -> Column:
    """Category by name suffix, whatever stands before it; ``other`` if none fits, null for a null path."""
    lower = F.rtrim(F.lower(path), F.lit("/"))
    pattern = lambda xs: "(" + "|".join(x[1:] for x in xs) + ")$"
    return F.when(path.isNotNull(), _first([(lower.rlike(r"\." + pattern(xs)), k) for k, xs in CATEGORIES.items()], "other"))


def report_category(path: Column, directory: Column | None = None) -> Column:
    """Category by the extension proper (a name like ``.jpg`` has none), with the reports' further suffixes."""
    ext = extension(path)
    found = _first([(ext.isin(xs + REPORT_EXTRA.get(k, [])), k) for k, xs in CATEGORIES.items()], "other")
    found = F.when(path.isNotNull(), found)
    return found if directory is None else F.when(directory, "folder").otherwise(found)


def category_label(key: Column, language: str = "en") -> Column:
    """Label of a category in English (reports) or Ukrainian (views); of unknown ones that of ``other``."""
    labels = {"en": LABELS, "uk": LABELS_UK}[language]
    return _first([(key == k, v) for k, v in labels.items()], labels["other"])


def problem_title(message: Column) -> Column:
    """Kind of a problem by the first rule one of whose words it contains."""
    text = F.lower(message)
    cases = [(reduce(lambda a, b: a | b, [text.contains(w) for w in words]), title) for words, title in PROBLEMS]
    return F.when(message.isNotNull(), _first(cases, OTHER_PROBLEM))


def problem_advice(message: Column) -> Column:
    """What to do about a problem, by its kind."""
    title = problem_title(message)
    return F.when(message.isNotNull(), _first([(title == k, v) for k, v in ADVICE.items()], ADVICE[OTHER_PROBLEM]))


def first_path(message: Column) -> Column:
    """The first absolute path in a message: up to ``: ``, a quote or the end, without closing punctuation."""
    raw = F.regexp_extract(message, r"""(?m)(/[^'"]*?)(?=: |['"]|$)""", 1)
    return F.when(raw != "", F.regexp_replace(raw, r"[.,;:)\]}»]+$", ""))


def _scaled(n: Column, units: list[str], whole: str, rest: str) -> Column:
    size = n.cast("double")
    out = F.when(size < 1024, F.format_string(whole + " " + units[0], F.floor(size).cast("bigint")))
    for k, unit in enumerate(units[1:], 1):
        value = size / float(1024**k)
        # ties are exact here and go to the even digit
        text = F.format_string(f"{rest} {unit}", F.bround(value, int(rest[2])))
        out = out.otherwise(text) if k == len(units) - 1 else out.when(size < float(1024 ** (k + 1)), text)
    return F.when(n.isNotNull(), out)


def human_bytes(n: Column) -> Column:
    """Size in units of 1024 with one decimal."""
    return _scaled(n, ["Б", "КБ", "МБ", "ГБ", "ТБ"], "%d", "%.1f")


def report_bytes(n: Column) -> Column:
    """Size in units of 1024 with two decimals, up to PB."""
    return _scaled(n, ["B", "KB", "MB", "GB", "TB", "PB"], "%d", "%.2f")


def exact_amount(n: Column) -> Column:
    """Digits in groups of three, parted by spaces."""
    return F.regexp_replace(F.format_number(n, 0), ",", " ")


def minute_of(ns: Column) -> Column:
    """``YYYY-MM-DD HH:MM`` of a time in nanoseconds, in the session's time zone."""
    return F.date_format(F.timestamp_micros(F.floor(ns / 1000)), "yyyy-MM-dd HH:mm")


def one_decimal(x: Column) -> Column:
    """A number from 0 on with one decimal, rounded as the binary value lies: the distance from the nearest tie is computed exactly, by
    splitting the number in two halves whose products with small integers are exact."""
    tenths = F.floor(x * 10)
    scaled = x * 134217729.0
    high = scaled - (scaled - x)
    over = (high * 20 - (tenths * 2 + 1)) + (x - high) * 20
    n = tenths + F.when((over > 0) | ((over == 0) & (tenths % 2 == 1)), 1).otherwise(0)
    return F.concat(F.floor(n / 10).cast("bigint").cast("string"), F.lit("."), (n % 10).cast("bigint").cast("string"))


def remaining_text(seconds: Column) -> Column:
    """Rough remaining time in seconds, minutes or hours."""
    s = F.greatest(F.lit(0.0), seconds)
    return (
        F.when(s < 60, F.format_string("~%d с", F.greatest(F.lit(1), F.bround(s).cast("int"))))
        .when(s < 3600, F.format_string("~%d хв", F.greatest(F.lit(1), F.bround(s / 60).cast("int"))))
        .otherwise(F.concat(F.lit("~"), one_decimal(s / 3600), F.lit(" год")))
    )


def phase_label(phase: Column) -> Column:
    """First part of a phase whose last part says that it counts bytes; else null."""
    parts = F.split(phase, " · ")
    return F.when((F.size(parts) >= 2) & (F.element_at(parts, -1) == "МіБ"), F.element_at(parts, 1))


def csv_safe(text: Column) -> Column:
    """Text that no spreadsheet takes for a formula."""
    return F.when(text.rlike(r"^[ \t\r]*[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


def html_escape(text: Column) -> Column:
    """Markup characters as references."""
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def redact(text: Column) -> Column:
    """Paths, credentials and addresses replaced by placeholders."""
    return reduce(lambda c, p: F.regexp_replace(c, p[0], p[1]), SENSITIVE, text)


def redact_all(texts: Column) -> Column:
    """:func:`redact` of each text of an array."""
    return F.transform(texts, redact)


def truncate_utf8(text: Column, limit: int, marker: str = "…") -> Column:
    """At most ``limit`` bytes of UTF-8 including ``marker``, never cutting a character."""
    room = max(0, limit - len(marker.encode()))
    raw = F.encode(text, "UTF-8")
    head = F.substring(raw, 1, room)
    # bytes of an incomplete last character go
    tail = F.hex(F.substring(raw, room + 1, 1)).between("80", "BF")
    whole = F.when(tail, F.regexp_replace(F.hex(head), r"(?:[CDEF][0-9A-F])(?:[89AB][0-9A-F])*$", "")).otherwise(F.hex(head))
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.concat(F.decode(F.unhex(whole), "UTF-8"), F.lit(marker)))


_SEMVER = r"^(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(?:-((?:0|[1-9]\d*|\d*[a-zA-Z-][0-9a-zA-Z-]*)(?:\.(?:0|[1-9]\d*|\d*[a-zA-Z-][0-9a-zA-Z-]*))*))?(?:\+([0-9a-zA-Z-]+(?:\.[0-9a-zA-Z-]+)*))?$"


def semver_key(version: Column) -> Column:
    """A struct that orders semantic versions by precedence; null for what is none. Builds have no precedence."""
    part = lambda k: F.regexp_extract(version, _SEMVER, k)
    pre = F.when(part(4) == "", F.array().cast("array<string>")).otherwise(F.split(part(4), r"\."))
    keyed = F.transform(pre, lambda x: F.when(x.rlike(r"^\d+$"), F.concat(F.lit("0"), F.lpad(x, 32, "0"))).otherwise(F.concat(F.lit("1"), x)))
    return F.when(
        version.rlike(_SEMVER),
        F.struct(
            F.try_to_number(part(1), F.lit("9" * 18)).cast("bigint").alias("major"),
            F.try_to_number(part(2), F.lit("9" * 18)).cast("bigint").alias("minor"),
            F.try_to_number(part(3), F.lit("9" * 18)).cast("bigint").alias("patch"),
            (part(4) == "").alias("released"),
            keyed.alias("pre"),
        ),
    )


def https_url(text: Column) -> Column:
    """Whether the text is an https address with a host and without user, fragment or white space."""
    host = F.try_parse_url(text, F.lit("HOST"))
    return F.coalesce(
        text.rlike(r"^https://[^\s]+$") & host.isNotNull() & (host != "") & F.try_parse_url(text, F.lit("USERINFO")).isNull() & F.try_parse_url(text, F.lit("REF")).isNull(), F.lit(False)
    )


GIB = 1 << 30


def storage_thresholds(total: Column) -> tuple[Column, Column]:
    """(critical, low) reserves of free space for a file system of ``total`` bytes."""
    size = F.greatest(F.lit(0), total)
    critical = F.greatest(F.lit(GIB // 2), F.least(F.lit(2 * GIB), F.floor(size * 0.002).cast("bigint")))
    low = F.greatest(F.lit(5 * GIB), F.least(F.lit(10 * GIB), F.floor(size * 0.02).cast("bigint")))
    return critical, F.greatest(critical + 1, low)


def storage_level(total: Column, free: Column) -> Column:
    """``critical`` below the critical reserve, ``low`` below the low one, else ``sufficient``."""
    critical, low = storage_thresholds(total)
    return F.when(free < critical, "critical").when(free < low, "low").otherwise("sufficient")


