"""Filters, tags and detail rows of result views."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratafold.functions.paths import casefold
from stratafold.functions.text import category
from stratafold.operators.ranking import under_any

# Presets of group views.
PRESETS = ("all", "largest", "safe", "review", "network")


@dataclass(frozen=True)
class Profile:
    """What a scan takes in. Extensions may have several dots; an excluded one wins over an included one."""

    min_size: int = 0
    hidden: bool = True
    bundles: bool = True
    symlinks: bool = True
    excluded_paths: Sequence[str] = field(default_factory=tuple)
    excluded_extensions: Sequence[str] = field(default_factory=tuple)
    included_extensions: Sequence[str] = field(default_factory=tuple)

    def __post_init__(self) -> None:
        for name in ("excluded_extensions", "included_extensions"):
            object.__setattr__(self, name, tuple(sorted({normal_extension(x) for x in getattr(self, name)})))
        if set(self.excluded_extensions) & set(self.included_extensions):
            raise ValueError("an extension is both included and excluded")
        if self.min_size < 0 or any(not p.startswith("/") for p in self.excluded_paths):
            raise ValueError("sizes aren't negative and paths are absolute")


def normal_extension(text: str) -> str:
    """An extension with its dot, NFC and folded; 2 to 32 characters."""
    out = unicodedata.normalize("NFC", text.strip()).casefold()
    out = out if out.startswith(".") else "." + out
    if not 2 <= len(out) <= 32 or "/" in out:
        raise ValueError(f"not an extension: {text!r}")
    return out


def should_include(p: Profile, directory: bool = False) -> Column:
    """A predicate on (path, name, size, is_bundle, is_symlink): null sizes count as 0, and links are tested with size 0. For a
    ``directory`` only hidden names, bundles and excluded paths count."""
    ok = F.lit(True)
    if not p.hidden:
        ok = ok & ~F.col("name").startswith(".")
    if not p.bundles:
        ok = ok & ~F.col("is_bundle")
    ok = ok & ~under_any(F.col("path"), p.excluded_paths)
    if directory:
        return ok
    size = F.when(F.col("is_symlink"), 0).otherwise(F.coalesce("size", F.lit(0)))
    ok = ok & (size >= p.min_size)
    if not p.symlinks:
        ok = ok & ~F.col("is_symlink")
    folded = casefold(F.col("name"))
    ends = lambda xs: reduce(lambda a, b: a | b, [folded.endswith(x) for x in xs])
    if p.excluded_extensions:
        ok = ok & ~ends(p.excluded_extensions)
    if p.included_extensions:
        ok = ok & ends(p.included_extensions)
    return ok


def visible_copies(copies: DataFrame, text: str = "", kind: str = "all", preset: str = "all") -> DataFrame:
    """The copies (class_id, path, mtime_ns) a view shows: those whose folded path holds ``text`` and whose category is ``kind``,
    in groups that fit the preset: ``all`` and ``largest`` are all of them (``largest`` is an order, see :func:`sorted_copies`), ``safe`` has several copies and no unknown date, ``review`` an unknown date or a
    copy on a volume, ``network`` a copy on a volume."""
    if preset not in PRESETS:
        raise ValueError(f"unknown preset: {preset}")
    out = copies
    if preset not in ("all", "largest"):
        g = copies.groupBy("class_id").agg(
            F.count("*").alias("n"), F.bool_or(F.col("path").startswith("/Volumes/")).alias("v"), F.bool_or(F.col("mtime_ns").isNull() | (F.col("mtime_ns") <= 0)).alias("m")
        )
        rule = {"safe": (F.col("n") > 1) & ~F.col("m"), "review": F.col("m") | F.col("v"), "network": F.col("v")}[preset]
        out = out.join(g.where(rule).select("class_id"), "class_id", "left_semi")
    if text:
        out = out.where(casefold(F.col("path")).contains(unicodedata.normalize("NFC", text).casefold()))
    if kind != "all":
        out = out.where(category(F.col("path")) == kind)
    return out


def visible_pairs(pairs: DataFrame, text: str = "", threshold: int = 0) -> DataFrame:
    """Pairs with ``text`` in either folder and at least ``threshold`` percent, which is held within 0 and 100."""
    out = pairs.where(F.col("percent") >= max(0, min(100, int(threshold))))
    if text:
        t = unicodedata.normalize("NFC", text).casefold()
        out = out.where(casefold(F.col("dir_a")).contains(t) | casefold(F.col("dir_b")).contains(t))
    return out


def put_tags(tags: DataFrame, changes: DataFrame, key: Sequence[str]) -> DataFrame:
    """``tags(*key, tag)`` after ``changes(*key, tag, at)``: the latest change of a key counts, an empty or null tag removes it."""
    last = changes.groupBy(*key).agg(F.max_by("tag", "at").alias("tag"))
    return tags.join(last.select(*key), list(key), "left_anti").unionByName(last.where("tag <> ''"))


def pair_rows(shared: DataFrame, totals: DataFrame, difference: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(*keys, kind, place, size, path_a, path_b, more)``: a pair's common contents (kind ``s``), files only in A (``a``) and only in B
    (``b``), each followed by a row that says how many more there are (``ts``, ``ta``, ``tb``), if any. ``shared(*keys, place, size, path_a,
    path_b)``, ``totals(*keys, shared_total)``, ``difference(*keys, side, total, place, path, size)``."""
    null = lambda kind: F.lit(None).cast(kind)
    rows = shared.select(*keys, F.lit("s").alias("kind"), "place", "size", "path_a", "path_b", null("bigint").alias("more"))
    shown = shared.groupBy(*keys).agg(F.count("*").alias("shown"))
    rest = totals.join(shown, list(keys), "left").withColumn("more", F.col("shared_total") - F.coalesce("shown", F.lit(0))).where("more > 0")
    marker = rest.select(*keys, F.lit("ts").alias("kind"), null("int").alias("place"), null("bigint").alias("size"), null("string").alias("path_a"), null("string").alias("path_b"), "more")
    only = difference.select(
        *keys, F.col("side").alias("kind"), "place", "size", F.when(F.col("side") == "a", F.col("path")).alias("path_a"), F.when(F.col("side") == "b", F.col("path")).alias("path_b"), null("bigint").alias("more")
    )
    cut = difference.groupBy(*keys, "side").agg((F.max("total") - F.count("*")).alias("more")).where("more > 0")
    cuts = cut.select(*keys, F.concat(F.lit("t"), "side").alias("kind"), null("int").alias("place"), null("bigint").alias("size"), null("string").alias("path_a"), null("string").alias("path_b"), "more")
    return rows.unionByName(marker).unionByName(only).unionByName(cuts)


def failed_candidates(errors: DataFrame, candidates: DataFrame) -> DataFrame:
    """The ``candidates(path)`` that an error of ``errors(message)`` names: it is the path, or begins with the path and ``: ``. Each
    prefix of a message before a ``: `` is joined by equality."""
    parts = F.split("message", ": ")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), ": "))
    named = errors.where("message IS NOT NULL").select(F.explode(prefixes).alias("path")).distinct()
    return candidates.join(named, "path", "left_semi")


def nfc_verdicts(entries: DataFrame, protected: Sequence[str] = ()) -> DataFrame:
    """``(path, verdict)`` for names (path, dir, name, found): ``already-nfc``, ``protected`` under a root, ``phantom`` if the entry isn't
    found, ``exists`` if the composed name is taken in its folder, else ``fixed``."""
    from stratafold.functions.paths import nfc

    named = entries.withColumn("composed", nfc(F.col("name")))
    taken = entries.select("dir", F.col("name").alias("composed"), F.lit(True).alias("taken")).distinct()
    j = named.join(taken, ["dir", "composed"], "left")
    verdict = (
        F.when(F.col("composed") == F.col("name"), "already-nfc").when(under_any(F.col("path"), protected), "protected").when(~F.col("found"), "phantom").when(F.col("taken"), "exists").otherwise("fixed")
    )
    return j.select("path", verdict.alias("verdict"))


def mount_types(paths: DataFrame, mounts: DataFrame) -> DataFrame:
    """``(path, mount, fs_type, network, trusted)`` by the longest mount point that holds each path."""
    from stratafold.operators.tree import longest_root

    at = longest_root(paths, mounts.select(F.col("mount").alias("root"))).withColumnRenamed("root", "mount")
    j = at.join(mounts, "mount", "left")
    # File systems over the network, and those whose metadata proves that a file is unchanged.
    network = F.col("fs_type").isin("smbfs", "nfs", "afpfs", "webdav", "cifs", "ftp")
    trusted = F.col("fs_type").isin("apfs", "hfs")
    return j.select("path", "mount", "fs_type", F.coalesce(network, F.lit(False)).alias("network"), F.coalesce(trusted, F.lit(False)).alias("trusted"))



def group_view(copies: DataFrame) -> DataFrame:
    """``(class_id, path, sort_path, category, size_text, born, changed, undated)``: a group's copies as a view shows and sorts them;
    times are null where unknown, and ``undated`` marks a copy without any."""
    from stratafold.functions.text import human_bytes, minute_of

    time = lambda c: F.when(F.col(c) > 0, F.col(c))
    born, changed = time("btime_ns"), time("mtime_ns")
    return copies.select(
        "class_id", "path", casefold(F.col("path")).alias("sort_path"), category(F.col("path")).alias("category"), human_bytes(F.col("size")).alias("size_text"),
        minute_of(born).alias("born"), minute_of(changed).alias("changed"), (born.isNull() & changed.isNull()).alias("undated"),
    )


def pair_view(pairs: DataFrame) -> DataFrame:
    """``(dir_a, dir_b, name_a, name_b, sort_a, sort_b, percent_text, bytes_text)`` of similar folders."""
    from stratafold.functions.paths import basename
    from stratafold.functions.text import human_bytes

    a, b = F.col("dir_a"), F.col("dir_b")
    return pairs.select(
        "dir_a", "dir_b", basename(a).alias("name_a"), basename(b).alias("name_b"), casefold(a).alias("sort_a"), casefold(b).alias("sort_b"),
        F.format_string("%.1f%%", F.col("percent")).alias("percent_text"), human_bytes(F.col("shared_bytes")).alias("bytes_text"),
    )


# What copies and pairs can be sorted by.
COPY_KEYS = {"path": "path", "size": "size", "born": "btime_ns", "changed": "mtime_ns"}
PAIR_KEYS = {"a": "dir_a", "b": "dir_b", "percent": "percent", "bytes": "shared_bytes"}


def sorted_copies(copies: DataFrame, key: str = "path", descending: bool = False, preset: str = "all") -> DataFrame:
    """``copies(class_id, path, size, btime_ns, mtime_ns)`` with ``group_place`` and ``place``: groups by their class, or with the preset
    ``largest`` by waste, greatest first; within each its copies by ``key``, unknown times as 0, then by path. The order of
    groups doesn't depend on ``key``."""
    from stratafold.operators.groups import duplicate_groups
    from stratafold.operators.ranking import Order, running

    g = duplicate_groups(copies).select("class_id", "wasted")
    order = [Order(F.col("wasted"), True), Order(F.col("class_id"))] if preset == "largest" else [Order(F.col("class_id"))]
    placed = running(g, order).select("class_id", F.col("k").alias("group_place"))
    value = casefold(F.col("path")) if key == "path" else F.coalesce(F.col(COPY_KEYS[key]), F.lit(0))
    w = W.partitionBy("class_id").orderBy(value.desc() if descending else value.asc(), "path")
    return copies.join(placed, "class_id").withColumn("place", F.row_number().over(w))


def sorted_pairs(pairs: DataFrame, key: str = "bytes", descending: bool = True) -> DataFrame:
    """``pairs`` with ``k``, the place by one of ``PAIR_KEYS``, then by both folders."""
    from stratafold.operators.ranking import Order, running

    value = casefold(F.col(PAIR_KEYS[key])) if key in ("a", "b") else F.col(PAIR_KEYS[key])
    return running(pairs, [Order(value, descending), Order(F.col("dir_a")), Order(F.col("dir_b"))])


def cleared(selected: DataFrame, shown: DataFrame | None = None) -> DataFrame:
    """``selected(path)`` after clearing what is ``shown(path)``, or all of it."""
    return selected.limit(0) if shown is None else selected.join(shown.select("path").distinct(), "path", "left_anti")


def check_one(copies: DataFrame, selected: DataFrame, asked: DataFrame, protected: Sequence[str] = ()) -> DataFrame:
    """``(path, allowed)`` for single copies ``asked(path)`` to select: not one under a protected root, and not the last of its group that
    isn't selected."""
    s = selected.select("path", F.lit(True).alias("s")).distinct()
    left = copies.join(s, "path", "left").groupBy("class_id").agg(F.count_if(F.col("s").isNull()).alias("open"))
    j = asked.select("path").distinct().join(copies.select("path", "class_id"), "path", "left").join(left, "class_id", "left").join(s, "path", "left")
    free = F.col("s").isNotNull() | (F.col("open") > 1)
    return j.select("path", F.coalesce(free & ~under_any(F.col("path"), protected), F.lit(False)).alias("allowed"))


def check_sides(rows: DataFrame) -> DataFrame:
    """``(row_id, side)`` for ``rows(row_id, a, b, at)`` of a similar pair's common contents, in which the sides ``a`` and ``b`` are asked to be
    selected: one side at most; of both the later request counts, side a of a tie."""
    both = rows.groupBy("row_id").agg(F.max(F.when(F.col("a"), F.col("at"))).alias("ta"), F.max(F.when(F.col("b"), F.col("at"))).alias("tb"))
    side = F.when(F.col("ta").isNull() & F.col("tb").isNull(), None).when(F.col("tb").isNull() | (F.col("ta") >= F.col("tb")), "a").otherwise("b")
    return both.select("row_id", side.alias("side")).where("side IS NOT NULL")


def pair_selection_stats(selected: DataFrame, pairs: DataFrame, shared: DataFrame) -> DataFrame:
    """One row (bytes, pairs): of the selected paths, and of the ``pairs(dir_a, dir_b)`` they touch, as one of the folders or as one of the
    pair's common files ``shared(dir_a, dir_b, path)``."""
    s = selected.select("path").distinct()
    by_dir = pairs.select("dir_a", "dir_b", F.explode(F.array("dir_a", "dir_b")).alias("path")).join(s, "path", "left_semi").select("dir_a", "dir_b")
    touched = by_dir.unionByName(shared.join(s, "path", "left_semi").select("dir_a", "dir_b")).distinct()
    total = selected.dropDuplicates(["path"]).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    return total.crossJoin(F.broadcast(touched.agg(F.count("*").alias("pairs"))))


def pairs_of_folders(folders: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(dir, dir_a, dir_b)``: the first similar pair, by shared bytes, percent and names, that names each of ``folders(dir)``."""
    each = pairs.select(F.explode(F.array("dir_a", "dir_b")).alias("dir"), F.struct(F.col("shared_bytes").alias("s"), F.col("percent").alias("p"), "dir_a", "dir_b").alias("r"))
    best = each.groupBy("dir").agg(F.max("r").alias("r"))
    return folders.select("dir").distinct().join(best, "dir").select("dir", "r.dir_a", "r.dir_b")


def with_dates(paths: DataFrame, files: DataFrame) -> DataFrame:
    """``(path, born, changed)``: the times of files, of folders those of the latest file directly in them; null where unknown."""
    time = lambda c: F.max(F.when(F.col(c) > 0, F.col(c)))
    own = files.groupBy("path").agg(time("btime_ns").alias("born"), time("mtime_ns").alias("changed"))
    inner = files.groupBy(F.col("dir").alias("path")).agg(time("btime_ns").alias("born"), time("mtime_ns").alias("changed"))
    return paths.select("path").distinct().join(own.unionByName(inner), "path", "left").select("path", "born", "changed")


def candidate_paths(copies: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``copies`` with each normal path once, the row that comes first by ``order``: ``//``, ``/./`` and a closing ``/`` don't tell paths apart."""
    normal = F.rtrim(F.regexp_replace(F.regexp_replace("path", r"/(\./)+", "/"), "/{2,}", "/"), F.lit("/"))
    first = F.min(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.struct(*copies.columns).alias("row")))
    return copies.groupBy(normal.alias("normal")).agg(first.alias("f")).select("f.row.*")


# Titles of problems that composing a name may solve, and what is said of each outcome of a name fix.
FIXABLE = ("Драйвер не відкриває файл", "Елемент зник")
OUTCOMES = {
    "fixed": "Ім'я полагоджено: {}. Повторіть сканування.",
    "phantom": "Драйвер не адресує запис навіть для перейменування — локально не полагодити; скопіюйте файл через інший комп'ютер.",
    "exists": "Файл з канонічним іменем уже існує поруч — нічого не змінено.",
    "already-nfc": "Ім'я вже канонічне — причина не в кодуванні.",
    "protected": "Шлях у теці-еталоні — перейменування заборонено.",
}
OTHER_OUTCOME = "Помилка перейменування"


def name_fix_candidates(problems: DataFrame) -> DataFrame:
    """The ``problems(message)`` of a kind that composing a name may solve."""
    from stratafold.functions.text import problem_title

    return problems.where(problem_title(F.col("message")).isin(*FIXABLE))


def outcome_text(verdict: Column, detail: Column) -> Column:
    """What is said of a name fix's outcome; an unknown one is an error with its detail, if there is any. Null for a null verdict."""
    said = F.when(F.coalesce(detail, F.lit("")) != "", F.concat(F.lit(OTHER_OUTCOME + ": "), detail)).otherwise(OTHER_OUTCOME + ".")
    out = F.when(verdict.isNull(), None)
    for k, v in OUTCOMES.items():
        head, *tail = v.split("{}")
        out = out.when(verdict == k, F.concat(F.lit(head), F.coalesce(detail, F.lit("")), F.lit(tail[0])) if tail else F.lit(v))
    return out.otherwise(said)


def read_only(live: Column, partial: Column) -> Column:
    """Whether a result may only be looked at: it is from a saved scan or of one that was stopped."""
    return ~F.coalesce(live, F.lit(False)) | F.coalesce(partial, F.lit(True))


def ready_to_act(live: Column, partial: Column) -> Column:
    """Whether copies may be acted on: the result is of this run and whole."""
    return ~read_only(live, partial)


def review_queue(problems: DataFrame, pairs: DataFrame, tags: DataFrame, selected: DataFrame, closed: bool = False, approved: str = "Схвалено") -> DataFrame:
    """One row (problems, pairs, selected, external, total): what is still to be looked at: problems, ``pairs(a, b)`` whose tag in ``tags(a, b,
    tag)`` isn't ``approved`` (one without a tag is open), the ``selected(path)``, those on external volumes among them counted too, and one more
    for a result that is read only."""
    open_pairs = pairs.join(tags, ["a", "b"], "left").where(F.coalesce(F.col("tag") != approved, F.lit(True))).agg(F.count("*").alias("pairs"))
    chosen = selected.agg(F.count("*").alias("selected"), F.count_if(F.col("path").startswith("/Volumes/")).alias("external"))
    row = problems.agg(F.count("*").alias("problems")).crossJoin(F.broadcast(open_pairs)).crossJoin(F.broadcast(chosen))
    return row.withColumn("total", F.col("problems") + F.col("pairs") + F.col("selected") + int(closed))
