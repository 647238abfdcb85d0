"""Decisions before copies are removed, as data: nothing is ever moved or deleted here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratafold.functions.paths import ancestors, extension, is_under

IDENTITY = ["dev", "ino", "size", "mtime_ns", "ctime_ns"]
# Fixed value: the greatest number that a transfer puts after a name.
SUFFIXES = 10_000


def operation_identity(kind: Column) -> Column:
    """What an operation remembers of an entry to know it again: device, inode, kind, size and both times."""
    return F.struct("dev", "ino", kind.alias("kind"), "size", "mtime_ns", "ctime_ns")


def survivors(victims: DataFrame, files: DataFrame) -> DataFrame:
    """``(path, safe)``: whether another file of the victim's class, on another inode, stays. Files among the victims don't
    stay. Per class the least and greatest inode that stays decide, so no pairs of files are formed."""
    stays = files.join(victims.select("path"), "path", "left_anti").where("class_id IS NOT NULL AND dev IS NOT NULL AND ino IS NOT NULL")
    inode = F.struct("dev", "ino")
    ends = stays.groupBy("class_id").agg(F.min(inode).alias("lo"), F.max(inode).alias("hi"))
    other = (F.col("lo") != F.struct("dev", "ino")) | (F.col("hi") != F.struct("dev", "ino"))
    return victims.join(ends, "class_id", "left").select("path", F.coalesce(other, F.lit(False)).alias("safe"))


def authorised(expected: DataFrame, current: DataFrame, protected: DataFrame | None) -> DataFrame:
    """``(path, verdict)`` for ``expected(path, dev, ino, size, mtime_ns, ctime_ns)``: ``missing``, ``changed`` when any part of the
    identity differs, ``protected`` under one of ``protected(root)``, else ``authorised``. With ``protected`` None
    (the list couldn't be read) everything is ``protected``."""
    now = current.select("path", F.struct(*IDENTITY).alias("now"))
    j = expected.select("path", F.struct(*IDENTITY).alias("was")).join(now, "path", "left")
    if protected is None:
        j = j.withColumn("kept", F.lit(True))
    else:
        up = expected.select("path", F.explode(ancestors(F.col("path"), include_self=True)).alias("root"))
        kept = up.join(protected.select("root"), "root", "left_semi").select("path").distinct().withColumn("kept", F.lit(True))
        j = j.join(kept, "path", "left")
    verdict = F.when(F.col("kept"), "protected").when(F.col("now").isNull(), "missing").when(~F.col("now").eqNullSafe(F.col("was")), "changed").otherwise("authorised")
    return j.select("path", verdict.alias("verdict"))


def proof_state(snapshot: DataFrame, current: DataFrame, trusted: DataFrame) -> DataFrame:
    """``(path, state)``: ``trusted`` if the class is proven, the identity unchanged and the volume's file system keeps
    metadata (``trusted(volume)``), else ``reread``; ``fail`` if the file is gone. Old rows with device 0 compare size and mtime."""
    from stratafold.functions.paths import volume

    old = snapshot.select("path", "class_id", *[F.col(c).alias(f"o_{c}") for c in IDENTITY])
    j = old.join(current.select("path", *IDENTITY, F.lit(True).alias("there")), "path", "left")
    j = j.withColumn("volume", volume(F.col("path"))).join(trusted.select("volume").distinct().withColumn("t", F.lit(True)), "volume", "left")
    light = F.col("size").eqNullSafe(F.col("o_size")) & F.col("mtime_ns").eqNullSafe(F.col("o_mtime_ns"))
    full = light & F.col("ctime_ns").eqNullSafe(F.col("o_ctime_ns")) & F.col("dev").eqNullSafe(F.col("o_dev")) & F.col("ino").eqNullSafe(F.col("o_ino"))
    same = F.when(F.col("o_dev") == 0, light).otherwise(full)
    proven = F.col("class_id").isNotNull() & ~F.col("class_id").startswith("u:")
    state = F.when(F.col("there").isNull(), "fail").when(proven & same & F.col("t"), "trusted").otherwise("reread")
    return j.select("path", state.alias("state"))


def _numbers_in_use(existing: DataFrame, pattern: str, first: int, most: int | None) -> DataFrame:
    """``(target, gaps)``: for each name that ``existing(path)`` holds with a number after it, how many numbers from ``first`` on are free
    below each one in use, in order. Numbers beyond ``most`` don't matter; they bound the array."""
    named = existing.select("path", F.length(extension(F.col("path"))).alias("e"))
    named = named.select(F.expr("substr(path, 1, length(path) - e)").alias("stem"), F.expr("substr(path, length(path) - e + 1)").alias("x"))
    number = F.try_to_number(F.regexp_extract("stem", pattern, 2), F.lit("9" * 9)).cast("bigint")
    used = named.where(F.col("stem").rlike(pattern)).select(F.concat(F.regexp_extract("stem", pattern, 1), "x").alias("target"), number.alias("n")).distinct()
    used = used.where(F.col("n").between(first, most or 1 << 62))
    below = F.col("n") - first - F.row_number().over(W.partitionBy("target").orderBy("n")) + 1
    return used.withColumn("gap", below).groupBy("target").agg(F.sort_array(F.collect_list("gap")).alias("gaps"))


def _free_number(gaps: Column, m: Column, first: int) -> Column:
    """The ``m``-th number from ``first`` on that isn't in use."""
    return m + first - 1 + F.coalesce(F.size(F.filter(gaps, lambda g: g < m)), F.lit(0))


def _numbered(path: str, text: Column) -> Column:
    """The name in column ``path`` with ``text`` before its extension."""
    e = F.length(extension(F.col(path)))
    return F.concat(F.substring(path, F.lit(1), F.length(path) - e), text, F.substring(path, F.length(path) - e + 1, e))


def final_names(plan: DataFrame, existing: DataFrame, most: int | None = SUFFIXES) -> DataFrame:
    """``(source, target, final, action)`` for a merge plan (source, target, class_id) against ``existing(path, class_id)``:
    ``skip`` where the target's name already holds the same proven class; else ``transfer`` under the target name or, where that is
    taken, ``name (2).ext``, ``(3)`` and so on in source order, the first number that is free. A number beyond ``most`` (None
    for no bound) is an ``error`` without a name. A name that one row gets by its number isn't looked up for another row's target."""
    there = existing.select(F.col("path").alias("target"), F.col("class_id").alias("held"), F.lit(True).alias("taken"))
    j = plan.join(there, "target", "left")
    skip = F.col("taken") & F.col("class_id").isNotNull() & (F.col("class_id") == F.col("held"))
    j = j.withColumn("skip", F.coalesce(skip, F.lit(False)))
    # how many names of the row's target are given before it: of a free target the first row gets the name itself
    given = F.row_number().over(W.partitionBy("target", "skip").orderBy("source")) - F.when(F.col("taken"), 0).otherwise(1)
    j = j.withColumn("m", given).join(_numbers_in_use(existing, r"(?s)^(.*) \((\d{1,9})\)$", 2, most), "target", "left")
    number = F.when(F.col("m") > 0, _free_number(F.col("gaps"), F.col("m"), 2))
    beyond = F.coalesce(number > (most or 1 << 62), F.lit(False))
    final = F.when(number.isNull(), F.col("target")).otherwise(_numbered("target", F.concat(F.lit(" ("), number.cast("string"), F.lit(")"))))
    action = F.when(F.col("skip"), "skip").when(beyond, "error").otherwise("transfer")
    return j.select("source", "target", F.when(~F.col("skip") & ~beyond, final).alias("final"), action.alias("action"))


def restore_names(items: DataFrame, existing: DataFrame, most: int | None = SUFFIXES) -> DataFrame:
    """``(original_path, trashed_path, final)`` for journal items to restore: the original path, or where ``existing(path)`` or an earlier item
    holds it ``name (restored 1).ext``, ``(restored 2)`` and so on, the first number that is free; items of one path in the order of
    ``trashed_path``. Null beyond ``most``."""
    taken = existing.select(F.col("path").alias("original_path"), F.lit(True).alias("taken")).distinct()
    used = _numbers_in_use(existing, r"(?s)^(.*) \(restored (\d{1,9})\)$", 1, most).withColumnRenamed("target", "original_path")
    j = items.join(taken, "original_path", "left").join(used, "original_path", "left")
    m = F.row_number().over(W.partitionBy("original_path").orderBy("trashed_path")) - F.when(F.col("taken"), 0).otherwise(1)
    j = j.withColumn("m", m).withColumn("number", _free_number(F.col("gaps"), F.col("m"), 1))
    final = F.when(F.col("m") == 0, F.col("original_path")).when(F.col("number") <= (most or 1 << 62), _numbered("original_path", F.concat(F.lit(" (restored "), F.col("number").cast("string"), F.lit(")"))))
    return j.select("original_path", "trashed_path", final.alias("final"))


def unproven(folder_files: DataFrame, outside: DataFrame) -> DataFrame:
    """Files of a folder that have no living copy outside it: it may be removed only if there is none. Metadata companions
    beside the file they belong to need no copy."""
    companion = F.col("name").startswith("._")
    own = folder_files.withColumn("of", F.when(companion, F.substring("name", 3, 1 << 20)))
    twins = folder_files.select("dir", F.col("name").alias("of")).distinct().withColumn("twin", F.lit(True))
    needed = own.join(twins, ["dir", "of"], "left").where(~(F.coalesce(companion & F.col("twin"), F.lit(False)))).drop("of", "twin")
    proven = outside.where("class_id IS NOT NULL AND NOT startswith(class_id, 'u:')").select("class_id").distinct()
    return needed.join(proven, "class_id", "left_anti").select("path")


def restorable(items: DataFrame, current: DataFrame, allowed: DataFrame) -> DataFrame:
    """``(original_path, verdict)`` of journal items (original_path, trashed_path, kind, size, digest, status): ``done`` unless the
    item is in the trash, ``gone`` if the trashed file isn't there, ``changed`` if size or class differs, ``outside`` if the original
    isn't under an allowed root, ``occupied`` if its name is taken (it then gets a new name), else ``ready``."""
    there = current.select(F.col("path").alias("trashed_path"), F.col("size").alias("now_size"), F.col("class_id").alias("now_class"), F.lit(True).alias("there"))
    taken = current.select(F.col("path").alias("original_path")).withColumn("taken", F.lit(True))
    up = items.select("original_path", F.explode(ancestors(F.col("original_path"))).alias("root"))
    inside = up.join(allowed.select("root"), "root", "left_semi").select("original_path").distinct().withColumn("inside", F.lit(True))
    j = items.join(there, "trashed_path", "left").join(taken, "original_path", "left").join(inside, "original_path", "left")
    same = F.col("now_size").eqNullSafe(F.col("size")) & (F.col("digest").isNull() | F.col("now_class").eqNullSafe(F.concat_ws(":", F.col("size").cast("string"), "digest")))
    verdict = (
        F.when(F.col("status") != "trashed", "done").when(F.col("there").isNull(), "gone").when(~same, "changed").when(F.col("inside").isNull(), "outside").when(F.col("taken"), "occupied").otherwise("ready")
    )
    return j.select("original_path", verdict.alias("verdict"))


def paranoid_state(states: DataFrame, fresh: DataFrame, paranoid: bool = False) -> DataFrame:
    """``(path, state)``: :func:`proof_state`'s rows (path, state, expected) after files were read again where needed: ``trusted``, or with
    ``paranoid`` and for ``reread`` ``reread_ok`` if ``fresh(path, digest)`` holds the expected digest; else ``fail``."""
    j = states.join(fresh.select("path", "digest"), "path", "left")
    again = F.when(F.col("digest").isNotNull() & (F.col("digest") == F.col("expected")), "reread_ok").otherwise("fail")
    state = F.when(F.col("state") == "fail", "fail").when((F.col("state") == "trusted") & F.lit(not paranoid), "trusted").otherwise(again)
    return j.select("path", state.alias("state"))


def claimed_survivors(victims: DataFrame, claimed: DataFrame, removed: DataFrame) -> DataFrame:
    """``(path, safe)`` for ``victims(path, digest, dev, ino, claim)`` of unknown class that name the copy which stays: it must be
    in ``claimed(path, digest, dev, ino)`` with the same digest on another inode, and neither itself nor a folder above it may be among
    ``removed(path)``."""
    up = claimed.select("path", F.explode(ancestors(F.col("path"), include_self=True)).alias("at"))
    gone = up.join(removed.select(F.col("path").alias("at")).distinct(), "at", "left_semi").select("path").distinct()
    stays = claimed.join(gone, "path", "left_anti").select(F.col("path").alias("claim"), F.col("digest").alias("d"), F.struct("dev", "ino").alias("inode"))
    safe = (F.col("d") == F.col("digest")) & (F.col("inode") != F.struct("dev", "ino"))
    return victims.join(stays, "claim", "left").select("path", F.coalesce(safe, F.lit(False)).alias("safe"))


def folder_removal(folders: DataFrame, before: DataFrame, after: DataFrame, missing: DataFrame, cancelled: bool = False) -> DataFrame:
    """``(dir, result, unproven)`` for ``folders(dir)``: ``changed`` if the state digest ``before(dir, digest)`` isn't that ``after``, or there is
    none; ``abort`` with the number of files in ``missing(dir, path)`` that have no living copy outside; ``cancelled``; else ``ok``."""
    n = missing.groupBy("dir").agg(F.count("*").alias("unproven"))
    j = folders.select("dir").join(before.select("dir", F.col("digest").alias("b")), "dir", "left").join(after.select("dir", F.col("digest").alias("a")), "dir", "left").join(n, "dir", "left")
    unproven_n = F.coalesce("unproven", F.lit(0))
    result = F.when(F.lit(cancelled), "cancelled").when(F.coalesce(F.col("a") != F.col("b"), F.lit(True)), "changed").when(unproven_n > 0, "abort").otherwise("ok")
    return j.select("dir", result.alias("result"), unproven_n.alias("unproven"))


def transfer_status(named: DataFrame, read: DataFrame, expected: DataFrame) -> DataFrame:
    """``(source, final, status)`` of the rows of :func:`final_names`: ``skipped`` where the target holds the same content, ``error`` if the
    source's digest in ``read(path, digest)`` isn't the ``expected(path, digest)`` one or is missing, else ``transferred``."""
    j = named.join(read.select(F.col("path").alias("source"), F.col("digest").alias("now")), "source", "left").join(expected.select(F.col("path").alias("source"), F.col("digest").alias("was")), "source", "left")
    good = F.coalesce(F.col("now") == F.col("was"), F.lit(False)) | (F.col("was").isNull() & F.col("now").isNotNull())
    status = F.when(F.col("action") == "skip", "skipped").when(~good, "error").otherwise("transferred")
    return j.select("source", F.when(status == "transferred", F.col("final")).alias("final"), status.alias("status"))


def prepared_merge(plan: DataFrame, fresh: DataFrame, roots: DataFrame) -> DataFrame:
    """A merge plan (keys, bucket, size, source, target) made ready: with the ``digest`` just read of each source (``fresh(path, digest)``; links
    need none), the identities of both folders from ``roots(root, dev, ino)``, and ``ready``, false where a digest or an identity is missing."""
    identity = lambda side: roots.select(F.col("root").alias(side), F.struct("dev", "ino").alias(f"{side}_id"))
    j = plan.join(fresh.select(F.col("path").alias("source"), "digest"), "source", "left").join(identity("dir_a"), "dir_a", "left").join(identity("dir_b"), "dir_b", "left")
    ready = ((F.col("bucket") == "symlink") | F.col("digest").isNotNull()) & F.col("dir_a_id").isNotNull() & F.col("dir_b_id").isNotNull() & (F.col("dir_a_id") != F.col("dir_b_id"))
    return j.select(*plan.columns, "digest", F.coalesce(ready, F.lit(False)).alias("ready"))


def fresh_pair(entries: DataFrame, pair: tuple[str, str], content: DataFrame | None = None, classes: DataFrame | None = None) -> DataFrame:
    """The pair's ``(dir_a, dir_b, percent, shared_bytes, shared_total)`` by a new scan of its two folders, without profile, before anything
    is done on an old result; no row if they share nothing now."""
    from stratafold.operators import similar, tree
    from stratafold.operators.scan import scan

    a, b = sorted(pair)
    inside = entries.where(is_under(F.col("path"), F.lit(a)) | is_under(F.col("path"), F.lit(b)))
    s = scan(inside, content, classes, skip_cloud=False)
    one = entries.sparkSession.createDataFrame([(a, b)], "dir_a string, dir_b string")
    return similar.score_pairs(one, similar.class_counts(s.duplicates()), tree.subtree_sums(s.files))
