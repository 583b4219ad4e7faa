"""Watched folders: targets, stability, fingerprints, job coverage and byte counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespan.functions import clock
from cuespan.operators.ordered import lane, number_rows
from cuespan.operators.ranged import listing_digests, number_all

MAX_DEPTH = 3


def with_pieces(files: DataFrame) -> DataFrame:
    """Video files with the pieces of their path below the root and their folder."""
    rel = F.expr("substring(path, length(root) + 2)")
    rows = files.where(F.col("is_video")).withColumn("pieces", F.split(rel, "/"))
    return rows.withColumn("folder", F.regexp_extract("path", r"^(.*)/[^/]*$", 1))


def settled(stable_sec: float, now: float) -> Column:
    """Aggregate: every file of the group has bytes and rests long enough."""
    return F.bool_and((F.col("size") > 0) & (F.lit(now) - F.col("mtime") >= stable_sec))


def targets(files: DataFrame, stable_sec: float, now: float, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Targets to queue: the deepest folder above ``max_depth`` with videos, or a loose root file.

    A folder that holds a deeper target is only a wrapper. Hidden entries are skipped.
    """
    rows = with_pieces(files).where(
        ~F.exists(F.slice(F.col("pieces"), 1, F.greatest(F.size("pieces") - 1, F.lit(1))), lambda p: F.startswith(p, F.lit(".")))
    )
    depth = F.size("pieces")
    loose = rows.where(depth == 1).groupBy("root", "path").agg(settled(stable_sec, now).alias("ok"))
    loose = loose.where("ok").select("root", F.col("path").alias("target"), F.lit(True).alias("loose"))
    # a folder rests when everything below it down to the depth limit rests
    inside = rows.where((depth >= 2) & (depth <= max_depth + 2))
    ancestors = F.array_distinct(
        F.transform(
            F.sequence(F.lit(1), F.least(depth - 1, F.lit(max_depth - 1))),
            lambda k: F.concat(F.col("root"), F.lit("/"), F.array_join(F.slice("pieces", 1, k), "/")),
        )
    )
    per = inside.select("root", "folder", "size", "mtime", F.explode(ancestors).alias("target"))
    folders = per.groupBy("root", "target").agg(
        settled(stable_sec, now).alias("ok"), F.max(F.col("folder") == F.col("target")).alias("direct")
    ).where(F.col("ok") & F.col("direct"))
    below = folders.select(
        "root", F.regexp_extract("target", r"^(.*)/[^/]*$", 1).alias("target")
    ).distinct()
    deepest = folders.join(below, ["root", "target"], "left_anti").select(
        "root", "target", F.lit(False).alias("loose")
    )
    return loose.unionByName(deepest)


def fingerprints(files: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """sha1 of a folder path with name, size and whole mtime of the videos below it, in walk order.

    Folders see up to ``max_depth`` levels of subfolders; ``left_out`` counts what lies deeper.
    """
    rows = with_pieces(files)
    n = F.size("pieces")
    depth = F.explode(F.sequence(F.greatest(F.lit(0), n - 1 - max_depth), n - 1))
    rows = rows.withColumn("k", depth)
    folder = F.concat_ws("/", "root", F.array_join(F.slice("pieces", 1, F.col("k")), "/"))
    rows = rows.withColumn("target", F.when(F.col("k") == 0, F.col("root")).otherwise(folder))
    piece = F.concat(
        F.lit("|"), clock.base_name(F.col("path")), F.lit("|"), F.col("size").cast("string"),
        F.lit("|"), F.col("mtime").cast("long").cast("string"),
    )
    return listing_digests(
        rows, ["target"], [F.col("pieces"), piece], piece, "sha1", lead=F.col("target"), name="fingerprint"
    )


def left_out(files: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Videos and their bytes, per root, in more than ``max_depth`` folders below the root."""
    deep = F.size("pieces") > max_depth + 1
    return with_pieces(files).groupBy("root").agg(
        F.count_if(deep).alias("files"), F.coalesce(F.sum(F.when(deep, F.col("size"))), F.lit(0)).alias("bytes")
    )


def covered(targets_fp: DataFrame, jobs: DataFrame) -> DataFrame:
    """Targets with ``done``: the first job on the path is done with the present fingerprint."""
    first = jobs.groupBy("path").agg(
        F.min_by(
            F.struct("state", F.coalesce("done_key", "key").alias("done_key")), F.struct("enqueued_at", "key")
        ).alias("j")
    )
    rows = targets_fp.join(first.withColumnRenamed("path", "target"), "target", "left")
    done = (F.col("j.state") == "done") & (F.col("j.done_key") == F.col("fingerprint"))
    return rows.withColumn("done", F.coalesce(done, F.lit(False))).drop("j")


def unprocessed_bytes(
    files: DataFrame, jobs: DataFrame, stable_sec: float, now: float, max_depth: int = MAX_DEPTH
) -> DataFrame:
    """Bytes of resting targets no finished job covers, per root.

    Loose files of the root form one target, other files belong to their own folder.
    """
    rows = with_pieces(files).where(F.size("pieces") <= max_depth + 1)
    groups = rows.groupBy("root", F.col("folder").alias("target")).agg(
        settled(stable_sec, now).alias("ok"), F.sum("size").alias("bytes")
    )
    prints = fingerprints(files, max_depth)
    open_ = covered(groups.where("ok").join(prints, "target", "left"), jobs).where(~F.col("done"))
    roots = files.select("root").distinct()
    return roots.join(open_.groupBy("root").agg(F.sum("bytes").alias("b")), "root", "left").select(
        "root", F.coalesce("b", F.lit(0)).alias("bytes")
    )


def new_bytes(
    files: DataFrame, stable_sec: float, now: float, window_sec: float = 86400.0, max_depth: int = MAX_DEPTH
) -> DataFrame:
    """Bytes written in ``(now - window, now]``, without top-level entries that are still growing."""
    rows = with_pieces(files).where(F.size("pieces") <= max_depth + 2)
    entry = F.get("pieces", F.lit(0))
    fresh = (F.col("mtime") > now - window_sec) & (F.col("mtime") <= now)
    per = rows.groupBy("root", entry.alias("entry")).agg(
        settled(stable_sec, now).alias("ok"),
        F.sum(F.when(fresh, F.col("size")).otherwise(0)).alias("b"),
    )
    return per.groupBy("root").agg(
        F.sum(F.when(F.col("ok"), F.col("b")).otherwise(0)).alias("bytes")
    )


def pending(files: DataFrame, scanned: DataFrame) -> DataFrame:
    """Listed but not yet scanned sources; a source with 0 events counts as scanned."""
    return files.join(scanned.select("src").distinct(), "src", "left_anti")


def merge_jobs(jobs: DataFrame) -> DataFrame:
    """One job per folder: running before queued before the rest, then the earliest enqueued.

    ``jobs`` needs ``is_dir``; loose files belong to their parent folder and lend it their job when
    several meet.
    """
    parent = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    grp = F.when(F.col("is_dir"), F.col("path")).otherwise(parent)
    prio = F.when(F.col("state") == "running", 0).when(F.col("state") == "queued", 1).when(
        F.col("state").isin("done", "failed"), 2
    ).otherwise(3)
    cols = [c for c in jobs.columns]
    best = jobs.groupBy(grp.alias("folder")).agg(
        F.min_by(F.struct(*cols), F.struct(prio, F.coalesce("enqueued_at", F.lit("")), F.col("key"))).alias("j"),
        F.count("*").alias("n"),
    )
    moved = (F.col("n") > 1) & ~F.col("is_dir")
    name = F.regexp_extract("folder", r"([^/]*)$", 1)
    return best.select("folder", "n", "j.*").select(
        *[
            F.when(moved, F.col("folder")).otherwise(F.col("path")).alias("path") if c == "path"
            else F.when(moved, name).otherwise(F.col("session")).alias("session") if c == "session"
            else F.col(c)
            for c in cols
        ]
    )


def job_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("state").agg(F.count("*").alias("n"))


def failed_sessions(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("state") == "failed").select("session", "key")


def jobs_in_order(jobs: DataFrame) -> DataFrame:
    """Jobs with their place in the queue by enqueue time."""
    rows = jobs.withColumn("__t", F.unix_timestamp(F.to_timestamp("enqueued_at")))
    return number_all(rows, ["__t", "key"], "place").drop("__t")


def latest_counts(indexes: DataFrame) -> DataFrame:
    """Newest index per line: (line, session, n) from (line, session, mtime, n)."""
    one = indexes.where(F.col("line") != "voice").groupBy("line").agg(
        F.max_by(F.struct("session", "n"), F.struct("mtime", "session")).alias("x")
    ).select("line", "x.session", F.col("x.n").alias("n"))
    voice = indexes.where(F.col("line") == "voice").withColumn(
        "grp", F.regexp_extract("session", r"^(.*)_P\d", 1)
    ).where(F.col("session").rlike(r"^.*_P\d"))
    groups = voice.groupBy("grp").agg(F.max("mtime").alias("mtime"), F.sum("n").alias("n"))
    best = groups.agg(F.max_by(F.struct("grp", "n"), F.struct("mtime", "grp")).alias("x"))
    return one.unionByName(
        best.where(F.col("x").isNotNull()).select(
            F.lit("voice").alias("line"), F.col("x.grp").alias("session"), F.col("x.n").alias("n")
        )
    )


def next_parts(files: DataFrame, new: DataFrame) -> DataFrame:
    """Part numbers of new recordings: the folder's largest plus the place among the new ones."""
    no = F.regexp_extract(clock.stem(F.col("path")), r"P(\d+)", 1).try_cast("long")
    top = files.withColumn("no", no).groupBy("folder").agg(F.max("no").alias("top"))
    rows = number_rows(new, lane("folder", ("started", *[c for c in new.columns if c not in ("folder", "started")]), 86400.0), "k")
    return rows.join(top, "folder", "left").withColumn(
        "part_no", F.coalesce("top", F.lit(0)) + F.col("k")
    ).drop("top", "k")


def register(index: DataFrame, incoming: DataFrame) -> DataFrame:
    """New recordings (by source path) with the next ``v%03d`` ids after the largest known."""
    fresh = incoming.join(index.select("source_path"), "source_path", "left_anti")
    fresh = fresh.groupBy("source_path").agg(F.min("ord").alias("ord"))
    numbered = number_all(fresh, ["ord", "source_path"], "k")
    top = index.where(F.startswith("id", F.lit("v"))).agg(
        F.coalesce(F.max(F.expr("try_cast(substring(id, 2) as bigint)")), F.lit(0))
    )
    return numbered.select(F.format_string("v%03d", top.scalar() + F.col("k")).alias("id"), "source_path")


def recordings(index: DataFrame) -> DataFrame:
    return index.orderBy("id")
