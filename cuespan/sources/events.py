"""Event files: reading with the corruption rule, choosing a part's file, writing, the pool."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuespan import schemas
from cuespan.functions import clock, safety
from cuespan.functions import text as tx
from cuespan.operators.ordered import Lane, scan

_WEAPON_STRUCTS = "array<struct<name:string>>"


def _row_schema() -> str:
    """Event fields as they stand in a line; weapons stay text, their shape varies."""
    meta = schemas.META.replace("weapons:array<string>", "weapons:string").replace(
        "hero:string", "hero:string", 1
    )
    return schemas.EVENTS.replace(schemas.META, meta).replace(
        "price bigint", "price bigint"
    ) + ", _bad string"


def weapon_names(col: Column) -> Column:
    """Weapons as names, from a list of names, a list of objects, or nothing.

    Objects are tried first: parsing them as plain strings would succeed with raw JSON.
    """
    return F.coalesce(
        F.from_json(col, _WEAPON_STRUCTS).getField("name"), F.from_json(col, "array<string>")
    )


def listed_files(spark: SparkSession, path: str) -> DataFrame:
    """Files below ``path`` with path, length and modification time (null if empty); no bytes are read.

    Spark's sources skip empty files; those are the names in its own listing that no source gives a row for.
    """
    files = spark.read.format("binaryFile").load(path)
    full = files.select(
        _same_scheme(F.col("_metadata.file_path")).alias("path"), "length", F.col("modificationTime").alias("modified")
    )
    names = spark.createDataFrame([(f,) for f in files.inputFiles()], "path string")
    empty = names.select(_same_scheme(F.col("path")).alias("path")).join(full.select("path"), "path", "left_anti")
    return full.unionByName(empty.withColumn("length", F.lit(0).cast("long")), allowMissingColumns=True)


def _same_scheme(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "file:///")


def read_lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Non-blank lines of event files: path, part_dir, pos (0-based), line, last.

    Files are read as plain lines, so Spark splits large ones. A line's place is the count of the splits before it
    plus its place in its own split. A file without such lines is a result as well (0 events): it gives one row
    without pos and line. Files are listed once; every name goes through the numbering as a row before the file's
    lines. ``options`` go to the reader.
    """
    files = spark.read.option("lineSep", "\n").options(**options).text(path)
    lines = files.select(
        _same_scheme(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_block_start").alias("__split"),
        F.monotonically_increasing_id().alias("__id"), F.regexp_replace("value", "\r$", "").alias("line"),
    ).where(F.btrim("line") != "")
    names = spark.createDataFrame(pa.table({"path": pa.array(files.inputFiles(), pa.string())})).select(
        _same_scheme(F.col("path")).alias("path"), F.lit(0).cast("long").alias("__split"), F.lit(-1).cast("long").alias("__id"), F.lit(None).cast("string").alias("line")
    )
    one = F.when(F.col("line").isNotNull(), 1).otherwise(0).cast("long")
    placed = scan(
        lines.unionByName(names), Lane(("path",), ("__split", "__id"), 1.0, F.col("__split")), running={"__no": one}, total={"__n": one}
    )
    kept = placed.where(F.col("line").isNotNull() | (F.col("__n") == 0))
    seen = F.col("line").isNotNull()
    return kept.select(
        "path", F.regexp_extract("path", r"([^/]+)/[^/]*$", 1).alias("part_dir"),
        F.when(seen, F.col("__no") - 1).alias("pos"), "line", F.when(seen, F.col("__no") == F.col("__n")).alias("last"),
    )


def parse_lines(lines: DataFrame) -> DataFrame:
    """Lines with the parsed event ``e`` and ``bad`` where the JSON is broken."""
    e = F.from_json(
        "line", _row_schema(), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    )
    rows = lines.withColumn("e", e)
    return rows.withColumn("bad", F.col("line").isNotNull() & F.col("e._bad").isNotNull())


def event_files(parsed: DataFrame) -> DataFrame:
    """One row per file: whether it is a usable result, its count and the source of its first row.

    A broken last line means the writing was cut off: the file is no result. An empty file is one.
    """
    return parsed.groupBy("path", "part_dir").agg(
        (~F.max(F.col("last") & F.col("bad"))).alias("usable_or_null"),
        F.count_if(F.col("line").isNotNull() & ~F.col("bad")).alias("n_events"),
        F.count_if(F.col("bad")).alias("n_bad"),
        F.count("line").alias("n_lines"),
        F.min_by(F.when(~F.col("bad"), F.col("e.src")), F.col("pos")).alias("first_src"),
        F.coalesce(F.max(F.when(F.col("pos") == 0, F.col("bad"))), F.lit(False)).alias("first_bad"),
    ).select(
        "path", "part_dir", F.coalesce("usable_or_null", F.lit(True)).alias("usable"), "n_events",
        "n_bad", "n_lines", "first_src", "first_bad",
    )


def usable_events(parsed: DataFrame) -> DataFrame:
    """Events of usable files without their broken lines: path, part_dir, line_no and the fields."""
    broken = parsed.where(F.col("last") & F.col("bad")).select("path").distinct()
    rows = parsed.where(F.col("line").isNotNull() & ~F.col("bad")).join(broken, "path", "left_anti")
    fields = ["session", "src", "kind", "t_start", "t_end", "detail", "confidence", "price", "price_source"]
    meta = F.col("e.meta").withField("weapons", weapon_names(F.col("e.meta.weapons")))
    hero = F.coalesce(F.get_json_object("e.meta.hero", "$.name"), F.col("e.meta.hero"))
    return rows.select(
        "path", "part_dir", F.col("pos").alias("line_no"), *[F.col(f"e.{f}").alias(f) for f in fields],
        F.when(F.col("e.meta").isNotNull(), meta.withField("hero", hero)).alias("meta"),
    )


def canonical_dir(filename: Column) -> Column:
    return F.concat(tx.slug(clock.stem(filename)), F.lit("_full"))


def resolve_reports(parts: DataFrame, files: DataFrame) -> DataFrame:
    """The event file of each part: the canonical directory first, else the first file (by path)
    whose first row names the part. Unusable files do not count."""
    p = parts.select("session", "src", canonical_dir(F.col("filename")).alias("part_dir"))
    good = files.where("usable")
    own = p.join(good.select("part_dir", "path"), "part_dir").select(
        "session", "src", "path", F.lit(0).alias("prio")
    )
    other = p.drop("part_dir").join(
        good.where((F.col("n_lines") > 0) & ~F.col("first_bad")).select(F.col("first_src").alias("src"), "path"), "src"
    ).select("session", "src", "path", F.lit(1).alias("prio"))
    return own.unionByName(other).groupBy("session", "src").agg(
        F.min_by("path", F.struct("prio", "path")).alias("path")
    )


def resolve_uploads(parts: DataFrame, files: DataFrame) -> DataFrame:
    """The report to upload: canonical (empty or with a readable first line), then other ``_full``
    directories, then any, of those whose first row names the part."""
    p = parts.select("session", "src", canonical_dir(F.col("filename")).alias("own_dir"))
    own = p.join(files.where(~F.col("first_bad")), p["own_dir"] == files["part_dir"]).select(
        "session", "src", "path", F.lit(0).alias("prio")
    )
    named = files.where((F.col("n_lines") > 0) & ~F.col("first_bad"))
    other = p.join(named, p["src"] == named["first_src"]).select(
        "session", "src", "path",
        F.when(F.col("part_dir") == F.col("own_dir"), 0)
        .when(F.col("part_dir").rlike("_full$"), 1).otherwise(2).alias("prio"),
    )
    return own.unionByName(other).groupBy("session", "src").agg(
        F.min_by("path", F.struct("prio", "path")).alias("path")
    )


def part_events(parts: DataFrame, files: DataFrame, events: DataFrame) -> DataFrame:
    """Events of each part from its resolved file, with missing sources filled in."""
    chosen = resolve_reports(parts, files).withColumnRenamed("src", "__src").withColumnRenamed(
        "session", "__session"
    )
    rows = events.join(chosen, "path")
    return rows.withColumn("src", F.coalesce("src", "__src")).withColumn(
        "session", F.coalesce("session", "__session")
    ).drop("__src", "__session")


def missing_parts(parts: DataFrame, scanned: DataFrame) -> DataFrame:
    """Parts without a recorded scan; a scan that found nothing is recorded and counts."""
    return parts.join(scanned.select("src").distinct(), "src", "left_anti")


def pool(events: DataFrame, root: str | None = None) -> DataFrame:
    """Events of ``*_full`` reports with ``safe`` telling whether their source may be used."""
    rows = events.where(F.col("part_dir").rlike("_full$"))
    return rows.withColumn("safe", safety.source_ok(F.col("src"), root))


def dropped_counts(pooled: DataFrame) -> DataFrame:
    return pooled.groupBy("part_dir").agg(
        F.count_if(~F.col("safe")).alias("dropped"), F.count_if(F.col("safe")).alias("kept")
    )


def rounded(events: DataFrame) -> DataFrame:
    """Times to one decimal, as they are stored; joins work on stored times."""
    return events.withColumn("t_start", F.bround("t_start", 1)).withColumn("t_end", F.bround("t_end", 1))


def write_events(events: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines by session; NULL fields are left out, the committer publishes whole files."""
    rounded(events).write.mode(mode).option("ignoreNullFields", "true").partitionBy("session").json(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events as ``write_events`` leaves them, with the session of their folder."""
    return spark.read.schema(schemas.EVENTS).json(path)
