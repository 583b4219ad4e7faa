"""Listings, transcripts, labels, logs and clip indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuespan import constants as K
from cuespan import schemas
from cuespan.functions import clock
from cuespan.operators.ordered import lane, number_rows
from cuespan.sources import documents


def list_videos(spark: SparkSession, path: str) -> DataFrame:
    """Video files in part order (length of the stem, then name); file bytes are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return video_order(files.select("path", "length", "modificationTime"))


def video_order(files: DataFrame) -> DataFrame:
    """Folder-wise numbered videos: P2 comes before P10."""
    rows = files.where(clock.suffix(F.col("path")).isin(K.VIDEO_SUFFIXES)).withColumn(
        "folder", F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    ).withColumn("name", clock.base_name(F.col("path")))
    rows = rows.withColumn("__len", F.length(clock.stem(F.col("path"))).cast("double"))
    return number_rows(rows, lane("folder", ("__len", "name"), 1.0), "part_seq").drop("__len")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Transcript files to sentence rows; a file is an object with sentences or a bare list."""
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), "value"
    )
    return parse_transcripts(files)


def parse_transcripts(files: DataFrame) -> DataFrame:
    doc = F.from_json("value", schemas.TRANSCRIPT)
    bare = F.from_json(
        "value", "array<struct<id:int,start:double,end:double,text:string,speaker:string>>"
    )
    rows = files.select(
        "path", F.regexp_extract("path", r"([^/]+)/[^/]*$", 1).alias("asr_dir"),
        doc.getField("game").alias("game"), doc.getField("duration_s").alias("duration_s"),
        F.when(F.startswith(F.btrim("value"), F.lit("[")), bare).otherwise(
            doc.getField("sentences")
        ).alias("sentences"),
    )
    return rows.select(
        "path", "asr_dir", "game", "duration_s", F.posexplode("sentences").alias("pos", "s")
    ).select("path", "asr_dir", "game", "duration_s", "pos", "s.*")


def parse_labels(files: DataFrame) -> DataFrame:
    """(session, value) label maps to one row per clip file."""
    kind = "map<string,struct<picked:boolean,verdict:string,score_override:double>>"
    return files.select("session", F.explode(F.from_json("value", kind)).alias("file", "l")).select(
        "session", "file", "l.*"
    )


def label_tally(clips: DataFrame, labels: DataFrame) -> DataFrame:
    """Clips, thumbs up and thumbs down per session."""
    rows = clips.select("session", "file").join(labels, ["session", "file"], "left")
    return rows.groupBy("session").agg(
        F.count("*").alias("clips"), F.count_if(F.col("verdict") == "up").alias("up"),
        F.count_if(F.col("verdict") == "down").alias("down"),
    )


def access_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def voice_scores(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All voice indexes, one row per clip, clip files tagged with their session folder."""
    rows = spark.read.schema(schema).option("multiLine", "true").json(path).withColumn(
        "folder", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]*$", 1)
    )
    return rows.select("session", "folder", F.explode("clips").alias("c")).select(
        "session", "folder", "c.*", F.concat_ws("/", "folder", "c.file").alias("audio_file")
    )


def clip_index(clips: DataFrame, order: str, columns: list[str] | None = None) -> DataFrame:
    """One nested document per session with its clips in order."""
    cols = columns or [c for c in clips.columns if c not in ("session", order)]
    entry = F.struct(F.col(order), F.struct(*cols).alias("c"))
    return clips.groupBy("session").agg(
        F.array_sort(F.collect_list(entry)).getField("c").alias("clips")
    )


def pickup_document(index: DataFrame, rows: DataFrame, matches: DataFrame, parts: DataFrame) -> DataFrame:
    """Pickup index of a session: matches, clips and the sessions left out as lobby."""
    clips = clip_index(index, "seq")
    m = matches.groupBy("session").agg(
        F.array_sort(F.collect_list(F.struct("no", "enter", "dur", "ok", "profit", "downs", "loots"))).alias("matches")
    )
    part = parts.select("session", "src", clock.part_no(F.col("filename")).alias("part"))
    lobby = rows.where("lobby").join(part, ["session", "src"]).groupBy("session").agg(
        F.array_sort(F.collect_list(F.struct("part", F.bround("t_start", 1).alias("t_start"), "label"))).alias("lobby_skipped")
    )
    return clips.join(m, "session", "full").join(lobby, "session", "left")


def edl_document(segs: DataFrame, stats: DataFrame, template: str, resolution: Column) -> DataFrame:
    """Edit decision list per session with the statistics of its pool."""
    cols = [c for c in segs.columns if c not in ("session", "seg", "t0", "t1", "cap", "ins", "hook")]
    body = segs.groupBy("session").agg(
        F.array_sort(F.collect_list(F.struct("seg", F.struct(*cols).alias("s")))).getField("s").alias("segments")
    )
    return body.join(stats, "session").select(
        "session", F.lit(template).alias("template"), resolution.alias("resolution"),
        F.struct("n_down", "n_extract_ok", "n_events").alias("pool_stats"), "segments",
    )


def clip_document_lines(clips: DataFrame, place: str, columns: list[str]) -> DataFrame:
    """Clip index of each session as the lines of a document: number of clips, then the clips."""
    heads = clips.groupBy("session").agg(F.count("*").alias("n"))
    return documents.json_lines(heads, {"clips": (clips.select("session", place, *columns), place)})


def edl_document_lines(segs: DataFrame, stats: DataFrame, template: str, resolution: Column) -> DataFrame:
    """Edit decision list of each session with segments, as the lines of a document."""
    heads = stats.join(segs.select("session"), "session", "left_semi").select(
        "session", F.lit(template).alias("template"), resolution.alias("resolution"),
        F.struct("n_down", "n_extract_ok", "n_events").alias("pool_stats"),
    )
    cols = [c for c in segs.columns if c not in ("t0", "t1", "cap", "ins", "hook")]
    return documents.json_lines(heads, {"segments": (segs.select(*cols, F.col("seg").alias("__place")), "__place")})


def voice_document_lines(clips: DataFrame) -> DataFrame:
    """Voice index of each session: its number of clips, then the clips in their places."""
    return clip_document_lines(clips, "place", [c for c in clips.columns if c not in ("session", "place")])
