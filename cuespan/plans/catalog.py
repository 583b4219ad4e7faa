"""Session catalog: completeness, manifests, import with source remap, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespan.functions import clock, safety
from cuespan.functions import text as tx
from cuespan.operators.ordered import lane, number_rows
from cuespan.operators.ranged import listing_digests


def first_by_path(df: DataFrame, keys: list[str], path: str = "path") -> DataFrame:
    """One row per key, the first by path."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(path)).alias("__r")).select(
        *keys, "__r.*"
    )


def completeness(
    parts: DataFrame, transcripts: DataFrame, event_files: DataFrame, voice_dirs: DataFrame
) -> DataFrame:
    """Parts with their transcript, event report and voice directory and what is missing.

    ``transcripts`` (game, path, asr_dir), ``event_files`` (src), ``voice_dirs`` (voice_dir).
    """
    t = first_by_path(transcripts.select(F.col("game").alias("src"), "path", "asr_dir"), ["src"])
    e = event_files.select("src").distinct().withColumn("has_events", F.lit(True))
    rows = parts.join(t.drop("path"), "src", "left").join(e, "src", "left")
    rows = rows.withColumn("__vd", tx.slug(F.col("asr_dir"), 40))
    v = voice_dirs.select(F.col("voice_dir").alias("__vd"), "voice_dir").distinct()
    rows = rows.join(v, "__vd", "left").drop("__vd")
    has_events = F.coalesce("has_events", F.lit(False))
    missing = F.array_compact(
        F.array(
            F.when(F.col("asr_dir").isNull(), F.concat("filename", F.lit("：无 ASR 转写"))),
            F.when(~has_events, F.concat("filename", F.lit("：无事件流"))),
        )
    )
    return rows.select(
        "session", "src", "part_seq", "filename", "asr_dir",
        F.when(has_events, F.concat(tx.slug(clock.stem(F.col("filename"))), F.lit("_full"))).alias("events_rpt"),
        "voice_dir", missing.alias("missing"),
    )


def manifests(complete: DataFrame, mode: str, version: str, pushed_at: Column, lines: DataFrame) -> DataFrame:
    """One manifest per session; ``lines`` has session, knockdowns, pickups."""
    part = F.struct(
        "part_seq",
        F.struct(
            F.col("src").alias("client_video"), "filename", "asr_dir", "events_rpt", "voice_dir"
        ).alias("p"),
    )
    rows = complete.groupBy("session").agg(
        F.array_sort(F.collect_list(part)).getField("p").alias("parts"),
        F.flatten(F.array_sort(F.collect_list(F.struct("part_seq", "missing"))).getField("missing")).alias("missing"),
        F.sort_array(F.collect_set("voice_dir")).alias("voice"),
    )
    return rows.join(lines, "session", "left").select(
        F.lit(version).alias("contract_version"), "session", F.lit(mode).alias("mode"),
        pushed_at.alias("pushed_at"), "parts", "missing",
        F.struct("knockdowns", "pickups", "voice").alias("lines"),
    )


def manifest_ok(parts: Column, lines: Column, session: Column) -> Column:
    """Whether every path field of a manifest is one safe piece; one bad field rejects it all."""
    def opt(c: Column) -> Column:
        return c.isNull() | (c == "") | safety.safe_component(c)

    each = F.forall(
        parts,
        lambda p: safety.safe_component(p.getField("filename"))
        & opt(p.getField("asr_dir"))
        & opt(p.getField("events_rpt")),
    )
    voices = F.forall(
        F.coalesce(lines.getField("voice"), F.array().cast("array<string>")), safety.safe_component
    )
    return (
        safety.safe_session(session) & each & voices
        & opt(lines.getField("knockdowns")) & opt(lines.getField("pickups"))
    )


def remap_sources(rows: DataFrame, video_map: DataFrame, column: str = "src") -> DataFrame:
    """Client paths to server paths; server paths stay; ``status`` tells what happened.

    ``video_map`` (session, client_video, server_video) is joined by key; Spark broadcasts it when
    it is under its threshold and sorts it otherwise. Keep rows with status other than ``dropped``.
    """
    by_client = video_map.select(
        "session", F.col("client_video").alias(column), F.col("server_video").alias("__to")
    ).distinct()
    known = video_map.select("session", F.col("server_video").alias(column)).distinct().withColumn(
        "__known", F.lit(True)
    )
    out = rows.join(by_client, ["session", column], "left").join(known, ["session", column], "left")
    status = (
        F.when(F.col("__to").isNotNull(), "remapped")
        .when(F.col("__known"), "unchanged")
        .otherwise("dropped")
    )
    return out.withColumn("status", status).withColumn(column, F.coalesce("__to", column)).drop(
        "__to", "__known"
    ).select(*rows.columns, "status")


def video_map(manifest: DataFrame, server_root: str) -> DataFrame:
    rows = manifest.select("session", F.explode("parts").alias("p"))
    return rows.where(F.coalesce("p.client_video", F.lit("")) != "").select(
        "session", F.col("p.client_video").alias("client_video"),
        F.concat(F.lit(server_root.rstrip("/") + "/sessions/"), "session", F.lit("/video/"),
                 F.col("p.filename")).alias("server_video"),
    )


def merge_state(state: DataFrame, manifest: DataFrame, overwrite: list[str]) -> DataFrame:
    """Session state as a superset of the manifest.

    Manifest fields win, fields only the state has stay, and ``report`` (a server field inside
    lines) survives a manifest without one.
    """
    both = state.alias("s").join(manifest.alias("m"), F.col("s.session") == F.col("m.session"), "full")
    cols = []
    for c in state.columns:
        s, m = F.col(f"s.{c}"), F.col(f"m.{c}") if c in manifest.columns else None
        if m is None:
            cols.append(s.alias(c))
        elif c in overwrite:
            cols.append(F.when(F.col("m.session").isNotNull(), m).otherwise(s).alias(c))
        else:
            cols.append(F.coalesce(m, s).alias(c))
    cols += [F.col(f"m.{c}") for c in manifest.columns if c not in state.columns]
    return both.select(*cols)


def retention(sessions: DataFrame, keep: int = 3, width: float = 86400.0) -> DataFrame:
    """Sessions beyond the newest ``keep`` of their tenant (victims only).

    ``sessions`` has tenant, session, imported_at as ISO text. Positions are counted from the
    newest with the two-level scan, so a tenant with most of the sessions is no special case.
    """
    at = F.coalesce(F.to_timestamp("imported_at"), F.lit("1970-01-01").cast("timestamp"))
    rows = sessions.withColumn("__age", -F.unix_timestamp(at).cast("double"))
    out = number_rows(rows, lane("tenant", ("__age", "session"), width), "newest")
    return out.where(F.col("newest") > keep).drop("__age")


def victim_artifacts(victims: DataFrame) -> DataFrame:
    """(tenant, session, tree, name) that go with each victim; unsafe names are left out.

    ``victims`` has parts (asr_dir, events_rpt) and lines (knockdowns, pickups, report, voice).
    """
    def one(tree: str, name: Column) -> Column:
        return F.struct(F.lit(tree).alias("tree"), name.alias("name"))

    from_parts = F.flatten(
        F.transform(
            "parts",
            lambda p: F.array(one("asr", p.getField("asr_dir")), one("reports", p.getField("events_rpt"))),
        )
    )
    line = F.col("lines")
    from_lines = F.array(
        one("knockdowns", line.getField("knockdowns")), one("pickups", line.getField("pickups")),
        one("game_reports", line.getField("report")),
    )
    voice = F.transform(
        F.coalesce(line.getField("voice"), F.array().cast("array<string>")), lambda v: one("voice", v)
    )
    every = F.concat(F.array(one("sessions", F.col("session"))), from_parts, from_lines, voice)
    rows = victims.select("tenant", "session", F.explode(every).alias("a"))
    return rows.where(safety.safe_component(F.col("a.name"))).select(
        "tenant", "session", "a.tree", "a.name"
    )


def localize_fields(published: DataFrame, remote_root: str, folder: str, columns: list[str]) -> DataFrame:
    return published.select(
        *[
            safety.localize(F.col(c), remote_root, F.col(folder)).alias(c) if c in columns else F.col(c)
            for c in published.columns
        ]
    )


def storage_use(files: DataFrame) -> DataFrame:
    """Bytes per tenant and session of ``.../tenants/<tenant>/(sessions/<session>|data)/...``."""
    path = F.col("path")
    rx = r"/tenants/([^/]+)/(?:sessions/([^/]+)|(data))/"
    rows = files.where(path.rlike(rx)).select(
        F.regexp_extract(path, rx, 1).alias("tenant"),
        F.nullif(F.regexp_extract(path, rx, 2), F.lit("")).alias("session"), "size",
    )
    return rows.groupBy("tenant", "session").agg(F.sum("size").alias("bytes"))


def upload_plan(files: DataFrame, line_of: Column, excludes: dict[str, list[str]]) -> DataFrame:
    """Files to upload after the line's exclusion patterns."""
    keep = F.lit(True)
    for line, patterns in excludes.items():
        keep = keep & ~((line_of == line) & safety.excluded(F.col("rel"), patterns))
    return files.where(keep)


def files_signature(files: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First 16 hex digits of the sha256 over ``path|size|sha`` lines in listing order (ties by line)."""
    line = F.concat_ws("|", F.col("path"), F.col("size").cast("string"), F.col("sha"))
    hashed = listing_digests(files, keys, [F.col(order), line], line, "sha256", sep="\n", name="signature")
    return hashed.withColumn("signature", F.substring("signature", 1, 16))
