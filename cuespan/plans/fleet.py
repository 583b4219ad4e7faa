"""Client fleet: access statistics, rules, configuration layers, pipeline progress, job outcome."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespan import constants as K


def parse_access(lines: DataFrame) -> DataFrame:
    """Access-log lines (value) to ip, day, path, build, os, install; ``bad`` marks others."""
    v = F.col("value")
    path = F.regexp_extract(v, K.ACCESS_LINE, 4)

    def param(name: str, pattern: str) -> Column:
        return F.nullif(F.regexp_extract(path, f"[?&]{name}=({pattern})", 1), F.lit(""))

    stamp = F.regexp_extract(F.regexp_extract(v, K.ACCESS_LINE, 2), r"^(\d{1,2}/[A-Za-z]{3}/\d{4})", 1)
    ok = v.rlike(K.ACCESS_LINE)
    return lines.select(
        (~ok).alias("bad"),
        F.regexp_extract(v, K.ACCESS_LINE, 1).alias("ip"),
        F.try_to_timestamp(stamp, F.lit("d/MMM/yyyy")).cast("date").alias("day"),
        path.alias("path"),
        F.coalesce(param("build", K.BUILD_PARAM), F.lit("unknown")).alias("build"),
        param("os", K.OS_PARAM).alias("os"),
        param("install", K.INSTALL_PARAM).alias("install"),
    )


def client_hits(parsed: DataFrame) -> DataFrame:
    return parsed.where(~F.col("bad") & F.contains("path", F.lit(K.ACCESS_LOCATION)))


def line_counts(parsed: DataFrame) -> DataFrame:
    hit = ~F.col("bad") & F.contains("path", F.lit(K.ACCESS_LOCATION))
    return parsed.agg(F.count_if(hit).alias("total"), F.count_if(F.col("bad")).alias("bad"))


def daily_actives(hits: DataFrame, who: str = "ip") -> DataFrame:
    return hits.groupBy("day").agg(F.count_distinct(who).alias("active"))


def last_days(daily: DataFrame, n: int) -> DataFrame:
    """The last n days that are present in the data."""
    return daily.orderBy(F.col("day").desc()).limit(n)


def build_actives(hits: DataFrame, days: int | None = None, top: int = 20) -> DataFrame:
    """Distinct addresses per build, the ``top`` largest; ``days`` keeps the last days present.

    The day window trims daily counts and builds; platforms and installs always cover all days.
    """
    rows = hits
    if days:
        keep = last_days(hits.select("day").distinct(), days)
        rows = hits.join(keep, "day", "left_semi")
    return rows.groupBy("build").agg(F.count_distinct("ip").alias("active")).orderBy(
        F.col("active").desc(), "build"
    ).limit(top)


def platform_actives(hits: DataFrame) -> DataFrame:
    return hits.where(F.col("os").isNotNull()).groupBy("os").agg(F.count_distinct("ip").alias("active"))


def installs(hits: DataFrame) -> DataFrame:
    """Distinct install ids in total, per day and per build (one row each, ``scope`` tells which)."""
    rows = hits.where(F.col("install").isNotNull()).select("day", "build", "install")
    sets = rows.groupingSets([[], ["day"], ["build"]], "day", "build").agg(
        F.count_distinct("install").alias("installs"), F.grouping_id().alias("g")
    )
    scope = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "day").otherwise("build")
    return sets.select(scope.alias("scope"), "day", "build", "installs")


def clamp_rules(rules: DataFrame, spec: Sequence[tuple] = tuple(K.RULE_SPEC)) -> DataFrame:
    """Known keys of (key, value) with values cast and clamped; wrong types are left out."""
    spark = rules.sparkSession
    table = spark.createDataFrame(
        [(k, t, float(lo), float(hi)) for k, t, lo, hi in spec], "key string, type string, lo double, hi double"
    )
    rows = rules.join(F.broadcast(table), "key")
    whole = F.when(F.col("value").rlike(r"^\s*[+-]?\d+\s*$"), F.btrim("value").try_cast("double"))
    v = F.when(F.col("type") == "int", whole).otherwise(F.col("value").try_cast("double"))
    return rows.withColumn("v", v).where(F.col("v").isNotNull()).select(
        *[c for c in rules.columns if c != "value"], F.greatest("lo", F.least("hi", "v")).alias("value")
    )


def layered(rows: DataFrame, keys: list[str], layer: str, values: list[str]) -> DataFrame:
    """Per key the values of the highest layer (later layers override earlier ones)."""
    top = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col(layer)).alias("__v"))
    return top.select(*keys, "__v.*")


# --- pipeline progress --------------------------------------------------------------------------


def parse_progress(lines: DataFrame, name_length: int | None = None) -> DataFrame:
    """Log lines (session, ts, line) to marks: skip, start, done, parts, detected, knocked, end.

    Lines of one second share ``ts``; a ``line_no`` column, if there is one, says which came first. A part is
    known by its whole name, or by its first ``name_length`` characters.
    """
    s = F.btrim("line")
    body = F.when(s.rlike(K.PIPELINE_LINE), F.btrim(F.regexp_extract(s, K.PIPELINE_LINE, 1))).otherwise(s)
    stages = "|".join(K.STAGES)
    of_stage = {m: p.replace("STAGE", stages) for m, p in (("skip", K.SKIP_MARK), ("start", K.START_MARK), ("done", K.DONE_MARK))}
    of_part = {"detected": K.DETECTED_MARK, "knocked": K.KNOCKED_MARK}
    marks = [*of_stage.items(), ("parts", K.PARTS_MARK), *of_part.items()]
    mark = F.coalesce(*[F.when(body.rlike(p), m) for m, p in marks], F.when(F.startswith(body, F.lit(K.END_MARK)), "end"))
    stage = F.coalesce(*[F.when(body.rlike(p), F.regexp_extract(body, p, 1)) for p in of_stage.values()])
    shard = F.coalesce(*[F.when(body.rlike(p), F.regexp_extract(body, p, 1)) for p in of_part.values()])
    if name_length is not None:
        shard = F.substring(shard, 1, name_length)
    n = F.when(body.rlike(K.PARTS_MARK), F.regexp_extract(body, K.PARTS_MARK, 2).try_cast("int"))
    line_no = F.col("line_no").cast("long") if "line_no" in lines.columns else F.lit(0).cast("long")
    return lines.select(
        "session", "ts", line_no.alias("line_no"), mark.alias("mark"), stage.alias("stage"), shard.alias("shard"), n.alias("n")
    ).where(F.col("mark").isNotNull())


def stage_states(marks: DataFrame) -> DataFrame:
    """Latest state per session and stage."""
    rows = marks.where(F.col("stage").isNotNull())
    return rows.groupBy("session", "stage").agg(
        F.max_by("mark", F.struct("ts", "line_no")).alias("state"), F.max("ts").alias("ts")
    )


def with_durations(marks: DataFrame, durations: DataFrame | None) -> DataFrame:
    """Marks with ``sec``, the length of the part that they name, and ``all_s``, that of the session's parts.

    ``durations`` (session, filename, duration_s) is a table; the marks may be a stream.
    """
    none = F.lit(None).cast("double")
    if durations is None:
        return marks.withColumns({"sec": none, "all_s": none})
    d = durations.groupBy("session", F.col("filename").alias("shard")).agg(F.sum("duration_s").alias("sec"))
    return marks.join(d, ["session", "shard"], "left").join(d.groupBy("session").agg(F.sum("sec").alias("all_s")), "session", "left")


def tallies(marks: DataFrame) -> DataFrame:
    """What the fraction depends on, a row a session: stage states, parts, finished parts and their seconds."""
    states = stage_states(marks).groupBy("session").agg(F.map_from_entries(F.collect_list(F.struct("stage", "state"))).alias("states"))
    at = F.struct("ts", "line_no")
    of = {m: F.col("mark") == m for m in ("parts", "detected", "knocked", "end")}
    seen = marks.where(of["detected"]).groupBy("session", "shard").agg(F.max("sec").alias("sec"))
    done = seen.groupBy("session").agg(F.sum("sec").alias("done_s"))
    counts = marks.groupBy("session").agg(
        F.max_by("n", F.when(of["parts"], at)).alias("parts"), F.max(of["parts"]).alias("known"),
        F.count_distinct(F.when(of["detected"], F.col("shard"))).alias("det"),
        F.count_distinct(F.when(of["knocked"], F.col("shard"))).alias("kd"),
        F.max(of["end"]).alias("ended"), F.min("ts").alias("t_first"), F.max("ts").alias("t_last"),
        F.max_by(F.struct("mark", "stage"), F.when(F.col("mark").isin("start", "done"), at)).alias("latest"), F.max("all_s").alias("all_s"),
    )
    return counts.join(states, "session", "left").join(done, "session", "left")


def fraction_of(rows: DataFrame, by_duration: bool = False) -> DataFrame:
    """``session``, ``cur``, ``frac``, ``eta_sec`` of tallies, which a table or a stream gives."""
    # columns of their own: looked up in every expression, they make more code than Java takes
    rows = rows.withColumns({f"__{x}": F.try_element_at("states", F.lit(x)) for x in K.STAGES})
    state = {x: F.col(f"__{x}") for x in K.STAGES}
    if by_duration:
        state["download"] = F.coalesce(state["download"], F.when(F.col("known"), "skip"))
    finished = sum((F.when(state[x].isin("done", "skip"), w).otherwise(0.0) for x, w in K.STAGE_WEIGHTS.items()), F.lit(0.0))
    if by_duration:
        cur = F.coalesce(*[F.when(state[x] == "start", x) for x in K.STAGES])
    else:
        cur = F.when(F.col("latest.mark") == "start", F.col("latest.stage"))
    rows = rows.withColumns({"cur": cur, "done": finished})
    share = F.least(F.lit(1.0), F.col("det") / F.col("parts"))
    if by_duration:
        by_sec = F.least(F.lit(1.0), F.coalesce("done_s", F.lit(0.0)) / F.col("all_s"))
        share = F.when(F.coalesce("all_s", F.lit(0.0)) > 0, by_sec).otherwise(share)
    cur_w = F.element_at(F.create_map(*[F.lit(x) for kv in K.STAGE_WEIGHTS.items() for x in kv]), F.col("cur"))
    running = (
        F.when((F.col("cur") == "detect") & share.isNotNull(), cur_w * share)
        .when((F.col("cur") == "knockdowns") & F.col("parts").isNotNull(), cur_w * F.least(F.lit(1.0), F.col("kd") / F.col("parts")))
    )
    half = cur_w * 0.5
    if by_duration:
        half = F.when(F.col("cur") != "detect", half)
    frac = F.least(F.lit(0.99), F.col("done") + F.coalesce(running, half, F.lit(0.0)))
    if by_duration:
        frac = F.when(F.col("ended"), 1.0).otherwise(frac)
    floor = 0.03 if by_duration else 0.05
    spent = (F.unix_micros("t_last") - F.unix_micros("t_first")) / 1e6
    eta = F.when(frac >= floor, spent * (1 - frac) / frac)
    return rows.select("session", "cur", frac.alias("frac"), eta.alias("eta_sec"))


def progress(marks: DataFrame, durations: DataFrame | None = None, by_duration: bool = False) -> DataFrame:
    """Fraction done per session, from stage weights and finished parts.

    Plain variant: parts counted, capped at 0.99. With ``by_duration`` detection is weighted by the
    seconds of the finished parts (``durations``: session, filename, duration_s; parts counted
    where a session has none), a known session without a download stage counts it as skipped, and a
    finished chain is 1.0.
    """
    return fraction_of(tallies(with_durations(marks, durations if by_duration else None)), by_duration)


def outcome(history: DataFrame, timeout_sec: float = 3600.0) -> DataFrame:
    """First terminal state per upload, ``timeout`` where none came in time.

    ``history`` has upload_id, asked_at (start of the wait, seconds), at (seconds), state.
    """
    due = F.col("at") <= F.col("asked_at") + timeout_sec
    end = F.when(F.col("state").isin("done", "failed") & due, F.col("at"))
    return history.groupBy("upload_id").agg(
        F.coalesce(F.min_by("state", end), F.lit("timeout")).alias("outcome"), F.min(end).alias("at")
    )


def repair_mojibake(lines: DataFrame, column: str = "line") -> DataFrame:
    """Undo GBK text read as UTF-8 where that gives more Chinese characters.

    A line of plain ASCII reads the same in both and never leaves the JVM. The others meet the
    codec, which Spark lacks, as whole Arrow columns. Lost characters show as a square.
    """
    text = F.col(column)
    foreign = F.coalesce(text.rlike(r"[^\x00-\x7F]"), F.lit(False))
    lost = "\ufffd"

    def in_gbk(column: pa.Array) -> pa.Array:
        marked = pc.replace_substring(column, lost, "\0")  # a byte that is the same in both codes
        read = pa.array([b.decode("gbk", "replace") for b in marked.cast(pa.binary()).to_pylist()], pa.string())
        return pc.replace_substring(read, "\0", K.LOST_CHARACTER)

    def chinese(c: Column) -> Column:
        return F.length(c) - F.length(F.regexp_replace(c, "[一-鿿]", ""))

    shown = F.replace(text, F.lit(lost), F.lit(K.LOST_CHARACTER))
    odd = lines.where(foreign).withColumn("__gbk", F.arrow_udf(in_gbk, "string")(text))
    better = (F.btrim(text) != "") & (chinese(F.col("__gbk")) > chinese(shown))
    mended = odd.withColumn(column, F.when(F.btrim(text) == "", text).when(better, F.col("__gbk")).otherwise(shown)).drop("__gbk")
    return lines.where(~foreign).unionByName(mended)


def log_tail(lines: DataFrame, keys: list[str], pos: str, limit: int = 512 * 1024) -> DataFrame:
    """Last lines of each file within ``limit`` bytes, cut at a line start.

    Bytes are counted from the end with the two-level scan over line positions.
    """
    from cuespan.operators.ordered import lane, scan

    rows = lines.withColumn("__p", -F.col(pos).cast("double"))
    size = (F.octet_length("line") + 1).cast("long")
    rows = scan(rows, lane(keys, ("__p",), 4096.0), running={"__b": size}, total={"__a": size})
    # an over-long file loses everything up to its first line break inside the tail
    keep = (F.col("__a") <= limit) | (F.col("__b") < limit)
    return rows.where(keep).drop("__p", "__b", "__a")


