"""The given tables seen as the library's input tables, in Spark and as SQL.

Users are sources, sixteen interleaved groups of users are sessions, and an hour of the event log is
a second of the recording, so that the default gaps and windows mean something. Everything is whole:
no rows are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SESSIONS = 16
DURATION = 720.0
HALLS = ["背包", "口袋", "安全箱"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def micros() -> Column:
    return F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")


def _case(k: Column, values: list) -> Column:
    out = None
    for i, v in enumerate(values):
        cond = k % len(values) == i
        out = F.when(cond, v) if out is None else out.when(cond, v)
    return out


def timeline(spark: SparkSession, sf: str, with_gear: bool = False) -> DataFrame:
    """Events as typed timeline events with meta."""
    e = table(spark, sf, "events").select(
        F.concat(F.lit("s"), (F.col("user_id") % SESSIONS).cast("string")).alias("session"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("src"),
        F.concat(F.lit("d"), F.col("user_id").cast("string"), F.lit("_full")).alias("part_dir"),
        F.col("event_id").alias("line_no"), "event_type", "value",
        (F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts) div 360000000") / F.lit(10.0)).alias("t_start"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    k = F.col("k")
    kind = (
        F.when(F.col("event_type") == "signup", "match_start").when(F.col("event_type") == "purchase", "loot")
        .when(F.col("event_type") == "error", "down").when(F.col("event_type") == "view", "extract")
        .otherwise("dance")
    )
    e = e.withColumn("kind", kind)
    is_kind = {x: F.col("kind") == x for x in ("match_start", "loot", "down", "extract", "dance")}
    target = F.concat(F.lit("T"), (k % 7).cast("string"))
    prev, cur = k % 10, k % 10 + 1 + k % 2
    hall = _case(k, HALLS)
    detail = (
        F.when(is_kind["down"], F.concat(F.lit("击倒 "), target))
        .when(is_kind["match_start"], "进入对局（部署）")
        .when(is_kind["loot"], F.concat(hall, F.lit(" "), prev.cast("string"), F.lit("->"), cur.cast("string")))
        .when(is_kind["extract"], F.when(k % 4 != 0, "撤离成功").otherwise("撤离失败"))
        .otherwise("跳舞")
    )
    loot, ext, down = is_kind["loot"], is_kind["extract"], is_kind["down"]
    profit = F.when(k % 6 == 0, "").otherwise(
        F.concat(k.cast("string"), F.lit(","), F.lpad(((k * 7) % 1000).cast("string"), 3, "0"))
    )
    none = F.lit(None)
    hint = F.when(loot & (k % 4 == 0), F.array(F.concat(F.lit("出金了 "), k.cast("string"))))
    meta = F.struct(
        F.when(down, target).alias("target"),
        F.when(down, F.concat(F.when(k % 3 == 0, "击中头部 ").otherwise("击倒 "), target)).alias("text"),
        F.when(ext, profit).alias("profit"),
        F.when(ext, F.when(k % 5 == 0, "三").otherwise((k % 12).cast("string"))).alias("kills_official"),
        F.when(loot, hall).alias("container"), F.when(loot, prev).alias("prev"), F.when(loot, cur).alias("cur"),
        F.when(loot, F.when(k % 5 == 0, F.array(F.lit("金条"), F.lit("x"))).otherwise(F.array(F.lit("杂物")))).alias("context"),
        hint.alias("voice_hint"),
        none.cast("string").alias("hero"), none.cast("array<string>").alias("weapons"),
        none.cast("string").alias("operator"), none.cast("string").alias("operator_class"),
        none.cast("string").alias("primary_weapon"),
    )
    out = e.select(
        "session", "src", "part_dir", "line_no", "kind", "t_start",
        (F.col("t_start") + (F.col("line_no") % 4) * 0.5).alias("t_end"), detail.alias("detail"),
        F.col("value").alias("confidence"),
        F.when(loot & (k % 3 != 0), ((k * 37) % 50 * 100000).cast("long")).alias("price"),
        F.when(loot & (k % 3 != 0), "table").alias("price_source"),
        hint.alias("voice_hint"), meta.alias("meta"), "k",
    )
    if not with_gear:
        return out
    op = _case(k, ["红狼", "骇爪", "蜂医"])
    gear = out.where((F.col("kind") == "match_start") & (k % 2 == 0)).withColumn("kind", F.lit("loadout")).withColumn(
        "meta",
        F.col("meta").withField("operator", op).withField("hero", op)
        .withField("operator_class", _case(k, ["突击", "侦察", "支援"]))
        .withField("primary_weapon", _case(k, ["M4A1", "AKM", "MP5", "P90"]))
        .withField("weapons", F.array(_case(k, ["M4A1", "AKM", "MP5", "P90"]), _case(k + 1, ["AKM", "M700"]))),
    )
    return out.unionByName(gear)


TL = """tl AS (
  SELECT 's' || (user_id % 16) AS session, 'u' || user_id AS src, 'd' || user_id || '_full' AS part_dir,
    event_id AS line_no, value AS confidence, user_id,
    CAST((epoch_us(ts) - 1704067200000000) // 360000000 AS DOUBLE) / CAST(10 AS DOUBLE) AS t_start,
    CAST((epoch_us(ts) - 1704067200000000) // 360000000 AS DOUBLE) / CAST(10 AS DOUBLE)
      + (event_id % 4) * CAST(0.5 AS DOUBLE) AS t_end,
    CAST(json_extract_string(props, '$.k') AS INT) AS k,
    CASE event_type WHEN 'signup' THEN 'match_start' WHEN 'purchase' THEN 'loot' WHEN 'error' THEN 'down'
      WHEN 'view' THEN 'extract' ELSE 'dance' END AS kind,
    CASE WHEN event_type = 'purchase' AND CAST(json_extract_string(props, '$.k') AS INT) % 3 <> 0
      THEN CAST((CAST(json_extract_string(props, '$.k') AS INT) * 37) % 50 * 100000 AS BIGINT) END AS price,
    CASE WHEN event_type = 'purchase' AND CAST(json_extract_string(props, '$.k') AS INT) % 4 = 0
      THEN '出金了 ' || CAST(json_extract_string(props, '$.k') AS INT) END AS hint,
    CASE WHEN event_type = 'view' THEN CAST(json_extract_string(props, '$.k') AS INT) % 4 <> 0 END AS ok,
    ['背包', '口袋', '安全箱'][CAST(json_extract_string(props, '$.k') AS INT) % 3 + 1] AS hall,
    'T' || (CAST(json_extract_string(props, '$.k') AS INT) % 7) AS target
  FROM events)"""


def parts(spark: SparkSession, sf: str) -> DataFrame:
    """One part per user; every eleventh has no clock in its name."""
    u = F.col("user_id")
    stamp = F.format_string(" 21日%02d点%02d分", u * 5 % 24, u * 7 % 60)
    name = F.concat(F.lit("s"), (u % SESSIONS).cast("string"), F.lit(" P"), u.cast("string"))
    return table(spark, sf, "events").select("user_id").distinct().select(
        F.concat(F.lit("s"), (u % SESSIONS).cast("string")).alias("session"),
        F.concat(F.lit("u"), u.cast("string")).alias("src"),
        F.concat(name, F.when(u % 11 == 0, "").otherwise(stamp), F.lit(".mp4")).alias("filename"),
        u.cast("int").alias("part_seq"), F.lit(DURATION).alias("duration_s"),
    )


PARTS = """parts AS (
  SELECT DISTINCT 's' || (user_id % 16) AS session, 'u' || user_id AS src, user_id AS part_seq,
    CASE WHEN user_id % 11 <> 0 THEN (user_id * 5 % 24) * 3600 + (user_id * 7 % 60) * 60 END AS clock,
    CAST(720 AS DOUBLE) AS duration_s, CAST(user_id AS VARCHAR) AS part
  FROM events)"""

BASES = PARTS + """, stamped AS (
  SELECT session, src, clock, row_number() OVER (PARTITION BY session ORDER BY part_seq) AS rn
  FROM parts WHERE clock IS NOT NULL),
fold AS (
  SELECT session, src, rn, clock AS base FROM stamped WHERE rn = 1
  UNION ALL
  SELECT s.session, s.src, s.rn, CASE WHEN s.clock < f.base - 43200 THEN s.clock + 86400 ELSE s.clock END
  FROM fold f JOIN stamped s ON s.session = f.session AND s.rn = f.rn + 1),
zeroed AS (
  SELECT session, src, coalesce(clock, 0) AS clock, row_number() OVER (PARTITION BY session ORDER BY part_seq) AS rn
  FROM parts),
zfold AS (
  SELECT session, src, rn, clock AS base FROM zeroed WHERE rn = 1
  UNION ALL
  SELECT s.session, s.src, s.rn, CASE WHEN s.clock < f.base - 43200 THEN s.clock + 86400 ELSE s.clock END
  FROM zfold f JOIN zeroed s ON s.session = f.session AND s.rn = f.rn + 1)"""


def readings(spark: SparkSession, sf: str) -> DataFrame:
    """Events as text readings, five hours to a frame, so frames hold several texts."""
    k, i = F.col("k"), F.col("event_id")
    e = table(spark, sf, "events").select(
        F.concat(F.lit("s"), (F.col("user_id") % SESSIONS).cast("string")).alias("session"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("src"), "event_id", "event_type", "value",
        (F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts) div 18000000000") * F.lit(5.0)).alias("t"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    text = (
        F.when(F.col("event_type") == "signup", _case(k, ["即将着陆", "匹配中", "出发", "开始游戏"]))
        .when(F.col("event_type") == "error", F.concat(F.lit("击倒 T"), (k % 7).cast("string"), F.lit("号")))
        .when(F.col("event_type") == "purchase", _case(k, ["撤离成功", "撤离失败", "撤离点 B", "收益 12,345", "1:02:03", "击败干员三", "金条", "跳舞"]))
        .when(F.col("event_type") == "click", F.concat(_case(k, HALLS), F.lit("："), (k % 20).cast("string"), F.lit("/30")))
        .otherwise(_case(k, ["M4A1", "红狼", "出战干员切换为骇爪", "大红", "电竞冠军", "杂物"]))
    )
    return e.select(
        "session", "src", "t", i.cast("int").alias("seq"), text.alias("text"),
        ((k % 10) / 10.0).alias("score"), (F.lit(1920) * ((i * 37 % 100) / 100.0)).alias("cx"),
        (F.lit(1080) * ((i * 53 % 100) / 100.0)).alias("cy"), ((i % 400)).cast("double").alias("box_w"),
        ((i % 50)).cast("double").alias("box_h"), F.lit(1920).alias("frame_w"), F.lit(1080).alias("frame_h"),
    )


RD = """rd AS (
  SELECT session, src, t, seq, score, cx, cy, box_w, box_h, k,
    CASE event_type
      WHEN 'signup' THEN ['即将着陆', '匹配中', '出发', '开始游戏'][k % 4 + 1]
      WHEN 'error' THEN '击倒 T' || (k % 7) || '号'
      WHEN 'purchase' THEN ['撤离成功', '撤离失败', '撤离点 B', '收益 12,345', '1:02:03', '击败干员三', '金条', '跳舞'][k % 8 + 1]
      WHEN 'click' THEN ['背包', '口袋', '安全箱'][k % 3 + 1] || '：' || (k % 20) || '/30'
      ELSE ['M4A1', '红狼', '出战干员切换为骇爪', '大红', '电竞冠军', '杂物'][k % 6 + 1] END AS text,
    CASE WHEN event_type = 'click' THEN ['背包', '口袋', '安全箱'][k % 3 + 1] END AS container,
    CASE WHEN event_type = 'click' THEN k % 20 END AS cur,
    cx / 1920 BETWEEN CAST(0.35 AS DOUBLE) AND CAST(0.64 AS DOUBLE)
      AND cy / 1080 BETWEEN CAST(0.28 AS DOUBLE) AND CAST(0.88 AS DOUBLE) AS band
  FROM (
    SELECT 's' || (user_id % 16) AS session, 'u' || user_id AS src, event_type, event_id AS seq,
      CAST((epoch_us(ts) - 1704067200000000) // 18000000000 AS DOUBLE) * 5 AS t,
      CAST(json_extract_string(props, '$.k') AS INT) AS k,
      CAST(json_extract_string(props, '$.k') AS INT) % 10 / CAST(10 AS DOUBLE) AS score,
      1920 * (event_id * 37 % 100 / CAST(100 AS DOUBLE)) AS cx, 1080 * (event_id * 53 % 100 / CAST(100 AS DOUBLE)) AS cy,
      CAST(event_id % 400 AS DOUBLE) AS box_w, CAST(event_id % 50 AS DOUBLE) AS box_h
    FROM events))"""


def sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as spoken sentences, 50 characters a second, with some exclamations added."""
    c = table(spark, sf, "conversations")
    n, conv = F.length("text"), F.col("conv_id")
    extra = F.concat(
        F.when(n % 3 == 0, "啊啊啊啊").otherwise(""), F.when(n % 5 == 0, "牛牛").otherwise(""),
        F.when(n % 4 == 0, "卧槽").otherwise(""),
    )
    start = F.col("turn") * 20.0 + (conv % 5) * 0.5
    said = F.when(n % 7 == 0, F.concat(F.lit("出金"), "text")).otherwise(F.concat("text", extra))
    return c.select(
        F.concat(F.lit("s"), (conv % SESSIONS).cast("string")).alias("session"),
        F.concat(F.lit("u"), conv.cast("string")).alias("src"), F.col("turn").cast("int").alias("id"),
        start.alias("start"), (start + n / 50.0).alias("end"), said.alias("text"),
        F.when(F.col("role") == "user", "host").when(F.col("role") == "assistant", "other").alias("speaker"),
    )


SE = """se AS (
  SELECT session, src, id, start, start + n / CAST(50 AS DOUBLE) AS "end", speaker,
    CASE WHEN n % 7 = 0 THEN '出金' || raw
      ELSE raw || CASE WHEN n % 3 = 0 THEN '啊啊啊啊' ELSE '' END || CASE WHEN n % 5 = 0 THEN '牛牛' ELSE '' END
        || CASE WHEN n % 4 = 0 THEN '卧槽' ELSE '' END END AS text
  FROM (
    SELECT 's' || (conv_id % 16) AS session, 'u' || conv_id AS src, turn AS id, text AS raw, length(text) AS n,
      CAST(turn * 20 AS DOUBLE) + (conv_id % 5) * CAST(0.5 AS DOUBLE) AS start,
      CASE role WHEN 'user' THEN 'host' WHEN 'assistant' THEN 'other' END AS speaker
    FROM conversations))"""


def durations(spark: SparkSession, sf: str) -> DataFrame:
    s = sentences(spark, sf)
    return s.groupBy("session", "src").agg((F.max("end") + 4.0).alias("duration_s"))


def audio(spark: SparkSession, sf: str) -> DataFrame:
    """Quarter-second loudness and pitch over the length of each conversation; the values are made up by rule."""
    d = durations(spark, sf).withColumn("c", F.expr("cast(substring(src, 2) as bigint)"))
    bins = d.select(
        "session", "src", "c",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("duration_s") * 4) - 1)).alias("b"),
    )
    loud = ((F.col("c") * 7919 + F.col("b") * 104729) % 1000 + 1) / 1000.0
    pitch = (F.col("c") * 31 + F.col("b") * 17) % 300 + 80
    return bins.select(
        "session", "src", F.col("b").alias("bin"), loud.alias("rms"),
        F.when(loud >= 0.2, pitch.cast("double")).alias("f0"),
    )


AU = SE + """, du AS (SELECT session, src, max("end") + 4 AS duration_s FROM se GROUP BY ALL),
au AS (
  SELECT session, src, b AS bin, ((c * 7919 + b * 104729) % 1000 + 1) / CAST(1000 AS DOUBLE) AS rms,
    CASE WHEN ((c * 7919 + b * 104729) % 1000 + 1) / CAST(1000 AS DOUBLE) >= CAST(0.2 AS DOUBLE)
      THEN CAST((c * 31 + b * 17) % 300 + 80 AS DOUBLE) END AS f0
  FROM (SELECT session, src, CAST(substring(src, 2) AS BIGINT) AS c,
      unnest(range(CAST(floor(duration_s * 4) AS BIGINT))) AS b FROM du))"""


def files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as files of watched folders: loose, one level down, or two levels down."""
    d = F.col("doc_id")
    root = F.concat(F.lit("/w/"), F.col("source"))
    name = F.concat(F.lit("a P"), (d % 13).cast("string"), F.lit("_"), d.cast("string"), F.when(F.col("lang") == "de", ".txt").otherwise(".mp4"))
    sub = _case(d, ["", "A/", "A/x/", "B/", "C/y/z/"])
    return table(spark, sf, "documents").select(
        root.alias("root"), F.concat(root, F.lit("/"), sub, name).alias("path"), F.col("n_chars").alias("size"),
        (d * 7919 % 200000).cast("double").alias("mtime"), (F.col("lang") != "de").alias("is_video"),
        d.alias("doc_id"),
    )


FILES = """fl AS (
  SELECT '/w/' || source AS root, ['', 'A/', 'A/x/', 'B/', 'C/y/z/'][doc_id % 5 + 1] AS sub,
    '/w/' || source || '/' || ['', 'A/', 'A/x/', 'B/', 'C/y/z/'][doc_id % 5 + 1] || 'a P' || (doc_id % 13) || '_' || doc_id
      || CASE WHEN lang = 'de' THEN '.txt' ELSE '.mp4' END AS path,
    n_chars AS size, CAST(doc_id * 7919 % 200000 AS DOUBLE) AS mtime, lang <> 'de' AS is_video, doc_id
  FROM documents)"""


def access_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Events as access-log lines; one in fifty is broken, one in seven is another location."""
    k, i = F.col("k"), F.col("event_id")
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    query_part = F.concat(
        F.when(k % 10 != 0, F.concat(F.lit("?build=2026-r"), (k % 30).cast("string"))).otherwise("?x=1"),
        F.when(k % 4 != 0, F.concat(F.lit("&os="), _case(k, ["win", "mac", "linux"]))).otherwise(""),
        F.when(k % 6 == 0, F.concat(F.lit("&install=inst"), F.lpad((F.col("user_id") % 97).cast("string"), 6, "0"))).otherwise(""),
    )
    place = F.when(i % 7 == 0, "/other/").otherwise("/eval/clients/")
    line = F.concat(
        F.lit("10.0."), (F.col("user_id") % 5).cast("string"), F.lit("."), (F.col("user_id") % 251).cast("string"),
        F.lit(" - - ["), F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0800] "GET '), place, F.lit("rules.json"),
        query_part, F.lit(' HTTP/1.1" 200 237'),
    )
    return e.select(F.when(i % 50 == 0, F.concat(F.lit("broken "), i.cast("string"))).otherwise(line).alias("value"))


HITS = """hits AS (
  SELECT '10.0.' || (user_id % 5) || '.' || (user_id % 251) AS ip, CAST(ts AS DATE) AS day,
    CASE WHEN k % 10 <> 0 THEN '2026-r' || (k % 30) ELSE 'unknown' END AS build,
    CASE WHEN k % 4 <> 0 THEN ['win', 'mac', 'linux'][k % 3 + 1] END AS os,
    CASE WHEN k % 6 = 0 THEN 'inst' || lpad(CAST(user_id % 97 AS VARCHAR), 6, '0') END AS install
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
  WHERE event_id % 50 <> 0 AND event_id % 7 <> 0)"""
