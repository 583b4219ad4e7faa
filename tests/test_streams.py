"""Streams against their batch twins."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from cuespan import constants as K
from cuespan.plans import fleet
from cuespan.streaming import jobs

T0 = dt.datetime(2026, 1, 1)


def feed(spark, tmp_path, rows, schema):
    d = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(d)
    return spark.readStream.schema(spark.read.parquet(d).schema).parquet(d), spark.read.parquet(d)


def drain(spark, df, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(100)
    return spark.table("out").collect()


def test_gap_sessions(spark, tmp_path):
    rows = [("u", T0 + dt.timedelta(seconds=s)) for s in (0, 12, 24, 37, 100, 5000)]
    stream, batch = feed(spark, tmp_path, rows, "k string, ts timestamp")
    want = [(r.n) for r in jobs.streaming_gap_sessions(batch, ["k"], "ts", "12 seconds", "1 second").orderBy("first_ts").collect()]
    assert want == [3, 1, 1, 1]
    got = sorted(r.n for r in drain(spark, jobs.streaming_gap_sessions(stream, ["k"], "ts", "12 seconds", "1 second"), tmp_path))
    assert got == [1, 1, 3]  # the open last session waits for the watermark


def test_presence(spark, tmp_path):
    hits = [1, 1, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0]
    rows = [("h", T0 + dt.timedelta(seconds=i), bool(x)) for i, x in enumerate(hits)]
    stream, batch = feed(spark, tmp_path, rows, "host string, ts timestamp, hit boolean")
    want = sorted((r.run, r.started_at - T0.timestamp(), r.stopped_at - T0.timestamp()) for r in jobs.presence_runs(batch, 3, 4.0).collect())
    assert [(a, round(b), round(c)) for a, b, c in want] == [(1, 0, 7), (2, 9, 12)]
    got = drain(spark, jobs.streaming_presence(stream, "0 seconds"), tmp_path)
    assert sorted(round(r.stopped_at - r.started_at) for r in got) == [3, 7]


def batches(spark, tmp_path, files, schema):
    """A stream that reads one file a batch, in the given order."""
    d = tmp_path / "files"
    d.mkdir(parents=True)
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"one{i}"))
        [part] = (tmp_path / f"one{i}").glob("part-*.parquet")
        (d / f"{i:04d}.parquet").write_bytes(part.read_bytes())
        os.utime(d / f"{i:04d}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    whole = spark.read.parquet(str(d))
    return spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(d)), whole


@pytest.mark.parametrize("seed", range(2))
def test_presence_of_shuffled_and_late_polls(spark, tmp_path, seed):
    r = random.Random(seed)
    polls = [(h, T0 + dt.timedelta(seconds=5 * i), r.random() < 0.4) for h in "ab" for i in range(120)]
    order = sorted(polls, key=lambda x: x[1].timestamp() + r.random() * 55)  # up to a minute late
    files = [order[lo : lo + 24] for lo in range(0, len(order), 24)] + [[("z", T0 + dt.timedelta(days=1), False)], [("z", T0 + dt.timedelta(days=2), False)]]
    stream, batch = batches(spark, tmp_path, files, "host string, ts timestamp, hit boolean")
    want = sorted((x.host, x.run, x.started_at, x.stopped_at) for x in jobs.presence_runs(batch, 3, 100.0).collect() if x.stopped_at)
    assert len(want) > 5
    assert sorted(map(tuple, drain(spark, jobs.streaming_presence(stream), tmp_path))) == want


def _lines(kind, what):
    return [{"start": f"[pipeline] {what} 开始 ...", "done": f"[pipeline] {what} 完成 (3s)", "skip": f"[pipeline] -- 跳过 {what}", "parts": f"[pipeline] 场次：s，{what} 个分片",
             "detected": f"  {what}：检测完成 -> x", "knocked": f"  {what}：3 粗簇"}[kind]]


@pytest.mark.parametrize("by_duration", [False, True])
def test_progress_stream_equals_batch_after_every_batch(spark, tmp_path, by_duration):
    r = random.Random(3)
    log = {"a": [], "b": []}
    for session, lines in log.items():
        no = 0
        for stage in K.STAGES:
            lines.append(r.choice([f"{stage} ok", *_lines("start", stage)]))
            if stage == "detect":
                lines += [*_lines("parts", 4), *(x for i in range(4) for x in _lines("detected", f"p{i}.mp4"))]
            if stage == "knockdowns":
                lines += [x for i in range(3) for x in _lines("knocked", f"p{i}.mp4")]
            lines += _lines(r.choice(["done", "skip"]), stage) if stage != "pickups" else []
    rows = [(s, T0 + dt.timedelta(seconds=i // 3), i, line) for s, lines in log.items() for i, line in enumerate(lines)]
    r.shuffle(rows)
    files = [rows[lo : lo + 7] for lo in range(0, len(rows), 7)]
    schema = "session string, ts timestamp, line_no long, line string"
    stream, _ = batches(spark, tmp_path, files, schema)
    durations = spark.createDataFrame([("a", f"p{i}.mp4", 60.0 * (i + 1)) for i in range(4)], "session string, filename string, duration_s double")
    seen = []

    def check(df, batch_id):
        seen.append({x.session: (x.cur, x.frac, x.eta_sec) for x in df.collect()})

    q = jobs.streaming_progress(stream, durations, by_duration).writeStream.foreachBatch(check).outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(100)
    now = {}
    assert len(seen) >= len(files)
    for i in range(len(files)):
        now |= seen[i]
        so_far = spark.createDataFrame([x for f in files[: i + 1] for x in f], schema)
        want = {x.session: (x.cur, x.frac, x.eta_sec) for x in fleet.progress(fleet.parse_progress(so_far), durations, by_duration).collect()}
        assert now == want
    assert any(0 < f < 1 and eta for _, f, eta in now.values())


def test_store_of_a_hundred_batches_stays_small(spark, tmp_path):
    schema = spark.createDataFrame([("a", 1)], "session string, x int").schema
    store = jobs.SessionStore(spark, str(tmp_path / "store"), schema, every=8)
    for n in range(100):
        store.compact()
        store.add(spark.createDataFrame([(f"s{n % 3}", n)], schema).coalesce(1), n)
        if n in (5, 40):  # run again, also after a later one
            store.add(spark.createDataFrame([(f"s{n % 3}", n)], schema), n)
            store.add(spark.createDataFrame([(f"s{(n - 1) % 3}", n - 1)], schema), n - 1)
        assert len(list((tmp_path / "store" / "log").iterdir())) <= 9
    assert sorted(r.x for r in store.rows().collect()) == list(range(100))
    assert len(list((tmp_path / "store" / "base").iterdir())) == 1
    old = store.version()
    store.add(spark.createDataFrame([("s0", old)], schema), old)  # in the base already
    assert sorted(r.x for r in store.rows().collect()) == list(range(100))


def test_late_rows_reopen_their_session(spark, tmp_path):
    files = [[("a", 1), ("b", 5)], [("c", 7)], [("a", 2)], [("a", 3), ("d", 1)]]
    stream, _ = batches(spark, tmp_path, files, "session string, x int")

    def total(df):
        return df.groupBy("session").agg(F.sum("x").alias("s"))

    def go():
        q = jobs.rewrite_sessions(stream, str(tmp_path / "store"), str(tmp_path / "o"), total, str(tmp_path / "ck"), every=2).trigger(availableNow=True).start()
        q.awaitTermination(100)
        return {(r.session, r.s) for r in spark.read.parquet(str(tmp_path / "o")).collect()}

    want = {("a", 6), ("b", 5), ("c", 7), ("d", 1)}
    assert go() == want
    # the last batch as if it had failed before its commit
    for f in (tmp_path / "ck" / "commits").iterdir():
        if f.name.lstrip(".").split(".")[0] == "3":
            f.unlink()
    assert go() == want


def test_stalls(spark, tmp_path):
    sizes = [(0, 1), (2, 2), (10, 2), (22, 2), (23, 2), (40, 3), (50, 4)]
    rows = [("v", T0 + dt.timedelta(seconds=s), n) for s, n in sizes]
    stream, batch = feed(spark, tmp_path, rows, "src string, ts timestamp, size long")
    b = jobs.stalls(batch, 20.0, 10.0).collect()
    assert [(round(r.stalled_at - r.grew)) for r in b] == [21]
    got = drain(spark, jobs.streaming_stalls(stream), tmp_path)
    # the last growth is told by its timer, if the watermark gets that far
    assert [(r.grew, r.stalled_at) for r in got if r.grew == b[0].grew] == [(b[0].grew, b[0].stalled_at)]
    brief = drain(spark, jobs.streaming_stalls(stream, stall_sec=9.0), tmp_path / "brief")
    short = jobs.stalls(batch, 9.0, 10.0).collect()
    assert {(r.grew, r.stalled_at) for r in short} <= {(r.grew, r.stalled_at) for r in brief}


def test_rewrite_sessions(spark, tmp_path):
    stream, _ = feed(spark, tmp_path, [("a", 1), ("a", 2), ("b", 5)], "session string, x int")

    def total(df):
        return df.groupBy("session").agg(F.sum("x").alias("s"))

    q = jobs.rewrite_sessions(stream, str(tmp_path / "store"), str(tmp_path / "o"), total, str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(100)
    assert {(r.session, r.s) for r in spark.read.parquet(str(tmp_path / "o")).collect()} == {("a", 3), ("b", 5)}
