"""Goldens of the timeline rules on small fixtures."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuespan import schemas
from cuespan.functions import clock, fuzzy, safety, versions
from cuespan.functions import text as tx
from cuespan.operators.merging import alike, merge_raw_events
from cuespan.plans import catalog, clips, detect, edl, fleet, inventory, loadout, matches, speakers, transcripts, voice
from cuespan.sources import events as ev


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first().asDict()


def test_scalars(spark):
    got = one(
        spark, slug=tx.slug(F.lit('a/b c:"d"')), empty=tx.slug(F.lit("///")), mm=clock.mmss(F.lit(125.4)),
        base=clock.clock_base(F.lit("/x/a P1 21日23点50分.mp4")), nobase=clock.clock_base(F.lit("b.mp4")),
        part=clock.part_no(F.lit("a P12 x.mp4")), nopart=clock.part_no(F.lit("abc.mp4")),
        n1=tx.to_count(F.lit("8,926,620")), n2=tx.to_count(F.lit("三")), n3=tx.to_count(F.lit("十")),
        emo=tx.emotion_count(F.lit("牛牛牛 卧槽 帅")), rep=tx.repeat_count(F.lit("啊啊啊啊 哈哈 ooo")),
        phone=safety.redact(F.lit("call 13812341234 sk-abcdefgh1")), uid=safety.mask_uid(F.lit("1234567890123")),
        url=safety.source_ok(F.lit("http://a")), pipe=safety.source_ok(F.lit("pipe:0")), win=safety.source_ok(F.lit("C:/a")),
        out=safety.source_ok(F.lit("/t/a/../../etc"), "/t/a"), ok=safety.source_ok(F.lit("/t/a/x"), "/t/a"),
        comp=safety.safe_component(F.lit("a.mp4")), bad=safety.safe_component(F.lit("a/b")), dots=safety.safe_component(F.lit("..")),
        newer=versions.newer_than(F.lit("0.2"), F.lit("x"), F.lit("0.1.9"), F.lit("20261022-r7f")),
        same=versions.newer_than(F.lit("0.1"), F.lit("20261022-r7f"), F.lit("0.1.0"), F.lit("20261022-r7")),
        below=versions.below_minimum(F.lit("0.1"), F.lit("0.1.1")),
        cut=tx.kill_word(F.lit(3)), many=tx.kill_word(F.lit(7)), glob=safety.excluded(F.lit("a/l2/b.mp4"), ["l2/"]),
        glob2=safety.excluded(F.lit("a/x.log"), ["*.log"]), glob3=safety.excluded(F.lit("al2/x.txt"), ["l2/", "*.log"]),
    )
    assert got == dict(
        slug="a_b_c_d", empty="clip", mm="02m05s", base=85800, nobase=None, part="12", nopart="-", n1=8926620, n2=3,
        n3=None, emo=3, rep=3, phone="call 138****1234 <已脱敏>", uid="123456…0123", url=False, pipe=False, win=True,
        out=False, ok=True, comp=True, bad=False, dots=False, newer=True, same=True, below=True, cut="三杀", many="7杀",
        glob=True, glob2=True, glob3=False,
    )


def test_same_target_both_forms(spark):
    names = ["", "Z", "Zzco", "岭南人爱少", "岭南源少", "雪代巴dd", "雪代dd", "路铃", "abcd", "abxd", "axyd"]
    pairs = [(a, b) for a in names for b in names]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", fuzzy.same_target(F.col("a"), F.col("b")).alias("s")).collect():
        assert r.s == alike(r.a, r.b), (r.a, r.b)


def test_part_bases(spark):
    rows = [("s", "a", "a P1 21日23点50分.mp4", 1, 1.0), ("s", "b", "b 无时间戳.mp4", 2, 1.0), ("s", "c", "c P2 22日00点20分.mp4", 3, 1.0)]
    got = {r.src: (r.base, r.zero_base) for r in matches.part_bases(spark.createDataFrame(rows, schemas.PARTS)).collect()}
    assert got == {"a": (85800, 85800), "b": (None, 86400), "c": (87600, 87600)}


def readings(spark, rows):
    base = dict(session="s", src="v", score=0.9, cx=960.0, cy=700.0, box_w=50.0, box_h=20.0, frame_w=1920, frame_h=1080)
    order = [c.split(" ")[0] for c in schemas.READINGS.split(", ")]
    data = [{**base, **dict(zip(("t", "seq", "text"), r[:3])), **(r[3] if len(r) > 3 else {})} for r in rows]
    return spark.createDataFrame([tuple(d[c] for c in order) for d in data], schemas.READINGS)


@pytest.mark.parametrize(
    "frames,want",
    [
        ([["背包：5/9"], ["背包：6/9"], ["背包：7/9"], ["背包：7/9"]], [("背包 5->6", 2.0), ("背包 6->7", 3.0)]),
        ([["背包：5/9"], ["背包：6/9"], ["背包：5/9"], ["背包：5/9"]], []),
        ([["背包：5/9"], ["安全箱：1/9"], ["背包：6/9"], ["安全箱：2/9"], ["背包：7/9", "安全箱：2/9"]],
         [("背包 5->6", 3.0), ("安全箱 1->2", 4.0)]),
    ],
)
def test_container_goldens(spark, frames, want):
    r = readings(spark, [(float(i + 1), j, x) for i, f in enumerate(frames) for j, x in enumerate(f)])
    got = detect.detect_events(r, 50.0).where(F.col("kind") == "loot").orderBy("t_start").collect()
    assert [(x.detail, x.t_start) for x in got] == want


def test_settlement_tracking_and_attributes(spark):
    off = {"cx": 200.0, "cy": 500.0}
    r = readings(spark, [
        (5.0, 0, "撤离成功", off),  # off band before tracking: not seen
        (10.0, 0, "撤离成功", {}), (10.0, 1, "本局 8,926,620", off),
        (16.0, 0, "撤离成功", off), (16.0, 1, "1:02:03", off), (16.0, 2, "8,926,620", off), (16.0, 3, "击败干员三", off),
        (40.0, 0, "撤离成功", off),
    ])
    spans = detect.settlement_spans(r).collect()
    assert [(s.lo, s.hi) for s in spans] == [(10.0, 28.0)]
    got = sorted(detect.detect_events(r).collect(), key=lambda e: e.t_start)  # a table has no order of its own
    assert [(e.t_start, e.t_end) for e in got] == [(10.0, 10.0), (16.0, 16.0)]
    m = got[1].meta
    assert (m.duration, m.profit, m.kills_official) == ("1:02:03", "8,926,620", "三")


def brute_merge(raw):
    events = []
    for t, kind, detail, conf, target in sorted(raw, key=lambda r: r[0]):
        hit = None
        if kind == "down":
            for e in reversed(events):
                if e["t0"] < t - 4.0:
                    break
                if e["kind"] == "down" and alike(e["target"], target):
                    hit = e
                    break
            if hit:
                if conf > hit["conf"]:
                    hit.update(detail=detail, target=target)
                hit.update(t1=t, conf=max(conf, hit["conf"]))
                continue
        elif events:
            e = events[-1]
            if e["kind"] == kind and t - e["t1"] <= (20.0 if kind == "match_start" else 2.5) and e["detail"] == detail:
                e.update(t1=t, conf=max(conf, e["conf"]))
                continue
        events.append(dict(kind=kind, t0=t, t1=t, detail=detail, conf=conf, target=target))
    return sorted((e["kind"], e["t0"], e["t1"], e["detail"], e["conf"]) for e in events)


def test_raw_merge_against_loop(spark):
    rnd = random.Random(3)
    raw, t = [], 0.0
    for _ in range(400):
        t = round(t + rnd.choice([0.5, 1.0, 1.0, 2.0, 3.0, 5.0, 25.0]), 1)
        kind = rnd.choice(["down", "down", "match_start", "loot", "extract"])
        target = rnd.choice(["Zzco", "Z", "铃路x", "岭南人爱少", "岭南源少"]) if kind == "down" else ""
        detail = f"击倒 {target}" if kind == "down" else rnd.choice(["p", "q"])
        raw.append((t, kind, detail, round(rnd.random(), 2), target))
    rank = {"down": 0, "match_start": 1, "extract": 2, "dance": 3, "loot": 4}
    rows = [("s", "v", r[0], rank[r[1]], r[0], i, r[1], r[2], r[3], r[4]) for i, r in enumerate(raw)]
    df = spark.createDataFrame(rows, "session string, src string, t double, rank int, ord_t double, ord_seq int, kind string, detail string, conf double, target string")
    for c, ty in (("text", "string"), ("point", "string"), ("snapshot", "array<string>"), ("container", "string"), ("prev", "int"), ("cur", "int"), ("context", "array<string>"), ("price", "long"), ("price_source", "string")):
        df = df.withColumn(c, F.lit(None).cast(ty))
    got = sorted((r.kind, r.t_start, r.t_end, r.detail, r.confidence) for r in merge_raw_events(df, 30.0).collect())
    assert got == brute_merge(raw)


def test_queue_goldens(spark):
    button = {"cx": 1700.0, "cy": 1000.0}
    rows = [(float(t), 0, "匹配中", button) for t in range(40, 80)]
    rows += [(float(t), 0, "出发", button) for t in range(300, 477)]
    e = spark.createDataFrame([("s", "v", "match_start", 119.0), ("s", "v", "match_start", 505.0), ("s", "v", "match_start", 560.0)],
                              "session string, src string, kind string, t_start double")
    p = spark.createDataFrame([("s", "v", "v P3.mp4", 1, 900.0)], schemas.PARTS)
    q = clips.queue_moments(e, readings(spark, rows), p, width=100.0).orderBy("t_match_start").collect()
    assert [(x.key, x.floor, x.t_queue, x.trigger) for x in q] == [
        ("P3#119", 0, 79, "匹配中"), ("P3#505", 205, 476, "出发"), ("P3#560", 559, None, None)
    ]
    assert q[2].skip.startswith("窗口内未见")


def test_event_file_matrix(spark, tmp_path):
    good = '{"src":"/v/a.mp4","kind":"down","t_start":1.0,"meta":{"weapons":[{"name":"AKM","type":"x","reads":2}]}}'
    other = '{"kind":"loot","t_start":2.0,"price":5,"meta":{"weapons":["M7"]}}'
    files = {"a_full": [good, other], "b_full": [good, '{"kind": "lo'], "c_full": [good, "{bad", other], "d_full": []}
    for d, lines in files.items():
        (tmp_path / d).mkdir()
        (tmp_path / d / "events.jsonl").write_text("\n".join(lines) + ("\n" if lines else ""), encoding="utf-8")
    parsed = ev.parse_lines(ev.read_lines(spark, str(tmp_path / "*" / "events.jsonl"))).cache()
    f = {r.part_dir: (r.usable, r.n_events) for r in ev.event_files(parsed).collect()}
    assert f == {"a_full": (True, 2), "b_full": (False, 1), "c_full": (True, 2), "d_full": (True, 0)}
    listed = {r.path.split("/")[-2]: r.length for r in ev.listed_files(spark, str(tmp_path / "*" / "events.jsonl")).collect()}
    assert set(listed) == set(files) and listed["d_full"] == 0
    e = ev.usable_events(parsed).where(F.col("part_dir") == "a_full").orderBy("line_no").collect()
    assert [list(x.meta.weapons) for x in e] == [["AKM"], ["M7"]] and e[1].price == 5
    parts = spark.createDataFrame([("s", "/v/a.mp4", "a.mp4", 1, 1.0), ("s", "/v/d.mp4", "d.mp4", 2, 1.0), ("s", "/v/b.mp4", "b.mp4", 3, 1.0)], schemas.PARTS)
    chosen = {r.src: r.path.split("/")[-2] for r in ev.resolve_reports(parts, ev.event_files(parsed)).collect()}
    assert chosen == {"/v/a.mp4": "a_full", "/v/d.mp4": "d_full"}


def test_lines_of_split_files_keep_their_places(spark, tmp_path):
    want = {}
    for d, n in (("a", 3000), ("b", 1), ("blank", 0)):
        (tmp_path / d).mkdir()
        lines = [f"{d} line {i} " + "x" * (i % 50) for i in range(n)]
        body = "\r\n \n".join(lines) + "\n\n"  # blank lines and both line ends
        (tmp_path / d / "e.jsonl").write_bytes(body.encode())
        want |= {(d, i): (x, i == n - 1) for i, x in enumerate(lines)} or {(d, None): (None, None)}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        df = ev.read_lines(spark, str(tmp_path / "*" / "e.jsonl"))
        got = {(r.part_dir, r.pos): (r.line, r.last) for r in df.collect()}
        scans = spark.read.text(str(tmp_path / "a")).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert scans > 5 and got == want


def test_access_goldens(spark):
    def line(ip, day, rest):
        return f'{ip} - - [{day}/Oct/2026:09:00:01 +0800] "GET /eval/clients/x.json?{rest} HTTP/1.1" 200 237 "-" "-"'

    rows = [line("1.1.1.1", 28, "build=r16&v=1&os=win"), line("1.1.1.1", 28, "build=r16&os=win"), line("2.2.2.2", 28, "build=r9c&os=mac"),
            line("3.3.3.3", 28, "x=1"), line("4.4.4.4", 27, "install=abcdef0123"), "garbage"]
    p = fleet.parse_access(spark.createDataFrame([(r,) for r in rows], "value string")).cache()
    assert fleet.line_counts(p).first().asDict() == {"total": 5, "bad": 1}
    h = fleet.client_hits(p)
    assert {str(r.day): r.active for r in fleet.daily_actives(h).collect()} == {"2026-10-28": 3, "2026-10-27": 1}
    assert {r.build: r.active for r in fleet.build_actives(h, days=1).collect()} == {"r16": 1, "r9c": 1, "unknown": 1}
    assert {(r.scope, r.installs) for r in fleet.installs(h).collect()} == {("total", 1), ("day", 1), ("build", 1)}


def test_inventory_goldens(spark):
    h = 3600.0
    now = 1e6

    def files(*rows):
        return spark.createDataFrame([("/w", p, s, m, p.rsplit(".", 1)[-1] in ("mp4", "flv")) for p, s, m in rows], schemas.FILES)

    f1 = files(("/w/old.mp4", 1000, now - 30 * h), ("/w/new.mp4", 2000, now - 2 * h), ("/w/edge.mp4", 300, now - 24 * h))
    assert inventory.new_bytes(f1, 0, now).first().bytes == 2000
    g = [("/w/A/P1.mp4", 500, now - 3 * h), ("/w/A/P2.mp4", 600, now - 3 * h)]
    assert inventory.new_bytes(files(*g), 0, now).first().bytes == 1100
    assert inventory.new_bytes(files(*g, ("/w/A/P3.mp4", 700, now - 1)), 60, now).first().bytes == 0
    f3 = files(("/w/A/a.mp4", 1000, now - 7200), ("/w/B/b.mp4", 2000, now - 7200), ("/w/c.mp4", 400, now - 7200))
    none = spark.createDataFrame([], schemas.JOBS)
    assert inventory.unprocessed_bytes(f3, none, 60, now).first().bytes == 3400
    fp = {r.target: r.fingerprint for r in inventory.fingerprints(f3).collect()}
    done = spark.createDataFrame([("k", "/w/A", "A", "done", 1, "2026-01-01 00:00:00", "", "", fp["/w/A"])], schemas.JOBS)
    assert inventory.unprocessed_bytes(f3, done, 60, now).first().bytes == 2400
    f4 = files(("/w/A/P1.mp4", 100, now - h), ("/w/A/P2.mp4", 100, now - h), ("/w/B/P1.mp4", 100, now - 30), ("/w/C/e.mp4", 0, now - h),
               ("/w/one.mp4", 100, now - h), ("/w/x.txt", 9, now - h), ("/w/D/E/v.mp4", 5, now - h), ("/w/D/F/G/v.mp4", 5, now - h))
    assert {r.target for r in inventory.targets(f4, 600, now).collect()} == {"/w/A", "/w/one.mp4", "/w/D/E"}


def log(spark, lines):
    return spark.createDataFrame([("PS", i, x) for i, x in enumerate(lines)], "session string, i int, line string").select(
        "session", F.timestamp_seconds(F.col("i") + 1).alias("ts"), "line")


def test_progress_goldens(spark):
    lines = ["[pipeline] 场次：PS，4 个分片", "[pipeline] -- 跳过 asr", "[pipeline] -- 跳过 speaker", "[pipeline] detect 开始 ..."]
    lines += [f"part{i}.mp4：检测完成" for i in range(3)]
    f = fleet.progress(fleet.parse_progress(log(spark, lines))).first()
    assert abs(f.frac - (0.04 + 0.75 * 3 / 4)) < 1e-9 and f.eta_sec > 0
    lines += ["[pipeline] detect 完成 (600s)", "[pipeline] knockdowns 开始 ...", "part0.mp4：3 粗簇 -> x"]
    f = fleet.progress(fleet.parse_progress(log(spark, lines))).first()
    assert abs(f.frac - (0.04 + 0.75 + 0.10 / 4)) < 1e-9
    d = spark.createDataFrame([("PS", "a P1.mp4", 1800.0), ("PS", "a P2.mp4", 1200.0)], "session string, filename string, duration_s double")
    lines = ["[pipeline] 场次：PS，2 个分片", "[pipeline] -- 跳过 asr", "[pipeline] -- 跳过 speaker", "[pipeline] detect 开始 ...", "  a P1.mp4：检测完成 -> r"]
    f = fleet.progress(fleet.parse_progress(log(spark, lines)), d, by_duration=True).first()
    assert abs(f.frac - (0.06 + 0.75 * 1800 / 3000)) < 1e-9
    f = fleet.progress(fleet.parse_progress(log(spark, [*lines, "[pipeline] 全链完成。"])), d, by_duration=True).first()
    assert f.frac == 1.0


def test_rules_and_manifest(spark):
    r = spark.createDataFrame([("threshold_gb", "9999"), ("scan_interval_min", "-5"), ("daily_hour", "abc"), ("stable_min", "0"), ("hack", "1")], "key string, value string")
    assert {x.key: x.value for x in fleet.clamp_rules(r).collect()} == {"threshold_gb": 100.0, "scan_interval_min": 10.0, "stable_min": 1.0}
    rows = spark.createDataFrame([("s", "C:/v/a.mp4"), ("s", "/srv/a.mp4"), ("s", "http://x"), ("s", "/etc/passwd")], "session string, src string")
    vm = spark.createDataFrame([("s", "C:/v/a.mp4", "/srv/a.mp4")], "session string, client_video string, server_video string")
    out = catalog.remap_sources(rows, vm).collect()
    assert sorted(x.status for x in out) == ["dropped", "dropped", "remapped", "unchanged"]
    assert {x.src for x in out if x.status != "dropped"} == {"/srv/a.mp4"}


def test_timed_sentences(spark):
    text = "你好。ok! 嗯"
    stamps = [[i * 100, i * 100 + 90] for i in range(5)]
    d = spark.createDataFrame([("s", "v", text, stamps), ("s", "w", "。！", [[0, 10], [20, 30]])], "session string, src string, text string, stamps array<array<long>>")
    got = sorted((r.src, r.start, r.end, r.text) for r in transcripts.timed_sentences(d).collect())
    assert got == [("v", 0.0, 0.19, "你好。"), ("v", 0.2, 0.39, "ok!"), ("v", 0.4, 0.49, "嗯"), ("w", 0.0, 0.03, "。！")]


def test_snap_window_rules(spark):
    talk = spark.createDataFrame([("s", "v", 0, 8.0, 12.0, "a", None), ("s", "v", 1, 20.0, 26.0, "b", None), ("s", "v", 2, 26.0, 60.0, "c", None)], schemas.SENTENCES)
    segs = [("s", 1, "v", 10.0, 22.0, 30.0), ("s", 2, "v", 10.0, 30.0, 20.0), ("s", 3, "v", -3.0, -1.0, 9.0), ("s", 4, "w", 5.0, 50.0, 10.0), ("s", 5, "v", 19.0, 40.0, 10.0)]
    df = spark.createDataFrame(segs, "session string, seg int, src string, t0 double, t1 double, cap double")
    got = {r.seg: (r.t_in, r.t_out) for r in edl.snap_windows(df, talk).collect()}
    assert got == {1: (8.0, 26.0), 2: (10.0, 30.0), 3: (0.0, 2.5), 4: (5.0, 15.0), 5: (19.0, 26.0)}


def test_clusters_large_equals_small(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(4, 16))
    rows = [(g, i, [float(x) for x in centers[i % 4] + rng.normal(scale=0.35, size=16)]) for g in (0, 1) for i in range(25)]
    df = spark.createDataFrame(rows, "grp int, id long, vec array<float>").cache()
    small = {(r.grp, r.id): r.cluster for r in speakers.cluster(df, 0.65).collect()}
    large = {(r.grp, r.id): r.cluster for r in speakers.cluster(df, 0.65, block=8).collect()}
    assert small == large
    # one-pair-at-a-time average linkage over the full distance matrix
    for g in (0, 1):
        x = np.array([r[2] for r in rows if r[0] == g], dtype=np.float32).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        groups = [[i] for i in range(len(x))]
        while len(groups) > 1:
            best = min(((np.mean([1 - x[i] @ x[j] for i in a for j in b]), p, q) for p, a in enumerate(groups) for q, b in enumerate(groups) if p < q))
            if best[0] >= 0.65:
                break
            groups[best[1]] += groups.pop(best[2])
        assert {(g, i): min(grp) for grp in groups for i in grp} == {k: v for k, v in small.items() if k[0] == g}


def test_linkage_in_small_blocks_equals_one_block(spark):
    """Random, clustered and repeated vectors; blocks so small that most merges cross them. Ties go by id in both."""
    for seed in (0, 2):
        rng = np.random.default_rng(seed)
        centers = rng.normal(size=(6, 8))
        x = np.concatenate([centers[rng.integers(6, size=70)] + rng.normal(scale=[0.1, 0.6, 2.0][seed], size=(70, 8)), rng.normal(size=(30, 8))])
        x[90:95] = x[3]
        rows = [(f"g{i % 2}", i, [float(v) for v in x[i]]) for i in range(100)] + [("g0", 200, [0.0] * 8), ("g0", 201, None), ("g1", 202, [float("nan")] * 8), ("lone", 5, [1.0] * 8)]
        df = spark.createDataFrame(rows, "grp string, id long, vec array<float>")
        whole = {(r.grp, r.id): r.cluster for r in speakers.cluster(df, 0.65).collect()}
        parts = {(r.grp, r.id): r.cluster for r in speakers.cluster(df, 0.65, block=5).collect()}
        assert whole == parts and len(whole) == 104
        assert all(whole[g, i] == i for g, i in (("g0", 200), ("g0", 201), ("g1", 202), ("lone", 5)))
        assert len(set(whole.values())) < 80


def test_linkage_compares_few_pairs_of_clustered_vectors(spark):
    rng = np.random.default_rng(2)
    n, centers = 1500, rng.normal(size=(40, 32))
    x = centers[rng.integers(40, size=n)] + rng.normal(scale=0.05, size=(n, 32))
    df = spark.createDataFrame([("g", i, [float(v) for v in x[i]]) for i in range(n)], "grp string, id long, vec array<float>")
    pairs = []
    got = speakers.cluster(df, 0.3, 64, pairs)
    sizes = sorted(r["count"] for r in got.groupBy("cluster").count().collect())
    assert len(sizes) == 40
    assert pairs[0] < n * n / 4 and sum(pairs) < n * n * 0.7  # of n * n a round without bounds and kept neighbours


def test_linkage_compares_equal_vectors_once(spark):
    """Copies cost no comparison of their own, and weigh as many as they are."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 8)) + 1.0
    rows = [("g", k * 40 + i, [float(v) for v in x[i]]) for k in range(12) for i in range(40) if k < 2 + i % 11]
    df = spark.createDataFrame(rows, "grp string, id long, vec array<float>")
    pairs = []
    got = {r.id: r.cluster for r in speakers.cluster(df, 0.2, 4096, pairs).collect()}
    assert sum(pairs) < 40 * 40 * 8 < len(rows) ** 2
    v = np.array([r[2] for r in rows], dtype=np.float32).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    groups = [([r[1]], u) for r, u in zip(rows, v, strict=True)]
    while True:
        c = np.array([g[1] / len(g[0]) for g in groups])
        d = np.round(1 - c @ c.T, 12)
        d[np.tril_indices(len(d))] = np.inf
        i, j = np.unravel_index(d.argmin(), d.shape)
        if d[i, j] >= 0.2:
            break
        groups[i] = (groups[i][0] + groups[j][0], groups[i][1] + groups[j][1])
        groups.pop(j)
    assert got == {i: min(g) for g, _ in groups for i in g} and len(groups) > 1


def test_loadout_vote(spark):
    toast, hud = {"cx": 960.0, "cy": 170.0}, {"cx": 1680.0, "cy": 1000.0}
    rows = [(100.0, 0, "出战干员切换为骇爪", toast)] + [(240.0 + 5 * i, 0, "M4A1", hud) for i in range(3)] + [(255.0, 1, "坠星者", hud)]
    starts = spark.createDataFrame([("s", "v", 200.0)], "session string, src string, t_start double")
    r = loadout.loadouts(readings(spark, rows), starts).first()
    assert r.meta.hero == "骇爪" and list(r.meta.weapons) == ["M4A1"] and r.detail == "干员骇爪(侦察) 主武器M4A1(突击步枪)"


def test_voice_grades_and_zigzag(spark):
    g = one(spark, s=voice.grade(F.lit(78.0)), a=voice.grade(F.lit(77.99)), b=voice.grade(F.lit(48.0)), c=voice.grade(F.lit(1.0)))
    assert g == {"s": "S", "a": "A", "b": "B", "c": "C"}
    z = spark.range(5).select(edl.zigzag(F.col("id"), F.lit(5)).alias("z")).collect()
    assert [r.z for r in z] == [0, 2, 4, 3, 1]
