"""Work that must be done once a row, or once a job, however the query uses its result."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from cuespan import schemas
from cuespan.functions import fuzzy
from cuespan.plans import clips, loadout, transcripts, voice
from cuespan.sources import events as ev


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_reading_is_cleaned_once_a_row(spark):
    # one regexp and one parse of the text, in whatever lambda the result is used
    df = spark.createDataFrame([('{"k": "x红狼!"}', "红狼"), ('{"k": "骇瓜"}', "骇爪"), ('{"k": "abc"}', None)], "j string, want string")
    named = df.select("want", fuzzy.match_operator(F.get_json_object("j", "$.k")).alias("name"), F.lit(1).alias("one"))
    assert _plan(named).count("regexp_replace(") == 1
    assert all(r.want == r.name for r in named.collect())
    arms = spark.createDataFrame([('{"k": "scar h"}', "SCAR-H"), ('{"k": "星者"}', "坠星者"), ('{"k": "30/120"}', None), ('{"k": "M4A7"}', "M4A1"), ('{"k": "新枪5"}', "新枪5")], "j string, want string")
    cleaned = arms.select("want", fuzzy.clean_weapon(F.get_json_object("j", "$.k")).alias("name"))
    assert _plan(cleaned).count("get_json_object(") == 1
    assert all(r.want == r.name for r in cleaned.collect())


def _stamps(n):
    return [[i * 100, i * 100 + 90] for i in range(n)]


def test_stamps_are_read_in_their_own_row(spark):
    text = "".join(f"句{i}好。" for i in range(300))
    rows = [("s", f"v{k}", text, _stamps(2000)) for k in range(6)] + [(None, "n", "你。好。", _stamps(2))]
    d = spark.createDataFrame(rows, "session string, src string, text string, stamps array<array<long>>")
    got = transcripts.timed_sentences(d)
    # only the join of texts that share their keys explodes anything: no row per stamp is left in the plan
    assert "posexplode(stamps" not in _plan(got)
    at, want = 0, []
    for i in range(300):
        n = len(f"句{i}好")
        want.append((i, at / 10, (at + n - 1) / 10 + 0.09, f"句{i}好。"))
        at += n
    for k in range(6):
        mine = sorted((r.id, r.start, r.end, r.text) for r in got.where(F.col("src") == f"v{k}").collect())
        assert [(i, t) for i, _, _, t in mine] == [(i, t) for i, _, _, t in want]
        assert all(abs(m[1] - w[1]) < 1e-9 and abs(m[2] - w[2]) < 1e-9 for m, w in zip(mine, want, strict=True))
    assert [tuple(r) for r in got.where(F.col("src") == "n").collect()] == [(None, "n", 0, 0.0, 0.19, "你。好。")]


def test_texts_that_share_their_keys_count_on(spark):
    d = spark.createDataFrame([("s", "v", "你好。嗯", _stamps(600))] * 2, "session string, src string, text string, stamps array<array<long>>")
    got = Counter((r.id, r.start, r.end) for r in transcripts.timed_sentences(d).collect())
    # both texts are counted through, and each sentence meets the stamps of both texts at its start and its end
    assert got == {(0, 0.0, 0.19): 4, (0, 0.2, 0.39): 4, (1, 0.4, 0.49): 4, (1, 0.5, 0.59): 4}


def test_event_files_are_listed_once(spark, tmp_path):
    for name, body in (("a", "x\n\ny\r\n"), ("b", ""), ("c", " \n\n")):
        (tmp_path / f"part={name}").mkdir()
        (tmp_path / f"part={name}" / "e.txt").write_text(body)
    got = ev.read_lines(spark, str(tmp_path), recursiveFileLookup="true", pathGlobFilter="*.txt")
    assert "binaryFile" not in _plan(got) and "Join LeftAnti" not in _plan(got)
    rows = sorted((r.part_dir, r.pos, r.line, r.last) for r in got.collect())
    assert rows == [("part=a", 0, "x", False), ("part=a", 1, "y", True), ("part=b", None, None, None), ("part=c", None, None, None)]


def test_candidates_are_worked_out_once(spark):
    readings = spark.createDataFrame(
        [("s", "v", 40.0, i, "M4A1", 0.9, 1700.0, 1000.0, 100.0, 30.0, 1920, 1080) for i in range(2)],
        "session string, src string, t double, seq int, text string, score double, cx double, cy double, box_w double, box_h double, frame_w int, frame_h int",
    )
    starts = spark.createDataFrame([("s", "v", 0.0)], "session string, src string, t_start double")
    # the votes read a table of candidates, not the readings again and again
    assert "regexp_replace" in _plan(loadout.candidates(readings, starts))
    assert "regexp_replace" not in _plan(loadout.loadouts(readings, starts))


def test_windows_are_made_of_steps(spark):
    rng = np.random.default_rng(3)
    rms = [float(x) for x in rng.uniform(0, 1, 120)]
    audio = spark.createDataFrame([("s", "v", i, x) for i, x in enumerate(rms)], "session string, src string, bin long, rms double")
    said = spark.createDataFrame([("s", "v", 0, 1.0, 14.9, "abc", None), ("s", "v", 1, 17.0, 24.0, "defg", None)], schemas.SENTENCES)
    long = spark.createDataFrame([("s", "v", 30.0)], "session string, src string, duration_s double")
    base = spark.createDataFrame([("s", "v", 0.1, 0.2, 0.9, 3.0)], "session string, src string, p40 double, p50 double, p85 double, rate_med double")
    out = voice.window_signals(audio, voice.char_bins(said, long), said, long, base)
    assert " percentile(" not in _plan(out)
    host = set(range(4, 60)) | set(range(68, 97))
    seen = out.collect()
    assert len(seen) == 12
    for r in seen:
        bins = [b for b in range(8 * r.win, 8 * r.win + 32) if b < 120]
        mine = [rms[b] for b in bins if b in host]
        assert abs(r.host_frac - len(mine) / len(bins)) < 1e-12
        if r.host_frac > 0.5 and np.median(mine) > 0.08:
            pre = [rms[b] for b in range(8 * r.win - 8, 8 * r.win) if b >= 0]
            assert abs(r.vol - np.quantile(mine, 0.95) / 0.2) < 1e-9
            assert abs(r.burst - max(mine) / max(np.median(pre) if pre else 0.2, 0.06)) < 1e-9


def test_sessions_need_no_join_back(spark):
    at = {"cx": 800.0, "cy": 500.0, "w": 10.0, "h": 10.0}
    counts = [(10.0, 0, "背包", "3"), (10.0, 1, "口袋", "1"), (11.0, 2, "背包", "5"), (12.0, 3, "背包", "4"), (12.0, 4, "口袋", "2"), (20.0, 5, "背包", "99999999999"), (20.5, 6, "背包", "7"), (30.0, 7, "口袋", "99999999999")]
    rows = [("s", "v", t, q, f"{c}：{n}/30", 0.9, at["cx"], at["cy"], at["w"], at["h"], 1920, 1080) for t, q, c, n in counts]
    islands = spark.createDataFrame([("s", "v", 1, 1, 15.0)], "session string, src string, cluster long, island long, t_start double")
    sessions, _ = clips.interface_sessions(spark.createDataFrame(rows, schemas.READINGS), islands)
    assert "Join" not in _plan(sessions)
    # counts of the last frame less those of the first; one that is no number adds nothing, alone it leaves none
    got = sorted((r.ui0, r.ui1, r.net_gain, r.organizing) for r in sessions.collect())
    assert got == [(9.0, 13.0, 2, True), (19.0, 21.5, 7, False), (29.0, 31.0, None, False)]
