"""Numbers of whole tables, hashes of listings: against plain loops."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from cuespan.operators.ranged import LINES_A_BLOCK, listing_digests, number_all
from cuespan.plans import inventory


def test_number_all_is_the_sorted_position(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 1.0, 1.0, 2.5, rng.random()])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, t double").repartition(5)
    got = {r.id: r.no for r in number_all(df, ["t", "id"]).collect()}
    ordered = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0.0, r[0]))
    assert got == {i: n for n, (i, _) in enumerate(ordered, 1)}


def test_number_all_of_nothing(spark):
    assert number_all(spark.createDataFrame([], "id long"), ["id"]).collect() == []


def test_jobs_in_order_meet_in_one_task_as_counts_only(spark):
    jobs = spark.range(2000).select(F.col("id").cast("string").alias("key"), F.lit("2026-01-01 00:00:00").alias("enqueued_at"))
    df = inventory.jobs_in_order(jobs)
    assert [r.key for r in df.orderBy("place").collect()] == sorted(str(i) for i in range(2000))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    whole = [x for x in plan.splitlines() if "Window" in x and "windowspecdefinition(__chunk" in x]
    assert whole and all("__s_" in x for x in whole)  # the window without a key reads range sums only


def test_digests_equal_hashlib_with_a_hot_key(spark):
    rng = random.Random(11)
    rows = []
    for i in range(6000):
        key = "hot" if i % 3 == 0 else rng.choice(["a", "é", None, "b|c", ""])
        rows.append((key, i % 2, rng.randrange(10**6), i, rng.choice([None, "", "päth", f"x{i}"])))
    rows.append(("only null", 0, 1, -1, None))
    df = spark.createDataFrame(rows, "k string, k2 int, o long, id long, line string").repartition(7)
    listing = defaultdict(list)
    for k, k2, _, _, line in sorted(rows, key=lambda r: (r[2], r[3])):
        listing[k, k2].append(line)
    for sep in ("", "\n"):
        got = listing_digests(df, ["k", "k2"], [F.col("o"), F.col("id")], F.col("line"), "sha256", lead=F.col("k"), sep=sep)
        want = {
            k: hashlib.sha256(((k[0] or "") + sep.join(x for x in v if x is not None)).encode()).hexdigest()
            for k, v in listing.items()
        }
        assert {(r.k, r.k2): r.digest for r in got.collect()} == want


def test_digests_of_nothing(spark):
    df = spark.createDataFrame([], "k string, o long, line string")
    assert listing_digests(df, ["k"], [F.col("o")], F.col("line"), "sha1").collect() == []


def test_fingerprint_of_a_root_with_a_million_names(spark):
    n = 1_000_000
    files = spark.range(n, numPartitions=8).select(
        F.lit("/w").alias("root"), F.format_string("/w/%07d.mp4", "id").alias("path"), F.lit(5).cast("long").alias("size"),
        F.lit(9.5).alias("mtime"), F.lit(True).alias("is_video"),
    )
    df = inventory.fingerprints(files)
    assert "collect_list" not in df._jdf.queryExecution().toString()
    h = hashlib.sha1(b"/w")
    for i in range(n):
        h.update(f"|{i:07d}.mp4|5|9".encode())
    assert [(r.target, r.fingerprint) for r in df.collect()] == [("/w", h.hexdigest())]


def test_blocks_are_bounded():
    assert LINES_A_BLOCK <= 1024  # a batch of blocks has to fit a Python worker


def test_depth_is_a_parameter_and_what_it_leaves_out_is_counted(spark):
    rows = [("/w", f"/w/{'d/' * k}v{k}.mp4", 10 + k, 1.0, True) for k in range(6)] + [("/x", "/x/v.mp4", 1, 1.0, True)]
    files = spark.createDataFrame(rows, "root string, path string, size long, mtime double, is_video boolean")
    deep = {r.root: (r["files"], r["bytes"]) for r in inventory.left_out(files).collect()}
    assert deep == {"/w": (2, 14 + 15), "/x": (0, 0)}
    assert {r.root: r["files"] for r in inventory.left_out(files, 9).collect()} == {"/w": 0, "/x": 0}
    seen = {r.target for r in inventory.targets(files, 0.0, 100.0, max_depth=6).collect()}
    assert "/w/d/d/d/d/d" in seen
