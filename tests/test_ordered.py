"""Two-level ordered operators against brute force, with chunks small enough to cross often."""

import bisect
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from cuespan.operators.distribution import percentiles, strict_rank
from cuespan.operators.intervals import count_in_spans, merge_spans, stab
from cuespan.operators.greedy import keep_apart, keep_disjoint
from cuespan.operators.ordered import asof, gap_groups, has_within, lane, nearest, number_rows, scan
from cuespan.plans.detect import confirmed_increases
from cuespan.plans.matches import roll_over


def rows(seed, n=200, keys=3, span=120.0):
    rnd = random.Random(seed)
    return [
        (f"k{rnd.randrange(keys)}", round(rnd.random() * span, 1), i, rnd.randrange(9))
        for i, _ in enumerate(range(n))
    ]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(rows(1), "k string, t double, id int, v int")


def by_key(data):
    out = {}
    for r in data:
        out.setdefault(r[0], []).append(r)
    return {k: sorted(v, key=lambda r: (r[1], r[2])) for k, v in out.items()}


def test_scan_matches_loop(df):
    odd = F.when(F.col("v") % 2 == 1, F.col("v"))
    got = scan(
        df, lane("k", ("t", "id"), 7.0), last={"l": odd}, prev={"p": F.col("v")},
        following={"f": F.col("v")}, upcoming={"u": odd}, running={"r": F.col("v")}, total={"a": F.col("v")},
    ).collect()
    want = {}
    for k, rs in by_key(rows(1)).items():
        last, run = None, 0
        for i, r in enumerate(rs):
            last = r[3] if r[3] % 2 else last
            run += r[3]
            up = next((x[3] for x in rs[i:] if x[3] % 2), None)
            want[(k, r[2])] = (
                last, rs[i - 1][3] if i else None, rs[i + 1][3] if i + 1 < len(rs) else None, up, run,
                sum(x[3] for x in rs),
            )
    assert {(g.k, g.id): (g.l, g.p, g.f, g.u, g.r, g.a) for g in got} == want


@pytest.mark.parametrize("gap,strict", [(0.4, False), (0.4, True), (1.5, False), (30.0, False)])
def test_gap_groups_inclusive_boundary(spark, gap, strict):
    data = [(k, float(t), i, v) for k, t, i, v in ((r[0], round(r[1] * 2) / 10, r[2], r[3]) for r in rows(2))]
    d = spark.createDataFrame(data, "k string, t double, id int, v int")
    got = gap_groups(d, lane("k", ("t", "id"), 3.0), gap, "g", strict).collect()
    want = {}
    for k, rs in by_key(data).items():
        g, prev = 0, None
        for r in rs:
            if prev is None or (r[1] - prev >= gap if strict else r[1] - prev > gap):
                g += 1
            prev = r[1]
            want[(k, r[2])] = g
    assert {(r.k, r.id): r.g for r in got} == want


def test_asof_nearest_within(spark, df):
    other = [(k, round(t + 0.0, 0), i) for k, t, i, _ in rows(3, 60)]
    o = spark.createDataFrame(other, "k string, s double, oid int")
    back = {(r.k, r.id): r.hit.s if r.hit else None for r in asof(df, o, ["k"], "t", "s", ["oid"], 5.0, tie="oid").collect()}
    ahead = {(r.k, r.id): r.hit.s if r.hit else None for r in asof(df, o, ["k"], "t", "s", [], 5.0, forward=True).collect()}
    strictly = {(r.k, r.id): r.hit.s if r.hit else None for r in asof(df, o, ["k"], "t", "s", [], 5.0, strict=True).collect()}
    near = {(r.k, r.id): (r.hit.s, r.hit.oid) if r.hit else None for r in nearest(df, o, ["k"], "t", "s", ["oid"], 5.0, tolerance=1.5, tie="oid").collect()}
    w = df.withColumn("lo", F.col("t") - 1).withColumn("hi", F.col("t") + 0.5)
    inside = {(r.k, r.id): r.has for r in has_within(w, o, ["k"], "lo", "hi", "s", 5.0).collect()}
    for k, t, i, _ in rows(1):
        mine = [x for x in other if x[0] == k]
        before = [x[1] for x in mine if x[1] <= t]
        after = [x[1] for x in mine if x[1] >= t]
        assert back[(k, i)] == (max(before) if before else None)
        assert ahead[(k, i)] == (min(after) if after else None)
        less = [x[1] for x in mine if x[1] < t]
        assert strictly[(k, i)] == (max(less) if less else None)
        best = min(mine, key=lambda x: (abs(x[1] - t), x[1], x[2]), default=None)
        assert near[(k, i)] == ((best[1], best[2]) if best and abs(best[1] - t) <= 1.5 else None)
        assert inside[(k, i)] == any(t - 1 <= x[1] <= t + 0.5 for x in mine)


def test_spans_and_intervals(spark, df):
    marks = spark.createDataFrame([("k0", 10.0), ("k0", 50.0), ("k1", 0.0)], "k string, s double")
    got = {(r.k, r.id): r.no for r in count_in_spans(marks, df, ["k"], "s", "t", 7.0).collect()}
    starts = {"k0": [10.0, 50.0], "k1": [0.0], "k2": []}
    want = {(k, i): n for k, t, i, _ in rows(1) if (n := sum(s <= t for s in starts[k]))}
    assert got == want
    iv = [(k, t, round(t + v * 1.5, 1), i) for k, t, i, v in rows(4, 40)]
    ivd = spark.createDataFrame(iv, "k string, lo double, hi double, iid int")
    for levels, most in ((None, None), (None, 3), (1, None), (3, 3)):
        pairs = {(r.k, r.id, r.iid) for r in stab(df, ivd, ["k"], "t", "lo", "hi", 4.0, levels=levels, rows_a_cell=most).collect()}
        assert pairs == {(k, i, x[3]) for k, t, i, _ in rows(1) for x in iv if x[0] == k and x[1] <= t <= x[2]}
    plan = stab(df, ivd, ["k"], "t", "lo", "hi", 4.0)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    isl = {r.iid: (r.k, r.island) for r in merge_spans(ivd, ["k"], "lo", "hi", 9.0).collect()}
    for k in ("k0", "k1", "k2"):
        n, reach = 0, None
        for x in sorted((x for x in iv if x[0] == k), key=lambda x: (x[1], x[2])):
            if reach is None or reach <= x[1]:
                n += 1
            reach = max(reach or 0, x[2])
            assert isl[x[3]] == (k, n)


@pytest.mark.parametrize("most", [None, 500])
def test_stab_of_a_year_long_span_and_a_hot_cell(spark, most):
    year = 365 * 86400.0
    inf = float("inf")
    spans = [("k", 0.0, year, 1), ("k", 10.0, 10.5, 2), ("k", 3.0, 3.0, 3), (None, -inf, inf, 4), ("k", 5.0, 4.0, 5),
             ("k", -100.0, 1000.0, 6), ("k", year, inf, 7), ("k", -inf, -1.0, 8), ("k", None, 9.0, 9)]
    points = [("k", 10.2, i) for i in range(4000)]  # one hot cell
    points += [("k", x, 5000 + i) for i, x in enumerate((-2.0, -0.5, 0.0, 3.0, 10.5, 999.9, year, year + 1, 1e12))]
    points += [(None, -1e9, 6000), (None, 1e9, 6001), ("other", 10.2, 6002), ("k", None, 6003)]
    p = spark.createDataFrame(points, "k string, t double, id int").repartition(3)
    iv = spark.createDataFrame(spans, "k string, lo double, hi double, iid int")
    for open_hi in (False, True):
        got = stab(p, iv, ["k"], "t", "lo", "hi", 2.0, open_hi=open_hi, rows_a_cell=most).collect()
        want = sorted(
            (i, n) for k, t, i in points for sk, lo, hi, n in spans
            if k == sk and None not in (t, lo) and lo <= t and (t < hi or (t == hi and not open_hi)) and lo <= hi
        )
        assert sorted((r.id, r.iid) for r in got) == want


def test_stab_lists_a_span_in_a_few_cells_and_splits_hot_ones(spark):
    p = spark.range(4000).select(F.lit("k").alias("k"), F.lit(7.5).alias("t"), "id")
    spans = [("k", float(i), float(i) + 2.0**j, j) for i in (0, 1, 7) for j in range(26)]
    iv = spark.createDataFrame(spans, "k string, lo double, hi double, iid int")
    sides = {}
    real = DataFrame.join

    def seen(self, other, *a, **kw):
        if "__pl" in self.columns and "__level" in other.columns:
            sides["points"], sides["spans"] = self, other
        return real(self, other, *a, **kw)

    DataFrame.join = seen
    try:
        stab(p, iv, ["k"], "t", "lo", "hi", 1.0)
        assert sides["spans"].groupBy("lo", "hi").count().agg(F.max("count")).first()[0] <= 2
        one = spark.createDataFrame([("k", 7.0, 8.0, 1)], "k string, lo double, hi double, iid int")
        stab(p, one, ["k"], "t", "lo", "hi", 1.0, rows_a_cell=500)
        parts = [r["count"] for r in sides["points"].groupBy("__pl", "__pc", "__pp").count().collect()]
        assert len(parts) == 8 and max(parts) < 700
    finally:
        DataFrame.join = real


def taken_in_order(spans, apart):
    """The plain loop: spans in rank order, kept where there is room."""
    kept, out = [], []
    for i, (lo, hi) in enumerate(spans):
        at = bisect.bisect_right(kept, (lo, hi))
        if (at == 0 or lo - kept[at - 1][1] >= apart) and (at == len(kept) or kept[at][0] - hi >= apart):
            kept.insert(at, (lo, hi))
            out.append(i)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_greedy_equals_the_loop_on_long_spans_and_ties(spark, seed):
    r = random.Random(seed)
    data = [(f"k{r.randrange(2)}", float(t := r.randrange(3000)), float(t + r.choice([0, 1, 5, 40, 900])), r.randrange(4), i) for i in range(1200)]
    data += [("k0", None, 5.0, 9, 5000), ("k0", 5.0, None, 9, 5001), (None, 7.0, 9.0, 1, 5002), (None, 8.0, 9.0, 2, 5003), ("k0", float("nan"), 9.0, 9, 5004)]
    d = spark.createDataFrame(data, "k string, lo double, hi double, v int, id int").repartition(3)
    whole = [x for x in data if x[1] is not None and x[2] is not None and x[1] == x[1]]
    for apart in (True, False):
        want = set()
        for k in ("k0", "k1", None):
            mine = sorted((x for x in whole if x[0] == k), key=lambda x: (-x[3], x[4]))
            kept = taken_in_order([(x[1], x[1] if apart else x[2]) for x in mine], 7.0 if apart else 0.0)
            want |= {mine[i][4] for i in kept}
        if apart:
            got = keep_apart(d.withColumn("o", -F.col("v")).where("hi is not null"), ("k",), "lo", ["o", "id"], 7.0, 50.0)
        else:
            got = keep_disjoint(d, ("k",), "lo", "hi", ["v", "id"], [False, True], 50.0)
        assert {x.id for x in got.collect()} == want


def test_greedy_decides_chains_over_many_slices(spark):
    """Each row hangs on the one before it, over 40 slices."""
    d = spark.range(4000).select(F.lit("k").alias("k"), F.col("id").cast("double").alias("t"), "id")
    got = sorted(r.id for r in keep_apart(d, ("k",), "t", ["t"], 7.0, 100.0).collect())
    assert got == list(range(0, 4000, 7))


def test_greedy_takes_one_island_of_a_million_rows(spark):
    n = 1_000_000
    d = spark.range(n).select(F.lit("k").alias("k"), (F.col("id") * 0.5).alias("t"), F.abs(F.xxhash64("id")).alias("rank"), "id")
    got = keep_apart(d, ("k",), "t", ["rank", "id"], 3.0, 20_000.0)
    rows = d.orderBy("rank", "id").select("t").toPandas()["t"].tolist()
    assert {r.t for r in got.select("t").collect()} == {rows[i] for i in taken_in_order([(t, t) for t in rows], 3.0)}


def test_greedy_keepers(spark):
    data = rows(5, 120, 2, 900.0)
    d = spark.createDataFrame(data, "k string, t double, id int, v int")
    got = {(r.k, r.id) for r in keep_apart(d, ("k",), "t", ["v", "t", "id"], 30.0, 100.0).collect()}
    want = set()
    for k in ("k0", "k1"):
        taken = []
        for r in sorted((r for r in data if r[0] == k), key=lambda r: (r[3], r[1], r[2])):
            if all(abs(r[1] - x) >= 30 for x in taken):
                taken.append(r[1])
                want.add((k, r[2]))
    assert got == want
    s = d.withColumn("hi", F.col("t") + F.col("v"))
    got = {(r.k, r.id) for r in keep_disjoint(s, ("k",), "t", "hi", ["v", "id"], [False, True], 50.0).collect()}
    want = set()
    for k in ("k0", "k1"):
        taken = []
        for r in sorted((r for r in data if r[0] == k), key=lambda r: (-r[3], r[2])):
            if all(r[1] + r[3] <= a or r[1] >= b for a, b in taken):
                taken.append((r[1], r[1] + r[3]))
                want.add((k, r[2]))
    assert got == want


def test_percentiles_and_rank(spark, df):
    p = {r.k: (r.a, r.b, r.c) for r in percentiles(df, ("k",), "t", {"a": 0.4, "b": 0.5, "c": 0.85}).collect()}
    for k, rs in by_key(rows(1)).items():
        assert np.allclose(p[k], np.percentile([r[1] for r in rs], [40, 50, 85]))
    ranked = strict_rank(df, ("k",), "v", "r", reference=F.col("id") % 2 == 0).collect()
    for r in ranked:
        ref = [x[3] for x in rows(1) if x[0] == r.k and x[2] % 2 == 0]
        assert abs(r.r - np.mean([x < r.v for x in ref])) < 1e-12


def test_hot_copies_rank(spark):
    d = spark.createDataFrame([("a", 5.0)] * 50 + [("a", float(i)) for i in range(50)], "k string, v double")
    got = {r.v: r.r for r in strict_rank(d, ("k",), "v", "r").distinct().collect()}
    assert got[5.0] == 0.05 and got[6.0] == 0.56


def test_confirmed_increases_goldens(spark):
    series = {
        "a": [5, 6, 7, 7], "b": [5, 6, 6, 6], "c": [5, 6, 5, 5], "d": [5, 5, 6],
    }
    data = [(k, float(i + 1), 0, v) for k, vs in series.items() for i, v in enumerate(vs)]
    d = spark.createDataFrame(data, "k string, t double, seq int, v int")
    got = {(r.k, r.prev, r.v, r.t) for r in confirmed_increases(d, ("k",), ("t", "seq"), "v", 2.0).collect()}
    assert got == {("a", 5, 6, 2.0), ("a", 6, 7, 3.0), ("b", 5, 6, 2.0)}


def test_confirmed_increases_random(spark):
    rnd = random.Random(9)
    data = [(f"s{s}", float(i), 0, rnd.randrange(6)) for s in range(30) for i in range(20)]
    d = spark.createDataFrame(data, "k string, t double, seq int, v int")
    got = {(r.k, r.t) for r in confirmed_increases(d, ("k",), ("t", "seq"), "v", 3.0).collect()}
    want = set()
    for s in range(30):
        last, pend = None, None
        for k, t, _, v in (x for x in data if x[0] == f"s{s}"):
            if last is not None and v > last:
                if pend:
                    want.add((k, pend[0]))
                pend = (t, v)
            elif pend:
                if v >= pend[1]:
                    want.add((k, pend[0]))
                pend = None
            last = v
    assert got == want


def test_roll_over_is_the_fold(spark):
    rnd = random.Random(4)
    data = [(f"s{s}", i, rnd.randrange(0, 86400, 1800)) for s in range(40) for i in range(12)]
    d = spark.createDataFrame(data, "session string, part_seq int, b long")
    got = {(r.session, r.part_seq): r.adjusted for r in roll_over(d, ("session",), ("part_seq",), "b").collect()}
    for s in range(40):
        prev = -1
        for _, i, b in (x for x in data if x[0] == f"s{s}"):
            if prev >= 0 and b < prev - 43200:
                b += 86400
            prev = b
            assert got[(f"s{s}", i)] == b


def test_number_rows(df):
    got = {(r.k, r.id): r.no for r in number_rows(df, lane("k", ("t", "id"), 5.0)).collect()}
    for k, rs in by_key(rows(1)).items():
        for n, r in enumerate(rs, 1):
            assert got[(k, r[2])] == n


def test_wide_rows_are_exchanged_once(spark):
    """One hash exchange of the wide rows per ordered operator; both neighbours in one scan."""
    import re

    was = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        import __spark_entry__ as entry

        def exchanges(df):
            return re.findall(r"Exchange hash.*", df._jdf.queryExecution().executedPlan().toString())

        got = exchanges(entry.queries()["nearest_dance"](spark, "/root/testdata/sf0.001"))
        assert len(got) <= 6, got
        rows = spark.range(100).selectExpr("id % 3 as k", "cast(id as double) as t", "cast(id as string) as wide")
        plan = number_rows(rows, lane("k", "t", 10.0))._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"Exchange hash.*__lane", plan)) <= 3 and plan.count("Window [row_number") == 0
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
