"""Phrases, languages and hard negatives against brute force; nulls, ties, empty tables, clashing columns."""

import itertools
import random
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuespan.llm import collocation, hardneg, langid

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VECTORS = "vec_id long, embedding array<float>, label int"


def clashing(df):
    return df.withColumns({c: F.lit("other") for c in ("n", "key", "gram", "score", "w1", "a", "salt", "tile", "anchor", "q", "rank", "slot")})


# --- phrases ------------------------------------------------------------------------------------------


def phrases(rows, top, least):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(lower)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, count in f.items():
        usual = {p: a for p, a in count.items() if a >= least and len(p) > 1}
        inside = Counter()
        for p, a in usual.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        found = []
        for p, a in usual.items():
            if 100 * inside[p] >= 80 * a:
                continue
            score, _, left, right = min((2000000 * a // (count[p[:k]] + count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for r, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, r, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def chatter(r, n, words):
    out = []
    for i in range(n):
        got = [r.choice(words) for _ in range(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            at = r.randrange(len(got) + 1)
            got[at:at] = r.choice(["Out of The blue", "kith\tand  kin", "spick and span and", "é ö", "blue moon"]).split(" ")
        out.append((i, "".join(w + r.choice([" ", " ", " ", ". ", "\n", "; ", "\t"]) for w in got), r.choice(["en", "en", "de", None, "und"]), "s", 1))
    return out


@pytest.mark.parametrize("top, slack", [(2000, 4), (7, 1), (3, 1)])
def test_phrases_equal_brute_force(spark, top, slack):
    r = random.Random(top)
    rows = chatter(r, 150, ["the", "a", "blue", "moon", "of", "x1", "and", "\x01", "kin", "sky", "\x1c"]) + [(900, None, "en", "s", 0), (901, "", None, None, None), (902, "..!?", "fr", "s", 1), (903, "once", "xx", "s", 1)]
    rows += [rows[0], rows[0], (904, "very long " * 30_000, "en", "s", 1), (None, "out of the blue", "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    want = phrases(rows, top, 5)
    assert want and len({w[0] for w in want}) >= 3
    for got in (collocation.collocations(df, top, 5, slack), collocation.collocations(clashing(df), top, 5, slack)):
        assert sorted(map(tuple, got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())) == want


def test_phrases_of_nothing(spark):
    assert collocation.collocations(spark.createDataFrame([], DOCS)).collect() == []
    assert collocation.collocations(spark.createDataFrame([(1, "a b", "en", "s", 1)], DOCS)).collect() == []


def test_frontier_goes_on_until_settled(spark, monkeypatch):
    """With a frontier of one pair a round, the first phrases are still those of full growth."""
    scans = []
    own = collocation.longer_counts
    monkeypatch.setattr(collocation, "longer_counts", lambda *a: scans.append(1) or own(*a))
    r = random.Random(5)
    rows = [(i, " ".join(r.choice("abcdefgh") for _ in range(40)) + " new york city . new york city", "en", "s", 1) for i in range(60)]
    got = collocation.collocations(spark.createDataFrame(rows, DOCS), 12, 5, 0.1)
    assert sorted(map(tuple, got.collect())) == phrases(rows, 12, 5)
    assert len(scans) > 1


def test_words_that_share_a_hash_start_anew(spark, monkeypatch):
    rows = [(i, "new york is new", "en", "s", 1) for i in range(9)]
    own = collocation.word_counts
    asked = []

    def bad(docs, seed):
        asked.append(seed)
        out = own(docs, seed)
        return out.withColumn("w", F.lit(7).cast("long")) if seed == 0 else out

    monkeypatch.setattr(collocation, "word_counts", bad)
    got = collocation.collocations(spark.createDataFrame(rows, DOCS), 12, 5)
    assert sorted(map(tuple, got.collect())) == phrases(rows, 12, 5) and asked == [0, 1]


# --- languages ----------------------------------------------------------------------------------------


def grams(text):
    kept = "".join((c.lower() if len(c.lower()) == 1 else c) if unicodedata.category(c)[0] in "LM" else " " for c in text)
    out = Counter()
    for w in kept.split():
        w = f" {w} "
        out.update(w[1:-1])
        out.update(w[i : i + 2] for i in range(len(w) - 1))
        out.update(w[i : i + 3] for i in range(len(w) - 2))
    # the blank between two words stands once for both
    return out


def ranks(count, k):
    return {g: i for i, (g, _) in enumerate(sorted(count.items(), key=lambda x: (-x[1], x[0]))[:k])}


def guess(text, profiles, k):
    if not profiles or not any(unicodedata.category(c)[0] == "L" for c in text or ""):
        return "und", 0.0
    own = ranks(grams(text), k)
    most = k * len(own)
    d, lang = min((sum(abs(i - p[g]) if g in p else k for g, i in own.items()), lang) for lang, p in profiles.items())
    return lang, 1 - d / most


def test_languages_equal_brute_force(spark, monkeypatch):
    r = random.Random(3)
    letters = {"en": "etaoinshr", "de": "enisratdüß", "ру": "оеаинтс", "": "αβγ"}
    rows = []
    for i in range(120):
        lang = r.choice(list(letters))
        rows.append((i, " ".join("".join(r.choice(letters[lang]) for _ in range(r.randint(1, 8))) for _ in range(r.randint(0, 40))) + r.choice(["", "!", " 42\n", " İX É"]), r.choice([lang, lang, None]), "s", 1))
    rows += [(200, None, "en", "s", 0), (201, "", "de", "s", 0), (202, "1234 !!", "en", "s", 0), (203, "́́ 7", "en", None, None), (204, "a" * 300_000 + " bé" * 100_000, "en", "s", 1), (205, "x", None, None, None), rows[0], rows[0], (None, "eins", "de", "s", 1)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    for k in (5, 60):
        counts = defaultdict(Counter)
        for d, text, lang, *_ in rows:
            if lang is not None and text and (d or 0) % 3:
                counts[lang] += grams(text)
        profiles = {lang: ranks(c, k) for lang, c in counts.items() if c}
        want = Counter((d, *guess(t, profiles, k)) for d, t, *_ in rows)
        learned = langid.learn(df, F.coalesce(F.col("doc_id"), F.lit(0)) % 3 != 0, k)
        for table in (df, clashing(df)):
            got = langid.identify(table, learned)
            assert Counter(tuple(x) for x in got.select("doc_id", "lang_pred", "score").collect()) == want
            assert set(table.columns) - {"score"} <= set(got.columns)


def test_languages_of_nothing(spark):
    none = langid.learn(spark.createDataFrame([], DOCS), F.lit(True))
    assert none.langs == []
    rows = langid.identify(spark.createDataFrame([(1, "some text", "en", "s", 1)], DOCS), none).collect()
    assert [(r.lang_pred, r.score) for r in rows] == [("und", 0.0)]
    assert langid.identify(spark.createDataFrame([], DOCS), none).collect() == []


def test_slices_count_like_the_whole(monkeypatch):
    a, _ = langid.letters("so it is, and ever was; " * 50)
    whole = langid.ranked(a, 1000)
    monkeypatch.setattr(langid, "_SLICE", 7)
    assert (langid.ranked(a, 1000) == whole).all()


# --- hard negatives -----------------------------------------------------------------------------------


def mined(rows, anchor, p, n):
    use = {}
    for vid, v, label in rows:
        if vid is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        use[vid, label, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)] = None
    out = []
    for vid, label, q in (x for x in use if anchor(x[0])):
        others = sorted((-sum(a * b for a, b in zip(q, q2, strict=True)), v2, l2 == label) for v2, l2, q2 in use if v2 != vid and len(q2) == len(q))
        for ps, pid, _ in [o for o in others if o[2]][:p]:
            fit = [o for o in others if not o[2] and 30 * -ps <= 100 * -o[0] <= 90 * -ps][:n]
            out += [(vid, pid, r, o[1], -ps, -o[0]) for r, o in enumerate(fit, 1)]
    return Counter(out)


def vectors(r, n=400):
    rows = []
    for i in range(n):
        if i % 4 == 0 and rows:
            rows.append((i, rows[r.randrange(len(rows))][1], r.randrange(3)))
        else:
            rows.append((i, [r.gauss(0.1, 0.3) for _ in range(6)], r.randrange(3)))
    same = [0.5, 0.25, 0.0, -0.125, 0.5, 0.5]
    rows += [(1000 + i, same, 1 if i < 60 else 2) for i in range(90)]
    nan, inf = float("nan"), float("inf")
    rows += [(2000, None, 1), (2010, [nan] * 6, 1), (2020, [inf] * 6, 1), (2030, [None] * 6, 1), (None, same, 1), (2040, same, None), (2050, [0.0] * 6, 1), (2060, [1.0, 2.0], 1), (2061, [1.0, 2.0], 1), (2062, [1.0, 1.0], 2), (2070, [], 1), (2071, [], 1), (2072, [], 2)]
    return rows + [rows[0], rows[0], (10, [0.9] * 6, 2), (40, [-0.9] * 6, 0)]


@pytest.mark.parametrize("block, tile", [(1024, 65_536), (16, 9)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, block, tile):
    monkeypatch.setattr(hardneg, "BLOCK", block)
    monkeypatch.setattr(hardneg, "TILE", tile)
    rows = vectors(random.Random(block))
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    want = mined(rows, lambda i: i % 10 == 0, 5, 10)
    assert sum(want.values()) > 500
    for table in (df, clashing(df)):
        got = hardneg.hard_negatives(table, F.col("vec_id") % 10 == 0)
        assert Counter(map(tuple, got.collect())) == want


def test_hard_negatives_of_nothing_and_few(spark):
    for rows in ([], [(10, [1.0], 1)], [(10, [1.0], 1), (11, [1.0], 1)], [(10, [1.0], 1), (11, [1.0], 2)]):
        assert hardneg.hard_negatives(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 10 == 0).collect() == []
    rows = [(10, [1.0], 1), (11, [1.0], 1), (12, [0.5], 2)]
    got = hardneg.hard_negatives(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 10 == 0).collect()
    assert [tuple(r) for r in got] == [(10, 11, 1, 12, 65536, 32768)]


@pytest.mark.parametrize("size", [3000.0, 4e5])
def test_large_components_are_exact(spark, size):
    r = random.Random(1)
    rows = [(i, [r.uniform(0, size) for _ in range(3)], r.randrange(2)) for i in range(60)]
    got = hardneg.hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), F.col("vec_id") % 10 == 0, 2, 3, most=99)
    use = [(i, label, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, label in rows]
    out = []
    for vid, label, q in use[::10]:
        s = sorted((-sum(a * b for a, b in zip(q, q2, strict=True)), v2, l2 == label) for v2, l2, q2 in use if v2 != vid)
        for ps, pid, _ in [o for o in s if o[2]][:2]:
            fit = [o for o in s if not o[2] and 30 * -ps <= 100 * -o[0] <= 99 * -ps][:3]
            out += [(vid, pid, k, o[1], -ps, -o[0]) for k, o in enumerate(fit, 1)]
    assert sorted(map(tuple, got.collect())) == sorted(out)


def test_scores_beyond_a_long_raise(spark):
    rows = spark.createDataFrame([(10, [1e30], 1), (11, [1.0], 1)], VECTORS)
    with pytest.raises(Exception, match="fit a long"):
        hardneg.hard_negatives(rows, F.col("vec_id") % 10 == 0).collect()


def test_neighbours_on_the_curve_are_neighbours_in_space():
    for dims, bits in ((2, 4), (3, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        order = np.argsort([int.from_bytes(h.tobytes(), "big") for h in hardneg.hilbert(cells, bits)])
        assert (np.abs(np.diff(cells[order], axis=0)).sum(1) == 1).all()


def test_bounds_skip_blocks_of_clustered_vectors():
    """Two far clusters: windows near one of them leave out the other's block."""
    anchor = {"key": 0, "vid": 0, "label": 1, "q": hardneg.packed(np.array([100, 0])), "width": 2, "window_low": [5000], "window_high": [9000]}
    c = hardneg.Chunk([anchor], 10)
    zones = [np.array(x, float) for x in ([[60, -5], [-90, -5]], [[80, 5], [-60, 5]])]
    labels = np.array([2, 2]), np.array([3, 3])
    assert c.must_read(*zones, *labels).tolist() == [[True, False]]
    assert c.must_read(*zones, np.array([1, 1]), np.array([1, 1])).tolist() == [[False, False]]
