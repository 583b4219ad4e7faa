"""Operators against brute force, round trips and held-out accuracy; nulls, ties, empty tables, clashing columns."""

import base64
import hashlib
import itertools
import json
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cuespan.llm import chat, components, fm, mixing, neardup, packing, pitmanyor, queries, rules, shinglejoin, warc
from cuespan.llm.common import staged

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(1)
WORDS = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(800)]


def prose(n, r):
    return " ".join(r.choice(WORDS) for _ in range(n))


def documents(r, n=120):
    """Prose, exact and near copies, a very long text, repeated rows, empty and null texts and ids."""
    rows = [(i, prose(r.randint(1, 200), r), r.choice(["en", "de", None]), "hot" if i % 3 == 0 else r.choice(["a", "b", None]), 5) for i in range(n)]
    for i in range(n, n + 40):
        words = rows[i % 20][1].split()
        if i % 2 and words:
            words[r.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words), "en", "hot", None))
    rows += [(900, prose(9000, r), "en", "a", 1), (901, "", "en", "a", 0), (902, None, None, None, None), (903, " \n\t ", "en", "a", 3)]
    rows += [(None, rows[0][1], "en", "a", 1), rows[3], rows[3], (5, "two words", "en", "b", 2), (905, "İ é <|endoftext|>x 漢字!! ſs\x1cy", "fr", "b", 9)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents")
    spark.createDataFrame(documents(random.Random(2)), DOCS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df):
    """The same table with further columns named as the operators' own."""
    return df.withColumns({c: F.lit("other") for c in ("row", "__row", "__counts", "__lang", "__source", "n", "cls", "key", "label", "measure", "bucket", "text_id", "max_symbol_share", "blk")})


# --- 1: packing ---------------------------------------------------------------------------------------


def check_packing(rows, pieces, window):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))
    want = Counter()
    for d, t, *_ in rows:
        want[d, tuple(tok.encode(t or "", add_special_tokens=False).ids + [1])] += 1
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
    # every document's pieces give its ids back, each once
    for d, ps in by_doc.items():
        assert sum(p.length for p in ps) == sum(len(ids) * k for (x, ids), k in want.items() if x == d)
        if sum(k for (x, _), k in want.items() if x == d) == 1:
            ps.sort(key=lambda p: p.start)
            got = [i for p in ps for i in np.frombuffer(bytes(p.ids), "<u4").tolist()]
            assert [p.start for p in ps] == [0, *itertools.accumulate(p.length for p in ps)][:-1]
            assert (d, tuple(got)) in want and all(p.doc_tokens == len(got) for p in ps)
    assert set(by_doc) == {d for d, _ in want}
    fill = defaultdict(list)
    for p in pieces:
        fill[p.sequence_id].append(p)
    padding = 0
    for ps in fill.values():
        ps.sort(key=lambda p: p.offset)
        assert [p.offset for p in ps] == [0, *itertools.accumulate(p.length for p in ps)][:-1]
        n = sum(p.length for p in ps)
        assert n <= window
        padding += 0 if n & (n - 1) == 0 else window - n
    return padding


@pytest.mark.parametrize("window,most_open", [(64, 4096), (64, 3), (2048, 4096)])
def test_packing(docs, window, most_open):
    got = packing.pack(clashing(docs), public_tokenizers.path(queries.TOKENIZER), window, most_open=most_open).collect()
    assert check_packing(docs.collect(), got, window) == 0


def test_packing_places_by_sum_of_squares():
    p = packing.Packer(10, 100)
    for doc, size in enumerate([6, 3, 3, 7, 4]):
        before = {h: int(p.level[h]) for h in range(1, 10)}
        list(p.add(doc, size, bytes(4 * size)))
        costs = {}
        for h in [0] + [h for h, k in before.items() if k]:
            if h + size <= 10:
                after = dict(before)
                if h:
                    after[h] -= 1
                if h + size < 10:
                    after[h + size] += 1
                costs[h] = sum(v * v for v in after.values())
        assert sum(int(v) ** 2 for v in p.level) == min(costs.values())


def test_packing_empty(empty):
    assert packing.pack(empty, public_tokenizers.path(queries.TOKENIZER)).count() == 0


# --- 2: mixing ----------------------------------------------------------------------------------------


def edf(counts):
    n, done, out = sum(counts), [0] * len(counts), []
    for t in range(n):
        ready = [(math.ceil((k + 1) * n / c), i) for i, (k, c) in enumerate(zip(done, counts)) if k < c and math.floor(k * n / c) <= t]
        due, i = min(ready)
        assert due > t
        done[i] += 1
        out.append(i)
    return out


def test_mixing_schedule(spark):
    cases = [[3, 5, 1], [7], [0, 4, 4, 1], [13, 1, 1, 2, 30]]
    df = spark.createDataFrame([(c,) for c in cases], "counts array<int>").withColumn("n", F.aggregate("counts", F.lit(0), lambda a, c: a + c)).withColumn("o", mixing.earliest_deadline_first(F.col("counts"), F.col("n"))).select("counts", "o")
    for counts, order in df.collect():
        assert order == edf(counts)
        for t in range(1, len(order) + 1):
            for i, c in enumerate(counts):
                assert abs(order[:t].count(i) - t * c / sum(counts)) < 1


def test_mixing(spark, docs):
    shares = spark.createDataFrame([("hot", 3), ("a", 2), ("b", 1), ("unused", 9)], "source string, share int")
    rows = docs.collect()
    got = mixing.mix(clashing(docs), shares, block=400).collect()
    assert Counter((r.doc_id, r.text, r.source, r.n_chars, r.cls) for r in got) == Counter((r.doc_id, r.text, r.source, r.n_chars, "other") for r in rows)
    slot_of = {}
    for r in got:
        assert slot_of.setdefault((r.source, r.block), r.slot) == r.slot
    assert len(set(slot_of.values())) == len(slot_of)
    for (s, b), (s2, b2) in itertools.product(slot_of, repeat=2):
        if s == s2 and b < b2:
            assert slot_of[s, b] < slot_of[s2, b2]
    # within a source, places are running sums of sizes
    for s in {r.source for r in rows}:
        at = 0
        for r in sorted((r for r in got if r.source == s), key=lambda r: r.before):
            assert r.before == at and r.block == at // 400
            at += max(1, len(r.text or "x"))
    blocks = Counter()
    for s in {r.source for r in rows}:
        blocks[s] = -(-sum(max(1, len(r.text or "x")) for r in rows if r.source == s) // 400)
    share = {"hot": 3, "a": 2, "b": 1, None: 1}
    full = min(blocks[s] // share[s] for s in blocks)  # rounds in which every source has its whole share
    per = sum(share[s] for s in blocks)
    owner = {v: k[0] for k, v in slot_of.items()}
    for t in range(1, full * per + 1):
        for s in blocks:
            missing = sum(1 for x in range(t) if x not in owner)  # slots whose block no document starts in
            assert abs(sum(owner.get(x) == s for x in range(t)) - t * share[s] / per) < 1 + missing
    ordered = mixing.in_order(mixing.mix(docs, shares, block=400)).collect()
    assert [(r.slot, r.before) for r in ordered] == sorted((r.slot, r.before) for r in ordered)


def test_mixing_empty(empty):
    assert mixing.mix(empty).count() == 0


# --- 3 and 10: factorisation machines -----------------------------------------------------------------


def test_machine_score_is_the_pairwise_sum():
    r = np.random.default_rng(0)
    m = fm.Machine(fm.QUALITY, np.array([2, 5, 9], np.int32), r.normal(size=3), r.normal(size=(3, 4)), 0.3)
    s = 0.3 + m.w[0] + m.w[2] + m.v[0] @ m.v[2]
    assert math.isclose(m.score(np.array([2, 7, 9], np.int32)), 1 / (1 + math.exp(-s)))
    assert math.isclose(m.score(np.zeros(0, np.int32)), 1 / (1 + math.exp(-0.3)))


def test_machine_learns_a_pair():
    """Either word alone is harmless, both together are not: additive weights can't tell."""
    r = np.random.default_rng(1)
    rows = [np.array(sorted({int(a), int(b) + 2, int(r.integers(10, 60))}), np.int32) for a, b in r.integers(0, 2, (2000, 2))]
    y = np.array([int((0 in x) == (2 in x)) for x in rows])
    m = fm.fit(rows, y, fm.Features(structure=False), least_z=0, least_lift=1.0, epochs=60)
    assert np.mean([(m.score(x) >= 0.5) == t for x, t in zip(rows, y)]) > 0.95


def test_machine_learns_a_pair_of_neutral_terms_with_defaults():
    """No term tells anything alone; texts that the machine hasn't seen are told by their pair."""
    r = np.random.default_rng(1)
    rows = [np.array(sorted({int(a), int(b) + 2, int(r.integers(10, 60))}), np.int32) for a, b in r.integers(0, 2, (3000, 2))]
    y = np.array([int((0 in x) == (2 in x)) for x in rows])
    m = fm.fit(rows[:2000], y[:2000], fm.Features(structure=False))
    assert len(m.ids) == len({i for x in rows[:2000] for i in x})
    assert np.mean([(m.score(x) >= 0.5) == t for x, t in zip(rows[2000:], y[2000:])]) > 0.95


@pytest.mark.parametrize("name,label,held,least", [("op3_quality_machine", "quality", 1, 0.97), ("op10_toxicity_machine", "toxic", 2, 0.92)])
def test_held_out_accuracy(spark, name, label, held, least):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES[name](spark, sf)
    rows = got.join(queries.table(spark, sf, "labels"), "doc_id").collect()
    out = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % (3 if held == 1 else 4) == held) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= (0.5 if held == 1 else 0.3)) for r in rows)
    assert sum(r.predicted == r[label] for r in out) >= least * len(out)
    assert got.count() == 1000


def test_machine_odd_rows(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(1, 0, 0), (None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int")
    m = fm.learn(docs, labels, "quality", F.lit(True), fm.QUALITY, most_rows=30)
    got = fm.scored(clashing(docs), m, 0.5)
    assert got.count() == docs.count() and got.where("score is null or score < 0 or score > 1").count() == 0
    none = fm.learn(empty, labels, "quality", F.lit(True), fm.QUALITY)
    assert [r.score for r in fm.scored(docs.limit(2), none, 0.5).collect()] == [0.5, 0.5]
    assert fm.scored(empty, m, 0.5).count() == 0
    one_class = fm.learn(docs, labels, "toxic", F.lit(True), fm.TOXICITY)
    assert all(r.predicted == 0 for r in fm.scored(docs.limit(3), one_class, 0.3).collect())


def test_machine_sample_counts_ids(spark, monkeypatch):
    """Copies of an id stand together in the sample's order and take one place."""
    rows = spark.createDataFrame([(i, f"text {i}", "en", "a", 6) for i in range(20) for _ in range(10)], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    monkeypatch.setattr(fm, "fit", lambda rows, labels, spec: len(rows))
    assert fm.learn(rows, labels, "quality", F.lit(True), fm.QUALITY, most_rows=15) == 15


# --- 4: tool calls ------------------------------------------------------------------------------------


def test_every_turn_is_a_call_or_a_result(spark, tmp_path):
    """Opening and system turns too, and rows without a role, a turn or a conversation."""
    rows = [(1, 0, "system", "be kind"), (1, 1, "assistant", "hm"), (1, 2, "tool", "ok"), (2, 0, "user", "hello"), (2, 1, None, "who"), (2, 2, "assistant", None), (3, None, "assistant", "x"), (3, None, "user", "y"), (None, 1, "user", "z"), (None, None, None, None), (4, 0, "assistant", "first"), (4, 1, "user", "")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.op4_tool_call_linking(spark, str(tmp_path)).collect()
    linked = [r for r in got if r.status == "linked"]
    assert len(got) + len(linked) == len(rows) and sorted((r.conv_id, r.call_turn) for r in linked) == [(1, 1), (4, 0)]
    assert sum(r.status == "no_call" for r in got) == 6 and sum(r.status == "no_result" for r in got) == 2


def test_tool_calls(spark):
    calls = spark.createDataFrame(
        [
            (1, 1, "a", "add", '{"y": 2, "x" : 1.50}', None), (1, 3, "b", "add", '{"x":1,"y":"2"}', "a"), (1, 5, "c", "add", "[1]", "b"),
            (1, 7, "d", "nope", '{"z":{"b":[1, 2],"a":null}}', "zz"), (1, 9, "e", "add", "{broken", "f"), (1, 10, "f", "add", '{"x":null,"y":1}', "e"),
            (2, 1, "a", "add", '{"y":3,"x":1,"q":"\\u00e9\\n\\""}', None), (2, 2, "r", "add", "{}", None), (2, 3, "r", "add", "{}", None),
            (None, 1, "n", None, None, None), (3, 1, None, "add", "", None),
        ],
        "conv_id long, turn long, call_id string, tool string, arguments string, after string",
    )
    results = spark.createDataFrame(
        [(1, 2, "a", 'say "hi"\n'), (1, 4, "b", None), (2, 4, "r", "x"), (2, 5, "lone", ""), (9, 1, "a", "y"), (1, 8, None, "z"), (1, 6, "c", "1"), (1, 6, "c", "2")],
        "conv_id long, turn long, call_id string, text string",
    )
    schemas = spark.createDataFrame([("add", "x", "number", True), ("add", "y", "integer", True), ("add", "y", "integer", True)], chat.SCHEMAS)
    rows = chat.format_calls(clashing(calls), clashing(results), schemas).collect()
    assert len(rows) == 11 + 8 - 2  # two pairs are linked: a and b of the first conversation
    by = {(r.conv_id, r.call_id): r for r in rows if r.status in ("linked", "no_result") and r.call_id}
    assert by[1, "a"].status == "linked" and by[1, "b"].status == "linked"
    assert [by[1, x].depth for x in "abd"] == [0, 1, 0] and by[1, "e"].depth is None and by[1, "f"].depth is None
    assert by[1, "a"].errors == [] and json.loads(by[1, "a"].canonical) == {"x": 1.5, "y": 2} and by[1, "a"].canonical.startswith('{"x":')
    assert by[1, "b"].errors == ["kind of y"] and by[1, "d"].errors == ["no such tool"] and by[1, "e"].errors == ["not an object"]
    assert by[1, "d"].canonical == '{"z":{"a":null,"b":[1,2]}}'
    assert by[1, "f"].errors == ["missing x"] and by[2, "a"].errors == ["unknown q"]
    assert Counter(r.status for r in rows) == Counter(linked=2, no_result=7 - 1, repeated=3 + 3, no_call=3)
    for r in rows:
        line = json.loads(r.line)
        assert line["call_id"] == r.call_id and line["status"] == r.status and line["result"] == r.result
        assert list(line) == sorted(line)
    none = chat.format_calls(calls.limit(0), results.limit(0), schemas)
    assert none.count() == 0


def test_long_chain_of_calls(spark):
    n = 300
    calls = spark.createDataFrame([(1, i, f"k{i}", "t", "{}", f"k{i - 1}" if i else None) for i in range(n)], "conv_id long, turn long, call_id string, tool string, arguments string, after string")
    links = chat.linked(calls, spark.createDataFrame([], "conv_id long, turn long, call_id string, text string"))
    assert sorted((r.call_turn, r.depth) for r in chat.ordered(links).collect()) == [(i, i) for i in range(n)]


# --- 5: rules -----------------------------------------------------------------------------------------


def plain_counts(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_rules(spark, docs, empty):
    extra = spark.createDataFrame([(2000, "é ü\n \na b\na b\x0c\nx\xa0y # <|>\n" + "one two three four five six seven eight nine " * 3, "en", "a", 1)] + [(2001 + i, "the " * 30, "en", "a", 1) for i in range(3)], DOCS)
    every = docs.unionByName(extra)
    got = rules.judge(rules.text_stats(clashing(every))).collect()
    mine = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    want = Counter((r.doc_id, *plain_counts(r.text)) for r in every.collect())
    assert mine == want
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and (not r.base_failed or not r.kept) for r in got)
    kept = rules.keep_good(clashing(every))
    assert kept.columns == clashing(every).columns and kept.count() == sum(r.kept for r in got)
    assert rules.judge(rules.text_stats(empty)).count() == 0 and rules.keep_good(empty).count() == 0


def test_fences_follow_their_group(spark):
    """Two sources of one language: what is usual in one is out of line in the other, on either side."""
    r = random.Random(4)
    text = lambda n, size, symbols: " ".join("".join(r.choice("abcdefgh") for _ in range(size + r.randint(-1, 1))) for _ in range(n)) + " " + "#" * symbols
    rows = [(i, text(60, 5, 0), "en", "prose", 1) for i in range(300)] + [(1000 + i, text(60, 9, r.randint(5, 40)), "en", "code", 1) for i in range(300)]
    odd = [(5000, text(60, 9, 0), "en", "prose", 1), (5001, text(60, 5, 30), "en", "prose", 1), (5002, text(60, 2, 0), "en", "prose", 1), (5003, text(60, 9, 30), "en", "code", 1), (5004, text(60, 3, 30), "en", "code", 1)]
    rows += odd + [(6000, text(60, 5, 0), "en", "small", 1), (6001, text(60, 80, 0), "en", "small", 1)]
    got = {x.doc_id: x.kept for x in rules.judge(rules.text_stats(spark.createDataFrame(rows, DOCS))).collect()}
    assert sum(not got[i] for i in range(300)) + sum(not got[1000 + i] for i in range(300)) <= 3
    # words of nine letters and a third of symbols: fine in code, not in prose; words of two or three are too short for both
    assert [got[x[0]] for x in odd] == [False, False, False, True, False]
    assert got[6000] and not got[6001]  # too few rows of its own: judged as its language


def test_sketch_merges_and_bounds(spark):
    r = np.random.default_rng(5)
    values = r.lognormal(3, 1, 5000)
    stats = spark.createDataFrame([(["a", "b"][i % 2], int(v * 1000), 1000) for i, v in enumerate(values)], "g string, word_chars long, n_words long")
    stats = stats.withColumns({c: F.lit(0).cast("long") for c in ("n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")})
    parts = rules.sketch(stats, ["g"])
    both = {tuple(x) for x in rules.merge(parts, []).collect()}
    assert both == {tuple(x) for x in rules.sketch(stats, []).collect()}
    q = rules.quantiles(rules.merge(parts, []), [], (0.25, 0.5, 0.99)).where("measure = 'mean_word_chars'").first()
    for share, got in zip((0.25, 0.5, 0.99), (q.q0, q.q1, q.q2)):
        assert abs(got / np.quantile(values, share) - 1) < 0.03


# --- 6: archives --------------------------------------------------------------------------------------


def test_chunks_round_trip():
    for n, size in itertools.product((0, 1, 7, 4096, 10000), (1, 7, 4096)):
        data = bytes(random.Random(n).randrange(256) for _ in range(n))
        assert warc.unchunked(warc.chunked(data, size)) == data
    assert warc.unchunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for broken in (b"", b"5\r\nabc\r\n0\r\n\r\n", b"zz\r\n"):
        with pytest.raises(ValueError):
            warc.unchunked(broken)


def test_archives(spark, tmp_path):
    nasty = b"x\r\n\r\nWARC/1.1\r\n\xff\x00\r\n\r\n" * 3
    rows = [(1, "http://a/\r\nX: y", b"same"), (7, "u", b"same"), (3, None, b"same"), (4, "u", b""), (2, "u", None), (5, "u", nasty), (6, "u", b"z" * 50_000), (6, "u", b"z" * 50_000), (None, "u", b"same"), (8, "u", bytes(range(256)) * 90)]
    spark.createDataFrame(rows, "page_id long, url string, payload binary").repartition(2).write.parquet(str(tmp_path / "p"))
    pages = spark.read.parquet(str(tmp_path / "p"))
    for least in (0, 5):
        folder = warc.write_archives(clashing(pages), least_bytes=least, segment=1000, chunk=300)
        got = warc.read_archives(spark, folder).collect()
        groups = defaultdict(list)
        for i, _, p in rows:
            groups[p or b""].append(-1 if i is None else i)
        want = Counter()
        for p, ids in groups.items():
            digest = base64.b32encode(hashlib.sha1(p).digest()).decode()
            ids.sort(reverse=True)
            for k, i in enumerate(ids):
                again = k > 0 and len(p) >= least
                want[None if i < 0 else i, len(p), digest, "revisit" if again else "response", ids[0] if again else None] += 1
        assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
        whole = warc.read_archives(spark, folder, with_payload=True).where("record_type = 'response'").collect()
        assert {(r.page_id, bytes(r.payload)) for r in whole} <= {(i, p or b"") for i, _, p in rows}
        assert warc.segments(spark, folder).where("kind = 'continuation'").count() > 50
    empty = warc.write_archives(pages.limit(0))
    assert warc.read_archives(spark, empty).count() == 0


def test_missing_segment_raises(spark):
    pages = spark.createDataFrame([(1, "u", b"q" * 5000)], "page_id long, url string, payload binary")
    parts = warc.segments(spark, warc.write_archives(pages, segment=1000))
    with pytest.raises(Exception, match="not whole"):
        warc.reassembled(parts.where("segment <> 2")).collect()
    with pytest.raises(Exception, match="not whole"):
        warc.reassembled(parts.where("total is null")).collect()


# --- 7: vectors ---------------------------------------------------------------------------------------


def vectors():
    r = np.random.default_rng(4)
    base = r.normal(size=(60, 24))
    rows = [(i, base[i % 60] + r.normal(size=24) * (0.25 if i % 3 else 0.6)) for i in range(400)]
    rows += [(1000 + i, rows[i % 5][1]) for i in range(30)]  # copies
    rows += [(2000, np.zeros(24)), (2001, None), (2002, [1.0, float("nan")] + [0.0] * 22), (2003, [float("inf")] * 24), (2004, rows[0][1] * 1e-300), (2005, rows[0][1] * 1e200)]
    rows += [(2006, [1.0, 2.0]), (2007, [2.0, 4.0]), (2008, [None] + [1.0] * 23), (2009, []), (None, rows[0][1])]
    return [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows]


def brute_vectors(rows, threshold):
    ok = [(i, np.array(v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)]
    unit = []
    for i, v in ok:
        v = v / np.abs(v).max()
        unit.append((i, v / np.sqrt(v @ v)))
    links = defaultdict(set)
    for (i, a), (j, b) in itertools.combinations(unit, 2):
        if len(a) == len(b) and a @ b >= threshold:
            links[i].add(j)
            links[j].add(i)
    root = {}
    for i, _ in sorted(((x, 0) for x, _ in rows if x is not None)):
        if i not in root:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in root:
                    root[x] = i
                    todo += links[x]
    return {(i, len(links[i]), root[i], root[i] == i) for i, _ in rows if i is not None} | {(None, 0, None, True)}


@pytest.mark.parametrize("block", [4096, 7])
def test_vectors(spark, block):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = neardup.near_duplicates(clashing(df), block=block, loss=1e-9).collect()
    assert {tuple(r) for r in got} == brute_vectors(rows, 0.9) and len(got) == len(rows)


def test_vectors_empty(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1200)] + [(5, 5), (None, 3), (2000, 2001), (2000, 2001)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in up}


# --- 8: language model --------------------------------------------------------------------------------


def test_language_model(spark, docs, empty):
    got = pitmanyor.score(clashing(docs), least_buckets=5).collect()
    rows = docs.collect()
    split = lambda t: [*(t or "").encode().lower().split(), None]
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0
    train = Counter(w for r in rows if not held(r.doc_id) for w in split(r.text))
    n, v = sum(train.values()), len(train)
    want = Counter()
    for r in rows:
        w = split(r.text)
        base = sum(math.log10((train[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        want[r.doc_id, held(r.doc_id), len(w), sum(train[x] > 0 for x in w), n, round(base, 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert pitmanyor.score(empty).count() == 0
    only_held = docs.where("doc_id is null")
    assert [(r.n_known, r.train_tokens) for r in pitmanyor.score(only_held).collect()] == [(0, 0)]


def test_predictions_add_up_to_one():
    """Over all known words and one unknown, in any context, the probabilities sum to one."""
    r = np.random.default_rng(2)
    known = pitmanyor.WordIds()
    texts = [" ".join(r.choice(WORDS[:60], 30)).encode() for _ in range(40)]
    pairs = [pitmanyor.tokens(t, known) for t in texts]
    ids, ctx = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    words, inverse = np.unique(ids, return_inverse=True)
    keys, count = np.unique(inverse * pitmanyor.CONTEXTS + ctx, return_counts=True)
    prior = pitmanyor.Prior()
    b = pitmanyor.Bucket(0, words, keys // pitmanyor.CONTEXTS, keys % pitmanyor.CONTEXTS, count)
    totals = pitmanyor.Totals(len(words), len(ids), [b.totals()])
    for k in range(3):
        b.sweep(k, totals.words, totals.split(totals.sweeps[k]), prior)
        totals.sweeps.append(b.totals())
        assert (b.t2 <= b.c2).all() and (b.t1 <= b.c1).all() and (b.t0 <= b.c0).all() and (b.t2 >= 1).all()
    flat = totals.split(totals.sweeps[-1])
    unknown = np.array([12345 << 5], np.uint64)
    for context in (0, int(ctx[5]), 1023):
        every = np.concatenate([words, unknown])
        p = b.predict(flat, totals.words, prior, every, np.full(len(every), context))
        assert (p > 0).all() and abs(p.sum() - 1) < 1e-9


def test_language_model_in_rounds(spark, tmp_path):
    """Buckets that are filled in passes and scored in rounds give every row the score that one round gives."""
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(WORDS[:60]) for _ in range(r.randrange(0, 30))) if i % 9 else None) for i in range(150)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    want = sorted(pitmanyor.score(docs, least_buckets=10, docs_per_bucket=40, rounds=1).collect())
    for rounds, passes in ((4, 2), (3, 3)):
        got = sorted(pitmanyor.score(docs, least_buckets=10, docs_per_bucket=40, rounds=rounds, passes=passes).collect())
        assert [x[:5] for x in got] == [x[:5] for x in want] and len(got) == 150
        assert np.allclose([x[5:] for x in got], [x[5:] for x in want], rtol=1e-12)
    # a pass moves the tokens of its own buckets only, and each bucket has one
    own = [{x.bucket for x in pitmanyor._sent(docs, 10, np.zeros(0, np.uint64), k, 2, 4).where("kind = 1").collect()} for k in range(2)]
    assert own[0] and own[1] and not own[0] & own[1]
    assert {b % 4 % 2 for b in own[0]} == {0} and {b % 4 % 2 for b in own[1]} == {1}


def test_texts_are_cut_alike(monkeypatch):
    """Words of many texts at a time are those of one text, with the same contexts, wherever a run ends."""
    r = random.Random(1)
    texts = ["".join(r.choice(" \t\n\x0b\x0c\rabAB\u00e9\u0130\x1c\x85") for _ in range(r.choice([0, 1, 5, 40]))) for _ in range(500)] + [None]
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts)})
    monkeypatch.setattr(pitmanyor, "BYTES", 30)
    monkeypatch.setattr(pitmanyor, "TOKENS", 300)
    seen = []
    for docs, sizes, first, second, word, ids in pitmanyor._gathered(iter([batch, batch.slice(0, 0)])):
        cut = np.cumsum(sizes)[:-1]
        for d, f, s, w in zip(docs, np.split(first, cut), np.split(second, cut), np.split(word, cut), strict=True):
            known = pitmanyor.WordIds()
            own, context = pitmanyor.tokens((texts[d] or "").encode(), known)
            assert ids[w].tolist() == own.tolist()
            assert ids[f].tolist() == known.ids[context // pitmanyor.BASE].tolist() and ids[s].tolist() == known.ids[context % pitmanyor.BASE].tolist()
            seen.append(d)
    assert seen == list(range(len(texts)))


@pytest.mark.parametrize("one_in", [1, 1_000_000])
def test_contexts_are_the_words_before(spark, one_in):
    """With no discount and next to no strength every dish keeps one table, so all is known: words of like endings stand
    for themselves as contexts, wherever the restaurants of frequent words lie."""
    r = random.Random(8)
    words = ["the"] * 12 + [f"{x}ing" for x in "abcdefghij"] + [f"{x}y" for x in "klmnop"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randrange(0, 40)))) for i in range(120)]
    s = 1e-9
    prior = pitmanyor.Prior(discount=(0.0, 0.0, 0.0), strength=(s, s, s))
    got = {x.doc_id: x.score for x in pitmanyor.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), prior, least_buckets=5, one_in=one_in).collect()}
    triples = {d: [*zip([None, None, *t.split()], [None, *t.split()], [*t.split(), None])] for d, t in rows}
    c2 = Counter(x for d, t in triples.items() if zlib.crc32(str(d).encode()) % 10 for x in t)
    c1 = Counter(x[1:] for x in c2)
    c0 = Counter(x[1] for x in c1)
    all2, all1 = Counter(), Counter()
    for x, n in c2.items():
        all2[x[:2]] += n
    for x, n in c1.items():
        all1[x[0]] += n

    def chance(x):
        p0 = (c0[x[2]] + s / (len(c0) + 1)) / (s + sum(c0.values()))
        p1 = (c1[x[1:]] + s * p0) / (s + all1[x[1]])
        return (c2[x] + s * p1) / (s + all2[x[:2]])

    for d, t in triples.items():
        assert math.isclose(got[d], sum(math.log10(chance(x)) for x in t), rel_tol=1e-6, abs_tol=1e-6)


# --- 9: shingle join ----------------------------------------------------------------------------------


def brute_shingles(rows):
    def sets(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    have = [(d, sets(t)) for d, t in rows]
    links = defaultdict(set)
    for i, j in itertools.combinations(range(len(have)), 2):
        a, b = have[i][1], have[j][1]
        if a and b and None not in (have[i][0], have[j][0]):
            both = len(a & b)
            if 100 * both >= 75 * (len(a) + len(b) - both):
                links[i].add(j)
                links[j].add(i)
    out = []
    for i, (d, s) in enumerate(have):
        seen, todo = set(), [i]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += links[x]
        out.append((d, len(s), d if d is None else min(have[x][0] for x in seen)))
    return Counter(out)


@pytest.mark.parametrize("block", [512, 4])
def test_shingle_join(spark, docs, block):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = shinglejoin.shingle_groups(clashing(docs), block=block, hubs=1).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_shingles(rows)
    kept = Counter(r.component_id for r in got if r.kept and r.n_shingles and r.doc_id is not None)
    assert kept.pop(5) == 2 and set(kept.values()) == {1}  # two texts have the id 5
    one = shinglejoin.one_of_each(clashing(docs))
    assert one.columns == clashing(docs).columns and one.count() == sum(r.kept for r in got)


@pytest.mark.parametrize("block", [512, 16])
def test_shingle_join_chain_of_near_copies(spark, tmp_path, block):
    """Neighbours link, the ends don't: a group over many blocks without a common centre."""
    r = random.Random(8)
    words = prose(120, r).split()
    rows = []
    for i in range(90):
        rows.append((500 - i, " ".join(words).upper() if i % 2 else " ".join(words)))
        for k in range(2):
            words[r.randrange(len(words))] = f"w{i}x{k}"
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(str(tmp_path / "d"))
    got = shinglejoin.shingle_groups(spark.read.parquet(str(tmp_path / "d")), block=block).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_shingles(rows)


def test_tree_bound_loses_nothing():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 1 << 63, 200, dtype=np.uint64) * np.uint64(2)) for _ in range(60)]
    for i in range(60):
        keep = np.sort(r.choice(sets[i], int(200 * r.uniform(0.75, 1)), replace=False))
        sets.append(np.unique(np.concatenate([keep, r.integers(0, 1 << 63, int(r.integers(0, 30)), dtype=np.uint64)])))
    points, sizes = [shinglejoin.point(s) for s in sets], np.array([len(s) for s in sets])
    assert all((shinglejoin.unpacked(shinglejoin.packed(p)) == p).all() for p in points)
    found = {frozenset((i, int(j))) for i, js in shinglejoin.survivors(points, sizes, 75, 100) for j in js}
    for i, j in itertools.combinations(range(len(sets)), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        if 100 * both >= 75 * (sizes[i] + sizes[j] - both):
            assert frozenset((i, j)) in found
    assert len(found) < 200  # of 7140 pairs


# --- pipeline -----------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = queries.table(spark, sf, "documents")
    names, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, sf), name)
        assert docs.columns == names and docs.count() <= before
        before = docs.count()
    pieces = queries.packed(docs)
    assert pieces.select("doc_id").distinct().count() == before
    whole = corpus_pipeline.run(spark, sf)
    assert whole.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).where("n <> m").count() == 0
