"""The named queries of this package."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, collocation, fm, hardneg, langid, mixing, neardup, packing, pitmanyor, rules, shinglejoin, warc
from .common import doc_bucket

TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def packed(docs: DataFrame) -> DataFrame:
    pieces = packing.pack(docs, public_tokenizers.path(TOKENIZER))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op1_sum_of_squares_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packed(table(spark, sf, "documents"))


def _classified(spark: SparkSession, sf: str, label: str, spec: fm.Features, folds: int, held: int, threshold: float) -> DataFrame:
    docs = table(spark, sf, "documents")
    fold = doc_bucket(F.col("doc_id"), folds)
    machine = fm.learn(docs, table(spark, sf, "labels"), label, fold != held, spec)
    return fm.scored(docs.select("doc_id", "text", *spec.metadata), machine, threshold).select(
        "doc_id", (fold == held).alias("held_out"), "score", "predicted")


def op3_quality_machine(spark: SparkSession, sf: str) -> DataFrame:
    return _classified(spark, sf, "quality", fm.QUALITY, 3, 1, 0.5)


def op10_toxicity_machine(spark: SparkSession, sf: str) -> DataFrame:
    return _classified(spark, sf, "toxic", fm.TOXICITY, 4, 2, 0.3)


def op5_adaptive_rules(spark: SparkSession, sf: str) -> DataFrame:
    from .common import staged

    stats = staged(rules.text_stats(table(spark, sf, "documents")), "text-stats")
    return rules.judge(stats).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_pfair_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents").select("source", "doc_id", "text"), block=16_384).select("doc_id", "source", "block", "slot", "before")


def op4_tool_call_linking(spark: SparkSession, sf: str) -> DataFrame:
    """Every assistant turn is a call, every other turn a result, of the call that is the turn before, if it is one.

    A row without a conversation or a turn has no id, and links with nothing.
    """
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    name = lambda turn: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    said = F.coalesce("text", F.lit(""))
    calls = turns.where("role = 'assistant'").select(
        "conv_id", "turn", name(F.col("turn")).alias("call_id"),
        F.when(F.length(said) % 3 == 0, "count").when(F.length(said) % 3 == 1, "lookup").otherwise("rank").alias("tool"),
        F.concat(F.lit('{"n": '), F.length(said).cast("string"), F.lit(' , "query":'), chat.quoted(said), F.lit(', "exact":'), (F.length(said) % 2 == 0).cast("string"), F.lit("}")).alias("arguments"),
        F.when(F.col("turn") >= 2, name(F.col("turn") - 2)).alias("after"),
    )
    results = turns.where("coalesce(role, '') <> 'assistant'").select("conv_id", "turn", name(F.col("turn") - 1).alias("call_id"), "text")
    schemas = spark.createDataFrame(
        [("count", "n", "integer", True), ("count", "query", "string", True), ("count", "exact", "boolean", False),
         ("lookup", "query", "string", True), ("lookup", "limit", "integer", True), ("lookup", "n", "number", False)], chat.SCHEMAS)
    rows = chat.format_calls(calls, results, schemas)
    return rows.select("conv_id", "call_id", "call_turn", "result_turn", "tool", "status", "depth", F.array_join("errors", "; ").alias("errors"), "canonical", "line")


def op6_segmented_archives(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    folder = warc.write_archives(pages.select("page_id", "url", F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload")))
    return warc.read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_hyperplane_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf, "embeddings"))


def op8_pitman_yor(spark: SparkSession, sf: str) -> DataFrame:
    return pitmanyor.score(table(spark, sf, "documents"))


def op9_count_tree_join(spark: SparkSession, sf: str) -> DataFrame:
    return shinglejoin.shingle_groups(table(spark, sf, "documents")).select("doc_id", "n_shingles", "component_id")


def op11_phrase_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocation.collocations(table(spark, sf, "documents"))


def op12_rank_order_profiles(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    fold = doc_bucket(F.col("doc_id"), 5)
    profiles = langid.learn(docs, fold != 0)
    return langid.identify(docs.select("doc_id", "text", (fold == 0).alias("held_out")), profiles).select("doc_id", "held_out", "lang_pred", "score")


def op13_zone_mapped_negatives(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hardneg.hard_negatives(vectors, F.col("vec_id") % 100 == 0)


QUERIES = {
    f.__name__: f
    for f in (
        op1_sum_of_squares_packing, op2_pfair_mixing, op3_quality_machine, op4_tool_call_linking, op5_adaptive_rules, op6_segmented_archives,
        op7_hyperplane_neighbours, op8_pitman_yor, op9_count_tree_join, op10_toxicity_machine,
        op11_phrase_collocations, op12_rank_order_profiles, op13_zone_mapped_negatives,
    )
}
#: Turns are unique in a conversation here, so ids are; islands of turns two apart give the depth.
ORACLE = {
    "op4_tool_call_linking": """WITH t AS (SELECT conv_id, turn, role, text, length(coalesce(text, '')) AS n FROM conversations),
c AS (SELECT *, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS isle FROM t WHERE role = 'assistant'),
d AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2, isle ORDER BY turn) - 1 AS depth FROM c),
r AS (SELECT conv_id, turn, text FROM t WHERE coalesce(role, '') <> 'assistant'),
j AS (
  SELECT coalesce(d.conv_id, r.conv_id) AS conv_id, 'c' || coalesce(d.conv_id, r.conv_id) || '-' || coalesce(d.turn, r.turn - 1) AS call_id,
    d.turn AS call_turn, r.turn AS result_turn, CASE d.n % 3 WHEN 0 THEN 'count' WHEN 1 THEN 'lookup' WHEN 2 THEN 'rank' END AS tool,
    CASE WHEN d.turn IS NULL THEN 'no_call' WHEN r.turn IS NULL THEN 'no_result' ELSE 'linked' END AS status, depth,
    CASE WHEN d.turn IS NULL THEN [] WHEN d.n % 3 = 0 THEN [] WHEN d.n % 3 = 1 THEN ['missing limit', 'unknown exact'] ELSE ['no such tool'] END AS errs,
    '{"exact":' || (d.n % 2 = 0) || ',"n":' || d.n || ',"query":' || CAST(to_json(coalesce(d.text, '')) AS VARCHAR) || '}' AS canonical, r.text AS result
  FROM d FULL JOIN r ON r.conv_id = d.conv_id AND r.turn = d.turn + 1)
SELECT conv_id, call_id, call_turn, result_turn, tool, status, CAST(depth AS BIGINT) AS depth, coalesce(array_to_string(errs, '; '), '') AS errors, canonical,
  '{"arguments":' || coalesce(canonical, 'null') || ',"call_id":"' || call_id || '","depth":' || coalesce(CAST(depth AS VARCHAR), 'null') || ',"errors":['
    || coalesce(array_to_string(list_transform(errs, lambda x: '"' || x || '"'), ','), '') || '],"result":' || coalesce(CAST(to_json(result) AS VARCHAR), 'null')
    || ',"status":"' || status || '","tool":' || coalesce('"' || tool || '"', 'null') || '}' AS line
FROM j""",
    "op5_adaptive_rules": r"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, chr(1)) AS lang, coalesce(source, chr(1)) AS source, coalesce(text, '') AS text,
  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT rid, unnest(range(1, len(w) - 6)) AS pos, w FROM d WHERE len(w) >= 8),
g AS (SELECT rid, pos, count(*) OVER (PARTITION BY rid, array_to_string(w[pos : pos + 7], ' ')) AS times FROM i),
r AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest(range(pos, pos + 8)) AS p FROM g WHERE times > 1) GROUP BY 1),
n AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
s AS (SELECT d.rid, doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN n ON n.rid = d.rid LEFT JOIN r ON r.rid = d.rid),
m AS (SELECT rid, lang, source, unnest(['symbol_share', 'dup_line_share', 'repeat_share', 'mean_word_chars']) AS measure, unnest([0.0125, 0.05, 0.034, 0.05]) AS guard,
  unnest([n_symbols / greatest(n_words, 1), n_dup_lines / greatest(n_lines, 1), n_repeat_words / greatest(n_words, 1), word_chars / greatest(n_words, 1)]) AS v FROM s),
b AS (SELECT *, CASE WHEN v > 0.000001 THEN CAST(ceil(ln(v) / ln(CAST(1.005 AS DOUBLE))) AS INT) END AS bucket FROM m),
k AS (SELECT *, unnest([lang || chr(2) || source, lang, '']) AS grp, unnest([1, 2, 3]) AS level FROM b),
c AS (SELECT level, grp, measure, max(guard) AS guard, coalesce(pow(CAST(1.005 AS DOUBLE), bucket), 0) AS value, count(*) AS n FROM k GROUP BY level, grp, measure, bucket),
u AS (SELECT *, sum(n) OVER (PARTITION BY level, grp, measure ORDER BY value) AS upto, sum(n) OVER (PARTITION BY level, grp, measure) AS total FROM c),
q AS (SELECT level, grp, measure, max(total) AS total, max(guard) AS guard, min(value) FILTER (upto >= 0.25 * total) AS q0, min(value) FILTER (upto >= 0.75 * total) AS q1 FROM u GROUP BY 1, 2, 3),
f AS (SELECT k.rid, k.measure, max(k.v) AS v, arg_min(q.q1 + 8 * greatest(q.q1 - q.q0, q.guard), k.level) FILTER (q.total >= 200 OR k.level = 3) AS cut,
    arg_min(q.q0 - 8 * greatest(q.q1 - q.q0, q.guard), k.level) FILTER (q.total >= 200 OR k.level = 3) AS low
  FROM k JOIN q ON q.level = k.level AND q.grp = k.grp AND q.measure = k.measure GROUP BY 1, 2),
o AS (SELECT rid, bool_and(v <= cut * CAST(1.005 AS DOUBLE) AND v * CAST(1.005 AS DOUBLE) >= low) AS inside FROM f GROUP BY 1)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND inside AS kept FROM s JOIN o ON o.rid = s.rid""",
    "op6_segmented_archives": """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, max(page_id) OVER (PARTITION BY h) AS best, CAST(CAST(unhex(sha1(h)) AS BIT) AS VARCHAR) AS bits FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * CAST(substr(bits, 5 * k + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * k + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * k + 3, 1) AS INT)
    + 2 * CAST(substr(bits, 5 * k + 4, 1) AS INT) + CAST(substr(bits, 5 * k + 5, 1) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to FROM d""",
    "op7_hyperplane_neighbours": """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= CAST(0.9 AS DOUBLE)),
r(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY 1), n AS (SELECT x, count(*) AS n FROM l GROUP BY 1)
SELECT c.x AS vec_id, coalesce(n, 0) AS n_links, component_id, c.x = component_id AS kept FROM c LEFT JOIN n ON n.x = c.x""",
    "op9_count_tree_join": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM i JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * m >= 75 * (a.n + b.n - m)),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT x AS doc_id, coalesce(max(n), 0) AS n_shingles, min(y) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.x GROUP BY 1""",
    "op11_phrase_collocations": r"""WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang,
  unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS k FROM w WHERE len(w) > 0),
g AS (SELECT lang, w[k : k + m - 1] AS g FROM i, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE k + m - 1 <= len(w)),
f AS (SELECT lang, g, count(*) AS a FROM g GROUP BY 1, 2 HAVING count(*) >= 30),
t AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY 1),
c AS (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM f WHERE len(g) > 1),
s AS (SELECT c.lang, c.g, c.a, k, x.a AS l, y.a AS r, CAST(2000000 * CAST(c.a AS HUGEINT) // (x.a + y.a) AS BIGINT) AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.g = c.g[1 : k] JOIN f y ON y.lang = c.lang AND y.g = c.g[k + 1 : len(c.g)]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
p AS (SELECT DISTINCT f.lang, f.g[j : j + m - 1] AS g, f.a FROM f, (SELECT unnest([1, 2, 3]) AS j), (SELECT unnest([2, 3]) AS m) WHERE m < len(f.g) AND j + m - 1 <= len(f.g)),
v AS (SELECT b.*, array_to_string(g, ' ') AS phrase FROM b WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.lang = b.lang AND p.g = b.g AND 100 * p.a >= 80 * b.a))
SELECT v.lang, row_number() OVER (PARTITION BY v.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM v JOIN t ON t.lang = v.lang QUALIFY rank <= 2000""",
    "op12_rank_order_profiles": r"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text, CAST(doc_id AS VARCHAR) AS id FROM documents),
f AS (SELECT rid, doc_id, lang, regexp_matches(text, '\p{L}') AS letters, ' ' || trim(regexp_replace(lower(text), '[^\p{L}\p{M}]+', ' ', 'g')) || ' ' AS t,
  xor(list_reduce(list_transform(range(1, length(id) + 1), lambda k: CAST(ascii(substr(id, k, 1)) AS BIGINT)), lambda c, b:
    list_reduce(range(8), lambda e, k: CASE WHEN e & 1 = 1 THEN xor(e >> 1, 3988292384) ELSE e >> 1 END, xor(c, b)), CAST(4294967295 AS BIGINT)), 4294967295) % 5 = 0 AS held_out FROM d),
i AS (SELECT rid, t, unnest(range(1, length(t) + 1)) AS k FROM f WHERE letters),
g AS (SELECT rid, substr(t, k, 1) AS g FROM i UNION ALL SELECT rid, substr(t, k, 2) FROM i WHERE k < length(t)
  UNION ALL SELECT rid, substr(t, k, 3) FROM i WHERE k < length(t) - 1 AND substr(t, k + 1, 1) <> ' '),
n AS (SELECT rid, g, count(*) AS n FROM g WHERE g <> ' ' GROUP BY 1, 2),
o AS (SELECT rid, g, row_number() OVER (PARTITION BY rid ORDER BY n DESC, g) AS r FROM n QUALIFY r <= 400),
p AS (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, g) AS r FROM n JOIN f USING (rid) WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, g QUALIFY r <= 400),
m AS (SELECT rid, 400 * count(*) AS most FROM o GROUP BY 1),
s AS (SELECT rid, p.lang, sum(400 - abs(o.r - p.r)) AS saved FROM o JOIN p USING (g) GROUP BY 1, 2),
b AS (SELECT rid, lang, saved FROM s QUALIFY row_number() OVER (PARTITION BY rid ORDER BY saved DESC, lang) = 1)
SELECT doc_id, held_out, coalesce(b.lang, CASE WHEN letters THEN (SELECT min(lang) FROM p) END, 'und') AS lang_pred,
  CASE WHEN b.rid IS NULL THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) - CAST(most - saved AS DOUBLE) / CAST(most AS DOUBLE) END AS score
FROM f LEFT JOIN b ON b.rid = f.rid LEFT JOIN m ON m.rid = f.rid""",
    "op13_zone_mapped_negatives": """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS INT) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10""",
}
