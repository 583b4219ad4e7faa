"""Tool calls in conversations: linked with their results, ordered, validated, written as canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: One argument of a tool: its JSON kind (string, integer, number, boolean, array, object), and if it must be there.
SCHEMAS = "tool string, argument string, kind string, required boolean"


def linked(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Every call and every result once, joined by conversation and call id.

    ``status``: linked, no_result, no_call, or repeated (an id that a conversation's calls or results
    use twice or more: which belongs to which can't be told, so all of them are kept apart). Null ids link
    with nothing. Ids are made unique before the join, so no id meets a product of rows.
    """
    key = ["conv_id", "call_id"]

    def unique(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        n = df.where("conv_id is not null and call_id is not null").groupBy(*key).agg(F.count(F.lit(1)).alias("times"))
        both = df.join(n, key, "left").withColumn("times", F.coalesce("times", F.lit(0)))
        return both.where("times = 1").drop("times"), both.where("times <> 1")

    c, odd_c = unique(calls)
    r, odd_r = unique(results)
    c = c.select(*key, F.col("turn").alias("call_turn"), "tool", "arguments", "after")
    r = r.select(*key, F.col("turn").alias("result_turn"), F.col("text").alias("result"))
    odd_ids = odd_c.select(*key).union(odd_r.select(*key)).distinct().withColumn("odd", F.lit(True))
    full = c.join(r, key, "full").join(odd_ids, key, "left")
    status = F.when(F.col("odd"), "repeated").when(F.col("call_turn").isNull(), "no_call").when(F.col("result_turn").isNull(), "no_result").otherwise("linked")
    names = [*key, "call_turn", "result_turn", "tool", "arguments", "after", "result"]
    lone = lambda times: F.when(times > 1, "repeated")
    out = full.select(*names, status.alias("status"))
    out = out.unionByName(odd_c.select(*key, F.col("turn").alias("call_turn"), "tool", "arguments", "after", F.coalesce(lone(F.col("times")), F.lit("no_result")).alias("status")), allowMissingColumns=True)
    return out.unionByName(odd_r.select(*key, F.col("turn").alias("result_turn"), F.col("text").alias("result"), F.coalesce(lone(F.col("times")), F.lit("no_call")).alias("status")), allowMissingColumns=True)


def ordered(links: DataFrame) -> DataFrame:
    """``links`` with ``depth``: how many calls must come before. ``after`` names the call that a call waits for.

    Pointers double each round: after k rounds a call knows its ancestor 2^k calls up, so a chain of n
    calls takes log n joins, and one conversation may hold any share of them. Calls on or behind a
    circle never reach a root; once all others have, they get depth null. A call that waits for an unknown, repeated
    or null id is a root.
    """
    key = ["conv_id", "call_id"]
    unique = links.where("status in ('linked', 'no_result')").where("conv_id is not null and call_id is not null")
    nodes = unique.select(*key, "after")
    known = nodes.select("conv_id", F.col("call_id").alias("after"), F.lit(True).alias("known"))
    now = staged(nodes.join(known, ["conv_id", "after"], "left").select(*key, F.when(F.col("known"), F.col("after")).alias("up"), F.when(F.col("known"), 1).otherwise(0).cast("long").alias("depth")), "call-depths")
    rounds, open_calls, limit = 0, now.where("up is not null").count(), now.count()
    while open_calls and 2**rounds <= limit:
        above = now.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        now = staged(now.join(above, ["conv_id", "up"], "left").select(*key, F.col("next").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "call-depths")
        rounds, open_calls = rounds + 1, now.where("up is not null").count()
    depths = now.select(*key, F.when(F.col("up").isNull(), F.col("depth")).alias("d"), F.col("up").isNotNull().alias("circle"))
    rest = links.join(depths, key, "left")
    single = F.col("status").isin("linked", "no_result")
    return rest.select(*links.columns, F.when(single & F.col("circle"), None).when(single, F.coalesce("d", F.lit(0))).alias("depth"))


def kind_of(value: Column) -> Column:
    """JSON kind of the text of a JSON value."""
    v = F.trim(value)
    return (
        F.when(v.startswith('"'), "string").when(v.startswith("{"), "object").when(v.startswith("["), "array")
        .when(v.isin("true", "false"), "boolean").when(v == "null", "null")
        .when(v.rlike(r"^-?(0|[1-9][0-9]*)$"), "integer").when(v.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), "number")
    )


def quoted(text: Column) -> Column:
    """A JSON string: backslash, quote and control characters escaped, all else as it is."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    short = {8: "b", 9: "t", 10: "n", 12: "f", 13: "r"}
    for c in range(32):
        out = F.replace(out, F.lit(chr(c)), F.lit("\\" + short[c] if c in short else f"\\u{c:04x}"))
    return F.concat(F.lit('"'), out, F.lit('"'))


def fields(arguments: Column) -> Column:
    """Name to value text of a JSON object, values as JSON without blanks between tokens; null unless an object."""
    return F.from_json(arguments, "map<string,variant>", {"mode": "PERMISSIVE"})


def canonical(entries: Column) -> Column:
    """Object text: names sorted by code point, no blanks; of ``entries``, structs of name and value text."""
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(entries), lambda e: F.concat(quoted(e["name"]), F.lit(":"), e["value"])), ","), F.lit("}"))


def validated(links: DataFrame, schemas: DataFrame) -> DataFrame:
    """``links`` with ``errors`` (sorted) and ``canonical`` (arguments with sorted names, null unless an object).

    Schemas are gathered per tool, so a call meets one row; an argument's kind must be the one given,
    ``number`` takes integers too. Unknown tools and arguments, missing required ones and text that isn't a
    JSON object are errors; a null argument counts as missing. Of repeated schema rows one counts.
    """
    rules = schemas.where("tool is not null and argument is not null").groupBy("tool", "argument").agg(F.max("kind").alias("kind"), F.max("required").alias("required"))
    rules = rules.groupBy("tool").agg(F.sort_array(F.collect_list(F.struct("argument", "kind", "required"))).alias("rules"))  # a tool's arguments: few
    got = links.join(rules, "tool", "left").withColumn("__map", fields(F.col("arguments")))
    pairs = F.transform(F.map_entries("__map"), lambda e: F.struct(e["key"].alias("name"), F.coalesce(F.to_json(e["value"]), F.lit("null")).alias("value")))
    got = got.withColumn("__pairs", pairs)
    names = F.transform("__pairs", lambda p: p["name"])
    known = F.transform("rules", lambda r: r["argument"])

    def fault(rule: Column) -> Column:
        mine = F.filter("__pairs", lambda p: p["name"] == rule["argument"])
        kind = kind_of(F.get(mine, F.lit(0))["value"])
        absent = (F.size(mine) == 0) | (kind == "null")
        right = (kind == rule["kind"]) | ((rule["kind"] == "number") & (kind == "integer"))
        return F.when(absent & rule["required"], F.concat(F.lit("missing "), rule["argument"])).when(~absent & ~right, F.concat(F.lit("kind of "), rule["argument"]))

    faults = F.filter(F.transform("rules", fault), lambda x: x.isNotNull())
    extra = F.transform(F.array_except(names, known), lambda n: F.concat(F.lit("unknown "), n))
    errors = F.when(F.col("tool").isNull(), F.array().cast("array<string>")).when(F.col("rules").isNull(), F.array(F.lit("no such tool"))).when(F.col("__map").isNull(), F.array(F.lit("not an object"))).otherwise(F.array_sort(F.concat(faults, extra)))
    return got.select(*links.columns, errors.alias("errors"), F.when(F.col("__map").isNotNull(), canonical(F.col("__pairs"))).alias("canonical"))


def format_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call or lone result: its link, depth, errors and ``line``.

    ``calls``: conv_id, turn, call_id, tool, arguments (JSON text), after (the id it waits for); ``results``:
    conv_id, turn, call_id, text. Sorted by depth, turn and id (null last), a conversation has every call behind the
    one it waits for, and circles and rows that don't link at its end. ``line`` is the canonical JSON of the
    exchange. Null texts are JSON null, empty ones "". Extra columns are not read. Repeated rows share their
    id, hence are 'repeated'. Empty tables give no row.
    """
    calls = calls.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "call_id", "tool", "arguments", "after")
    results = results.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "call_id", F.col("text").cast("string").alias("text"))
    rows = validated(ordered(linked(calls, results)), schemas)
    text = lambda c: F.coalesce(quoted(F.col(c)), F.lit("null"))
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    line = F.concat(
        F.lit('{"arguments":'), F.coalesce("canonical", F.lit("null")), F.lit(',"call_id":'), text("call_id"), F.lit(',"depth":'), number("depth"),
        F.lit(',"errors":['), F.array_join(F.transform("errors", quoted), ","), F.lit('],"result":'), text("result"), F.lit(',"status":'), text("status"), F.lit(',"tool":'), text("tool"), F.lit("}"),
    )
    return rows.withColumn("line", line)
