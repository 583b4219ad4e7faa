"""Merging of repeated detections.

Rows are first cut into islands across which a rule provably has no effect (with the skew-proof gap
grouping), so a task gets one short stretch of one source, never a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespan.functions.fuzzy import same_target
from cuespan.operators.ordered import gap_groups, lane, scan

LOOK_BACK = 4.0
MERGE_GAP = 2.5
START_GAP = 20.0
SNAPSHOT_CAP = 40

def one_edit(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    if len(a) == len(b):
        return a[head + 1 :] == b[head + 1 :]
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return long[head + 1 :] == short[head:]


def alike(a: str, b: str) -> bool:
    """The same rule as ``functions.fuzzy.same_target``, for use inside a task."""
    if a == b:
        return True
    if not (a and b):
        return False
    skeleton = (
        min(len(a), len(b)) >= 3
        and (a[:2], a[-1]) == (b[:2], b[-1])
        and abs(len(a) - len(b)) <= 1
    )
    return one_edit(a, b) or a in b or b in a or skeleton


_ORDER = ("t", "rank", "ord_t", "ord_seq")
_FIELDS = ("target", "text", "point", "container", "prev", "cur", "context", "price", "price_source")


def _down_events(downs: DataFrame, width: float) -> DataFrame:
    """Every down with ``event``: the order key of the sighting that it belongs to.

    Downs over LOOK_BACK apart can't meet, so each stretch between such pauses is decided alone, in the JVM:
    a look-back over the sightings of the last seconds, whose name follows their surest reading.
    """
    keys = ("session", "src")
    rows = gap_groups(downs, lane(keys, _ORDER, width), LOOK_BACK, "stretch")
    name = F.coalesce("target", F.lit(""))
    brief = F.struct(*_ORDER, F.col("conf").alias("sure"), name.alias("name"))
    lists = rows.groupBy(*keys, "stretch").agg(F.array_sort(F.collect_list(brief)).alias("seen"))
    sighting = "struct<at:int,since:double,sure:double,name:string>"
    start = F.struct(F.array().cast(f"array<{sighting}>").alias("live"), F.array().cast("array<int>").alias("owner"))

    def look_back(state: Column, row: Column) -> Column:
        live = F.filter(state["live"], lambda e: e["since"] >= row["t"] - LOOK_BACK)
        own = F.get(F.reverse(F.filter(live, lambda e: same_target(e["name"], row["name"]))), F.lit(0))
        at = F.coalesce(own["at"], F.size(state["owner"]))

        def surer(e: Column) -> Column:
            better = (e["at"] == at) & (row["sure"] > e["sure"])
            return F.struct(
                e["at"].alias("at"), e["since"].alias("since"), F.when(better, row["sure"]).otherwise(e["sure"]).alias("sure"),
                F.when(better, row["name"]).otherwise(e["name"]).alias("name"),
            )

        opened = F.struct(at.alias("at"), row["t"].alias("since"), row["sure"].alias("sure"), row["name"].alias("name"))
        kept = F.when(own.isNull(), F.concat(live, F.array(opened))).otherwise(F.transform(live, surer))
        return F.struct(kept.alias("live"), F.concat(state["owner"], F.array(at)).alias("owner"))

    owner = F.aggregate("seen", start, look_back, lambda s: s["owner"])
    pairs = F.transform("seen", lambda r, i: F.struct(*[r[c].alias(c) for c in _ORDER], i.alias("i")))
    named = lists.withColumn("owner", owner).withColumn("pair", F.explode(pairs))
    key_of = F.struct(*[F.get("seen", F.get("owner", F.col("pair.i")))[c].alias(c) for c in _ORDER])
    named = named.select(*keys, *[F.col(f"pair.{c}").alias(c) for c in _ORDER], key_of.alias("event"))
    return rows.drop("stretch").join(named, [*keys, *_ORDER])


def merge_raw_events(raw: DataFrame, width: float = 600.0, snapshot_cap: int = SNAPSHOT_CAP) -> DataFrame:
    """Fold repeated raw detections of one source into events.

    A down joins the latest similar down that began at most LOOK_BACK seconds before; the event takes
    its words from the surest reading. Any other kind joins the event directly before it, if that has the
    same kind and detail and ended in time: a run that another kind, another detail, a pause or a first
    sighting of a down breaks. Order keys are unique within a source.
    """
    keys = ("session", "src")
    order = F.struct(*_ORDER)
    downs = _down_events(raw.where("kind = 'down'"), width).withColumn("key", order)
    surest = F.struct("conf", *[(-F.col(c)).alias(c) for c in _ORDER])
    down_events = downs.groupBy(*keys, "event").agg(
        F.first("kind").alias("kind"), F.min("t").alias("t_start"), F.max("t").alias("t_end"), F.max_by("detail", surest).alias("detail"),
        F.max("conf").alias("confidence"), F.max_by("target", surest).alias("target"), F.max_by("text", surest).alias("text"),
        *[F.min_by(c, "key").alias(c) for c in ("snapshot", *_FIELDS[2:])],
    )
    # runs of the others; a down matters to them only where it is a sighting of its own
    others = raw.where("kind <> 'down'").unionByName(downs.where(F.col("event") == F.col("key")).select(*raw.columns))
    ln = lane(keys, _ORDER, width)
    seq = scan(others, ln, prev={"__before": F.struct("kind", "detail", "t")})
    gap = F.when(F.col("kind") == "match_start", START_GAP).otherwise(MERGE_GAP)
    same = F.col("__before.kind").eqNullSafe(F.col("kind")) & F.col("__before.detail").eqNullSafe(F.col("detail"))
    goes_on = F.coalesce(same & (F.col("t") - F.col("__before.t") <= gap), F.lit(False))
    seq = scan(seq.withColumn("__opens", (~goes_on).cast("long")), ln, running={"event": F.col("__opens")})
    texts = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("key"), "snapshot"))), lambda x: F.coalesce(x["snapshot"], F.array().cast("array<string>")))
    runs = seq.where("kind <> 'down'").withColumn("key", order).groupBy(*keys, "event").agg(
        F.first("kind").alias("kind"), F.min("t").alias("t_start"), F.max("t").alias("t_end"), F.min_by("detail", "key").alias("detail"),
        F.max("conf").alias("confidence"), F.count(F.lit(1)).alias("__n"), texts.alias("__texts"),
        *[F.min_by(c, "key").alias(c) for c in ("snapshot", *_FIELDS)],
    )
    joined = F.aggregate(
        F.slice("__texts", 2, F.greatest(F.size("__texts") - 1, F.lit(0))), F.get("__texts", F.lit(0)),
        lambda have, more: F.slice(F.concat(have, F.filter(more, lambda x: ~F.array_contains(have, x))), 1, snapshot_cap),
    )
    merged = (F.col("kind") == "extract") & (F.col("__n") > 1)
    runs = runs.withColumn("snapshot", F.when(merged, joined).otherwise(F.col("snapshot")))
    names = [*keys, "kind", "t_start", "t_end", "detail", "confidence", "target", "text", "point", "snapshot", *_FIELDS[3:]]
    return down_events.select(*names).unionByName(runs.select(*names))
