"""Pfair mixing of sources: every block has a release and a deadline; the earliest deadline goes first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import own_name, partitions, staged


def shares_from_sizes(sizes: DataFrame, power: float = 0.5, slots: int = 256) -> DataFrame:
    """``source``, ``share``: whole slots of a round, in proportion to size to the ``power``, one at least."""
    weight = F.ceil(F.pow(F.col("size").cast("double"), F.lit(power)) * 1000)  # whole, so that sums are exact
    total = F.sum(weight).over(Window.partitionBy(F.lit(0)))  # one row per source
    return sizes.select("source", F.greatest(F.lit(1), F.round(weight / total * slots)).cast("int").alias("share"))


def earliest_deadline_first(counts: Column, slots: Column) -> Column:
    """The schedule of one round: for ``counts[i]`` blocks of source ``i``, ``slots`` in sum, the source of each slot.

    Block k of c in a round of n slots is released at floor((k-1)n/c) and due at ceil(kn/c). In each
    slot the released block with the earliest deadline runs, ties to the lower source. Every
    deadline is met, so a source is never a whole block away from its share at any slot.
    """
    start = F.struct(F.transform(counts, lambda _: F.lit(0)).alias("done"), F.array().cast("array<int>").alias("order"))

    def step(state: Column, slot: Column) -> Column:
        due = F.zip_with(counts, state["done"], lambda c, k: F.when((k < c) & (F.floor(k * slots / c) <= slot), F.ceil((k + 1) * slots / c)))
        pick = F.array_position(due, F.array_min(due)).cast("int") - 1
        done = F.transform(state["done"], lambda k, i: k + (i == pick).cast("int"))
        return F.struct(done.alias("done"), F.concat(state["order"], F.array(pick)).alias("order"))

    return F.aggregate(F.sequence(F.lit(0), slots - 1), start, step, lambda s: s["order"])


def positions(docs: DataFrame, size: Column, block: int, bucket_rows: int = 4_096) -> DataFrame:
    """``docs`` with ``before``: the size of the source's documents ahead of each, in a hashed order.

    A source is cut into buckets by hash, many for a large one; running sums stay inside a
    bucket, and the buckets' totals are summed up in a second, small window. No task meets a whole source.
    """
    rows = docs.withColumn("__size", F.greatest(F.lit(1), F.coalesce(size, F.lit(1))).cast("long"))
    number = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).select(F.col("source").alias("__s"), F.ceil(F.col("n") / bucket_rows).cast("int").alias("__buckets"))
    rows = rows.join(number, F.col("source").eqNullSafe(F.col("__s"))).withColumn("__h", F.xxhash64("doc_id", "__row"))
    rows = rows.withColumn("__b", F.pmod(F.col("__h"), F.col("__buckets")).cast("int"))
    totals = rows.groupBy("source", "__b").agg(F.sum("__size").alias("t"))
    ahead = F.sum("t").over(Window.partitionBy("source").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(F.col("source").alias("__ts"), F.col("__b").alias("__tb"), F.coalesce(ahead, F.lit(0)).alias("__ahead"))
    inside = F.sum("__size").over(Window.partitionBy("source", "__b").orderBy("__h", "__row").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__inside", F.coalesce(inside, F.lit(0)))
    rows = rows.join(totals, F.col("source").eqNullSafe(F.col("__ts")) & (F.col("__b") == F.col("__tb")))
    return rows.withColumn("before", F.col("__ahead") + F.col("__inside")).drop("__s", "__buckets", "__b", "__ts", "__tb", "__ahead", "__inside")


def schedule(sizes: DataFrame, shares: DataFrame, block: int) -> DataFrame:
    """One row per block: ``source``, ``block`` (from 0), ``slot`` (gapless from 0 over all blocks).

    Rounds: in each, a source gives its share of blocks, or what it has left. A round starts and ends
    with every source exactly at its share, so rounds are scheduled apart, each by earliest deadline
    first; rounds alike in counts use one schedule. Once a source ends, the others divide its slots.
    """
    named_shares = shares.select(F.col("source").alias("__src"), "share")
    per = sizes.join(named_shares, F.col("source").eqNullSafe(F.col("__src"))).select("source", "share", F.ceil(F.col("size") / block).cast("long").alias("blocks"))
    whole = Window.partitionBy(F.lit(0))  # one row per source from here, whatever the number of documents
    per = per.withColumn("i", F.row_number().over(whole.orderBy("source")) - 1).withColumn("rounds", F.ceil(F.col("blocks") / F.col("share")))
    lists = per.agg(F.sort_array(F.collect_list(F.struct("i", "share", "blocks"))).alias("all"), F.max("rounds").alias("rounds"))
    chunk = 4096  # rounds of one row of the first explode; they are then dealt out
    rounds = lists.where("rounds > 0").select("all", "rounds", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rounds") - 1, F.lit(chunk).cast("long"))).alias("from")).repartition("from")
    rounds = rounds.select("all", F.explode(F.sequence("from", F.least(F.col("from") + chunk, F.col("rounds")) - 1)).alias("round"))
    give = F.transform("all", lambda s: F.greatest(F.lit(0), F.least(s["share"].cast("long"), s["blocks"] - F.col("round") * s["share"])).cast("int"))
    first = F.aggregate("all", F.lit(0).cast("long"), lambda a, s: a + F.least(s["blocks"], F.col("round") * s["share"]))
    rounds = rounds.select("round", give.alias("counts"), first.alias("first"))
    # a few kinds of rounds, each scheduled once: the written schedules are what the rounds join
    kinds = rounds.select("counts").distinct().withColumn("slots", F.aggregate("counts", F.lit(0), lambda a, c: a + c))
    kinds = staged(kinds.repartition("counts").select("counts", earliest_deadline_first(F.col("counts"), F.col("slots")).alias("order")), "round-schedules")
    slots = rounds.join(kinds, "counts").select("round", "first", F.posexplode("order").alias("at", "i"))
    turn = F.row_number().over(Window.partitionBy("round", "i").orderBy("at")) - 1
    slots = slots.withColumn("turn", turn)
    named = slots.join(per.select("i", "source", "share"), "i")
    return named.select("source", (F.col("round") * F.col("share") + F.col("turn")).alias("block"), (F.col("first") + F.col("at")).alias("slot"))


def mix(docs: DataFrame, shares: DataFrame | None = None, block: int = 16_384, size: Column | None = None) -> DataFrame:
    """``docs`` with ``block`` of their source, ``slot`` of the mixture and ``before``, their place in the source.

    Read in the order of slot and place, the sources alternate block by block so that at every slot
    each source is less than one block away from its target share. ``size`` (default: text
    length) measures a block; a document belongs to the block in which it starts, so one longer than a
    block takes several slots. ``shares``: ``source`` and whole slots of a round; by default they follow
    the square root of the sources' sizes. Every document has exactly one place: none is
    dropped or repeated, and as a source ends the others take its slots in proportion.

    ``docs`` should be a table in storage: with further columns, rows find their place by scan position.
    Null source: a source of its own. A source without a share gets one slot of a round. Null or empty
    text counts as size 1. Ties and repeated rows are ordered by a row number of the scan. An empty table gives
    no row. Extra columns stay; columns named ``block``, ``slot``, ``before`` are replaced.
    """
    size = F.length("text") if size is None else size
    names = [c for c in docs.columns if c not in ("block", "slot", "before")]
    thin = docs.select("source", "doc_id", size.alias("__measure"), F.monotonically_increasing_id().alias("__row"))
    placed = staged(positions(thin, F.col("__measure"), block), "places")
    sizes = staged(placed.groupBy("source").agg(F.sum("__size").alias("size")), "source-sizes")
    if shares is None:
        shares = shares_from_sizes(sizes)
    else:
        given = shares.groupBy(F.col("source").alias("__src")).agg(F.max("share").alias("given"))
        shares = sizes.join(given, F.col("source").eqNullSafe(F.col("__src")), "left").select("source", F.greatest(F.lit(1), F.coalesce("given", F.lit(1))).cast("int").alias("share"))
    slots = schedule(sizes, shares, block).select(F.col("source").alias("__ss"), F.col("block").alias("__sb"), "slot")
    placed = placed.withColumn("block", F.floor(F.col("before") / block))
    out = placed.join(slots, F.col("source").eqNullSafe(F.col("__ss")) & (F.col("block") == F.col("__sb")))
    if set(names) <= {"source", "doc_id"}:
        return out.select(*names, "block", "slot", "before")
    row = own_name("row")
    return docs.select(*names, F.monotonically_increasing_id().alias(row)).join(out.select(F.col("__row").alias(row), "block", "slot", "before"), row).drop(row)


def in_order(mixed: DataFrame) -> DataFrame:
    """Rows dealt and sorted by place, so that files written from it are runs of the mixture."""
    n = partitions(mixed.sparkSession)
    return mixed.repartitionByRange(n, "slot", "before").sortWithinPartitions("slot", "before")
