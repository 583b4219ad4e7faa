"""Structured Streaming jobs and the batch queries they must agree with."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from cuespan.operators.ordered import lane, scan


# --- gap sessions -------------------------------------------------------------------------------


def streaming_gap_sessions(
    events: DataFrame, keys: list[str], ts: str, gap: str, late: str
) -> DataFrame:
    """Gap sessions of a stream; rows exactly ``gap`` apart stay together, as in batch.

    In append mode a session appears once the watermark has passed its end.
    """
    return (
        events.withWatermark(ts, late)
        .groupBy(*keys, F.session_window(ts, gap).alias("w"))
        .agg(F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
        .drop("w")
    )


# --- stall detection ----------------------------------------------------------------------------


def stalls(growth: DataFrame, stall_sec: float = 20.0, width: float = 3600.0) -> DataFrame:
    """Batch twin: moments a source had not grown for more than ``stall_sec``.

    Each row where the size changed opens a quiet stretch until the next change; the stall is the
    first later row more than that into it.
    """
    t = F.unix_micros("ts") / 1e6
    rows = scan(
        growth.withColumn("__t", t), lane("src", ("__t",), width), prev={"__s": F.col("size")}
    )
    changed = F.col("__s").isNull() | (F.col("__s") != F.col("size"))
    rows = scan(
        rows.withColumn("__ch", changed), lane("src", ("__t",), width),
        last={"grew": F.when(F.col("__ch"), F.col("__t"))},
    )
    late = rows.where((F.col("__t") - F.col("grew") > stall_sec) & ~F.col("__ch"))
    return late.groupBy("src", "grew").agg(F.min("__t").alias("stalled_at"))


class _StallWatch(StatefulProcessor):
    """Stalls of one source. The latest growth is carried over as the row ahead of a batch; growth rows
    and the distance of the others to them come from shifted columns. A timer tells of a source that sends no more rows."""

    def __init__(self, stall_sec: float) -> None:
        self._limit = int(stall_sec * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("growth", "size long, grew_ms long, told boolean")

    def _stalls(self, key: tuple, grew: list, at: list) -> pd.DataFrame:
        return pd.DataFrame({"src": [key[0]] * len(grew), "grew": [g / 1000.0 for g in grew], "stalled_at": [t / 1000.0 for t in at]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fed = pd.concat(list(rows)).sort_values("ts")
        table = pd.DataFrame({"ms": (fed["ts"].astype("int64") // (10 ** 6 if fed["ts"].dt.unit == "ns" else 10 ** 3)).to_numpy(), "size": fed["size"].to_numpy()})
        told_of = None
        if self._state.exists():
            size, grew, told = self._state.get()
            table = pd.concat([pd.DataFrame({"ms": [grew], "size": [size]}), table], ignore_index=True)
            told_of = grew if told else None
        grown = table["size"].ne(table["size"].shift())
        table["grew"] = table["ms"].where(grown).ffill().astype("int64")
        quiet = table[~grown & (table["ms"] - table["grew"] > self._limit)]
        first = quiet.groupby("grew")["ms"].min()
        first = first[first.index != told_of] if told_of is not None else first
        last = table.iloc[-1]
        known = bool(last["grew"] in first.index or last["grew"] == told_of)
        self._state.update((int(last["size"]), int(last["grew"]), known))
        for old in list(self._handle.listTimers()):
            self._handle.deleteTimer(old)
        if not known:
            self._handle.registerTimer(int(last["grew"]) + self._limit + 1)
        yield self._stalls(key, first.index.tolist(), first.tolist())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        size, grew, told = self._state.get()
        due = not told and expiredTimerInfo.getExpiryTimeInMs() > grew + self._limit
        if due:
            self._state.update((size, grew, True))
        yield self._stalls(key, [grew] * due, [expiredTimerInfo.getExpiryTimeInMs()] * due)

    def close(self) -> None:
        pass


def streaming_stalls(growth: DataFrame, late: str = "10 seconds", stall_sec: float = 20.0) -> DataFrame:
    """Stalls of a stream of file sizes; needs the RocksDB state store provider.

    As the batch twin, a stall is told at the first later row; without one, when the watermark passes it.
    """
    return (
        growth.withWatermark("ts", late)
        .groupBy("src")
        .transformWithStateInPandas(
            _StallWatch(stall_sec), "src string, grew double, stalled_at double", "Append", "EventTime"
        )
    )


def rotations(growth: DataFrame, segment_sec: float = 1800.0) -> DataFrame:
    """Segment number of each row, counted from the first row of its source."""
    t = F.unix_micros("ts") / 1e6
    start = growth.groupBy("src").agg(F.min(t).alias("t0"))
    return growth.join(start, "src").select(
        *growth.columns, F.floor((t - F.col("t0")) / segment_sec).alias("segment")
    )


# --- presence debounce --------------------------------------------------------------------------


def presence_runs(polls: DataFrame, misses: int = 3, width: float = 86400.0) -> DataFrame:
    """Batch twin: recordings per host, from the first hit to the third miss in a row.

    ``polls`` has host, ts, hit. A miss belongs to the hits before it by its distance in polls.
    """
    t = F.unix_micros("ts") / 1e6
    rows = polls.withColumn("__t", t)
    ln = lane("host", ("__t",), width)
    rows = scan(rows, ln, running={"__i": F.lit(1).cast("long")})
    rows = scan(rows, ln, last={"__h": F.when(F.col("hit"), F.struct("__i", "__t"))})
    rows = rows.where(F.col("__h").isNotNull()).withColumn("__gone", F.col("__i") - F.col("__h.__i"))
    on = rows.where(F.col("__gone") < misses)
    on = scan(on, ln, prev={"__pi": F.col("__i")})
    opens = F.when(F.col("__pi").isNull() | (F.col("__i") - F.col("__pi") > 1), 1).otherwise(0)
    on = scan(on.withColumn("__o", opens), ln, running={"run": F.col("__o").cast("long")})
    stops = rows.where(F.col("__gone") == misses).select(
        "host", (F.col("__i") - 1).alias("__e"), F.col("__t").alias("stopped_at")
    )
    runs = on.groupBy("host", "run").agg(F.min("__t").alias("started_at"), F.max("__i").alias("__e"))
    return runs.join(stops, ["host", "__e"], "left").drop("__e")


class _PresenceWatch(StatefulProcessor):
    """Polls of one host wait in a list until the watermark is past them, and then follow one another by time,
    however they came. A timer stands at the earliest that waits. Released polls get their distance to the latest hit, as in the batch twin."""

    def __init__(self, misses: int) -> None:
        self._misses = misses

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = handle.getListState("waiting", "us long, hit boolean")
        #: gone: polls since the latest hit; run: number of the latest run, and its start
        self._run = handle.getValueState("run", "gone long, run long, started long")

    def _release(self, key: tuple, polls: list, until_ms: int) -> Iterator[pd.DataFrame]:
        table = pd.DataFrame(polls, columns=["us", "hit"])
        due = table["us"] < until_ms * 1000
        left = table[~due]
        self._waiting.put([tuple(r) for r in left.astype(object).itertuples(index=False)]) if len(left) else self._waiting.clear()
        for old in list(self._handle.listTimers()):
            self._handle.deleteTimer(old)
        if len(left):
            self._handle.registerTimer(int(left["us"].min() // 1000) + 1)
        # of several polls at one moment a hit counts
        now = table[due].groupby("us", as_index=False)["hit"].max().sort_values("us", ignore_index=True)
        far = self._misses + 1
        gone, run, started = self._run.get() if self._run.exists() else (far, 0, 0)
        place = pd.Series(range(len(now)), dtype="int64")
        since = place - place.where(now["hit"]).ffill().fillna(-1 - gone).astype("int64")
        since = since.clip(upper=far)
        on = since < self._misses
        opens = on & ~on.shift(fill_value=gone < self._misses)
        runs = run + opens.cumsum()
        start = now["us"].where(opens).ffill().fillna(started).astype("int64")
        if len(now):
            self._run.update((int(since.iloc[-1]), int(runs.iloc[-1]), int(start.iloc[-1])))
        ends = since == self._misses
        yield pd.DataFrame({"host": pd.Series([key[0]] * int(ends.sum()), dtype=object), "run": runs[ends].to_numpy(), "started_at": start[ends].to_numpy() / 1e6, "stopped_at": now["us"][ends].to_numpy() / 1e6})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fed = pd.concat(list(rows))
        new = list(zip((fed["ts"].astype("datetime64[us]").astype("int64")).tolist(), fed["hit"].astype(bool).tolist(), strict=True))
        yield from self._release(key, [*self._waiting.get(), *new], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._release(key, list(self._waiting.get()), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def streaming_presence(polls: DataFrame, late: str = "1 minute", misses: int = 3) -> DataFrame:
    """Finished recordings of a stream of polls (host, ts, hit), which may come up to ``late`` out of order.

    A run is told when the watermark is past its last miss. Polls later than that are left out, as in every event-time operator.
    """
    return polls.withWatermark("ts", late).groupBy("host").transformWithStateInPandas(
        _PresenceWatch(misses), "host string, run long, started_at double, stopped_at double", "Append", "EventTime"
    )


def process_hits(presence: DataFrame, includes: list[str], excludes: list[str]) -> DataFrame:
    """One poll per (host, ts): whether any process name is wanted and not a resident helper."""
    name = F.lower("process_name")

    def any_of(words: list[str]):
        ws = F.array(*[F.lit(w.lower()) for w in words if w])
        return F.exists(ws, lambda w: F.contains(name, w))

    wanted = any_of(includes) & ~any_of(excludes)
    return presence.groupBy("host", "ts").agg(F.max(F.coalesce(wanted, F.lit(False))).alias("hit"))


# --- progress and daily actives -----------------------------------------------------------------


class _ProgressWatch(StatefulProcessor):
    """Tallies of one session: the latest state of each stage, the parts that were seen, and a few counts."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._stages = handle.getMapState("stages", "stage string", "state string, us long, line long")
        self._parts = handle.getMapState("parts", "kind string, shard string", "sec double")
        self._rest = handle.getValueState(
            "rest", "parts long, parts_us long, parts_line long, known boolean, det long, kd long, done_s double, all_s double, ended boolean, first long, last long, mark string, stage string, mark_us long, mark_line long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fed = pd.concat(list(rows))
        fed["us"] = fed["ts"].astype("datetime64[us]").astype("int64")
        fed = fed.sort_values(["us", "line_no"], kind="stable")
        names = ["parts", "parts_us", "parts_line", "known", "det", "kd", "done_s", "all_s", "ended", "first", "last", "mark", "stage", "mark_us", "mark_line"]
        s = dict(zip(names, self._rest.get() if self._rest.exists() else [None] * len(names), strict=True))
        for stage, row in fed[fed["stage"].notna()].groupby("stage").tail(1).set_index("stage").iterrows():
            old = self._stages.getValue((stage,)) if self._stages.containsKey((stage,)) else None
            if old is None or (row["us"], row["line_no"]) >= (old[1], old[2]):
                self._stages.updateValue((stage,), (row["mark"], int(row["us"]), int(row["line_no"])))
        for kind, count in (("detected", "det"), ("knocked", "kd")):
            for shard, sec in fed[fed["mark"] == kind].groupby("shard")["sec"].max().items():
                if not self._parts.containsKey((kind, shard)):
                    self._parts.updateValue((kind, shard), (None if pd.isna(sec) else float(sec),))
                    s[count] = (s[count] or 0) + 1
                    if kind == "detected" and not pd.isna(sec):
                        s["done_s"] = (s["done_s"] or 0.0) + float(sec)

        def latest(mine: pd.DataFrame, us: str, line: str, **columns: str) -> None:
            if len(mine):
                last = mine.iloc[-1]
                if s[us] is None or (last["us"], last["line_no"]) >= (s[us], s[line]):
                    s.update({us: int(last["us"]), line: int(last["line_no"])} | {k: last[c] for k, c in columns.items()})

        parts = fed[fed["mark"] == "parts"]
        latest(parts[parts["n"].notna()], "parts_us", "parts_line", parts="n")
        latest(fed[fed["mark"].isin(["start", "done"])], "mark_us", "mark_line", mark="mark", stage="stage")
        s["parts"] = None if s["parts"] is None else int(s["parts"])
        s["known"], s["ended"] = bool(s["known"]) or len(parts) > 0, bool(s["ended"]) or bool((fed["mark"] == "end").any())
        s["first"] = int(min(fed["us"].min(), s["first"] if s["first"] is not None else fed["us"].min()))
        s["last"] = int(max(fed["us"].max(), s["last"] if s["last"] is not None else fed["us"].max()))
        all_s = fed["all_s"].max()
        s["all_s"] = s["all_s"] if pd.isna(all_s) else float(all_s)
        self._rest.update(tuple(s[n] for n in names))
        states = [(k[0], v[0]) for k, v in self._stages.iterator()]
        out = {c: [s[c]] for c in ("parts", "known", "ended", "mark", "stage", "done_s", "all_s")}
        # plain objects: Arrow makes chunks of pandas' own strings
        out |= {"session": [key[0]]}
        yield pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in out.items()} | {"det": [s["det"] or 0], "kd": [s["kd"] or 0], "first": [s["first"]], "last": [s["last"]], "stages": [[a for a, _ in states]], "marks": [[b for _, b in states]]})

    def close(self) -> None:
        pass


def streaming_progress(lines: DataFrame, durations: DataFrame | None = None, by_duration: bool = False) -> DataFrame:
    """``session``, ``cur``, ``frac``, ``eta_sec`` of every session that a batch has lines of (update mode).

    The tallies of ``fleet.tallies`` are kept as state, whatever order the lines come in; the fraction is then
    the batch query's own expression. Lines of one moment are told apart by ``line_no``.
    """
    from cuespan.plans import fleet

    marks = fleet.with_durations(fleet.parse_progress(lines), durations if by_duration else None)
    kept = marks.groupBy("session").transformWithStateInPandas(
        _ProgressWatch(),
        "session string, parts long, known boolean, ended boolean, mark string, stage string, done_s double, all_s double, det long, kd long, first long, last long, stages array<string>, marks array<string>",
        "Update", "None",
    )
    latest = F.when(F.col("mark").isNotNull(), F.struct("mark", "stage"))
    rows = kept.withColumns({"states": F.map_from_arrays("stages", "marks"), "latest": latest, "t_first": F.timestamp_micros("first"), "t_last": F.timestamp_micros("last")})
    return fleet.fraction_of(rows, by_duration)


def streaming_daily_actives(hits: DataFrame, ts: str, who: str, late: str = "6 hours") -> DataFrame:
    """Approximate distinct clients per day; a stream cannot count distinct values exactly."""
    return (
        hits.withWatermark(ts, late)
        .groupBy(F.window(ts, "1 day").alias("w"))
        .agg(F.approx_count_distinct(who, 0.01).alias("active"))
        .select(F.col("w.start").alias("day"), "active")
    )


# --- recomputation of finished sessions ---------------------------------------------------------


class SessionStore:
    """Rows of sessions by the batch that brought them, with compaction.

    ``log/batch=N`` has the rows of one batch; ``base/version=N`` has those of all batches up to N, sorted by session. A batch
    that is run again replaces its own log, or is known to be in the base already; so a batch counts once, however often
    it is run. After ``every`` logs they go into a new base; what it replaces is deleted once it is complete. The
    listing stays at ``every`` logs and two bases. A folder counts only when Spark's writer has finished it.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, every: int = 16) -> None:
        self._spark, self._path, self._schema, self._every = spark, path, schema, every
        self._jpath = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._jpath(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _finished(self, kind: str) -> dict[int, str]:
        top = self._jpath(f"{self._path}/{kind}")
        found = {}
        for status in self._fs.listStatus(top) if self._fs.exists(top) else []:
            name = status.getPath().getName()
            if "=" in name and self._fs.exists(self._jpath(status.getPath(), "_SUCCESS")):
                found[int(name.partition("=")[2])] = str(status.getPath().toString())
        return found

    def version(self) -> int:
        """The last batch that is in the base; -1 without one."""
        return max(self._finished("base"), default=-1)

    def add(self, rows: DataFrame, batch_id: int) -> None:
        if batch_id > self.version():
            rows.write.mode("overwrite").parquet(f"{self._path}/log/batch={batch_id}")

    def rows(self) -> DataFrame:
        """All rows of all batches, each once."""
        bases = self._finished("base")
        version = max(bases, default=-1)
        paths = [p for n, p in self._finished("log").items() if n > version] + ([bases[version]] if bases else [])
        read = self._spark.read.schema(self._schema)
        return read.parquet(*paths) if paths else self._spark.createDataFrame([], self._schema)

    def compact(self) -> None:
        """Put the logs into a new base, if there are enough of them, and delete what no reader needs."""
        logs, version = self._finished("log"), self.version()
        new = [n for n in logs if n > version]
        if len(new) >= self._every:
            n = int(self._spark.conf.get("spark.sql.shuffle.partitions"))
            target = max(new)
            self.rows().repartitionByRange(n, "session").sortWithinPartitions("session").write.mode("overwrite").parquet(f"{self._path}/base/version={target}")
            version = target
        gone = [p for n, p in logs.items() if n <= version] + [p for n, p in self._finished("base").items() if n < version]
        for p in gone:
            self._fs.delete(self._jpath(p), True)


def rewrite_sessions(stream: DataFrame, store: str, out: str, compute, checkpoint: str, every: int = 16):
    """Late rows reopen a session: its rows are added to the store and its result is rebuilt.

    Only the session partitions named in the batch are overwritten. A batch that is run again after a failure
    adds nothing twice, and rebuilds the same results.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        kept = SessionStore(batch.sparkSession, store, batch.schema, every)
        # first the logs of earlier batches, whose results are written
        kept.compact()
        kept.add(batch, batch_id)
        touched = batch.select("session").distinct()
        result = compute(kept.rows().join(touched, "session", "left_semi"))
        result.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "session"
        ).parquet(out)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
