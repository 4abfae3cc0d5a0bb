"""Continuous scans: batch runs per micro-batch, and keyed state without a state table."""

from __future__ import annotations

import time
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from logscan.model import KEY, TEN_YEARS, Search
from logscan.operators.classify import accepted, appearances, line_matches
from logscan.operators.report import alert_rate
from logscan.tables import broadcast_if_small

CARRY = "tag string, host string, logfile string, level string, carry long, threshold_times array<timestamp>"
CLEAR = "tag string, host string, logfile string, cleared long"
SEEN = "tag string, host string, logfile string, level string, pat_idx int, message string, seen int"


def _hadoop(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _epochs(spark: SparkSession, out: str) -> list[int]:
    """The micro-batches whose state is there, ascending."""
    place, fs = _hadoop(spark, f"{out}/_state")
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(place)) if fs.exists(place) else []


def stream_missing(spark: SparkSession, out: str) -> DataFrame:
    """key, level, pat_idx, message of the must-appear patterns that no line of the stream into out has had so far.

    Whether a pattern is missing is known at the end only, so it is asked for here and is not among the matches.
    """
    epochs = _epochs(spark, out)
    seen = spark.read.schema(SEEN).parquet(f"{out}/_state/{epochs[-1]}/seen") if epochs else spark.createDataFrame([], SEEN)
    return seen.filter("seen = 0").drop("seen")


def _cleared(spark: SparkSession, out: str, epoch: int | None) -> DataFrame:
    """key, cleared: the last micro-batch up to one that had an all-clear line."""
    place, fs = _hadoop(spark, f"{out}/_state/{epoch}/clear")
    return spark.read.schema(CLEAR).parquet(f"{out}/_state/{epoch}/clear") if epoch is not None and fs.exists(place) else spark.createDataFrame([], CLEAR)


def stream_standing(spark: SparkSession, out: str, searches: list[Search], now: datetime) -> DataFrame:
    """The matches of the stream into out that stand at now, with when: of sticky searches those that no later all-clear line has taken back and that are not too old, of others those of the last micro-batch.

    Matches are written once; a row for each source that was cleared is all that changes. So what stands after many
    micro-batches is what one batch over all their lines has.
    """
    epochs = _epochs(spark, out)
    rows = spark.read.option("basePath", out).parquet(out)
    if not epochs:
        return rows.limit(0).drop("batch")
    stands = F.lit(False)
    by_time: dict[int, list[str]] = {}
    for s in searches:
        by_time.setdefault((s.sticky if s.sticky > 1 else TEN_YEARS) if s.sticky else 0, []).append(s.tag)
    for seconds, tags in by_time.items():
        young = F.unix_timestamp(F.lit(now)) - F.unix_timestamp("when") <= seconds if seconds else F.col("batch") == epochs[-1]
        stands = stands | (F.col("tag").isin(tags) & young)
    rows = rows.filter((F.col("batch") <= epochs[-1]) & stands)
    clear = broadcast_if_small(_cleared(spark, out, epochs[-1]))
    return rows.join(clear, list(KEY), "left").filter(F.col("cleared").isNull() | (F.col("batch") >= F.col("cleared"))).drop("cleared", "batch")


def scan_stream(lines: DataFrame, searches: list[Search], out: str, checkpoint: str, trigger: dict | None = None):
    """Matches of a stream of lines (tag, host, logfile, file_seq, line_no, line) into Parquet, a folder per micro-batch.

    A micro-batch that is run again overwrites its folder, so each match is written once.
    Thresholds count on from micro-batch to micro-batch, hits expire as in runs, and
    must-appear patterns are judged over the whole stream (stream_missing): the state after each
    micro-batch is in out/_state, and one that is run again starts from that of the one before.
    What an all-clear line takes back of earlier micro-batches, and what stands, is told by stream_standing.
    """
    from logscan.jobs.scan import scan_all
    from logscan.operators.thresholds import live_times

    def batch(df: DataFrame, epoch: int) -> None:
        spark, now = df.sparkSession, datetime.fromtimestamp(time.time())
        before = [e for e in _epochs(spark, out) if e < epoch]
        last = f"{out}/_state/{before[-1]}" if before else None
        carry = spark.read.schema(CARRY).parquet(f"{last}/carry") if last else spark.createDataFrame([], CARRY)
        seen = spark.read.schema(SEEN).parquet(f"{last}/seen") if last else spark.createDataFrame([], SEEN)
        for s in searches:
            if s.threshold_expiry:
                own = F.col("tag") == s.tag
                live = live_times(carry.filter(own), now, s.threshold_expiry).withColumn("carry", F.size("threshold_times").cast("long"))
                carry = carry.filter(~own).unionByName(live)
            if any(s.must_appear(x) for x in ("CRITICAL", "WARNING")):
                seen = seen.unionByName(appearances(df.filter(F.col("tag") == s.tag), s))
        df.persist()
        try:
            scanned = scan_all(df, searches, carry, df.select(*KEY).limit(0), now)
            scanned.matches.withColumn("when", F.lit(now)).write.mode("overwrite").parquet(f"{out}/batch={epoch}")
            after = scanned.carry if scanned.carry is not None else carry
            # the last micro-batch that clears a source, one row each
            cleared = _cleared(spark, out, before[-1] if before else None).unionByName(scanned.clear.select(*KEY, F.lit(epoch).cast("long").alias("cleared")))
            cleared.groupBy(*KEY).agg(F.max("cleared").alias("cleared")).write.mode("overwrite").parquet(f"{out}/_state/{epoch}/clear")
            after.write.mode("overwrite").parquet(f"{out}/_state/{epoch}/carry")
            seen.groupBy(*KEY, "level", "pat_idx", "message").agg(F.max("seen").alias("seen")).write.mode("overwrite").parquet(f"{out}/_state/{epoch}/seen")
        finally:
            df.unpersist()
        for e in before[:-1]:  # the last one is needed if this micro-batch is run again
            place, fs = _hadoop(spark, f"{out}/_state/{e}")
            fs.delete(place, True)

    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class _Alerts(StatefulProcessor):
    """Threshold counters and sticky alerts of a key; an all-clear line empties both.

    sticky: the seconds that alerts stand, 0 if none stands after its own line.
    """

    def __init__(self, thresholds: dict[str, int], sticky: int):
        self.thresholds, self.sticky = thresholds, sticky

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getMapState("counts", "level string", "n long")
        self.open = handle.getMapState("open", "level string, at long", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["file_seq", "line_no"], kind="stable")
        fired, now = [], int(time.time())
        for k in list(self.open.keys()):
            if now - k[1] > self.sticky:
                self.open.removeKey(k)
        standing: dict[str, int] = {}
        for (level, _), (n,) in list(self.open.iterator()):
            standing[level] = standing.get(level, 0) + n
        for r in frame.itertuples():
            for level in r.levels:
                n = (self.counts.getValue((level,))[0] if self.counts.containsKey((level,)) else 0) + 1
                every = self.thresholds.get(level, 1)
                if n >= every:
                    total = standing.get(level, 0) + 1
                    if self.sticky:
                        standing[level], at = total, (level, now)
                        self.open.updateValue(at, ((self.open.getValue(at)[0] if self.open.containsKey(at) else 0) + 1,))
                    fired.append((level, total, r.line))
                    n = 0
                self.counts.updateValue((level,), (n,))
            if r.cleared:
                for state in (self.counts, self.open):
                    for k in list(state.keys()):
                        state.removeKey(k)
                standing = {}
                fired.append(("OK", 0, r.line))
        yield pd.DataFrame([(*key, *f) for f in fired], columns=["tag", "host", "logfile", "level", "standing", "message"])

    def close(self) -> None:
        pass


def stream_alerts(lines: DataFrame, search: Search) -> DataFrame:
    """tag, host, logfile, level, standing, message, as lines come in.

    standing: alerts of the level since the last all-clear that still stand; without sticky alerts this one alone.

    Only lines that match a pattern or clear the alert are shuffled, once, by key. Those that a
    micro-batch has of a key are sorted in one task: bound micro-batches at the source (maxFilesPerTrigger).
    """
    found = F.transform(line_matches(F.col("line"), search), lambda m: m["level"])
    clear = accepted(F.col("line"), search) & F.col("line").rlike(search.flags() + "|".join(f"(?:{p})" for p in search.ok)) if search.ok else F.lit(False)
    rows = lines.select(F.lit(search.tag).alias("tag"), "host", "logfile", "file_seq", "line_no", "line", F.coalesce(found, F.array().cast("array<string>")).alias("levels"), clear.alias("cleared"))
    rows = rows.filter((F.size("levels") > 0) | F.col("cleared"))
    every = {k.upper(): v for k, v in search.threshold.items()}
    return rows.groupBy("tag", "host", "logfile").transformWithStateInPandas(
        statefulProcessor=_Alerts(every, search.sticky if (search.sticky or 0) > 1 else TEN_YEARS if search.sticky else 0), outputStructType="tag string, host string, logfile string, level string, standing long, message string", outputMode="Append", timeMode="None"
    )


def heartbeat(events: DataFrame, is_beat, start, end, interval: str, key: str, ts: str = "ts") -> DataFrame:
    """key, window_start of the intervals from start to end in which a key (of any event) has no beat."""
    keys = events.select(key).distinct()
    grid = keys.withColumn("window_start", F.explode(F.sequence(F.lit(start), F.expr(f"timestamp '{end}' - interval {interval}"), F.expr(f"interval {interval}"))))
    beats = events.filter(is_beat).select(key, F.window(ts, interval).start.alias("window_start")).distinct()
    return grid.join(beats, [key, "window_start"], "left_anti")


class _Beats(StatefulProcessor):
    """The intervals without a beat of a key: an interval is judged when the watermark has passed its end, by a timer, whether the key has rows or not."""

    def __init__(self, interval: int, columns: list[str]):
        self.interval, self.columns = interval, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "at long")  # the interval that is judged next
        self.beats = handle.getMapState("beats", "at long", "n int")  # intervals from there on that have a beat

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            at = frame["at"] // self.interval * self.interval
            first = int(at.min()) if first is None else min(first, int(at.min()))
            for beat in at[frame["beat"]].unique():
                self.beats.updateValue((int(beat),), (1,))
        if not self.next.exists():
            self.next.update((first,))
            self.handle.registerTimer(first + self.interval)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        reached, at, silent = timerValues.getCurrentWatermarkInMs(), self.next.get()[0], []
        while at + self.interval <= reached:
            if self.beats.containsKey((at,)):
                self.beats.removeKey((at,))
            else:
                silent.append(at)
            at += self.interval
        self.next.update((at,))
        self.handle.registerTimer(at + self.interval)
        if silent:  # Spark takes no empty frame here
            yield pd.DataFrame([(*key, n) for n in silent], columns=self.columns)

    def close(self) -> None:
        pass


def heartbeat_stream(events: DataFrame, is_beat, interval: int, delay: str, key: str, ts: str = "ts") -> DataFrame:
    """key, window_start of the intervals (of so many seconds) in which a key has no beat, from the interval of its first event on.

    An interval is told as soon as the watermark, delay behind the latest event of any key, passes its end: a key that has fallen
    silent alerts without any new row of it. A key's state is one number and its beats since then.
    """
    rows = events.withWatermark(ts, delay).select(key, ts, (F.unix_micros(ts) / 1000).cast("long").alias("at"), F.coalesce(is_beat, F.lit(False)).alias("beat"))
    kind = events.schema[key].dataType.simpleString()
    found = rows.groupBy(key).transformWithStateInPandas(statefulProcessor=_Beats(interval * 1000, [key, "at"]), outputStructType=f"`{key}` {kind}, at long", outputMode="Append", timeMode="EventTime")
    return found.select(key, F.timestamp_millis("at").alias("window_start"))


def drop_late_stream(events: DataFrame, delay: str, ts: str = "ts") -> DataFrame:
    """Events of a stream with a watermark: what comes later than delay behind the latest event is dropped by the windows that follow."""
    return events.withWatermark(ts, delay)


def alert_rates(matches: DataFrame, window: str, slide: str | None = None, delay: str = "10 minutes", key: tuple = ("tag",), when: str = "when") -> DataFrame:
    """report.alert_rate of a stream of matches: a window is told once, when the watermark has passed its end."""
    return alert_rate(drop_late_stream(matches, delay, when), window, slide, key, when)
