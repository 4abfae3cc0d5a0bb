from __future__ import annotations

import random
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from logscan.jobs.scan import scan_lines
from logscan.model import Search
from logscan.operators import callbacks
from logscan.operators import report
from logscan.streaming import stream as streams
from logscan.streaming.stream import scan_stream, stream_alerts, stream_missing

SCHEMA = "tag string, host string, logfile string, file_seq int, line_no long, line string"


def test_stream_finds_what_a_batch_finds(spark, tmp_path):
    lines = spark.createDataFrame([("t", "h", f"l{i % 3}", 0, i, "hit" if i % 4 else "calm") for i in range(40)], SCHEMA)
    lines.repartition(4).write.parquet(str(tmp_path / "in"))
    search = [Search(tag="t", critical=["hit"])]
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    scan_stream(stream, search, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    want, _ = scan_lines(lines, search)
    assert sorted(r["line_no"] for r in got.collect()) == sorted(r["line_no"] for r in want.collect())


def test_thresholds_and_missing_patterns_over_batches(spark, tmp_path):
    rows = [("t", "h", "a", n, i, "hit" if i < 9 else "calm") for n in range(4) for i in range(10)]
    rows += [("t", "h", "b", n, i, "alive" if (n, i) == (1, 0) else "calm") for n in range(4) for i in range(3)]
    rows += [("t", "h", "c", 2, 0, "calm")]
    for n in range(4):
        spark.createDataFrame([x for x in rows if x[3] == n], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    search = [Search(tag="t", critical=["hit", "!alive"], threshold={"critical": 10})]
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    for _ in range(2):  # a restart finds nothing new
        scan_stream(stream, search, out, str(tmp_path / "cp")).awaitTermination(180)
    cols = ["logfile", "level", "pat_idx", "message"]
    got = spark.read.parquet(out).select("file_seq", "line_no", *cols).collect()
    want, _ = scan_lines(spark.createDataFrame(rows, SCHEMA), search)
    missing = want.filter("pat_key = 'missing'")
    assert len(got) == 3 and sorted(got) == sorted(want.filter("pat_key <> 'missing'").select("file_seq", "line_no", *cols).collect())
    assert sorted(stream_missing(spark, out).select(*cols).collect()) == sorted(missing.select(*cols).collect())
    assert [r["logfile"] for r in stream_missing(spark, out).orderBy("logfile").collect()] == ["a", "c"]


def test_keyed_alerts_stand_only_if_they_are_sticky(spark, tmp_path):
    schema = "host string, logfile string, file_seq int, line_no long, line string"
    for n in range(2):
        spark.createDataFrame([("h", "l", n, i, "open") for i in range(2)], schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for name, sticky, want in (("stay", 1, [1, 2, 3, 4]), ("go", None, [1, 1, 1, 1])):
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = stream_alerts(stream, Search(tag="t", critical=["open"], sticky=sticky)).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert sorted(r["standing"] for r in spark.sql(f"select * from {name}").collect()) == want


def test_keyed_alerts_over_batches(spark, tmp_path):
    s = Search(tag="t", critical=["open"], ok=["closed"], threshold={"critical": 2}, sticky=60)
    first = [("h", 0, "open"), ("h", 1, "noise"), ("h", 2, "open"), ("g", 0, "open")]
    second = [("h", 3, "open"), ("g", 1, "open"), ("h", 4, "open"), ("h", 5, "closed")]
    for n, rows in enumerate((first, second)):
        spark.createDataFrame([(h, "l", 0, i, x) for h, i, x in rows], "host string, logfile string, file_seq int, line_no long, line string").coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema("host string, logfile string, file_seq int, line_no long, line string").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_alerts(stream, s).writeStream.format("memory").queryName("alerts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = sorted((r["host"], r["level"], r["standing"]) for r in spark.sql("select * from alerts").collect())
    assert got == [("g", "CRITICAL", 1), ("h", "CRITICAL", 1), ("h", "CRITICAL", 2), ("h", "OK", 0)]


def test_flood_history(spark):
    rows = spark.createDataFrame([("t", i) for i in (0, 1, 2, 3, 4, 5, 12, 13)], "tag string, s long").select("tag", F.timestamp_seconds("s").alias("when"))
    waits = [r["wait"] for r in callbacks.flood(rows, 5, 10).orderBy("when").collect()]
    assert waits == [0, 0, 0, 0, 0, 5, 0, 0]
    kept = [r["wait"] for r in callbacks.flood(rows, 5, 10, push_after_shift=False).orderBy("when").collect()]
    assert kept == [0, 0, 0, 0, 0, 5, 0, 0]


def test_callbacks(spark):
    m = spark.createDataFrame([("t", "CRITICAL", "a"), ("t", "WARNING", "b")], "tag string, level string, message string")
    louder = lambda f: pd.DataFrame({"level": ["OK"] * len(f), "message": f["message"].str.upper()})

    def broken(f):
        raise RuntimeError("no")

    rows = lambda df: sorted((r["level"], r["message"], r["origin"]) for r in df.collect())
    assert rows(callbacks.on_match(m, louder, "supersmart")) == [("OK", "A", "callback"), ("OK", "B", "callback")]
    assert len(rows(callbacks.on_match(m, louder, "smart"))) == 4 and len(rows(callbacks.on_match(m, louder, "plain"))) == 2
    assert rows(callbacks.on_match(m, broken, "smart")) == [("CRITICAL", "a", "match"), ("WARNING", "b", "match"), ("WARNING", "could not execute callback: no", "failure")]


def test_standing_alerts_of_a_stream_equal_one_batch(spark, tmp_path):
    r = random.Random(3)
    rows = [("t", "h", f"l{r.randrange(3)}", n, i, r.choice(["open", "open", "x", "closed" if r.random() < 0.3 else "odd"])) for n in range(4) for i in range(12)]
    rows += [("u", "h", "l", n, 0, "open") for n in range(4)]
    for n in range(4):
        spark.createDataFrame([x for x in rows if x[3] == n], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    t = Search(tag="t", critical=["open"], warning=["odd"], ok=["closed"], threshold={"warning": 2}, sticky=1)
    u = Search(tag="u", critical=["open"])
    source = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    scan_stream(source, [t, u], out, str(tmp_path / "cp")).awaitTermination(180)
    cols = ["tag", "logfile", "level", "file_seq", "line_no", "message"]
    standing = streams.stream_standing(spark, out, [t, u], datetime.now()).select(*cols)
    want, _ = scan_lines(spark.createDataFrame(rows, SCHEMA), [t, u])
    got = sorted(map(tuple, standing.collect()))
    assert got == sorted(map(tuple, want.filter("tag = 't' or file_seq = 3").select(*cols).collect()))
    assert spark.read.parquet(out).filter("tag = 't'").count() > sum(x[0] == "t" for x in got)  # some were taken back
    late = datetime.now() + timedelta(seconds=100)
    assert streams.stream_standing(spark, out, [Search(tag="t", critical=["open"], sticky=60)], late).count() == 0


def _events(spark, tmp_path, parts):
    for n, part in enumerate(parts):
        df = spark.createDataFrame([(h, t, k) for h, t, k in part], "host string, s long, kind string").select("host", F.timestamp_seconds("s").alias("ts"), "kind")
        df.coalesce(1).write.parquet(str(tmp_path / "in" / f"{n:02}"))
    schema = "host string, ts timestamp, kind string"
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_silent_keys_alert_by_timers(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    # a beats in every minute but one; b beats once and then has no row at all
    parts = [[("a", 60 * n + 5, "other" if n == 3 else "beat"), *([("b", 10, "beat")] if n == 0 else [])] for n in range(8)]
    out = streams.heartbeat_stream(_events(spark, tmp_path, parts), F.col("kind") == "beat", 60, "30 seconds", "host")
    out.writeStream.format("memory").queryName("silent").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(240)
    got = sorted((r["host"], int(r["window_start"].timestamp())) for r in spark.sql("select * from silent").collect())
    # the watermark is 30 seconds behind second 425: the interval of 360 is open still
    assert got == [("a", 180)] + [("b", 60 * n) for n in range(1, 6)]
    rows = [(h, t, k) for part in parts for h, t, k in part]
    batch = spark.createDataFrame(rows, "host string, s long, kind string").select("host", F.timestamp_seconds("s").alias("ts"), "kind")
    grid = streams.heartbeat(batch, F.col("kind") == "beat", F.timestamp_seconds(F.lit(0)), "1970-01-01 00:06:00", "60 seconds", "host")
    assert got == sorted((r["host"], int(r["window_start"].timestamp())) for r in grid.collect())


def test_rates_of_a_stream_drop_late_rows(spark, tmp_path):
    parts = [[("a", 10, "x"), ("a", 20, "x"), ("b", 70, "x")], [("a", 400, "x"), ("b", 410, "x")], [("b", 420, "x")], [("a", 30, "late"), ("a", 390, "x")], [("a", 900, "x")], [("a", 1500, "x")]]
    events = _events(spark, tmp_path, parts)
    rates = streams.alert_rates(events, "1 minute", delay="1 minute", key=("host",), when="ts")
    rates.writeStream.format("memory").queryName("rates").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination(240)
    kept = spark.read.parquet(*[str(tmp_path / "in" / f"{n:02}") for n in range(6)]).filter("kind <> 'late' and ts < timestamp_seconds(1440)")
    want = report.alert_rate(kept, "1 minute", key=("host",), when="ts")
    assert sorted(map(tuple, spark.sql("select * from rates").collect())) == sorted(map(tuple, want.collect()))
