"""Runs over records: each is in one run, whatever tells old ones from new ones."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logscan.jobs import scan
from logscan.model import Search
from logscan.sources import feeds

AT = datetime(2024, 3, 1, 12, 0, 0)


@pytest.fixture
def go(spark, tmp_path):
    def run(second, feed, **options):
        s = Search(tag="t", feed="records", critical=["bad"], **options)
        out = scan.run(spark, [s], [], str(tmp_path / "state"), AT + timedelta(seconds=second), feeds={"records": feed})
        return sorted((r["host"], r["message"]) for r in out.matches.collect()), {r["tag"]: r["lines"] for r in out.counters.collect()}

    return run


def timed(spark, *rows, columns="host string, at double, message string"):
    made = spark.createDataFrame([r for r in rows], columns)
    return made.withColumn("ts", F.timestamp_micros((F.col("at") * 1_000_000 + F.lit(AT.timestamp() * 1_000_000)).cast("long")))


@pytest.mark.parametrize("kind", ["time", "minute", "second"])
def test_windows_of_runs_meet_without_a_gap(spark, go, kind):
    make = {"time": feeds.journal_feed, "minute": feeds.report_feed, "second": feeds.alert_feed}[kind]
    rows = [("h1", at, f"bad {at}") for at in (-700.0, -650.0, -100.0, -30.0, -1.0, -0.5, 0.0, 29.0, 30.0, 59.5, 61.0, 119.0, 120.0, 121.0, 180.0)] + [("h2", 59.0, "bad of h2"), ("h2", 60.0, "fine"), ("h2", None, "bad without a time")]
    feed = make(timed(spark, *rows), host="host", **({"units": None} if kind == "time" else {}))
    found, lines = [], 0
    for second in (0, 61, 62, 121, 300):
        got, counted = go(second, feed)
        found += got
        lines += counted.get("t", 0)
    back = 600 if kind == "time" else 300
    want = sorted([("h1", f"bad {at}") for _, at, m in rows if at is not None and at >= -back and m.startswith("bad -") | m.startswith("bad ") and m != "bad of h2"] + [("h2", "bad of h2")])
    assert sorted(found) == want and lines == len(want) + 1


def test_a_first_run_reads_all_and_kept_records_are_chosen(spark, go):
    rows = timed(spark, ("h1", -90_000.0, "bad old"), ("h1", 5.0, "bad new"), ("h1", 5.0, "bad other"))
    feed = feeds.Feed(rows, "time", "ts", F.col("message"), chosen=F.col("message") != "bad other")
    assert go(1, feed, read_all_first=True)[0] == [("localhost", "bad old")]
    assert go(10, feed)[0] == [("localhost", "bad new")] and go(11, feed)[0] == []


def test_listings_by_id(spark, go):
    def listing(*rows):
        return feeds.listing_feed(spark.createDataFrame([(h, f" {i} | 03/04 | {t}") for h, i, t in rows], "host string, line string"), host="host")

    assert go(0, listing(("h1", "1", "bad a")))[0] == []  # known from the first run on
    assert go(1, listing(("h1", "1", "bad a"), ("h1", "2", "bad b"), ("h2", "1", "bad c")))[0] == [("h1", " 2 ; 03/04 ; bad b"), ("h2", " 1 ; 03/04 ; bad c")]
    assert go(2, listing(("h1", "2", "bad b")))[0] == []
    assert go(3, listing(("h1", "1", "bad again"), ("h1", "2", "bad b")))[0] == [("h1", " 1 ; 03/04 ; bad again")]


def test_kernel_rings_by_line(spark, go):
    ring = lambda *lines: feeds.kernel_feed(spark.createDataFrame([("h", i, t) for i, t in enumerate(lines)], "host string, line_no long, line string"), host="host")
    assert go(0, ring("bad 0"), read_all_first=True)[0] == [("h", "bad 0")]
    assert go(1, ring("bad 0", "x", "bad 2"), read_all_first=True)[0] == [("h", "bad 2")]
    assert go(2, ring("bad 0", "x", "bad 2"))[0] == []
    assert go(3, ring("bad anew"))[0] == [("h", "bad anew")]


def test_records_beside_files_with_thresholds(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs/log").write_text("bad line\n")
    rows = timed(spark, *[("h", float(i), "bad") for i in range(10)])
    searches = [Search(tag="file", logfile="log", critical=["bad"], read_all_first=True), Search(tag="feed", feed="r", critical=["bad", "!beat"], threshold={"critical": 4})]
    go = lambda second: sorted((r["tag"], r["message"]) for r in scan.run(spark, searches, [str(tmp_path / "logs")], str(tmp_path / "state"), AT + timedelta(seconds=second), feeds={"r": feeds.journal_feed(rows)}).matches.collect())
    missing = ("feed", "MISSING: beat")
    assert go(6) == [missing, ("feed", "bad"), ("file", "bad line")]
    assert go(9) == [missing, ("feed", "bad")]  # the two carried on and two more
    assert go(20) == [missing]


def test_thresholds_and_missing_patterns_by_host(spark, go):
    rows = timed(spark, *[(h, float(t), "bad") for h, at in (("h1", (1, 2, 11, 12)), ("h2", (3, 13, 23))) for t in at], ("h3", 5.0, "beat"))
    feed = feeds.journal_feed(rows, host="host")
    opts = {"threshold": {"critical": 3}}
    assert [go(second, feed, **opts)[0] for second in (10, 20, 30)] == [[], [("h1", "bad")], [("h2", "bad")]]


def test_jdbc_windows_are_pushed_down(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/alerts;create=true"
    rows = timed(spark, *[(f"h{i % 3}", float(i), f"bad {i}") for i in range(100)], ("h0", 50.0, ""))
    rows.select("host", "message", "ts").write.format("jdbc").options(url=url, dbtable="alerts", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver", createTableColumnTypes="host VARCHAR(20), message VARCHAR(200)").save()
    ask = feeds.jdbc_rows(spark, url, "alerts", partitions=4, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    begin, end = AT + timedelta(seconds=10), AT + timedelta(seconds=90)
    found = ask(begin, end)
    assert found.rdd.getNumPartitions() == 4
    feed = feeds.alert_feed(ask, host="host")
    state = spark.createDataFrame([("t", "h", "r", {"at": str(int(begin.timestamp() * 1_000_000))})], f"tag string, host string, logfile string, cursor {feeds.CURSOR}")
    lines, cursors = feeds.read(feed, "r", "t", "h", state, end + timedelta(seconds=1))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = lines._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "*GreaterThanOrEqual(ts" in plan and "*LessThan(ts" in plan
    assert sorted(r["line"] for r in lines.collect()) == sorted(f"bad {i}" for i in range(10, 90))
    assert cursors.first()["cursor"] == {"at": str(int(end.timestamp() * 1_000_000))}
