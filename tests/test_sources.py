from __future__ import annotations

import bz2
import gzip
import os
from datetime import datetime

import pytest

from logscan.jobs import scan, sinks
from logscan.model import Search
from logscan.operators import events, formats
from logscan.sources import incremental, lines, records


def test_lines_offsets_and_archives(spark, tmp_path):
    (tmp_path / "log").write_bytes(b"one\r\n\nthree")
    with gzip.open(tmp_path / "log.1.gz", "wb") as f:
        f.write(b"a\nbb\n")
    with bz2.open(tmp_path / "log.2.bz2", "wb") as f:
        f.write(b"c\n")
    got = sorted((r["logfile"], r["line_no"], r["start_offset"], r["end_offset"], r["line"]) for r in lines.read_lines(spark, [str(tmp_path)]).collect())
    assert got == [("log", 0, 0, 5, "one\r"), ("log", 1, 5, 6, ""), ("log", 2, 6, 11, "three"), ("log.1.gz", 0, 0, 2, "a"), ("log.1.gz", 1, 2, 5, "bb"), ("log.2.bz2", 0, 0, 2, "c")]


def test_lines_of_a_split_file_are_in_order(spark, tmp_path):
    text = "".join(f"line {i} {'x' * (i % 50)}\n" for i in range(20_000))
    (tmp_path / "big").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        rows = lines.read_lines(spark, [str(tmp_path)]).orderBy("line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert "".join(r["line"] + "\n" for r in rows) == text
    assert [r["line_no"] for r in rows] == list(range(20_000)) and rows[-1]["end_offset"] == len(text)
    assert all(a["end_offset"] == b["start_offset"] for a, b in zip(rows, rows[1:], strict=False))


def test_encoding(spark, tmp_path):
    (tmp_path / "u").write_bytes("eins\r\nzwei ä\r\n".encode("UTF-16LE"))
    got = [r["line"] for r in lines.read_lines(spark, [str(tmp_path)], encoding="UTF-16LE").orderBy("line_no").collect()]
    assert got == ["eins", "zwei ?"]


@pytest.mark.parametrize(
    ("scheme", "yes", "no"),
    [
        ("LOGLOGDATE8GZ", ["messages-20240101.gz", "messages20240101.gz"], ["messages-2024.gz", "messagess-20240101.gz", "messages-20240101.bz2"]),
        ("LOGLOG0LOG1GZ", ["messages.0", "messages.1.gz"], ["messages.10.gz", "messages.00"]),
        ("LOGLOG0GZLOG1GZ", ["messages.0.gz", "messages.10.gz"], ["messages.0", "messages.00.gz"]),
        ("LOGLOG0LOG1", ["messages.0", "messages.12"], ["messages.01", "messages.0.gz"]),
        ("SOLARIS", ["messages.0", "messages.x.1"], ["messages"]),
        ("HPUX", ["OLDmessages"], ["messages"]),
        ("EHL", ["h_messages.2024_1_2_3_4_5"], ["messages.2024_1_2_3_4_5"]),
        (r"messages\.\d{4}", ["messages.2024"], ["xmessages.2024"]),
    ],
)
def test_rotation_names(spark, scheme, yes, no):
    rx = incremental.rotation_regex(scheme, "messages", "h")
    got = {r["n"] for r in spark.createDataFrame([(n,) for n in yes + no], "n string").filter(f"n rlike '{rx.replace(chr(92), chr(92) * 2)}'").collect()}
    assert got == set(yes)


def counts(out):
    r = out.result.first()
    return r["warnings"], r["criticals"], r["unknowns"], r["code"]


def test_runs_with_appends_and_rotation(spark, tmp_path):
    logs, state = tmp_path / "logs", str(tmp_path / "state")
    logs.mkdir()
    s = [Search(tag="disk", logfile="messages", critical=["Disk full"], warning=["Fan slow"], rotation="LOGLOG0LOG1", threshold={"warning": 2})]
    go = lambda day: scan.run(spark, s, [str(logs)], state, datetime(2024, 1, day), protocol_path=str(tmp_path / "protocol"))
    (logs / "messages").write_text("Disk full\nDisk full\n")
    os.utime(logs / "messages", (1_700_000_000,) * 2)
    assert counts(go(1)) == (0, 0, 0, 0)  # a first run starts at the end
    with (logs / "messages").open("a") as f:
        f.write("x\nDisk full\nFan slow\n")
    os.utime(logs / "messages", (1_700_000_100,) * 2)
    assert counts(go(2)) == (0, 1, 0, 2)
    assert counts(go(3)) == (0, 0, 0, 0)
    with (logs / "messages").open("a") as f:
        f.write("Disk full\n")
    os.utime(logs / "messages", (1_700_000_200,) * 2)
    (logs / "messages").rename(logs / "messages.0")
    (logs / "messages").write_text("Fan slow\n")
    os.utime(logs / "messages", (1_700_000_300,) * 2)
    assert counts(go(4)) == (1, 1, 0, 2)  # the second warning since the first run
    assert sinks.load_state(spark, state).first()["runcount"] == 4
    assert spark.read.parquet(str(tmp_path / "protocol")).count() == 3
    (logs / "messages").unlink()
    (logs / "messages.0").unlink()
    assert counts(go(5)) == (0, 0, 1, 3)


def test_first_run_can_read_all(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "messages").write_text("Disk full\nDisk full\n")
    s = [Search(tag="disk", logfile="messages", critical=["Disk full"], read_all_first=True)]
    assert counts(scan.run(spark, s, [str(tmp_path / "logs")], str(tmp_path / "state"), datetime(2024, 1, 1))) == (0, 2, 0, 2)


def test_what_a_series_of_runs_carries_on(spark, tmp_path):
    logs, state = tmp_path / "logs", str(tmp_path / "state")
    logs.mkdir()
    door = Search(tag="door", logfile="door", critical=["open"], ok=["closed"], sticky=600, read_all_first=True)
    rare = Search(tag="rare", logfile="rare", warning=["slow"], ok=["fast"], threshold={"warning": 3}, threshold_expiry=60, read_all_first=True)
    beat = Search(tag="beat", logfile="beat", critical=["!alive"], maxage=3600)

    def go(second, **text):
        for name, add in text.items():
            with (logs / name).open("a") as f:
                f.write(add)
            os.utime(logs / name, (1_700_000_000 + second,) * 2)
        out = scan.run(spark, [door, rare, beat], [str(logs)], state, datetime.fromtimestamp(1_700_000_000 + second)).matches
        return sorted((r["tag"], r["message"]) for r in out.collect())

    missing, opened, slow = ("beat", "MISSING: alive"), ("door", "open 1"), ("rare", "slow")
    assert go(0, door="open 1\n", rare="slow\nslow\n", beat="alive\n") == [missing, opened]  # beat starts at its end
    assert go(10, beat="alive\n") == [opened]  # it sticks
    assert go(50, rare="slow\n") == [missing, opened, slow]  # the third within 60 seconds
    assert go(100, rare="slow\nslow\n", beat="alive\n", door="open 2\n") == [opened, ("door", "open 2")]
    assert go(200, rare="slow\n", beat="alive\n") == [opened, ("door", "open 2")]  # the two are too old to count
    assert go(650, rare="slow\nfast\nslow\n", beat="alive\n") == [("door", "open 2")]  # open 1 is too old
    assert go(670, rare="slow\nslow\n", beat="alive\n", door="closed\nopen 3\n") == [("door", "open 3"), slow]  # the third since the all-clear
    assert go(9000, door="closed\n") == [missing, ("beat", "logfile beat is too old (> 3600 s)")]


def test_a_copied_archive_counts_once(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    s = [Search(tag="disk", logfile="messages", critical=["Broken"], rotation="LOGLOG0LOG1", read_all_first=True)]
    go = lambda day: scan.run(spark, s, [str(logs)], str(tmp_path / "state"), datetime(2024, 1, day))
    for name, text, at in (("messages.2", "head\nBroken 1\n", 0), ("messages.1", "head\nBroken 2\n", 100), ("messages.0", "head\nBroken 2\n", 200), ("messages", "Broken 3\n", 300), ("messages.3", "Broken 3\n", 400)):
        (logs / name).write_text(text)
        os.utime(logs / name, (1_700_000_000 + at,) * 2)
    assert sorted(r["message"] for r in go(1).matches.collect()) == ["Broken 1", "Broken 2", "Broken 3"]  # the same head and length are not enough
    assert sinks.load_state(spark, str(tmp_path / "state")).first()["logoffset"] == 9


def _write(logs, at, **text):
    for name, add in text.items():
        with (logs / name.replace("__", ".")).open("a") as f:
            f.write(add)
        os.utime(logs / name.replace("__", "."), (1_700_000_000 + at,) * 2)


def _runs(spark, tmp_path, *searches, **more):
    """A function that runs the searches at a second, and gives tag, level and message of what is reported."""
    logs = tmp_path / "logs"
    logs.mkdir()

    def go(second, own=searches, **k):
        out = scan.run(spark, list(own), [str(logs)], str(tmp_path / "state"), datetime.fromtimestamp(1_700_000_000 + second), **more, **k)
        return sorted((r["tag"], r["level"], r["message"]) for r in out.matches.collect())

    return logs, go


def test_a_search_that_is_added_starts_at_the_end(spark, tmp_path):
    a, b, c = Search(tag="a", logfile="log", critical=["hit"]), Search(tag="b", logfile="log", critical=["hit"]), Search(tag="c", logfile="late", critical=["hit"])
    logs, go = _runs(spark, tmp_path)
    _write(logs, 0, log="hit 1\nhit 2\n")
    assert go(1, [a]) == []
    _write(logs, 2, log="hit 3\n")
    assert go(3, [a, b, c]) == [("a", "CRITICAL", "hit 3"), ("c", "UNKNOWN", "could not find logfile late")]
    _write(logs, 4, log="hit 4\n", late="hit 5\n")  # a log that comes later is read from its start
    assert go(5, [a, b, c]) == [("a", "CRITICAL", "hit 4"), ("b", "CRITICAL", "hit 4"), ("c", "CRITICAL", "hit 5")]


def test_a_log_with_other_content_is_read_whole(spark, tmp_path):
    logs, go = _runs(spark, tmp_path, Search(tag="t", logfile="log", critical=["hit"], read_all_first=True))
    _write(logs, 0, log="first line\nhit 0\n")
    assert go(1) == [("t", "CRITICAL", "hit 0")]
    (logs / "log").write_text("")
    _write(logs, 2, log="".join(f"hit {i} of the new log\n" for i in range(10)))  # longer than what was read
    assert len(go(3)) == 10
    (logs / "log").write_text("")
    assert go(4) == []  # empty
    _write(logs, 5, log="hit a\n")
    assert go(6) == [("t", "CRITICAL", "hit a")]
    (logs / "log").write_text("hit\n")  # shrunk
    os.utime(logs / "log", (1_700_000_007,) * 2)
    assert go(8) == [("t", "CRITICAL", "hit")] and go(9) == []


def test_an_idle_log_is_not_read(spark, tmp_path, monkeypatch):
    logs, go = _runs(spark, tmp_path, Search(tag="t", logfile="log", critical=["hit", "!alive"], read_all_first=True))
    _write(logs, 0, log="alive\nhit 1\n")
    assert go(1) == [("t", "CRITICAL", "hit 1")]
    with monkeypatch.context() as m:
        m.setattr(lines, "measure", lambda *_: 1 / 0)
        assert go(2) == go(3) == [("t", "CRITICAL", "MISSING: alive")]
    _write(logs, 4, log="alive\nhit 2\n")
    assert go(5) == [("t", "CRITICAL", "hit 2")]


def test_rotations_between_runs(spark, tmp_path):
    logs, go = _runs(spark, tmp_path, Search(tag="t", logfile="log", critical=["hit"], warning=["odd"], rotation="LOGLOG0LOG1GZ", read_all_first=True))
    _write(logs, 0, log="one\nhit 1\n")
    assert len(go(1)) == 1
    _write(logs, 2, log="hit 2\nhit 3\n")
    with gzip.open(logs / "log.1.gz", "wb") as f:  # rotated twice, no log is there
        f.write((logs / "log").read_bytes())
    (logs / "log").unlink()
    os.utime(logs / "log.1.gz", (1_700_000_002,) * 2)
    _write(logs, 3, log__0="two\nodd 1\n")
    assert go(4) == [("t", "CRITICAL", "hit 2"), ("t", "CRITICAL", "hit 3"), ("t", "WARNING", "odd 1")]
    _write(logs, 5, log="three\nhit 4\n")
    assert go(6) == [("t", "CRITICAL", "hit 4")]


def test_must_appear_without_new_lines(spark, tmp_path):
    logs, go = _runs(spark, tmp_path, Search(tag="t", logfile="log", critical=["copy error", "!BEGUN", "!ENDED"]))
    _write(logs, 0, log="x\n")
    both = [("t", "CRITICAL", "MISSING: BEGUN"), ("t", "CRITICAL", "MISSING: ENDED")]
    assert go(1) == both and go(2) == both
    _write(logs, 3, log="BEGUN\ncopy error\n")
    assert go(4) == [both[1], ("t", "CRITICAL", "copy error")]
    _write(logs, 5, log="BEGUN\nENDED\n")
    assert go(6) == []


@pytest.mark.parametrize(("level", "want"), [("unknown", (0, 0, 1, 3)), ("warning", (1, 0, 0, 1)), ("critical", (0, 1, 0, 2)), ("ok", (0, 0, 0, 0)), ("off", (0, 0, 0, 0))])
def test_levels_of_missing_logs(spark, tmp_path, level, want):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "other").write_text("x\n")
    out = scan.run(spark, [Search(tag="t", logfile="log", critical=["x"], logfile_missing=level)], [str(tmp_path / "logs")], str(tmp_path / "state"), datetime(2024, 1, 1))
    assert counts(out) == want and [r["level"] for r in out.matches.collect()] == ([] if level == "off" else [level.upper()])


def test_virtual_and_newest_logs(spark, tmp_path):
    whole = Search(tag="whole", logfile="status", critical=["down"], virtual=True)
    newest = Search(tag="newest", logfile="app", critical=["hit"], rotation=r"app\.\d+$", newest=True, read_all_first=True)
    logs, go = _runs(spark, tmp_path, whole, newest)
    _write(logs, 0, status="up\ndown\n", app__1="hit 1\n")
    assert go(1) == [("newest", "CRITICAL", "hit 1"), ("whole", "CRITICAL", "down")]
    _write(logs, 2, app__1="hit 2\n")
    _write(logs, 3, app__2="hit 3\n")
    assert go(4) == [("newest", "CRITICAL", "hit 2"), ("newest", "CRITICAL", "hit 3"), ("whole", "CRITICAL", "down")]


def test_dated_names_and_counters(spark, tmp_path):
    s = Search(tag="t", logfile="log.$CL_DATE_YYYY$$CL_DATE_MM$$CL_DATE_DD$", critical=["on $CL_HOSTNAME$"], read_all_first=True)
    logs, _ = _runs(spark, tmp_path)
    (logs / "log.20240102").write_text("x\nfail on web1\n")
    (logs / "log.20240103").write_text("x\nfail on web2\n\nz")
    go = lambda day: scan.run(spark, [s], [str(logs)], str(tmp_path / "state"), datetime(2024, 1, day), host="web1.example.org")
    assert [tuple(r) for r in go(2).counters.collect()] == [("t", 2, 1, 0, 0)] and [tuple(r) for r in go(3).counters.collect()] == [("t", 4, 0, 0, 0)]


def test_thresholds_that_are_not_saved(spark, tmp_path):
    a = Search(tag="a", logfile="log", critical=["hit"], threshold={"critical": 3}, read_all_first=True)
    b = Search(tag="b", logfile="log", critical=["hit"], threshold={"critical": 3}, read_all_first=True, save_threshold=False)
    logs, go = _runs(spark, tmp_path, a, b)
    _write(logs, 0, log="hit\nhit\n")
    assert go(1) == []
    _write(logs, 2, log="hit\nhit\n")
    assert go(3) == [("a", "CRITICAL", "hit")]


def test_callbacks_with_state_over_runs(spark, tmp_path):
    def call(frame, private):
        n = int(private.get("n", 0))
        private["n"] = str(n + len(frame))
        return frame.assign(level="WARNING", message=[f"call {n + i + 1}" for i in range(len(frame))])

    logs, go = _runs(spark, tmp_path, Search(tag="t", logfile="log", critical=["hit"], callback=call, callback_mode="supersmart", read_all_first=True), Search(tag="u", logfile="log", critical=["hit"], read_all_first=True))
    _write(logs, 0, log="hit\nhit\n")
    assert go(1) == [("t", "WARNING", "call 1"), ("t", "WARNING", "call 2"), *[("u", "CRITICAL", "hit")] * 2]
    assert go(2) == []
    _write(logs, 3, log="hit\n")
    assert go(4) == [("t", "WARNING", "call 3"), ("u", "CRITICAL", "hit")]


def test_a_run_that_died_writes_its_protocol_once(spark, tmp_path, monkeypatch):
    logs, go = _runs(spark, tmp_path, Search(tag="t", logfile="log", critical=["hit"], read_all_first=True), protocol_path=str(tmp_path / "protocol"))
    _write(logs, 0, log="hit 1\n")
    written = sinks.save_state

    def dies(*_):
        raise RuntimeError("no space")

    monkeypatch.setattr(sinks, "save_state", dies)
    assert go(1) == [("state", "CRITICAL", "cannot write state: no space"), ("t", "CRITICAL", "hit 1")]
    monkeypatch.setattr(sinks, "save_state", written)
    assert go(86_400) == [("t", "CRITICAL", "hit 1")]
    _write(logs, 86_500, log="hit 2\n")
    go(86_600)
    rows = spark.read.parquet(str(tmp_path / "protocol"))
    assert sorted(r["message"] for r in rows.collect()) == ["hit 1", "hit 2"]
    texts = sinks.text_protocol(rows.withColumn("file_seq", rows["file_seq"].cast("int"))).orderBy("place").collect()
    assert [r["text"] for r in texts] == ["#CRITICAL Errors in log (tag t)", "hit 1", "hit 2"]
    for i in range(3):
        go(90_000 + i)
    assert sinks._versions(spark, str(tmp_path / "state")) == [4, 5]  # older ones are gone
    from datetime import date

    assert sinks.drop_protocol(spark, str(tmp_path / "protocol"), date(2024, 1, 1)) == ["run_date=2023-11-14", "run_date=2023-11-15"]
    assert not list((tmp_path / "protocol").glob("run_date=*"))


def test_reading_lines_shuffles_no_text(spark, tmp_path):
    (tmp_path / "log").write_text("a\nb\n")
    plan = lines.read_lines(spark, [str(tmp_path)])._jdf.queryExecution().executedPlan().toString()
    assert "FileScan text" in plan and "Exchange hash" not in plan and "Sort" not in plan


def test_files_below_some_folders(spark, tmp_path):
    for name in ("a", "d/b", "d/e/c"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    names = lambda levels: sorted(r["path"][-1] for r in lines.list_files(spark, [str(tmp_path)], levels=levels).collect())
    assert (names(0), names(1), names(None)) == (["a"], ["a", "b"], ["a", "b", "c"])


def test_results_are_appended(spark, tmp_path):
    for day in (1, 2):
        sinks.write_results(spark.createDataFrame([("OK", day)], "level string, n int"), str(tmp_path / "results"), datetime(2024, 1, day))
    assert sorted(r["n"] for r in spark.read.parquet(str(tmp_path / "results")).collect()) == [1, 2]


def test_functions_around_a_run(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "messages").write_text("Disk full\n")
    s = [Search(tag="disk", logfile="messages", critical=["Disk full"], read_all_first=True)]
    go = lambda name, **k: scan.run(spark, s, [str(tmp_path / "logs")], str(tmp_path / name), datetime(2024, 1, 1), **k)
    assert counts(go("a", before=lambda: ("WARNING", "low disk"))) == (1, 1, 0, 2)
    assert counts(go("b", before=lambda: 1 / 0)) == (1, 1, 0, 2)
    ended = go("c", before=lambda: ("UNKNOWN", "stop"), replaces=True)
    assert counts(ended) == (0, 0, 1, 3) and sinks.load_state(spark, str(tmp_path / "c")) is None
    out = go("d", after=lambda result, matches: ("OK", f"{result['criticals']} found"), replaces=True).result.first()
    assert (out["level"], out["code"], out["text"]) == ("OK", 0, "1 found")
    assert counts(go("e", after=lambda result, matches: ("WARNING", "more"))) == (1, 1, 0, 2)
    (tmp_path / "file").write_text("")
    assert counts(go("f", protocol_path=str(tmp_path / "file" / "x"), protocol_error="UNKNOWN")) == (0, 1, 1, 2)


def test_records(spark):
    one = lambda text: spark.createDataFrame([(t,) for t in text], "line string")
    r = records.parse_syslog(one(["Mar 09 04:05:06 alpha diskd[42]: Disk full", "no record"]), 2024).collect()
    assert (str(r[0]["ts"]), r[0]["host"], r[0]["process"], r[0]["pid"], r[0]["message"]) == ("2024-03-09 04:05:06", "alpha", "diskd", 42, "Disk full")
    assert r[1]["ts"] is None and r[1]["host"] is None
    r = records.parse_event_csv(one(["05.02.21,16:17:18,4,0,300,Backup,N/A,BETA,Done: a, b", "2/5/2021,12:17:18 PM,4,0,1,S,N/A,H,m", "short"])).collect()
    assert [str(x["generated"]) for x in r] == ["2021-02-05 16:17:18", "2021-02-05 12:17:18"] and r[0]["message"] == "Done: a, b"
    r = records.parse_kernel_lines(one(["kern  :warn  : [   12.345678] FAN SPEED LOW", "  more"]), "2024-01-01 00:00:00").collect()
    assert [(str(x["ts"]), x["event_type"], x["message"]) for x in r] == [("2024-01-01 00:00:12.345678", "warn", "FAN SPEED LOW")]
    r = records.id_listing(one(["   5 | 03/04/2021 | Fan Tray", "no entries here"])).collect()
    assert [(x["id"], x["line"]) for x in r] == [("5", "   5 ; 03/04/2021 ; Fan Tray")]


def test_event_filters(spark):
    rows = [(1, "Error", "watcher", 30), (2, "Error", "watcher", 31), (3, "Error", "Tape", 32), (4, "Error", "watcher", 44), (5, None, None, 30)]
    e = spark.createDataFrame(rows, "id int, event_type string, source string, event_id long").selectExpr("*", "cast(null as string) category")
    kept = e.filter(events.include(event_type=["error"], source=["Watcher"])).filter(~events.exclude(event_id=[33, 44]))
    assert [r["id"] for r in kept.collect()] == [1, 2]
    assert e.filter(events.include(source=["Tape"], op="or")).count() == 5  # what is not given always passes
    assert e.filter(events.exclude(source=["Tape"], event_id=[32], op="and")).count() == 0


FORMATS = """
// a comment
FORMAT Base
%t %s %s*
hostname LABEL
-when $1
msg $3
END
FORMAT Check FOLLOWS Base
%t %s RACK: %s*
severity MINOR
END
FORMAT Two FOLLOWS Base
%s* Event= %s:%s%n occurred at %s*
severity WARNING
msg PRINTF("%s at %s", silo, place)
-silo $2
-place $4
END
FORMAT *DISCARD*
%s* noise %s*
END
"""


def test_formats(spark):
    f = formats.parse_formats(FORMATS)
    assert [x.name for x in f] == ["Base", "Check", "Two", "*DISCARD*"] and f[1].slots["hostname"] == "LABEL"
    text = ["Mar 09 04:05:06 h1 RACK: broken (x)", "Mar 09 04:05:06 h1 other: y", "it Event= B:7", " occurred at noon", "Mar 09 04:05:06 h1 RACK: a noise b"]
    rows = spark.createDataFrame([("l", 0, i, t) for i, t in enumerate(text)], "logfile string, file_seq int, line_no int, line string")
    got = {r["line_no"]: r["hit"] for r in formats.match_formats(rows, f, defaults={"LABEL": "me"}, severity_map={"minor": 2}).collect()}
    assert set(got) == {0, 3}
    assert (got[0]["exit_code"], got[0]["format_name"], got[0]["subject"], got[0]["slots"]["hostname"]) == (2, "Check", "broken (x)", "me")
    assert (got[3]["exit_code"], got[3]["subject"]) == (1, "B at noon")


def test_newest_file_and_archives(spark):
    rows = [("access.log.1700000000", 1), ("access.log.1700000300", 3), ("access.log.1700000100", 2), ("error.log", 9)]
    files = spark.createDataFrame([(f"/logs/{n}", t, 10) for n, t in rows], "path string, mtime int, length long")
    search = spark.createDataFrame([("web", "h", "access.log", incremental.rotation_regex("MOD_LOG_ROTATE", "access.log"))], "tag string, host string, logfile string, pattern string")
    found = incremental.match_archives(files, search).drop("current")
    got = {r["name"]: r["current"] for r in incremental.current_file(found).collect()}
    assert got == {"access.log.1700000000": False, "access.log.1700000300": True, "access.log.1700000100": False}


def test_text_functions(spark):
    from pyspark.sql import functions as F

    from logscan.functions import text

    row = spark.createDataFrame([("5m", '<a href="x">&</a>', "%41+b", "one\r\ntwo \n")], "d string, h string, u string, s string")
    got = row.select(text.duration_seconds(F.col("d")), text.html_encode(F.col("h")), text.html_escape(F.col("h")), text.url_decode(F.col("u")), text.squeeze(F.col("s"))).first()
    assert list(got) == [300, "&lta href=&quotx&quot&gt&amp&lt/a&gt", '&lt;a href="x"&gt;&&lt;/a&gt;', "A+b", "one two"]
