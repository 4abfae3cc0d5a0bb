"""Runs over series of files: folders and hosts, formats over lines, many searches, unreadable files, charsets."""

from __future__ import annotations

import gzip
import os
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logscan.jobs import scan, sinks
from logscan.model import Search
from logscan.operators import callbacks, classify, dispatch, formats, literals
from logscan.sources import incremental, lines

LINES = "tag string, host string, logfile string, file_seq long, line_no long, line string"


def write(path, text, at, encoding="utf-8"):
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("ab") as f:
        f.write(text.encode(encoding))
    os.utime(path, (1_700_000_000 + at,) * 2)


@pytest.fixture
def go(spark, tmp_path):
    """Runs searches over tmp_path/logs; gives host, log, level and message of what is reported."""

    def run(second, *searches, **more):
        out = scan.run(spark, list(searches), [str(tmp_path / "logs")], str(tmp_path / "state"), datetime.fromtimestamp(1_700_000_000 + second), **more)
        return sorted((r["host"], r["logfile"].removeprefix(f"{tmp_path}/logs/"), r["level"], r["message"]) for r in out.matches.collect())

    return run


# ------------------------------------------------------------------ sources


def test_logs_of_one_name_in_two_folders(spark, tmp_path, go):
    logs, s = tmp_path / "logs", Search(tag="t", logfile="messages", critical=["hit"], rotation="LOGLOG0LOG1")
    write(logs / "a/messages", "hit old\n" * 5, 0)
    write(logs / "b one/messages", "hit old\n" * 3, 0)
    assert go(1, s) == []
    write(logs / "a/messages", "hit a\n" * 5, 2)
    write(logs / "b one/messages", "hit b\n" * 3, 3)
    assert go(4, s) == [("localhost", "a/messages", "CRITICAL", "hit a")] * 5 + [("localhost", "b one/messages", "CRITICAL", "hit b")] * 3
    (logs / "a/messages").rename(logs / "a/messages.0")
    write(logs / "a/messages", "hit after\n", 5)
    write(logs / "a/messages.0", "hit before\n", 5)
    (logs / "b one/messages").unlink()
    assert go(6, s) == [("localhost", "a/messages", "CRITICAL", "hit after"), ("localhost", "a/messages", "CRITICAL", "hit before"), ("localhost", "b one/messages", "UNKNOWN", "could not find logfile b one/messages")]
    state = {r["logfile"][len(f"{logs}/") :]: r["logoffset"] for r in sinks.load_state(spark, str(tmp_path / "state")).collect()}
    assert state == {"a/messages": 10, "b one/messages": 42}


def test_a_state_that_names_no_folders_is_taken_over(spark, tmp_path, go):
    logs, s = tmp_path / "logs", Search(tag="t", logfile="messages", critical=["hit"], rotation="LOGLOG0LOG1")
    write(logs / "a/messages", "first of a\nhit a\n", 0)
    write(logs / "b/messages", "first of b\nhit b\n", 0)
    go(1, s)
    state = sinks.load_state(spark, str(tmp_path / "state")).filter(F.col("logfile").contains("/a/"))
    sinks.save_state(state.withColumn("logfile", F.lit("messages")).drop("tail"), str(tmp_path / "state"))
    write(logs / "a/messages", "hit a 2\n", 2)
    write(logs / "b/messages", "hit b 2\n", 2)
    # the position is that of a; b is new, and starts at its end
    assert go(3, s) == [("localhost", "a/messages", "CRITICAL", "hit a 2")]
    write(logs / "b/messages", "hit b 3\n", 4)
    assert go(5, s) == [("localhost", "b/messages", "CRITICAL", "hit b 3")]


def test_hosts_and_archive_folders(spark, tmp_path, go):
    logs = tmp_path / "logs"
    every = Search(tag="every", logfile="messages", critical=["hit"], rotation=r"\d{4}\.log", archives=r"old/\d{6}", read_all_first=True)
    one = Search(tag="one", logfile="var/messages", critical=["hit"], host="h2", read_all_first=True)
    for h in ("h1", "h2"):
        write(logs / h / "var/messages", f"hit {h}\n", 3)
        write(logs / h / "var/old/202401/2301.log", f"hit archive {h}\n", 1)
        write(logs / h / "var/2302.log", "hit nowhere\n", 1)
    layout = f"{logs}/{{host}}/"
    want = [(h, f"{h}/var/messages", "CRITICAL", m) for h in ("h1", "h2") for m in (f"hit {h}", f"hit archive {h}")] + [("h2", "h2/var/messages", "CRITICAL", "hit h2")]
    assert go(4, every, one, layout=layout) == sorted(want)
    assert go(5, every, one, layout=layout) == []


def test_files_meet_searches_in_an_equi_join(spark, tmp_path):
    names = ["messages", "messages.0", "messages.1.gz", "OLDmessages", "xmessages.7.gz", "h_messages.2024_1_2_3_4_5", "app-17.log", "@40000", "other"]
    files = spark.createDataFrame([(f"file:/logs/{d}/{n}", 1, 1) for n in names for d in "ab"], "path string, mtime int, length long")
    schemes = ["LOGLOG0LOG1GZ", "HPUX", "DEBIAN", "EHL", "QMAIL", r"app-\d+\.log", r"[a-z]+", None]
    rows = [(f"t{i}", "h", "messages", incremental.rotation_regex(s or "(?!)", "messages", "h"), *incremental.stem(s, "messages")) for i, s in enumerate(schemes)]
    searches = spark.createDataFrame(rows, "tag string, host string, logfile string, pattern string, stem string, anywhere boolean")
    found = incremental.match_archives(files, searches)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {(r["tag"], r["path"], r["logfile"], r["current"]) for r in found.collect()}
    # the same by trying every pattern on every name
    tried = files.crossJoin(searches).withColumn("name", F.regexp_extract("path", "([^/]+)$", 1)).filter("name = logfile or name rlike pattern")
    assert got == {(r["tag"], r["path"], r["path"].removeprefix("file:").rsplit("/", 1)[0] + "/messages", r["name"] == "messages") for r in tried.collect()} and len(got) > 20


# ------------------------------------------------------------------ formats

ALONE = "FORMAT Alone\n%s*odd %s*\nseverity WARNING\nEND\n"
TWO = "FORMAT Two\nbegin %s*%nend %s*\nseverity CRITICAL\nmsg $2\nEND\n"
GONE = "FORMAT *DISCARD*\n%s*noise%s*\nEND\n"


def matched(spark, text, **options):
    rows = spark.createDataFrame([("t", "h", "l", 0, i, x) for i, x in enumerate(text)], LINES)
    return sorted((r["line_no"], r["level"], r["message"]) for r in scan.scan_lines(rows, [Search(tag="t", **options)])[0].collect())


def test_formats_are_one_list(spark):
    assert matched(spark, ["begin 1", "end odd x"], formats=ALONE + TWO) == [(1, "CRITICAL", "odd x")]
    assert matched(spark, ["begin 1", "end odd x"], formats=TWO + ALONE) == [(1, "WARNING", "end odd x")]
    assert matched(spark, ["begin 1", "end noise", "begin 2", "end 2"], formats=TWO + GONE) == [(3, "CRITICAL", "2")]
    assert matched(spark, ["noise", "x"], formats=GONE) == [] == matched(spark, ["noise"], formats="FORMAT None\n%s*\nEND\n")
    assert matched(spark, ["begin 1", "skipped", "end 1"], formats=TWO, skip=["skip"]) == [(2, "CRITICAL", "1")]
    assert matched(spark, ["begin 1", "end odd"], formats=ALONE + TWO, warning=["end"], preferred_level="warning") == [(1, "WARNING", "end odd")]


def test_formats_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(formats, "BLOCK", 2)
    three = formats.parse_formats("FORMAT Three\na%s*%nb%s*%nc%s*\nseverity CRITICAL\nEND")
    r = random.Random(4)
    text = [r.choice("abc") + str(i) for i in range(200)]
    rows = [("l", i // 50, i % 50 * r.choice([1, 1, 1]), x, i) for i, x in enumerate(text)]
    df = spark.createDataFrame(rows, "logfile string, file_seq long, line_no long, line string, n int").repartition(4)
    got = sorted(x["n"] for x in formats.match_formats(df, three).collect())
    assert got == [i for i in range(2, 200) if text[i][0] == "c" and text[i - 1][0] == "b" and text[i - 2][0] == "a"] and got
    plan = formats.match_formats(df, three)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan  # no text is sorted over a whole log


def test_a_format_over_lines_of_two_runs(tmp_path, go):
    s = Search(tag="t", logfile="log", formats=TWO, read_all_first=True)
    write(tmp_path / "logs/log", "x\nbegin 1\n", 0)
    assert go(1, s) == []
    assert go(2, s) == []
    write(tmp_path / "logs/log", "end 1\nbegin 2\nend 2\nend 3\n", 3)
    assert [x[3] for x in go(4, s)] == ["1", "2"]


# ------------------------------------------------------------------ many searches


def some_search(r, i):
    text = lambda: r.choice(["disk full", "Fan", "error [0-9]+", "fa(il|ll)ed", r"user \w+ gone", r"x\vy", "[a-c]{2}", ".*", "a|b", f"host-{i}", "Ünder", "ok", r"\Qa.b\E"])
    some = lambda n: [text() for _ in range(r.randrange(n))]
    return Search(
        tag=f"t{i}", logfile=r.choice([None, "l0", "l1"]), critical=[*some(3), *(["!beat"] if i % 5 == 0 else [])], warning=[("k", p) for p in some(3)], unknown=[*some(2), "!x"], case=i % 3 > 0,
        exceptions={"critical": some(3)}, ok=some(2), need=some(2) if i % 7 == 0 else [], skip=some(2) if i % 4 == 0 else [], preferred_level=r.choice([None, "warning", "critical"]), maxlength=r.choice([None, 5]),
    )


def test_dispatched_rules_equal_compiled_ones(spark, monkeypatch):
    r = random.Random(2)
    searches = [some_search(r, i) for i in range(14)]
    words = ["disk full", "FAN", "Fan", "error 12", "failed", "fAlled", "user bob gone", "x\vy", "x\x85y", "ab", "a.b", "host-3", "Ünder", "ünder", "ok", "beat", ""]
    rows = [(f"t{r.randrange(15)}", "h", f"l{r.randrange(3)}", 0, i, None if i == 7 else " ".join(r.choice(words) for _ in range(r.randrange(4)))) for i in range(300)]
    df = spark.createDataFrame(rows, LINES).repartition(3)
    both = []
    for limits in ((1000, 1000), (-1, -1)):
        monkeypatch.setattr(dispatch, "PATTERNS", limits[0])
        monkeypatch.setattr(dispatch, "SEARCHES", limits[1])
        both.append([sorted(map(str, f(df, searches).collect())) for f in (classify.line_events, classify.classify)])
    assert both[0] == both[1] and len(both[0][0]) > 50


def test_thousands_of_searches(spark):
    n = 5000
    searches = [Search(tag=f"s{i}", critical=[f"bad{i} thing", ("k", f"worse{i}")], warning=["odd"], threshold={"critical": 2}, ok=[f"fine{i}"]) for i in range(n)]
    line = F.concat(F.lit("bad"), (F.col("id") % n).cast("string"), F.lit(" thing, odd"))
    df = spark.range(2 * n).select(F.concat(F.lit("s"), (F.col("id") % n).cast("string")).alias("tag"), F.lit("h").alias("host"), F.lit("l").alias("logfile"), F.lit(0).alias("file_seq"), F.col("id").alias("line_no"), line.alias("line"))
    matches, carry = scan.scan_lines(df, searches)
    assert {(r["level"], r["n"]) for r in matches.groupBy("level").agg(F.count("*").alias("n")).collect()} == {("CRITICAL", n), ("WARNING", 2 * n)}
    assert carry.filter("carry > 0").count() == 0


def test_many_searches_of_one_file_in_a_run(tmp_path, go):
    searches = [Search(tag=f"s{i:02}", logfile="log" if i else "other", critical=[f"bad {i}$"], read_all_first=True) for i in range(30)]
    searches.append(Search(tag="wide", logfile="log", formats=TWO, read_all_first=True))
    write(tmp_path / "logs/log", "".join(f"bad {i}\n" for i in range(30)) + "begin\nbegin 1\nend 1\n", 0)
    write(tmp_path / "logs/other", "bad 0\nbad 1\n", 0)
    want = [("localhost", "other" if i == 0 else "log", "CRITICAL", f"bad {i}") for i in range(30)] + [("localhost", "log", "CRITICAL", "1")]
    assert go(1, *searches) == sorted(want)
    write(tmp_path / "logs/log", "bad 7\nend 2\n", 2)
    assert go(3, *searches) == [("localhost", "log", "CRITICAL", "bad 7")]


# ------------------------------------------------------------------ what cannot be read, charsets, small faults


def test_unreadable_files_do_not_stop_a_run(spark, tmp_path, go):
    logs = tmp_path / "logs"
    for i in range(12):
        (logs / f"d{i}").mkdir(parents=True)
        with gzip.open(logs / f"d{i}/log.1.gz", "wb") as f:
            f.write(b"one\nhit\n" * 1000 + os.urandom(3000))
        os.utime(logs / f"d{i}/log.1.gz", (1_700_000_000,) * 2)
        write(logs / f"d{i}/log", f"hit {i}\n", 1)
    for i in (3, 5, 8, 9):
        b = (logs / f"d{i}/log.1.gz").read_bytes()
        (logs / f"d{i}/log.1.gz").write_bytes(b[: len(b) // 2] + b"xx" + b[len(b) // 2 + 2 :])
        os.utime(logs / f"d{i}/log.1.gz", (1_700_000_000,) * 2)
    s = Search(tag="t", logfile="log", critical=["^hit [0-9]+$"], rotation="LOGLOG0LOG1GZ", unreadable="warning", read_all_first=True)
    got = go(2, s)
    assert [x for x in got if x[2] == "CRITICAL"] == sorted(("localhost", f"d{i}/log", "CRITICAL", f"hit {i}") for i in range(12))
    assert [x for x in got if x[2] != "CRITICAL"] == [("localhost", f"d{i}/log", "WARNING", f"could not read {logs}/d{i}/log.1.gz") for i in (3, 5, 8, 9)]


def test_charsets_in_runs(spark, tmp_path, go):
    logs = tmp_path / "logs"
    wide = Search(tag="wide", logfile="u", critical=["hit"], encoding="UTF-16LE", read_all_first=True)
    plain = Search(tag="plain", logfile="l", critical=["hit \\?"], encoding="ISO-8859-1", read_all_first=True)
    write(logs / "u", "one\r\nhit ä\r\n", 0, "utf-16-le")
    write(logs / "l", "hit ä\n", 0, "iso-8859-1")
    assert [x[3] for x in go(1, wide, plain)] == ["hit ?", "hit ?"]
    write(logs / "u", "hit 2\r\n", 2, "utf-16-le")
    assert go(3, wide, plain) == [("localhost", "u", "CRITICAL", "hit 2")]


def test_wide_charsets_are_read_in_splits(spark, tmp_path):
    # signs whose bytes hold a line feed across two signs
    text = "".join(f"line {i} ਅA{'x' * (i % 50)}ੁ\u0012 ሊ㐀ö\r\n" for i in range(4000)) + "end"
    (tmp_path / "u").write_bytes(text.encode("utf-16-le"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        read = lines.read_lines(spark, [str(tmp_path / "u")], encoding="UTF-16LE")
        assert read.rdd.getNumPartitions() > 3
        rows = read.orderBy("start_offset").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["line"] for r in rows] == [x.removesuffix("\r").encode("ascii", "replace").decode() for x in text.split("\n")]
    assert rows[-1]["end_offset"] == (tmp_path / "u").stat().st_size
    with pytest.raises(ValueError, match="order of bytes"):
        lines.width("UTF-16")


@pytest.mark.parametrize("pattern", [r"x\vy", r"a\hb", "a{,2}b", r"\0101", r"x\Ry"])
def test_no_texts_where_dialects_differ(pattern):
    assert literals.required(pattern) == ([], False)


def test_texts_are_held_by_every_match(spark):
    """What Java finds holds the texts that Python's reading of the pattern asks for."""
    r = random.Random(6)
    parts = ["a", "bc", "d+", "(ef|g)", "[h-k]", r"\.", r"\d", r"\x41", r"\t", "(?:lm)?", "(no){2}", "p*", "^", "$", r"\bq", "r{1,2}", r"\v", r"\e", "(?i:s)", r"t", r"\s", r"\w+", r"[^a\d]", ".", ".*?", r"\S", "(a|b|)+", r"\W"]
    patterns = ["".join(r.choice(parts) for _ in range(r.randrange(1, 6))) for _ in range(150)]
    texts = ["".join(r.choice(["a", "bc", "d", "ef", "g", "h", ".", "7", "A", "\t", "lm", "nono", "p", "q", "r", "\n", "\x1b", "S", "t", " ", "\x85", "é", "\u2028", "\r", "\x1c", "😀"]) for _ in range(12)) for _ in range(120)]
    df = spark.createDataFrame([(t,) for t in texts], "line string")
    for n in range(0, len(patterns), 50):
        part = patterns[n : n + 50]
        plain = df.select(*[F.col("line").rlike("(?d)" + p).alias(f"p{i}") for i, p in enumerate(part)]).collect()
        sifted = df.select(*[literals.found(F.col("line"), p, "(?d)").alias(f"p{i}") for i, p in enumerate(part)]).collect()
        assert plain == sifted
        alike = [(i, literals.plain(p)) for i, p in enumerate(part)]
        assert sum(p is not None for _, p in alike) > 5
        for t, found in zip(df.collect(), plain, strict=True):
            for i, p in alike:
                assert p is None or bool(p.search(t["line"])) == found[i], (part[i], t["line"])


def test_unknown_patterns_are_never_missed(spark):
    s = Search(tag="t", unknown=["!never"], warning=["!once"])
    rows = spark.createDataFrame([("t", "h", "l", 0, 0, "x")], LINES)
    want = [("WARNING", "MISSING: once")]
    assert [(r["level"], r["message"]) for r in classify.missing_patterns(rows, s).collect()] == want
    assert [(r["level"], r["message"]) for r in scan.scan_lines(rows, [s])[0].collect()] == want


@pytest.mark.parametrize("option", ["ok", "need", "skip", "client", "rotation", "exceptions"])
def test_bad_patterns_are_told_with_their_search(spark, option):
    value = {"client": "(", "rotation": "(", "exceptions": {"critical": ["("]}}.get(option, ["("])
    with pytest.raises(ValueError, match="search bad, "):
        Search(tag="bad", **{option: value}).check(spark)


def test_flood_without_times_and_with_equal_ones(spark):
    rows = [("t", 10, 1), ("t", 10, 0), ("t", None, 2), ("t", 10, 3), ("t", 200, 4), ("u", None, 5)]
    df = spark.createDataFrame(rows, "tag string, at long, n int").withColumn("when", F.timestamp_seconds("at")).drop("at")
    got = {r["n"]: r["wait"] for r in callbacks.flood(df.repartition(3), 2, 60).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 60, 4: 0, 5: 0}  # in the order of time, then of the other columns; events without a time are allowed


def test_callbacks_see_captures_and_the_last_run(tmp_path, go):
    def call(frame, private):
        seen = [(r.pat_key, list(r.captures), int(r.runcount) if r.runcount == r.runcount and r.runcount is not None else 0) for r in frame.itertuples()]
        return frame.assign(level="WARNING", message=[str(x) for x in seen])

    s = Search(tag="t", logfile="log", critical={"three": "bla ((pat1) blub (pat2.*)) bla(x)?", "none": "plain"}, read_all_first=True, callback=call, callback_mode="supersmart")
    again = Search(tag="again", logfile="log", critical=["run $CL_RUN_COUNT$!"], read_all_first=True)
    write(tmp_path / "logs/log", "bla pat1 blub pat2kaas bla\nrun 0!\n", 0)
    assert [x[3] for x in go(1, s, again)] == ["run 0!", "('three', ['pat1 blub pat2kaas', 'pat1', 'pat2kaas', None], 0)"]
    write(tmp_path / "logs/log", "plain\nrun 0!\nrun 1!\n", 2)
    assert [x[3] for x in go(3, s, again)] == ["run 1!", "('none', [], 1)"]
