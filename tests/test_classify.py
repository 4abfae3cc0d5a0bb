"""Scenarios of single scans, and a sequential scanner as oracle on random lines."""

from __future__ import annotations

import random
import re
from collections import Counter
from dataclasses import replace
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logscan.jobs.scan import scan_lines
from logscan.model import Search, expand_templates, macros, merge_searches, read_rules, resolve, resolved, seconds, select_searches, with_rules
from logscan.operators import classify, events, literals, report, sticky, thresholds

SCHEMA = "tag string, host string, logfile string, file_seq int, line_no long, line string"


def frame(spark, lines, tag="t", logfile="log"):
    return spark.createDataFrame([(tag, "h", logfile, 0, i, x) for i, x in enumerate(lines)], SCHEMA)


def counts(matches):
    n = Counter(r["level"] for r in matches.collect())
    return n["WARNING"], n["CRITICAL"], n["UNKNOWN"]


def test_exceptions(spark):
    s = Search(
        tag="t",
        critical=["Disk full"],
        warning=["Fan slow", "Disk full on volume scratch"],
        exceptions={"critical": ["Disk full on volume (cache|scratch)"], "warning": ["Fan slow in rack 7"]},
    )
    lines = ["Disk full on volume data"] * 2 + ["Disk full on volume scratch"] * 2 + ["Disk full on volume cache"] * 2 + ["Fan slow in rack 7", "Fan slow in rack 9", "all quiet"]
    assert counts(scan_lines(frame(spark, lines), [s])[0]) == (3, 2, 0)


@pytest.mark.parametrize(("preferred", "line", "want"), [(None, "Disk full on b", (2, 2, 0)), ("critical", "Disk full on c", (0, 4, 0)), ("warning", "Disk full on c", (2, 0, 0))])
def test_each_pattern_counts_and_preferred_level(spark, preferred, line, want):
    s = Search(tag="t", critical=["Disk full", "on c"], warning=[".*"], preferred_level=preferred)
    assert counts(scan_lines(frame(spark, [line] * 2), [s])[0]) == want


def test_must_appear(spark):
    s = Search(tag="t", critical=["copy error", "!.*BEGUN.*", "!.*ENDED.*", "!never"])
    matches, _ = scan_lines(frame(spark, ["x BEGUN", *["copy error"] * 4, "y ENDED"]), [s])
    assert counts(matches) == (0, 5, 0)
    assert [r["message"] for r in matches.filter("message like 'MISSING%'").collect()] == ["MISSING: never"]


def test_threshold_two_levels_and_carry(spark):
    s = Search(tag="t", critical=["port"], warning=["user"], threshold={"critical": 10, "warning": 3})
    matches, carry = scan_lines(frame(spark, ["port"] * 199 + ["user"] * 31), [s])
    assert counts(matches) == (10, 19, 0)
    assert {r["level"]: r["carry"] for r in carry.collect()} == {"CRITICAL": 9, "WARNING": 1}
    matches, after = scan_lines(frame(spark, ["port"] * 12), [s], carry)
    assert counts(matches) == (0, 2, 0)
    assert {r["level"]: r["carry"] for r in after.collect()} == {"CRITICAL": 1, "WARNING": 1}


@pytest.mark.parametrize(("lines", "want"), [(["hit"] * 19 + ["fine"] + ["hit"] * 9, 0), (["hit"] * 19 + ["fine"] + ["hit"] * 19, 1)])
def test_all_clear_resets_threshold(spark, lines, want):
    s = Search(tag="t", critical=["hit"], ok=["fine"], threshold={"critical": 10})
    assert counts(scan_lines(frame(spark, lines), [s])[0]) == (0, want, 0)


def test_hot_key_numbering_equals_plain(spark):
    rows = spark.range(1000).select(F.lit("a").alias("tag"), (F.col("id") / 100).cast("int").alias("file_seq"), F.col("id").alias("line_no"), F.lit(0).alias("pat_pos"))
    plain = thresholds.apply_threshold(rows, 7, key=("tag",))
    hot = thresholds.apply_threshold(rows, 7, key=("tag",), hot="file_seq")
    assert sorted(r["line_no"] for r in plain.collect()) == sorted(r["line_no"] for r in hot.collect())


def scanner(lines, s: Search):
    """Line by line, as a program would."""
    found = []
    carry = {"CRITICAL": 0, "WARNING": 0}
    for line in lines:
        if not all(re.search(p, line) for p in s.need) or any(re.search(p, line) for p in s.skip):
            continue
        hits = []
        for level in ("CRITICAL", "WARNING"):
            if any(re.search(p, line) for p in s.exceptions.get(level.lower(), ())):
                continue
            hits += [(level, i) for i, _, p in s.rules(level) if re.search(p, line)]
        preferred = (s.preferred_level or "").upper()
        if any(x == preferred for x, _ in hits):
            hits = [h for h in hits if h[0] == preferred]
        for level, i in hits:
            carry[level] += 1
            if carry[level] >= s.threshold.get(level.lower(), 1):
                carry[level] = 0
                found.append((level, i))
        if any(re.search(p, line) for p in s.ok):
            found, carry = [], {"CRITICAL": 0, "WARNING": 0}
    return Counter(found)


@pytest.mark.parametrize("seed", range(6))
def test_against_a_sequential_scanner(spark, seed):
    r = random.Random(seed)
    lines = [" ".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(r.choice([0, 1, 300]))]
    s = Search(
        tag="t", critical=["a", "b c"], warning=["d", "a"], exceptions={"critical": ["e"]}, skip=["h h"] if seed % 2 else [], need=["[a-f]"],
        preferred_level=r.choice([None, "critical", "warning"]), ok=["g g g"] if seed % 3 else [], threshold={"critical": r.choice([1, 3])},
    )
    got = Counter((x["level"], x["pat_idx"]) for x in scan_lines(frame(spark, lines), [s])[0].collect())
    assert got == scanner(lines, s)


@pytest.mark.parametrize("searches", [1, 20])
def test_all_searches_read_the_lines_once(spark, tmp_path, searches):
    frame(spark, ["hit", "fine"]).write.parquet(str(tmp_path / "in"))
    read = spark.read.parquet(str(tmp_path / "in"))
    own = [Search(tag=f"t{i}", critical=["hit", "!seen"], warning=["h.t"], ok=["fine"], threshold={"critical": 2, "warning": 3}, exceptions={"warning": ["x"]}) for i in range(searches)]
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(classify.line_events(read, own)).count("Relation [") == 1
    matches, carry = scan_lines(read, own, keys=spark.createDataFrame([("t0", "h", "log")], "tag string, host string, logfile string"))
    assert str(tmp_path / "in") not in "".join(df._jdf.queryExecution().executedPlan().toString() for df in (matches, carry))


def test_searches_keep_to_their_tags(spark):
    own = [Search(tag="a", critical=["x"], threshold={"critical": 2}), Search(tag="b", warning=["x"], ok=["y"]), Search(tag="c", critical=["!z"], unknown=["x$"])]
    both = frame(spark, ["x", "x", "x"], "a").union(frame(spark, ["x", "y", "x"], "b")).union(frame(spark, ["ax", "xa"], "c"))
    matches, carry = scan_lines(both, own)
    assert Counter((r["tag"], r["level"], r["pattern"]) for r in matches.collect()) == {("a", "CRITICAL", "x"): 1, ("b", "WARNING", "x"): 1, ("c", "UNKNOWN", "x$"): 1, ("c", "CRITICAL", "z"): 1}
    assert [(r["tag"], r["carry"]) for r in carry.collect()] == [("a", 1)]


PATTERNS = ["abc", "a(bc)+d", "a|b", "(ab|cd)ef", "x{0,2}yz", "[ab]cd", "a.c", "(?i)abc", "^ab$", "a\\.b", "(?:foo)bar", "ab*c", "b+", "\\d\\dab", "(?=ab)a", "a\\/b", "[[:alpha:]]b", "[a[bc]]d", "(a(b(c)))?d", "AbC"]


@pytest.mark.parametrize("case", [True, False])
def test_literals_lose_no_match(spark, case):
    r = random.Random(3)
    lines = ["".join(r.choice("abcdefoxyzABC./1 ") for _ in range(r.randrange(1, 9))) for _ in range(2000)] + ["foobar", "abcbcd", "abef", "12ab", "a.b", "a/b", ":b", "cd", "\u212a"]
    rows = frame(spark, lines)
    flags = "(?d)" if case else "(?di)"
    sifted = [literals.found(F.col("line"), p, flags, case).alias(f"s{i}") for i, p in enumerate(PATTERNS)]
    plain = [F.col("line").rlike(flags + p).alias(f"p{i}") for i, p in enumerate(PATTERNS)]
    for x in rows.select(*sifted, *plain, literals.any_found(F.col("line"), PATTERNS, flags, case).alias("any")).collect():
        assert all(x[f"s{i}"] == x[f"p{i}"] for i in range(len(PATTERNS))) and x["any"] == any(x[f"p{i}"] for i in range(len(PATTERNS)))


@pytest.mark.parametrize(("pattern", "texts", "whole"), [("abc", ["abc"], True), ("abc.*de", ["abc", "de"], False), ("x(foo)+y", ["foo", "x"], False), ("(foo)bar", ["foobar"], False), ("a|b", [], False), ("(?i)abc", [], False), ("ab?", ["a"], False), ("[a[b]]c", [], False), ("\\p{L}abc", [], False)])
def test_required_literals(pattern, texts, whole):
    assert literals.required(pattern) == (texts, whole)


def test_formats_as_an_option(spark):
    text = "FORMAT Disk\n%s* disk %s is %s*\nseverity WARNING\nmsg $2\nEND\nFORMAT Dead FOLLOWS Disk\n%s* disk %s is dead\nseverity FATAL\nEND\nFORMAT Two\n%s* begins%n%s* ends\nseverity MINOR\nmsg $1\nEND"
    s = Search(tag="t", critical=["panic"], formats=text, format_levels={"minor": 3})
    matches, _ = scan_lines(frame(spark, ["the disk sda is slow", "the disk sdb is dead", "panic", "it begins", "it ends", "none"]), [s])
    assert {(r["level"], r["pat_key"], r["message"]) for r in matches.collect()} == {("WARNING", "Disk", "sda"), ("CRITICAL", "Dead", "sdb"), ("CRITICAL", "unknown_pattern", "panic"), ("UNKNOWN", "Two", "it")}


def test_rule_sets(tmp_path, spark):
    a = Search(tag="a", critical={"k": "own"}, warning="w", exceptions={"critical": ["e"]})
    (tmp_path / "r.json").write_text('{"critical": ["one"], "ok": "fine", "exceptions": {"critical": ["f"], "warning": ["g"]}}')
    b = with_rules(a, [*read_rules(spark, [str(tmp_path / "r.json")]), {"critical": {"x": "two"}}])
    assert b.rules("critical") == [(0, "x", "two"), (1, "unknown_pattern", "one"), (2, "k", "own")] and b.rules("warning") == a.rules("warning")
    assert b.exceptions == {"critical": ["f", "e"], "warning": ["g"]} and b.ok == ["fine"]
    with pytest.raises(ValueError, match="search a"):
        with_rules(a, [{"criticals": []}])


def test_all_lines_and_no_line(spark):
    s = Search(tag="t", warning=["match_them_all"], critical=["match_never_ever", "b"])
    assert counts(scan_lines(frame(spark, ["a", "b", ""]), [s])[0]) == (3, 1, 0)


def test_macros_in_searches():
    values = macros(datetime(2024, 3, 7, 5, 6, 9), "web1.example.org", OWN="a.b")
    s = resolved(Search(tag="t", logfile="log.$CL_DATE_YYYY$-$CL_DATE_MM$-$CL_DATE_DD$", critical={"k": "$CL_HOSTNAME$ $OWN$"}, exceptions={"critical": ["$CL_FQDN$"]}, ok=["$NONE$"]), values)
    assert s.logfile == "log.2024-03-07" and s.rules("critical") == [(0, "k", "web1 a\\.b")]
    assert s.exceptions == {"critical": ["web1\\.example\\.org"]} and s.ok == ["$NONE$"] and values["CL_DATE_CW"] == "10" and values["CL_DOMAIN"] == "example.org"


def test_client_server_and_tags_of_templates(spark):
    lines = ["web.1 x", "web21 x", "localhost x", "db x"]
    own = lambda **k: counts(scan_lines(frame(spark, lines), [Search(tag="t", critical=["x"], **k)])[0])[1]
    assert (own(client="web.?1"), own(server="web.1"), own(server="db", need=["l"]), own()) == (2, 2, 1, 4)
    (s,) = expand_templates([Search(tag="n", template=True, logfile="$CL_tag$.log", client="$CL_TAG$ ", critical=["$CL_TEMPLATE$"])], ["Web.1"])
    assert (s.tag, s.logfile, s.client, s.rules("critical")) == ("n_Web.1", "web.1.log", "Web\\.1 ", [(0, "unknown_pattern", "n")])
    s = resolved(Search(tag="t", logfile="$CL_TAG$.$X$", server="$X$", need=["$CL_LOGFILE$"]), {"X": "a.b"})
    assert (s.logfile, s.server, s.need, s.needed()[1]) == ("t.a.b", "a.b", ["t\\.a\\.b"], "(a\\.b|localhost)")


def test_where_the_window_of_a_run_begins(spark):
    now, last = datetime(2024, 3, 1, 12), datetime(2024, 3, 1, 11)
    begins = [events.since(last, now), events.since(None, now), events.since(None, now, kind="report"), events.since(last, now, "2h"), events.since(None, now, read_all=True)]
    row = spark.range(1).select(*[(F.unix_timestamp(F.lit(now)) - F.unix_timestamp(b)).alias(f"b{i}") for i, b in enumerate(begins)]).first()
    assert list(row) == [3600, 600, 300, 7200, 3650 * 86400]


def test_long_report_and_its_page(spark):
    rows = [(t, "CRITICAL" if i % 2 else "WARNING", 0, i, 0, f"{t}<{i}>") for t in ("a", "b") for i in range(3000)]
    m = spark.createDataFrame(rows, "tag string, level string, file_seq int, line_no long, pat_pos int, message string")
    out = [r["text"] for r in report.long_report(m, 200).orderBy("seq").collect()]
    want, size = [], 0
    for text in ["tag a CRITICAL", *(f"a<{i}>" for i in range(1, 3000, 2))]:
        size += len(text)
        if size >= 200:
            break
        want.append(text)
    assert out == want
    page = report.html_report(report.long_report(m, 40)).orderBy("seq").collect()
    assert page[1]["html"] == '<tr style="background-color: #ff9999"><td>a&lt;1&gt;</td></tr>'


def test_several_searches_in_one_pass(spark):
    a, b = Search(tag="a", critical=["x"], logfile="log"), Search(tag="b", warning=["x"], logfile="other")
    both = frame(spark, ["x"]).union(frame(spark, ["x", "x"], logfile="other")).drop("tag")
    got = Counter((r["tag"], r["level"]) for r in classify.classify(both, [a, b]).collect())
    assert got == {("a", "CRITICAL"): 1, ("b", "WARNING"): 2}


def test_case_captures_and_messages(spark):
    s = Search(tag="t", critical={"key1": "BROKEN (\\w+)( now)?", "key2": "^$"}, case=False, maxlength=8)
    found = classify.with_captures(classify.classify(frame(spark, ["broken drive", ""]), [s]), "(?i)BROKEN (\\w+)( now)?", 2)
    rows = {r["pat_key"]: r for r in found.collect()}
    assert rows["key1"]["captures"] == ["drive", None] and rows["key1"]["highest"] == 1 and rows["key1"]["message"] == "broken d"
    assert rows["key2"]["message"] == "_(null)_"


def test_carriage_return_is_an_ordinary_sign(spark):
    s = Search(tag="t", critical=["a.b$"])
    assert classify.classify(frame(spark, ["a\rb", "a\u0085b"]), [s]).count() == 2


def test_bad_pattern_names_its_search(spark):
    with pytest.raises(ValueError, match="search t.*CRITICAL"):
        Search(tag="t", critical=["(open"]).check(spark)


def test_sticky_and_compact(spark):
    now = "2024-01-01 01:00:00"
    rows = lambda x: spark.createDataFrame(x, "tag string, host string, logfile string, level string, when string, message string").withColumn("when", F.to_timestamp("when"))
    old = rows([("t", "h", "l", "CRITICAL", "2024-01-01 00:59:50", "door"), ("t", "h", "l", "CRITICAL", "2024-01-01 00:59:30", "gone"), ("u", "h", "l", "WARNING", "2024-01-01 00:59:59", "wiped")])
    new = rows([("u", "h", "l", "WARNING", "2024-01-01 00:59:58", "before"), ("u", "h", "l", "WARNING", "2024-01-01 00:59:59", "after")])
    clear = spark.createDataFrame([("u", "h", "l", "2024-01-01 00:59:58")], "tag string, host string, logfile string, ok_when string").withColumn("ok_when", F.to_timestamp("ok_when"))
    kept = sticky.apply_sticky(new, old, clear, F.to_timestamp(F.lit(now)), 15)
    assert sorted(r["message"] for r in kept.collect()) == ["after", "door"]
    assert sticky.compact_sticky(kept).count() == 2


def test_service_texts(spark):
    rows = [("t", "CRITICAL", 0, i, 0, f"err{i}|") for i in range(3)] + [("t", "WARNING", 0, 9, 0, "warn")]
    m = spark.createDataFrame(rows, "tag string, level string, file_seq int, line_no long, pat_pos int, message string")
    r = report.service_result(m, report.preview(m, 2, ("file_seq", "line_no"))).first()
    assert (r["level"], r["code"], r["text"]) == ("CRITICAL", 2, "CRITICAL - (3 errors, 1 warnings) - err2//, err1// ...")
    r = report.service_result(m.limit(0), report.preview(m.limit(0), 2, ("file_seq", "line_no"))).first()
    assert (r["code"], r["text"]) == (0, "OK - no errors or warnings")


def test_configuration():
    a, b = Search(tag="a", critical=["1"]), Search(tag="b")
    newer = replace(a, critical=["2"])
    assert merge_searches([[a, b], [newer]]) == [newer, b]
    assert [s.tag for s in select_searches([Search(tag="disk"), Search(tag="disk_2"), Search(tag="x")], ["disk.*"])] == ["disk", "disk_2"]
    assert [s.tag for s in select_searches([Search(tag="disk"), Search(tag="disk_2")], ["disk"])] == ["disk"]
    assert [s.tag for s in expand_templates([Search(tag="n", template=True), b], ["h1", "h2"])] == ["n_h1", "n_h2", "b"]
    assert [s.tag for s in expand_templates([Search(tag="n", template=True)], [])] == []
    assert (seconds("5m"), seconds(90), seconds("2h"), seconds("1d")) == (300, 90, 7200, 86400)
    assert resolve("a $X$ $Y$", {"X": "1.2-3/4"}, in_pattern=True) == r"a 1\.2\-3\/4 $Y$"
