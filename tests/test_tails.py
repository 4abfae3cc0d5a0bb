"""Logs that have grown are read on at their saved offsets."""

from __future__ import annotations

import io
import os
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logscan.jobs import scan, sinks
from logscan.model import Search
from logscan.sources import lines, tails

ENCODINGS = ("utf-8", "UTF-16LE", "UTF-16BE")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("aखਊ\n\r ", max_size=6), max_size=12), st.lists(st.integers(0, 120), max_size=5), st.sampled_from(ENCODINGS), st.integers(0, 3))
def test_every_line_is_read_in_one_part(texts, cuts, encoding, missing):
    data, feed = "\n".join(texts).encode(encoding), "\n".encode(encoding)
    end, w = max(len(data) - missing, 0), len(feed)
    want, at = [], 0
    for line in data[:end].decode(encoding, "surrogateescape" if encoding == "utf-8" else "ignore").split("\n"):
        size = len(line.encode(encoding, "surrogateescape" if encoding == "utf-8" else "strict"))
        want.append(at)
        at += size + w
    want = [x for x in want if x < end]
    edges = sorted({0, end, *(c // w * w for c in cuts if c < end)})
    got = [x for a, b in zip(edges, edges[1:], strict=False) for x in tails.lines_from(io.BytesIO(data), a, b, end, feed)]
    assert [x for x, _ in got] == want
    assert feed.join(x for _, x in got) == data[:end] or feed.join([*(x for _, x in got), b""]) == data[:end]


def test_lines_longer_than_what_is_read_at_once():
    data = b"x" * (3 * tails.CHUNK) + b"\n" + b"y" * tails.FIRST + b"\nz"
    assert [(a, len(b)) for a, b in tails.lines_from(io.BytesIO(data), 0, len(data), len(data), b"\n")] == [(0, 3 * tails.CHUNK), (3 * tails.CHUNK + 1, tails.FIRST), (len(data) - 1, 1)]
    assert [a for a, _ in tails.lines_from(io.BytesIO(data), 5, len(data), len(data), b"\n")] == [3 * tails.CHUNK + 1, len(data) - 1]


@pytest.fixture
def go(spark, tmp_path, monkeypatch):
    """Appends to logs, runs, and tells what is reported, the lines counted, and whether a log was read whole."""
    whole = []
    measure = lines.measure
    monkeypatch.setattr(lines, "measure", lambda s, paths, *a, **k: whole.extend(paths) or measure(s, paths, *a, **k))

    def run(second, searches, written, mode="ab"):
        for name, data in written.items():
            path = tmp_path / "logs" / name
            path.parent.mkdir(parents=True, exist_ok=True)
            with path.open(mode) as f:
                f.write(data)
            os.utime(path, (1_700_000_000 + second,) * 2)
        whole.clear()
        out = scan.run(spark, searches, [str(tmp_path / "logs")], str(tmp_path / "state"), datetime.fromtimestamp(1_700_000_000 + second))
        found = sorted((r["tag"], r["message"], r["line_no"]) for r in out.matches.collect())
        return found, {r["tag"]: r["lines"] for r in out.counters.collect()}, sorted(os.path.basename(p) for p in whole)

    return run


def test_a_grown_log_is_not_read_whole(spark, tmp_path, go):
    a = Search(tag="a", logfile="a log", critical=["hit"], read_all_first=True)
    late = Search(tag="late", logfile="a log", critical=["hit"], read_all_first=True)
    wide = Search(tag="wide", logfile="wide", critical=["hit"], read_all_first=True, encoding="UTF-16LE")
    u16 = lambda t: t.encode("UTF-16LE")
    assert go(1, [a, wide], {"a log": b"first\nhit 1\nlast", "wide": u16("first\nhit 1\n")})[0] == [("a", "hit 1", 1), ("wide", "hit 1", 1)]
    # what goes on in the line that was read last is no line of its own, as before
    found, count, whole = go(2, [a, wide], {"a log": b" hit 2\r\nhit 3\n\nhit 4", "wide": u16("ਊ hit 2\n")})
    assert (found, count, whole) == ([("a", "hit 3", 3), ("a", "hit 4", 5), ("wide", "? hit 2", 2)], {"a": 3, "wide": 1}, [])
    # a search that is new reads the whole log, the other its tail
    found, count, whole = go(3, [a, late], {"a log": b"\nhit 5\n"})
    assert found == [("a", "hit 5", 6), *[("late", f"hit {n}", line) for n, line in ((1, 1), (3, 3), (4, 5), (5, 6))], ("late", "last hit 2\r", 2)]
    assert whole == ["a log"]
    found, count, whole = go(4, [a, late], {"a log": b"hit 6\n"})
    assert (found, count, whole) == ([("a", "hit 6", 7), ("late", "hit 6", 7)], {"a": 1, "late": 1}, [])
    assert {(r["tag"], r["loglines"], r["logoffset"]) for r in sinks.load_state(spark, str(tmp_path / "state")).filter("tag <> 'wide'").collect()} == {("a", 8, 49), ("late", 8, 49)}
    # another first line: another log
    found, count, whole = go(5, [a], {"a log": b"other\n" + b"hit 7\n" * 20}, "wb")
    assert (len(found), count, whole) == (20, {"a": 21}, ["a log"])


def test_a_tail_is_read_in_parts(spark, tmp_path):
    path, head = tmp_path / "log", b"head\n" * 7
    body = [b"%d " % n + b"x" * (n % 50) for n in range(2000)]
    path.write_bytes(head + b"\n".join(body))
    end = path.stat().st_size
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        parts = tails.measure(spark, [(str(path), len(head), end)])
        rows = tails.read_tails(spark, [(str(path), len(head), end, 7)], parts).orderBy("line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert parts.filter("begin > 0").count() > 10
    assert [(r["line_no"], r["line"].encode()) for r in rows] == list(enumerate(body, 7))
    data = path.read_bytes()
    assert all(data[r["start_offset"] :].startswith(r["line"].encode()) and data[r["start_offset"] - 1 : r["start_offset"]] == b"\n" for r in rows)
    assert all(r["file_path"] == f"tail:{path}" for r in rows)


def test_a_log_that_cannot_be_read_any_more(tmp_path, spark):
    path = tmp_path / "log"
    path.write_bytes(b"a\nb\n")
    found = tails.measure(spark, [(str(path), 2, 4), (str(tmp_path / "gone"), 2, 4)])
    assert sorted((r["path"], r["begin"], r["rows"], r["fingerprint"] is None) for r in found.collect()) == [(str(path), 0, 1, False), (str(path), 2, 1, True)]
