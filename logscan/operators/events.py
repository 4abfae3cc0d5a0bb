"""Structured event records: time windows, include and exclude filters, severity by type, rendering."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logscan.model import TEN_YEARS, seconds
from logscan.tables import broadcast_if_small, written


# The seconds that a first run looks back, for events, and for reports and alert tables.
LOOKBACK = {"event": 600, "report": 300}


def since(last, now, lookback: str | int | None = None, read_all: bool = False, kind: str = "event") -> Column:
    """Where the window of a run at now begins: lookback (`90s`, `5m`, `2h`, `1d`) before now, if given; else at the last run; in a first run (last is None) the kind's time before now, or ten years with read_all."""
    if lookback is None and last is not None:
        return F.lit(last).cast("timestamp")
    back = seconds(lookback) if lookback is not None else TEN_YEARS if read_all else LOOKBACK[kind]
    return F.lit(now).cast("timestamp") - F.make_dt_interval(secs=F.lit(back))


def event_window(events: DataFrame, last, now, ts: str = "ts") -> DataFrame:
    """last <= ts < now: a record is in one run only."""
    return events.filter((F.col(ts) >= F.lit(last)) & (F.col(ts) < F.lit(now)))


def whole_minutes(events: DataFrame, last, now, ts: str = "ts") -> DataFrame:
    """The same on whole minutes: the minute in progress is left for the next run."""
    floor = lambda t: F.date_trunc("minute", F.lit(t).cast("timestamp"))
    return events.filter((F.col(ts) >= floor(last)) & (F.col(ts) < floor(now)))


def drop_late(events: DataFrame, state: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """Events not before their key's last run (key, last_ts); keys without state lose none."""
    return events.join(state.select(key, "last_ts"), key, "left").filter(F.col("last_ts").isNull() | (F.col(ts) >= F.col("last_ts"))).drop("last_ts")


def of_hosts(events: DataFrame, hosts: DataFrame, key: str = "host") -> DataFrame:
    """Events of the hosts listed (key). A list of checked size goes to the events, a larger one meets them in a shuffle."""
    return events.join(broadcast_if_small(written(hosts.select(key).distinct())), key, "left_semi")


def units(events: DataFrame, last, now, names: list[str] | None = None, unit: str = "unit", ts: str = "ts") -> DataFrame:
    """Journal records from last on and before now, of the given units if any."""
    inside = event_window(events, last, now, ts)
    return inside.filter(F.col(unit).isin(names)) if names else inside


def event_lines(events: DataFrame, last, now, included: Column | None = None, excluded: Column | None = None, fmt: str = "%g %i %m", ts: str = "ts", key: tuple = ("tag", "host", "logfile")) -> DataFrame:
    """tag, host, logfile, file_seq, line_no, line of the events of a run: those in its window that are included and not excluded, rendered, in the order of time (line_no is in microseconds)."""
    kept = event_window(events, last, now, ts)
    kept = kept if included is None else kept.filter(included)
    kept = kept if excluded is None else kept.filter(~excluded)
    return kept.select(*key, F.lit(0).alias("file_seq"), F.unix_micros(ts).alias("line_no"), render_event(fmt).alias("line"))


def _tests(source: list | None, category: list | None, event_id: list | None, event_type: list | None) -> list[Column | None]:
    blind = lambda col, values: F.lower(col).isin([v.lower() for v in values]) if values else None
    return [blind("source", source), blind("category", category), F.col("event_id").bitwiseAND(0xFFFF).isin(list(event_id)) if event_id else None, blind("event_type", event_type)]


def include(source=None, category=None, event_id=None, event_type=None, op: str = "and") -> Column:
    """Whether a record passes: all given attributes (and), or any of the four, where one that is not given always passes (or)."""
    tests = _tests(source, category, event_id, event_type)
    out = None
    for t in tests:
        t = F.lit(True) if t is None else F.coalesce(t, F.lit(False))
        out = t if out is None else out & t if op == "and" else out | t
    return out


def exclude(source=None, category=None, event_id=None, event_type=None, op: str = "or") -> Column:
    """Whether a record is to go: any given attribute hits (or), or all four do (and)."""
    out = None
    for t in _tests(source, category, event_id, event_type):
        t = F.lit(False) if t is None else F.coalesce(t, F.lit(False))
        out = t if out is None else out | t if op == "or" else out & t
    return out


def level_from_type(kind: Column) -> Column:
    """CRITICAL or WARNING by the type of the event, else null."""
    k = F.lower(kind)
    return F.when(k.isin("error", "err", "crit", "alert", "emerg"), "CRITICAL").when(k.isin("warning", "warn"), "WARNING")


def render_event(fmt: str = "%g %i %m", names: dict[str, str] | None = None) -> Column:
    """A record as a line by a format of %t %c %C %s %i %m %<n>m %w %g %W %G %u; replaced in one pass, so texts are never expanded.

    names maps the fields (event_type, category, source, event_id, message, written, generated, user) to columns.
    """
    col = lambda n: F.col((names or {}).get(n, n))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    filled = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("None"))
    joined = lambda c: F.regexp_replace(F.trim(c), r"\s+", "_")
    message = lambda: F.coalesce(F.nullif(F.translate(F.rtrim(col("message")), "\n\r", " "), F.lit("")), F.lit("unknown message"))
    parts = []
    for text, n, letter in re.findall(r"([^%]+)|%(\d*)([a-zA-Z])", fmt):
        if text:
            parts.append(F.lit(text))
        elif letter == "m":
            parts.append(F.substring(message(), 1, int(n)) if n else message())
        else:
            parts.append(
                {
                    "t": lambda: col("event_type"),
                    "c": lambda: joined(filled(col("category"))),
                    "C": lambda: filled(col("category")),
                    "s": lambda: joined(col("source")),
                    "i": lambda: F.format_string("%04d", col("event_id").bitwiseAND(0xFFFF)),
                    "w": lambda: stamp(col("written")),
                    "g": lambda: stamp(col("generated")),
                    "W": lambda: F.unix_timestamp(col("written")).cast("string"),
                    "G": lambda: F.unix_timestamp(col("generated")).cast("string"),
                    "u": lambda: F.coalesce(F.nullif(col("user"), F.lit("")), F.lit("undef")),
                }[letter]()
            )
    return F.concat(*parts)
