"""Searches, rules and levels."""

from __future__ import annotations

import json
import re
import socket
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Levels, their codes, and how severe each is (not in the order of codes).
LEVELS = {"OK": 0, "WARNING": 1, "CRITICAL": 2, "UNKNOWN": 3}
SEVERITY = {"OK": 0, "UNKNOWN": 1, "WARNING": 2, "CRITICAL": 3}
#: The order in which the levels of a line are visited, and the levels whose patterns can be missed.
VISITED = ("CRITICAL", "WARNING", "UNKNOWN")
MISSED = ("CRITICAL", "WARNING")
KEY = ("tag", "host", "logfile")
ORD = ("file_seq", "line_no")

UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}
TEN_YEARS = 10 * 365 * 86400


def seconds(duration: str | int) -> int:
    """Seconds of `90`, `90s`, `5m`, `2h` or `1d`."""
    found = re.fullmatch(r"\s*(\d+)\s*([smhd]?)\s*", str(duration))
    if not found:
        raise ValueError(f"not a duration: {duration!r}")
    return int(found[1]) * UNITS[found[2] or "s"]


def _pairs(patterns: tuple | list | dict | str) -> list[tuple[str, str]]:
    """(key, pattern) of patterns in any of their forms."""
    given = [patterns] if isinstance(patterns, str) else patterns
    return list(given.items()) if isinstance(given, dict) else [p if isinstance(p, tuple) else ("unknown_pattern", p) for p in given]


@dataclass(frozen=True)
class Search:
    """A tag with its rules and options.

    Patterns are lists of patterns or of (key, pattern), or dicts from a key to a pattern; `!` in
    front of a pattern means that it must appear, for critical and warning; unknown ones are never missed. client: a pattern of the host that lines must
    name; server: a host, whose lines or those of localhost are taken. newest: the log is the newest of the files that
    rotation names. virtual: the file is read whole in each run. logfile_missing: the level of a
    missing log, `ok`, or `off` for none; unreadable: that of a file that is there and cannot be read. logfile is a
    name, with folders above it if these tell it from others; each folder's log is a source of its own. archives: a pattern of
    the folder of its archives, below the log's folder or whole; without it they are beside the log. encoding: the charset of its files. feed: the name of the records
    that it looks at instead of files (see sources.feeds). formats: FORMAT blocks, with format_levels from severities
    to codes. callback sees the matches of a run (see callbacks.with_state).
    """

    tag: str
    logfile: str | None = None
    critical: tuple | list | dict | str = ()
    warning: tuple | list | dict | str = ()
    unknown: tuple | list | dict | str = ()
    ok: tuple | list = ()
    exceptions: dict = field(default_factory=dict)
    need: tuple | list = ()
    skip: tuple | list = ()
    client: str | None = None
    server: str | None = None
    case: bool = True
    preferred_level: str | None = None
    threshold: dict = field(default_factory=dict)
    threshold_expiry: int | None = None
    sticky: int | None = None
    maxage: int | None = None
    read_all_first: bool = False
    maxlength: int | None = None
    count: bool = True
    perfdata: bool = True
    protocol: bool = True
    template: bool = False
    rotation: str | None = None
    host: str | None = None
    newest: bool = False
    virtual: bool = False
    logfile_missing: str = "unknown"
    save_threshold: bool = True
    archives: str | None = None
    unreadable: str = "critical"
    encoding: str | None = None
    feed: str | None = None
    formats: str | None = None
    format_levels: dict = field(default_factory=dict)
    callback: Callable | None = None
    callback_mode: str = "plain"

    def flags(self) -> str:
        """Line feeds alone end lines for the dot."""
        return "(?d)" if self.case else "(?di)"

    def needed(self) -> list[str]:
        """All patterns that a line must hold."""
        return [*self.need, *([self.client] if self.client else []), *([f"({re.escape(self.server)}|localhost)"] if self.server else [])]

    def rules(self, level: str) -> list[tuple[int, str, str]]:
        """(number, key, pattern) of a level, without those that must appear."""
        return [r for r in self._all(level) if not r[2].startswith("!")]

    def must_appear(self, level: str) -> list[tuple[int, str, str]]:
        return [(i, k, p[1:]) for i, k, p in self._all(level) if p.startswith("!")]

    def _all(self, level: str) -> list[tuple[int, str, str]]:
        pairs = _pairs(getattr(self, level.lower()))
        pairs = [(k, ".*" if p == "match_them_all" else p) for k, p in pairs if p != "match_never_ever"]
        return [(i, k, p) for i, (k, p) in enumerate(pairs)]

    def check(self, spark) -> None:
        """Compiles every pattern where it will run, so that a bad one fails here with its tag."""
        named = [(f"{level} pattern {key}", p) for level in VISITED for _, key, p in [*self.rules(level), *self.must_appear(level)]]
        named += [(f"{level} exception", p) for level, patterns in self.exceptions.items() for _, p in _pairs(patterns)]
        named += [(n, p) for n in ("ok", "need", "skip") for p in getattr(self, n)]
        named += [(n, getattr(self, n)) for n in ("client", "rotation", "archives") if getattr(self, n)]
        for what, p in named:
            try:
                spark._jvm.java.util.regex.Pattern.compile(self.flags() + p)
            except Exception as e:
                raise ValueError(f"search {self.tag}, {what} {p!r}: {e}") from None


def merge_searches(configs: list[list[Search]]) -> list[Search]:
    """Of searches with the same tag the one of the last config, at the place of the first."""
    merged: dict[str, Search] = {}
    for config in configs:
        for s in config:
            merged[s.tag] = s
    return list(merged.values())


def newest_configs(rows: DataFrame, tag: str = "tag", version: str = "version") -> DataFrame:
    """Of the rows of a table of configurations the one of each tag with the largest version: merging for configurations that are kept as a table."""
    newest = rows.groupBy(tag).agg(F.max_by(F.struct(*[c for c in rows.columns if c != tag]), version).alias("_r"))
    return newest.select(tag, "_r.*")


def with_rules(search: Search, rule_sets: list[dict]) -> Search:
    """The search with the patterns of rule sets (level to patterns, and `exceptions`: level to patterns) in front of its own, those of a later set before those of an earlier one."""
    for rules in rule_sets:
        unknown = set(rules) - {"critical", "warning", "unknown", "ok", "exceptions"}
        if unknown:
            raise ValueError(f"search {search.tag}: a rule set has {sorted(unknown)}")
        both = {level: [*_pairs(rules[level]), *_pairs(getattr(search, level))] for level in ("critical", "warning", "unknown") if level in rules}
        if "ok" in rules:
            both["ok"] = [*(p for _, p in _pairs(rules["ok"])), *search.ok]
        more = {level: [p for _, p in _pairs(ps)] for level, ps in rules.get("exceptions", {}).items()}
        search = replace(search, **both, exceptions={level: [*more.get(level, ()), *search.exceptions.get(level, ())] for level in {**more, **search.exceptions}})
    return search


def read_rules(spark: SparkSession, paths: list[str]) -> list[dict]:
    """Rule sets from JSON files, one of each, in the order of paths."""
    return [json.loads("\n".join(r["value"] for r in spark.read.text(p, wholetext=True).collect())) for p in paths]


def select_searches(searches: list[Search], names: list[str]) -> list[Search]:
    """Searches named, or matched by a name that holds * or ? as a regular expression."""

    def wanted(tag: str) -> bool:
        return any(re.search(n, tag) if re.search(r"[*?]", n) else n == tag for n in names)

    return [s for s in searches if wanted(s.tag)]


def expand_templates(searches: list[Search], tags: list[str]) -> list[Search]:
    """Templates once for each tag, named template_tag, bound to that host and with $CL_TAG$, $CL_tag$ and $CL_TEMPLATE$ replaced; without tags they are left out."""
    out = []
    for s in searches:
        out += [resolved(replace(s, tag=f"{s.tag}_{t}", need=[*s.need, re.escape(t)], template=False), {"CL_TAG": t, "CL_tag": t.lower(), "CL_TEMPLATE": s.tag}) for t in tags] if s.template else [s]
    return out


def macros(run_ts: datetime, host: str = "", **own: str) -> dict[str, str]:
    """The built-in macros at a time, with the parts of a host's full name if one is given, and the caller's."""
    name, _, domain = host.partition(".")
    names = {"CL_HOSTNAME": name, "CL_DOMAIN": domain or "localdomain", "CL_FQDN": f"{name}.{domain or 'localdomain'}"} if host else {}
    parts = {"YYYY": "%Y", "YY": "%y", "MM": "%m", "DD": "%d", "HH": "%H", "MI": "%M", "SS": "%S", "CW": "%V"}
    return {f"CL_DATE_{k}": run_ts.strftime(v) for k, v in parts.items()} | {"CL_DATE_TIMESTAMP": f"{int(run_ts.timestamp()):10d}"} | names | own


def address(name: str) -> str:
    """The address of a host, that of this one itself if none is known."""
    try:
        return socket.gethostbyname(name)
    except OSError:
        return "127.0.0.1"


def resolve(text: str, values: dict[str, str], in_pattern: bool = False) -> str:
    """$NAME$ replaced by its value; in patterns its / - and . are escaped."""
    quote = (lambda v: re.sub(r"([/.\-])", r"\\\1", v)) if in_pattern else (lambda v: v)
    return re.sub(r"\$(\w+)\$", lambda m: quote(values[m[1]]) if m[1] in values else m[0], text)


def resolved(search: Search, values: dict[str, str]) -> Search:
    """The search with the macros in its log's name, its rotation, its server and its patterns replaced; $CL_TAG$, $CL_tag$ and $CL_LOGFILE$ are its own."""
    values = {"CL_TAG": search.tag, "CL_tag": search.tag.lower()} | values
    named = {n: resolve(getattr(search, n), values) for n in ("logfile", "rotation", "server") if getattr(search, n)}
    values = {"CL_LOGFILE": named.get("logfile", "")} | values if "logfile" in named else values
    inside = lambda p: resolve(p, values, in_pattern=True)
    rules = {level: [(k, inside(p)) for k, p in _pairs(getattr(search, level))] for level in ("critical", "warning", "unknown")}
    plain = {n: [inside(p) for p in getattr(search, n)] for n in ("ok", "need", "skip")}
    client = inside(search.client) if search.client else None
    return replace(search, **named, **rules, **plain, client=client, exceptions={level: [inside(p) for _, p in _pairs(ps)] for level, ps in search.exceptions.items()})
