"""One incremental run: list, measure, select, read, classify, reduce, write, then save the state.

The text is read twice: once to measure it (sizes, line counts, fingerprints: sums of each
split), and, of files with something new, once for all searches together; of a log that has only
grown, what has come since the last run alone. What the lines
have for the searches is written as a table of events, and all that follows works on that.
"""

from __future__ import annotations

import getpass
import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logscan.jobs import sinks
from logscan.model import KEY, LEVELS, ORD, TEN_YEARS, Search, address, macros, resolved
from logscan.operators import callbacks, classify, formats, report, sticky, thresholds
from logscan.sources import feeds as feeds_of_run
from logscan.sources import incremental, lines
from logscan.sources import tails as ends_of_logs
from logscan.sources.feeds import Feed
from logscan.tables import BROADCAST_ROWS, broadcast_if_small, written

STATE = "tag string, host string, logfile string, logoffset long, loglines long, logtime timestamp, fingerprint string, threshold map<string,long>, threshold_times map<string,array<timestamp>>, sticky array<struct<level:string,when:timestamp,message:string>>, private map<string,string>, tail array<string>, cursor map<string,string>, runcount long, runtime timestamp"

FILES = "tag string, host string, logfile string, path string, mtime timestamp, length long, name string, current boolean, pattern string"
CHOSEN = "tag string, host string, logfile string, path string, file_path string, encoding string, mtime timestamp, current boolean, file_seq int, end long, rows long, fingerprint string, start long, seen long"

#: Where alerts stand that no line has made: at the end.
END = (1 << 31) - 1
ALERT = "tag string, host string, logfile string, level string, pat_idx int, pat_key string, pattern string, file_seq long, line_no long, pat_pos int, message string"
COLUMNS = [c.split()[0] for c in ALERT.split(", ")]


def alert(spark: SparkSession, tag: str, level: str, message: str, host: str = "localhost") -> DataFrame:
    """A match that no line has made."""
    return spark.createDataFrame([(tag, host, "", level, 0, "alert", "", END, END, 0, message)], ALERT)


def _alerts(found: DataFrame, what: str) -> DataFrame:
    """Rows (key, level, message, and maybe pat_idx and pattern) as matches at the end."""
    given = {"pat_idx": F.lit(0), "pattern": F.lit(""), "pat_pos": F.lit(0)} | {c: F.col(c) for c in ("pat_idx", "pattern") if c in found.columns}
    fixed = {"pat_key": F.lit(what), "file_seq": F.lit(END), "line_no": F.lit(END)}
    return found.withColumns({**given, **fixed}).select(*[F.col(n).cast(t).alias(n) for n, t in (c.split() for c in ALERT.split(", "))])


def _called(call: Callable, what: str, *args) -> tuple[str, str]:
    """The level and text of a user's function; a failure is a warning."""
    try:
        return call(*args) or ("OK", "")
    except Exception as e:  # the user's code, whatever it does
        return "WARNING", f"cannot execute {what}: {e}"


@dataclass
class Run:
    matches: DataFrame
    counters: DataFrame
    result: DataFrame
    state: DataFrame


@dataclass
class Scanned:
    """What the lines of a run give: matches to report, the thresholds' carry (key, level, carry, threshold_times), the last all-clear line (key, ok_at), and the lines that formats over several lines look back at in the next run (key, tail)."""

    matches: DataFrame
    carry: DataFrame | None
    clear: DataFrame
    tails: DataFrame | None = None


def _several_lines(read: DataFrame, searches: list[Search], tails: DataFrame | None) -> tuple[list[DataFrame], DataFrame | None]:
    """The events of searches with formats over several lines, which look at the lines before a line that passed the prefilter, and the tails of their logs."""
    out, after = [], None
    for s in searches:
        own = read.filter((F.col("tag") == s.tag) & classify.accepted(F.col("line"), s)).select(*KEY, *ORD, "line")
        before = None if tails is None else tails.filter(F.col("tag") == s.tag)
        rows, tail = formats.with_before(own, classify.lines_before(s), ORD, KEY, before)
        out.append(classify.line_events(rows, [s]))
        after = tail if after is None else after.unionByName(tail)
    return out, after


def line_events(read: DataFrame, searches: list[Search], tails: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """What lines have for their searches, written (see classify.line_events), and the tails of logs with formats over several lines."""
    wide = [s for s in searches if classify.lines_before(s)]
    several, after = _several_lines(read, wide, tails)
    plain = [s for s in searches if s not in wide]
    parts = [*([classify.line_events(read, plain)] if plain or not several else []), *several]
    return written(reduce(DataFrame.unionByName, parts)), after


def scan_all(read: DataFrame, searches: list[Search], carry: DataFrame | None = None, keys: DataFrame | None = None, now: datetime | None = None, tails: DataFrame | None = None, events: DataFrame | None = None) -> Scanned:
    """What the lines (tag, host, logfile, file_seq, line_no, line) give for the searches of their tags.

    Effects on a line come in this order: prefilter, exceptions, patterns, preferred level,
    all-clear, threshold; must-appear patterns are judged over all lines, and with keys for these
    sources, lines or not. With now the carry has threshold_times, for searches whose hits expire. Formats
    are one list of a line, those over several lines too, which look at tails for what was read before.

    The lines are read once for all searches (but once more for each with formats over several lines, and for
    must-appear patterns without keys, which ask for the sources of the lines), and not at all if their events are given.
    """
    after_tails = None
    if events is None:
        events, after_tails = line_events(read, searches, tails)
    kind = F.col("kind")
    clear = events.filter(kind == classify.CLEARED).groupBy(*KEY).agg(F.max(F.struct("file_seq", "line_no")).alias("ok_at"))
    found = events.filter(kind == classify.MATCHED)
    if any(s.ok for s in searches):
        clear = written(clear)
        found = classify.wipe(found, broadcast_if_small(clear))
    after = None
    if any(n > 1 for s in searches for n in s.threshold.values()):
        found = thresholds.with_every(found, searches)
        counted, every, before = found.filter("every > 1"), F.col("every"), None
        if carry is not None:
            before = thresholds.with_every(carry, searches).filter("every > 1").drop("every").join(clear, list(KEY), "left_anti")
        after = thresholds.next_carry(counted, searches, before, now=now)
        if now is not None:
            expiring = F.col("tag").isin([s.tag for s in searches if s.threshold_expiry])
            after = after.withColumn("threshold_times", F.when(expiring, F.col("threshold_times")))
        rows = thresholds.apply_threshold(counted.withColumn("_run", thresholds.run_of_lines()), every, before, hot="_run").drop("_run")
        found = found.filter("every = 1").unionByName(rows)
    matches = found.select(*[F.col(n).cast(t).alias(n) for n, t in (c.split() for c in ALERT.split(", "))])
    missing = classify.missing_events(events, searches, read.select(*KEY).distinct() if keys is None else keys)
    if missing is not None:
        matches = matches.unionByName(_alerts(missing, "missing").withColumn("pat_pos", F.col("pat_idx")))
    return Scanned(matches, after, clear, after_tails)


def scan_lines(read: DataFrame, searches: list[Search], carry: DataFrame | None = None, keys: DataFrame | None = None, now: datetime | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The matches and the carry of scan_all."""
    out = scan_all(read, searches, carry, keys, now)
    return out.matches, out.carry


def _by(searches: list[Search], value: Callable[[Search], object]) -> dict:
    """Tags by a value of their searches, for those that have it."""
    out: dict = {}
    for s in searches:
        if value(s):
            out.setdefault(value(s), []).append(s.tag)
    return out


def _carried(state: DataFrame, searches: list[Search], now: datetime) -> DataFrame:
    """key, level, carry, threshold_times of a state; of searches whose hits expire without those that are too old, and none of searches that do not save them."""
    unsaved = [s.tag for s in searches if not s.save_threshold]
    old = state.filter(~F.col("tag").isin(unsaved)).select(*KEY, "threshold_times", "runtime", F.explode("threshold").alias("level", "carry"))
    times = F.coalesce(F.col("threshold_times")[F.col("level")], F.array_repeat("runtime", F.col("carry").cast("int")))
    old = old.select(*KEY, "level", "carry", times.alias("threshold_times"))
    expiring = _by(searches, lambda s: s.threshold_expiry)
    parts = [old.filter(~F.col("tag").isin([t for tags in expiring.values() for t in tags]))]
    for expiry, tags in expiring.items():
        live = thresholds.live_times(old.filter(F.col("tag").isin(tags)), now, expiry)
        parts.append(live.withColumn("carry", F.size("threshold_times").cast("long")))
    return reduce(DataFrame.unionByName, parts)


def _standing(matches: DataFrame, state: DataFrame, clear: DataFrame, searches: list[Search], now: datetime) -> DataFrame:
    """The matches that stand after this run with when, for searches with sticky alerts: those of this run and, before them, those kept."""
    at = F.lit(now).cast("timestamp")
    kept = state.select(*KEY, F.posexplode("sticky").alias("nth", "m"))
    kept = kept.select(*KEY, "m.level", F.lit(0).alias("pat_idx"), F.lit("sticky").alias("pat_key"), F.lit("").alias("pattern"), F.lit(-1).cast("long").alias("file_seq"), F.col("nth").cast("long").alias("line_no"), F.lit(0).alias("pat_pos"), "m.message", "m.when")
    clear = clear.select(*KEY, F.timestamp_seconds(F.lit(0)).alias("ok_when"))  # this run's matches before the line are wiped already
    parts = []
    for seconds, tags in _by(searches, lambda s: s.sticky and (s.sticky if s.sticky > 1 else TEN_YEARS)).items():
        own = F.col("tag").isin(tags)
        parts.append(sticky.apply_sticky(matches.filter(own).withColumn("when", at), kept.filter(own), clear.filter(own), now, seconds, also=("pat_idx", "pat_key", "pattern", "file_seq", "line_no", "pat_pos")))
    return reduce(DataFrame.unionByName, parts)


def _called_back(matches: DataFrame, state: DataFrame, searches: list[Search]) -> tuple[DataFrame, DataFrame]:
    """The matches after the callbacks of their searches have seen them, and the callbacks' state (key, private).

    A callback sees a match with its pattern (pat_idx, pat_key, pattern), what the groups of that hold (captures), and
    the time and the number of its source's last run (lastruntime, runcount).
    """
    last = state.select(*KEY, F.col("runtime").alias("lastruntime"), "runcount")
    out = matches.filter(~F.col("tag").isin([s.tag for s in searches]))
    states = state.filter("private is not null").select(*KEY, "private")
    kept = states.filter(~F.col("tag").isin([s.tag for s in searches]))
    for s in searches:
        own = F.col("tag") == s.tag
        told = classify.row_captures(matches.filter(own), s).join(last, list(KEY), "left")
        seen = written(callbacks.with_state(told, s.callback, s.callback_mode, states.filter(own), also=("pat_idx", "pat_key", "pattern", "captures", "lastruntime", "runcount")))
        rows = seen.filter("origin <> 'state'")
        if s.callback_mode == "plain":
            rows = rows.filter("origin = 'failure'")
            out = out.unionByName(matches.filter(own))
        out = out.unionByName(rows.select(*KEY, "level", F.lit(0).alias("pat_idx"), F.col("origin").alias("pat_key"), F.lit("").alias("pattern"), "file_seq", "line_no", "pat_pos", "message"))
        new = seen.filter("origin = 'state'").select(*KEY, "private")
        kept = kept.unionByName(new).unionByName(states.filter(own).join(new, list(KEY), "left_anti"))
    return out, kept


def _late(searches: list[Search], state: DataFrame | None, values: dict[str, str]) -> tuple[dict[str, str], dict[str, dict[str, str]]]:
    """values with the host's address and the user, and by tag the macros of a search's last run, each only where it is asked for."""
    asked = {s.tag: repr(s) for s in searches}
    uses = lambda name: any(f"${name}$" in text for text in asked.values())
    if uses("CL_IPADDRESS"):
        values = {"CL_IPADDRESS": address(values.get("CL_FQDN", ""))} | values
    if uses("CL_USERNAME"):
        values = {"CL_USERNAME": getpass.getuser()} | values
    own: dict[str, dict[str, str]] = {s.tag: {} for s in searches}
    if uses("CL_LAST_RUNTIME") or uses("CL_RUN_COUNT"):
        own = {s.tag: {"CL_LAST_RUNTIME": "0", "CL_RUN_COUNT": "0"} for s in searches}
        if state is not None:  # a row for each search
            for r in state.filter(F.col("tag").isin(list(own))).groupBy("tag").agg(F.max(F.unix_timestamp("runtime")).alias("t"), F.max("runcount").alias("n")).collect():
                own[r["tag"]] = {"CL_LAST_RUNTIME": str(r["t"] or 0), "CL_RUN_COUNT": str(r["n"] or 0)}
    return values, own


def _options(spark: SparkSession, searches: list[Search]) -> DataFrame:
    """What reading files depends on, a row for each search."""
    rows = [(s.tag, bool(s.rotation), s.read_all_first, s.virtual, s.encoding or "") for s in searches]
    out = spark.createDataFrame(rows, "tag string, rotating boolean, read_all boolean, virtual boolean, encoding string")
    return F.broadcast(out) if len(rows) <= BROADCAST_ROWS else out


@dataclass
class Tails:
    """Logs of one encoding that have only grown: files (path, begin, end, lines before begin) and the measured parts of their tails."""

    files: list[tuple[str, int, int, int]]
    parts: DataFrame


def _grown(spark: SparkSession, marked: DataFrame) -> dict[str, Tails]:
    """The logs of marked that are read on at their offsets, by encoding: those without a new archive, longer than before, whose first line is the saved one.

    A log of several searches is read from the first of their offsets on, and whole if their states do not agree on its first line.
    """
    asked: dict[str, dict[str, list]] = {}
    saved = marked.filter(ends_of_logs.grown()).select("path", "encoding", "logoffset", "loglines", "length", "_print").distinct()
    for r in saved.collect():  # file names, as above
        asked.setdefault(r["encoding"], {}).setdefault(r["path"], []).append(r)
    found = {}
    for e, own in sorted(asked.items()):
        wide = lines.width(e or None)
        files = {}
        for path, rows in own.items():
            first = min(rows, key=lambda r: r["logoffset"])
            if not first["logoffset"] % wide and len({r["_print"] for r in rows}) == 1:
                files[path] = (first["logoffset"], first["length"], first["loglines"], first["_print"])
        if files:
            parts = ends_of_logs.measure(spark, [(p, begin, end) for p, (begin, end, _, _) in sorted(files.items())], e or None)
            now = {r["path"]: r["fingerprint"] for r in parts.filter("begin = 0").select("path", "fingerprint").collect()}  # a row a file
            same = [(p, begin, end, seen) for p, (begin, end, seen, known) in sorted(files.items()) if now.get(p) == known]
            if same:
                found[e] = Tails(same, parts)
    return found


def _grown_rows(spark: SparkSession, marked: DataFrame, tails: dict[str, Tails]) -> DataFrame:
    """The rows of marked whose logs are tails, with until and rows of their files."""
    files = spark.createDataFrame([(p, e, end, seen) for e, t in tails.items() for p, _, end, seen in t.files], "path string, encoding string, until long, before long")
    counted = reduce(DataFrame.unionByName, [t.parts.filter("begin > 0").groupBy("path").agg(F.sum("rows").alias("_new")).withColumn("encoding", F.lit(e)) for e, t in tails.items()])
    files = files.join(counted, ["path", "encoding"], "left").withColumn("rows", F.col("before") + F.coalesce("_new", F.lit(0)))
    return marked.filter(ends_of_logs.grown()).join(files, ["path", "encoding"])


def _chosen(spark: SparkSession, files: DataFrame, state: DataFrame, searches: list[Search]) -> tuple[DataFrame, dict[str, DataFrame], dict[str, Tails], DataFrame | None]:
    """The files of this run (key, path, file_path, encoding, mtime, current, file_seq, end, rows, fingerprint, start, seen), written, the splits of their text and the tails by encoding, and the sources' files (key, path) that cannot be read.

    A log with the time and the size of the last run, and no archive beside it, is not read at all; of one that has
    grown and has no archive beside it only the first line and its tail are.
    """
    options = _options(spark, searches)
    saved = state.select(*KEY, "logoffset", "logtime", F.col("fingerprint").alias("_print"), "loglines")
    alone = F.count(F.lit(1)).over(Window.partitionBy(*KEY)) == 1  # over the files of a log
    unchanged = F.col("current") & ~F.col("virtual") & alone & (F.col("mtime") == F.col("logtime")) & (F.col("length") == F.col("logoffset")) & F.col("loglines").isNotNull()
    relevant = incremental.relevant_files(files, state).select(*KEY, "path", "mtime", "current", "file_seq", "length")
    marked = written(relevant.join(options, "tag").join(saved, list(KEY), "left").withColumns({"alone": alone, "idle": F.coalesce(unchanged, F.lit(False))}))
    columns = [*KEY, "path", "file_path", "encoding", "mtime", "current", "file_seq", "end", "rows", "fingerprint", "start", "seen"]
    idle = marked.filter("idle").select(*KEY, "path", F.lit("").alias("file_path"), "encoding", "mtime", "current", "file_seq", F.col("length").alias("end"), F.col("loglines").alias("rows"), F.col("_print").alias("fingerprint"), F.col("length").alias("start"), F.col("loglines").alias("seen"))
    busy = marked.filter("not idle").select(*KEY, "path", "mtime", "current", "encoding")
    tails, longer = _grown(spark, marked.filter("not idle")), None
    if tails:
        longer = _grown_rows(spark, marked.filter("not idle"), tails)
        busy = written(busy.join(longer.select(*KEY, "path"), [*KEY, "path"], "left_anti"))
        idle = idle.unionByName(longer.select(*KEY, "path", F.concat(F.lit(ends_of_logs.MARK), "path").alias("file_path"), "encoding", "mtime", "current", "file_seq", F.col("until").alias("end"), "rows", F.col("_print").alias("fingerprint"), F.col("logoffset").alias("start"), F.col("loglines").alias("seen")))
    names: dict[str, list[str]] = {}
    for r in busy.select("path", "encoding").distinct().collect():  # file names: Spark's own listing is on the driver too
        names.setdefault(r["encoding"], []).append(r["path"])
    splits, measured, broken = {}, [], []
    for encoding, own in sorted(names.items()):
        found, bad = lines.measure_each(spark, sorted(own), encoding or None)
        broken += [(b, encoding) for b in bad]
        if found is not None:
            splits[encoding] = found
            measured.append(lines.measured_files(found).withColumn("_encoding", F.lit(encoding)))
    if not names:
        return (idle if longer is None else written(idle)), splits, tails, None
    bad = None
    if broken:
        given = spark.createDataFrame(broken, "path string, encoding string")
        bad = written(busy.join(given, ["path", "encoding"]).select(*KEY, "path"))
        busy = busy.join(given, ["path", "encoding"], "left_anti")
    told = reduce(DataFrame.unionByName, measured) if measured else spark.createDataFrame([], "file_path string, rows long, end long, fingerprint string, content string, _encoding string")
    named = busy.join(told, (lines.metadata_path("file_path") == lines.plain_path("path")) & (F.col("encoding") == F.col("_encoding")), "left").withColumns({"end": F.coalesce("end", F.lit(0)), "rows": F.coalesce("rows", F.lit(0))})
    # copies by their whole content; of a log and its copy the log stays
    newest = F.when(F.col("current"), F.lit("9999-01-01").cast("timestamp")).otherwise(F.col("mtime"))
    copies = named.select(*KEY, "path", "file_path", F.col("mtime").alias("_mtime"), newest.alias("mtime"), "current", F.col("fingerprint").alias("_print"), F.coalesce("content", "path").alias("fingerprint"), F.col("end").alias("length"), "rows")
    once = incremental.dedupe_files(copies).withColumns({"mtime": F.col("_mtime"), "fingerprint": F.col("_print")})
    chosen = incremental.relevant_files(once, state).select(*KEY, "path", "file_path", "mtime", "current", "file_seq", F.col("length").alias("end"), "rows", "fingerprint")
    chosen = incremental.starts(chosen.join(options, "tag"), state).select(*columns)
    return written(chosen.unionByName(idle)), splits, tails, bad


def _fresh_events(spark: SparkSession, chosen: DataFrame, splits: dict[str, DataFrame], grown: dict[str, Tails], searches: list[Search], tails: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """What the new lines of the files have for their searches, and the last lines of their logs."""
    fresh = chosen.filter("start < end").select(*KEY, "file_path", "encoding", "file_seq", "start")  # of a written table
    names: dict[str, list[str]] = {}
    for r in fresh.filter(~F.col("file_path").startswith(ends_of_logs.MARK)).select("file_path", "encoding").distinct().collect():
        names.setdefault(r["encoding"], []).append(r["file_path"])
    if not names and not grown:
        return line_events(spark.createDataFrame([], "tag string, host string, logfile string, file_seq int, line_no long, line string"), searches[:1], None)
    texts = [lines.read_lines(spark, sorted(unquote(n) for n in own), splits=splits[e], encoding=e or None).drop("host", "logfile", "file_mtime", "end_offset").withColumn("encoding", F.lit(e)) for e, own in sorted(names.items())]
    texts += [ends_of_logs.read_tails(spark, t.files, t.parts, e or None).withColumn("encoding", F.lit(e)) for e, t in grown.items()]
    text = reduce(DataFrame.unionByName, texts)
    by_file = ["file_path", "encoding"]
    own_lines = lambda fresh: text.join(broadcast_if_small(fresh, size=64 << 20), by_file).filter("start_offset >= start")
    plain = [s for s in searches if not s.formats]
    if not classify.many(plain):
        return line_events(own_lines(fresh), searches, tails)
    # a line goes once to all searches that look at its file; only what is found goes to their sources
    sets = written(fresh.filter(F.col("tag").isin([s.tag for s in plain])).groupBy(*by_file).agg(F.sort_array(F.collect_set("tag")).alias("tags")).withColumn("_set", F.xxhash64("tags")))
    place = {s.tag: n for n, s in enumerate(plain)}
    looking = {r["_set"]: [place[t] for t in r["tags"]] for r in sets.select("_set", "tags").distinct().collect()}  # sets of searches: configuration
    at = text.join(broadcast_if_small(sets.drop("tags"), size=64 << 20), by_file)
    found = classify.rule_events(at, plain, "_set", looking)
    mine = found.join(broadcast_if_small(fresh, size=64 << 20), [*by_file, "tag"]).filter("start_offset >= start")
    parts, after = [mine.select(*KEY, *ORD, "kind", "level", "pat_idx", "pat_key", "pattern", "pat_pos", "message")], None
    rest = [s for s in searches if s.formats]
    if rest:
        more, after = line_events(own_lines(fresh.filter(F.col("tag").isin([s.tag for s in rest]))), rest, tails)
        parts.append(more)
    return written(reduce(DataFrame.unionByName, parts)), after


def _shown(paths: list[str]) -> Column:
    """How a log is named: its path below the folder that was looked into."""
    roots = sorted((re.sub("^file:/+", "/", p).rstrip("/") for p in paths), key=len, reverse=True)
    return F.regexp_replace("logfile", "^(?:" + "|".join(f"\\Q{r}\\E" for r in roots) + ")/", "")


def _hosts(files: DataFrame, layout: str | None, host: str) -> DataFrame:
    """files with host: the part of its path where layout has {host}; * in it is any name."""
    if not layout:
        return files
    parts = re.split(r"(\{host\}|\*)", re.sub("^file:/+", "/", layout))
    pattern = "".join({"{host}": "([^/]+)", "*": "[^/]*"}.get(p, re.escape(p)) for p in parts)
    return files.withColumn("host", F.coalesce(F.nullif(F.regexp_extract(lines.plain_path("path"), f"^{pattern}", 1), F.lit("")), F.lit(host)))


def _wanted(spark: SparkSession, searches: list[Search], host: str, hosts_known: bool) -> DataFrame:
    """The searches as rows for match_archives."""
    rows = []
    for s in searches:
        base, at = s.logfile.rsplit("/", 1)[-1], s.host or ("" if hosts_known else host)
        rows.append((s.tag, at or None, s.logfile, incremental.rotation_regex(s.rotation or "(?!)", base, at), *incremental.stem(s.rotation, base), s.archives))
    return spark.createDataFrame(rows, "tag string, host string, logfile string, pattern string, stem string, anywhere boolean, archives string")


def run(
    spark: SparkSession,
    searches: list[Search],
    paths: list[str],
    state_path: str,
    run_ts: datetime,
    host: str = "localhost",
    protocol_path: str | None = None,
    before: Callable | None = None,
    after: Callable | None = None,
    replaces: bool = False,
    protocol_error: str = "CRITICAL",
    state_error: str = "CRITICAL",
    own_macros: dict[str, str] | None = None,
    levels: int | None = None,
    layout: str | None = None,
    feeds: dict[str, Feed] | None = None,
) -> Run:
    """A run over the files of the searches' logs; what it read is not read again. The state is saved last, so a run that dies is repeated.

    before() and after(result, matches) return None or (level, text); a level other than OK is
    an alert. With replaces, an alert of before ends the run, and what after returns is the
    result. A protocol that cannot be written is an alert of level protocol_error, a state that cannot
    be saved one of state_error; the next run reads the same lines again then. Macros in the names
    of logs, rotations and patterns are replaced by their values at run_ts and own_macros. levels: how
    many folders below paths archives are looked for, all if None. layout: the beginning of paths of files, such as
    /logs/{host}/, from which the host of a log is known; a search without host then takes the logs of all hosts.

    feeds: records by name, for searches that look at these instead of files.

    A log of a name that is in several folders, or of several hosts, is a source each, with a state each.
    """
    values, of_tags = _late(searches, sinks.load_state(spark, state_path), macros(run_ts, host, **(own_macros or {})))
    searches = [resolved(s, values | of_tags[s.tag]) for s in searches]
    for s in searches:
        s.check(spark)
    alerts = []
    if before:
        level, text = _called(before, "before")
        if level != "OK":
            alerts.append(alert(spark, "before", level, text, host))
            if replaces:
                none = spark.createDataFrame([], "tag string, lines long, criticals long, warnings long, unknowns long")
                return Run(alerts[0], none, report.service_result(alerts[0], report.preview(alerts[0], 1, ("file_seq", "line_no"))), spark.createDataFrame([], STATE))
    of_feeds = [s for s in searches if s.feed]
    of_files = [s for s in searches if not s.feed]
    wanted = _wanted(spark, of_files, host, bool(layout))
    version, state = sinks.state_version(spark, state_path), sinks.load_state(spark, state_path)
    state = state if state is not None else spark.createDataFrame([], STATE)
    for f in spark.createDataFrame([], STATE).schema.fields:  # a state of an older form
        state = state if f.name in state.columns else state.withColumn(f.name, F.lit(None).cast(f.dataType))

    shown = _shown(paths)
    if of_files:
        files = incremental.match_archives(_hosts(lines.list_files(spark, paths, levels=levels), layout, host), wanted)
        newest = [s.tag for s in of_files if s.newest]
        if newest:
            files = files.filter(~F.col("tag").isin(newest)).unionByName(incremental.current_file(files.filter(F.col("tag").isin(newest)), KEY))
        files = written(files)
        fed = F.col("tag").isin([s.tag for s in of_feeds])
        state = incremental.adopted(state.filter(~fed), files.select(*KEY).distinct()).unionByName(state.filter(fed).withColumn("shared", F.lit(False)))
        chosen, splits, grown, broken = _chosen(spark, files, state, of_files)
        state = state.drop("shared")
        events, tails = _fresh_events(spark, chosen, splits, grown, of_files, state.filter("tail is not null").select(*KEY, "tail"))
    else:
        files, chosen, broken, events, tails = spark.createDataFrame([], FILES), spark.createDataFrame([], CHOSEN), None, None, None
    read = [chosen.groupBy("tag").agg(F.sum(F.col("rows") - F.col("seen")).alias("lines"))]
    cursors, hosts = None, state.filter(F.col("tag").isin([s.tag for s in of_feeds])).select(*KEY)
    for s in of_feeds:
        found, reached = feeds_of_run.read((feeds or {})[s.feed], s.feed, s.tag, s.host or host, state, run_ts, s.read_all_first)
        found = written(found)
        more, ends = line_events(found, [s], state.filter("tail is not null").select(*KEY, "tail"))
        events = more if events is None else events.unionByName(more)
        tails = ends if tails is None else tails if ends is None else tails.unionByName(ends)
        cursors = reached if cursors is None else cursors.unionByName(reached)
        hosts = hosts.unionByName(found.select(*KEY))
        read.append(found.groupBy("tag").agg(F.count(F.lit(1)).alias("lines")))

    old = _carried(state, searches, run_ts)
    tags = [s.tag for s in searches]
    # sources: those with files, those that had some, and searches that never had any
    base = F.regexp_extract("logfile", r"([^/]+)$", 1)
    had = state.filter(F.contains("logfile", F.lit("/"))).select(*KEY, base.alias("_base")).join(wanted.select("tag", F.regexp_extract("logfile", r"([^/]+)$", 1).alias("_base")), ["tag", "_base"]).select(*KEY)
    sources = files.select(*KEY).unionByName(had).distinct()
    if cursors is not None:
        cursors = written(cursors)
        sources = sources.unionByName(hosts.unionByName(cursors.select(*KEY)).distinct())
    sources = sources.unionByName(wanted.select("tag", F.coalesce("host", F.lit(host)).alias("host"), "logfile").join(sources.select("tag").distinct(), "tag", "left_anti"))
    # the first run of a source that reads all of it does not miss patterns
    unread = sources.join(state.filter("logoffset is not null").select(*KEY), list(KEY), "left_anti").filter(F.col("tag").isin([s.tag for s in searches if s.read_all_first]))
    scanned = scan_all(events, searches, old, sources.join(unread.select(*KEY), list(KEY), "left_anti"), run_ts, events=events)
    matches, carry = scanned.matches, scanned.carry
    reached = chosen.select(*KEY, "file_seq", F.col("end").alias("end_offset"), "mtime", "fingerprint", "current", F.col("rows").alias("loglines"))
    state_after = incremental.advance_state(state, reached, run_ts)
    stale = [incremental.stale_sources(state_after.filter(F.col("tag").isin(own)), run_ts, maxage, shown=shown) for maxage, own in _by(of_files, lambda s: s.maxage).items()]
    # a source that is not there yet is known from now on, and read from its start when it comes
    unseen = sources.join(state_after.select(*KEY), list(KEY), "left_anti")
    state_after = state_after.unionByName(unseen.select(*KEY, F.lit(0).cast("long").alias("logoffset"), F.timestamp_seconds(F.lit(0)).alias("logtime"), F.lit(None).cast("string").alias("fingerprint"), F.lit(1).cast("long").alias("runcount"), F.lit(run_ts).alias("runtime")))
    if cursors is not None:
        kept = state.filter("cursor is not null").select(*KEY, "cursor").join(cursors.select(*KEY), list(KEY), "left_anti")
        state_after = state_after.join(kept.unionByName(cursors), list(KEY), "left")
    else:
        state_after = state_after.join(state.filter("cursor is not null").select(*KEY, "cursor"), list(KEY), "left")
    at_line = reached.groupBy(*KEY).agg(F.max_by(F.when(F.col("current"), F.col("loglines")).otherwise(0), "file_seq").alias("_reached"))
    state_after = state_after.join(at_line, list(KEY), "left").join(state.select(*KEY, "loglines"), list(KEY), "left").withColumn("loglines", F.coalesce("_reached", "loglines")).drop("_reached")
    for level in sorted({s.logfile_missing for s in of_files} - {"off"}):
        asked = sources.filter(F.col("tag").isin([s.tag for s in of_files if s.logfile_missing == level]))
        matches = matches.unionByName(_alerts(incremental.missing_sources(asked, files, level.upper(), shown=shown), "missing log"))
    if broken is not None:
        for level in sorted({s.unreadable for s in searches} - {"off"}):
            own = broken.filter(F.col("tag").isin([s.tag for s in searches if s.unreadable == level]))
            matches = matches.unionByName(_alerts(own.select(*KEY, F.lit(level.upper()).alias("level"), F.concat(F.lit("could not read "), lines.plain_path("path")).alias("message")), "unreadable log"))
    for old_ones in stale:
        matches = matches.unionByName(_alerts(old_ones, "stale"))
    others = old.filter(~F.col("tag").isin(tags))
    carry = carry.unionByName(others) if carry is not None else others
    timed = F.when(F.col("threshold_times").isNotNull(), F.struct("level", "threshold_times"))
    counts = carry.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("level", "carry"))).alias("threshold"), F.map_from_entries(F.collect_list(timed)).alias("threshold_times"))
    state_after = state_after.join(counts, list(KEY), "left")
    ends = state.filter("tail is not null").select(*KEY, "tail")
    ends = ends if tails is None else ends.join(tails.select(*KEY), list(KEY), "left_anti").unionByName(tails)
    state_after = state_after.join(ends, list(KEY), "left")
    matches = written(matches)
    heard = [s for s in searches if s.callback]
    private = state.filter("private is not null").select(*KEY, "private")
    if heard:
        matches, private = _called_back(matches, state, heard)
        matches = written(matches)
    new, sticking = matches, [s for s in searches if s.sticky]
    stuck = state.filter(~F.col("tag").isin(tags)).select(*KEY, "sticky").filter("sticky is not null")
    if sticking:
        standing = written(_standing(new, state, scanned.clear, sticking, run_ts))
        matches = new.filter(~F.col("tag").isin([s.tag for s in sticking])).unionByName(standing.drop("when"))
        in_order = F.sort_array(F.collect_list(F.struct("when", "file_seq", "line_no", "pat_pos", "level", "message")))
        each = F.transform(in_order, lambda m: F.struct(m["level"].alias("level"), m["when"].alias("when"), m["message"].alias("message")))
        stuck = stuck.unionByName(standing.groupBy(*KEY).agg(each.alias("sticky")))
    state_after = state_after.join(stuck, list(KEY), "full").join(private, list(KEY), "full")
    state_after = state_after.withColumns({"runcount": F.coalesce("runcount", F.lit(1).cast("long")), "runtime": F.coalesce("runtime", F.lit(run_ts))}).select(*[c.split()[0] for c in STATE.split(", ")])
    if protocol_path:
        keep = [s.tag for s in searches if s.protocol]
        try:
            sinks.write_protocol(new.filter(F.col("tag").isin(keep) & (F.col("level") != "OK")).withColumn("logfile", shown), protocol_path, run_ts, str(version))
        except Exception as e:
            alerts.append(alert(spark, "protocol", protocol_error, f"cannot write protocol: {str(e)[:200]}", host))
    for extra in alerts:
        matches = matches.unionByName(extra)
    silent = [s.tag for s in searches if not s.count]

    def summed(rows: DataFrame) -> DataFrame:
        counted = rows.filter(~F.col("tag").isin(silent)) if silent else rows
        return report.service_result(counted, report.preview(counted, 1, ("file_seq", "line_no")))

    result = summed(matches)
    if after:
        level, text = _called(after, "after", result.first().asDict(), matches)
        if replaces:
            result = result.withColumns({"level": F.lit(level), "code": F.lit(LEVELS[level]), "text": F.lit(text)})
        elif level != "OK":
            matches = matches.unionByName(alert(spark, "after", level, text, host))
            result = summed(matches)
    try:
        sinks.save_state(state_after, state_path)
        state_after = sinks.load_state(spark, state_path)
    except Exception as e:
        matches = matches.unionByName(alert(spark, "state", state_error, f"cannot write state: {str(e)[:200]}", host))
        result = summed(matches)
    return Run(matches, report.counters(reduce(DataFrame.unionByName, read), matches), result, state_after)
