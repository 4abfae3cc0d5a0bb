"""Where a run takes up its sources: rotated archives, saved positions, missing and stale files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logscan.operators.literals import required
from logscan.sources.lines import plain_path
from logscan.tables import BROADCAST_ROWS, broadcast_if_small, written

KEY = ["tag", "host", "logfile"]

# Names of archives by rotation scheme, anchored at the start of the name; NAME and HOST are filled in.
SCHEMES = {
    "LOGLOGDATE8GZ": r"^NAME[\.\-]{0,1}[0-9]{8}\.gz$",
    "LOGLOGDATE8BZ2": r"^NAME[\.\-]{0,1}[0-9]{8}\.bz2$",
    "LOGLOG0LOG1GZ": r"^NAME\.((0)|([1-9]+\.gz))$",
    "LOGLOG0GZLOG1GZ": r"^NAME\.((0)|([1-9]+[0-9]*))\.gz$",
    "LOGLOG0BZ2LOG1BZ2": r"^NAME\.((0)|([1-9]+[0-9]*))\.bz2$",
    "LOGLOG0LOG1": r"^NAME\.((0)|([1-9]+[0-9]*))$",
    "SUSE": r"^NAME.*[0-9]*.gz",
    "DEBIAN": r"^NAME.0|NAME.*[0-9]*.gz",
    "QMAIL": r"^@.*",
    "LOGROTATE": r"^NAME.*[0-9]*.gz",
    "SOLARIS": r"^NAME.*\.[0-9]+",
    "HPUX": r"^OLDNAME",
    "BMWHPUX": r"^OLDNAME|NAME\.[A-Z][0-9]+_[0-9]+\.gz$",
    "EHL": r"^HOST_NAME\.\d\d\d\d_\d+_\d+_\d+_\d+_\d+$",
    "MOD_LOG_ROTATE": r"^access\.log\.\d{10}",
}


def rotation_regex(scheme: str, basename: str, host: str = "") -> str:
    """The pattern of a scheme for a log's name; other schemes are patterns themselves."""
    known = SCHEMES.get(scheme.upper())
    return known.replace("NAME", re.escape(basename)).replace("HOST", re.escape(host)) if known else f"^{scheme}"


#: Schemes whose names do not begin with the log's name, and what their names hold instead, or do hold in another place.
ELSEWHERE = {"HPUX": "NAME", "BMWHPUX": "NAME", "DEBIAN": "NAME", "EHL": "NAME", "QMAIL": "@", "MOD_LOG_ROTATE": "access.log"}


def stem(scheme: str | None, basename: str) -> tuple[str, bool]:
    """A text that all names of archives hold, and whether it may stand anywhere and not only in front."""
    if not scheme:
        return basename, False
    if scheme.upper() in SCHEMES:
        text = ELSEWHERE.get(scheme.upper())
        return (basename, False) if text is None else (text.replace("NAME", basename), True)
    texts, _ = required(scheme)
    return (texts[0] if texts else ""), True


def match_archives(files: DataFrame, searches: DataFrame) -> DataFrame:
    """files (path, mtime, length, and host where that is known) with the searches (tag, host, logfile, pattern) whose log or archives they are; current marks the log itself.

    logfile becomes the whole path of the log, so that logs of one name in several folders are several sources. The
    archives of a log are beside it, or, where a search has archives, in folders of that pattern: below
    the log's folder, or whole ones, which are those of every log of the search. A search without host takes the logs of all hosts.
    stem and anywhere of searches (see stem) are a text that names of archives hold: files meet searches by
    it and by the log's name in an equi join, so a pattern is tried on the names that can have it only.
    """
    given = {"stem": F.lit(""), "anywhere": F.lit(True), "archives": F.lit(None).cast("string")}
    asked = searches.withColumns({c: v for c, v in given.items() if c not in searches.columns})
    asked = asked.withColumns({"_base": F.regexp_extract("logfile", r"([^/]+)$", 1), "_above": F.regexp_extract("logfile", r"^(.*)/[^/]*$", 1)})
    of = ["tag", "_host", "pattern", "archives", "_base", "_above"]
    either = asked.withColumnRenamed("host", "_host").select(*of, F.explode(F.array(F.struct(F.lit(True).alias("log"), F.col("_base").alias("text"), F.lit(False).alias("anywhere")), F.struct(F.lit(False).alias("log"), F.col("stem").alias("text"), F.col("anywhere").alias("anywhere")))).alias("_s")).select(*of, "_s.*")
    sizes, total = {True: [], False: []}, 0
    for r in either.groupBy(F.length("text").alias("n"), "anywhere").count().collect():  # lengths of names
        sizes[r["anywhere"]].append(r["n"])
        total += r["count"]
    cut = lambda at, sizes: F.filter(F.transform(F.array(*[F.lit(n) for n in sizes]), lambda n: F.substring("name", at, n)), lambda x: F.length(x) > 0)
    front = F.transform(F.concat(cut(F.lit(1), [n for n in sizes[False] if n]), F.array(F.lit(""))) if any(sizes[False]) else F.array(F.lit("")), lambda x: F.struct(x.alias("text"), F.lit(False).alias("anywhere")))
    inner = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length("name")), lambda i: cut(i, [n for n in sizes[True] if n])))) if any(sizes[True]) else F.array().cast("array<string>")
    inner = F.transform(F.concat(F.array(F.lit("")), inner), lambda x: F.struct(x.alias("text"), F.lit(True).alias("anywhere")))
    named = files.withColumns({"name": F.regexp_extract("path", r"([^/]+)$", 1), "_folder": F.regexp_extract(plain_path("path"), r"^(.*)/[^/]*$", 1)})
    keyed = named.withColumn("_k", F.explode(F.array_distinct(F.concat(front, inner)))).select(*named.columns, "_k.*")
    if "host" in files.columns:
        keyed = keyed.withColumnRenamed("host", "_at").withColumn("host", F.col("_at"))
    found = keyed.drop("host").join(F.broadcast(either) if total <= BROADCAST_ROWS else either, ["text", "anywhere"])
    if "host" in files.columns:
        found = found.filter(F.col("_host").isNull() | F.col("_at").isNull() | (F.col("_host") == F.col("_at"))).withColumn("host", F.coalesce("_host", "_at")).drop("_at")
    else:
        found = found.withColumn("host", F.col("_host"))
    is_log = F.col("name") == F.col("_base")
    found = found.filter(F.when(F.col("log"), is_log).otherwise(~is_log & F.expr("name rlike pattern")))
    below = F.expr("regexp_extract(_folder, concat('^(.*)/(?:', archives, ')$'), 1)")
    whole = F.col("archives").startswith("/")
    home = F.when(F.col("log") | F.col("archives").isNull(), F.col("_folder")).when(~whole, F.nullif(below, F.lit("")))
    found = found.withColumn("_home", home)
    plain = found.filter(F.col("_home").isNotNull())
    # archives in folders of their own belong to the logs that their search has
    apart = found.filter(F.col("_home").isNull() & whole & F.expr("_folder rlike concat('^(?:', archives, ')$')")).drop("_home")
    logs = found.filter("log").select(F.col("tag").alias("_t"), F.col("host").alias("_h"), "_home").distinct()
    apart = apart.join(logs, (F.col("tag") == F.col("_t")) & F.col("host").eqNullSafe(F.col("_h"))).drop("_t", "_h")
    both = plain.unionByName(apart)
    below_that = (F.col("_above") == "") | (F.col("_home") == F.col("_above")) | (~F.col("_above").startswith("/") & F.endswith("_home", F.concat(F.lit("/"), "_above")))
    both = both.filter(below_that).withColumns({"logfile": F.concat("_home", F.lit("/"), "_base"), "current": F.col("log")})
    return both.drop("log", "text", "anywhere", "archives", "_base", "_above", "_host", "_folder", "_home")


def adopted(state: DataFrame, sources: DataFrame, key: list = KEY) -> DataFrame:
    """The state where rows that name a log without its folder are rows of the sources (key) of that name that have none of their own.

    Such rows are those of logs that were not there yet, and of states of an older form. shared is true where several sources take
    over one position: which of them it belongs to, the fingerprint tells (see starts).
    """
    nameless = state.filter(~F.contains("logfile", F.lit("/")) & (F.col("cursor").isNull() if "cursor" in state.columns else F.lit(True)))
    if not nameless.limit(1).count():
        return state.withColumn("shared", F.lit(False))
    own = sources.select(*key).join(state.select(*key), key, "left_anti").withColumn("_base", F.regexp_extract("logfile", r"([^/]+)$", 1))
    heirs = own.select(F.col("tag").alias("_tag"), F.col("host").alias("_host"), F.col("logfile").alias("_log"), "_base")
    taken = written(nameless.join(heirs, (F.col("tag") == F.col("_tag")) & F.col("host").eqNullSafe(F.col("_host")) & (F.col("logfile") == F.col("_base"))).drop("_tag", "_host", "_base"))
    several = taken.groupBy(*key).agg((F.count(F.lit(1)) > 1).alias("shared"))
    heirs = taken.join(several, key).withColumn("logfile", F.col("_log")).drop("_log")
    left = state.join(taken.select(*key).distinct(), key, "left_anti")
    return written(left.withColumn("shared", F.lit(False)).unionByName(heirs))


def current_file(files: DataFrame, key: tuple = ("tag",)) -> DataFrame:
    """files with current: the newest of each key, for logs without a fixed name."""
    w = Window.partitionBy(*key).orderBy(F.desc("mtime"), F.desc("path"))
    return files.withColumn("current", F.row_number().over(w) == 1)


def classify_source(files: DataFrame, state: DataFrame, key: list = KEY) -> DataFrame:
    """Files with the saved logoffset and fingerprint, situation and start_at.

    Situations of a log that is not rotated: missing, new, changed, empty, shrunk, same, grown.
    """
    both = files.select(*key, "length", F.col("fingerprint").alias("now_print"), F.lit(True).alias("_there")).join(state.select(*key, "logoffset", "fingerprint"), key, "full")
    size, at = F.col("length"), F.col("logoffset")
    situation = (
        F.when(F.col("_there").isNull(), "missing")
        .when(at.isNull(), "new")
        .when(F.col("now_print") != F.col("fingerprint"), "changed")
        .when(size == 0, "empty")
        .when(size < at, "shrunk")
        .when(size == at, "same")
        .otherwise("grown")
    )
    start = F.when(situation.isin("grown", "same"), at).when(situation.isin("changed", "empty", "shrunk"), 0)
    return both.select(*key, situation.alias("situation"), start.cast("long").alias("start_at"))


def first_start(files: DataFrame, state: DataFrame, read_all: bool = False, key: list = KEY) -> DataFrame:
    """key, start_at: the saved offset; on a first run the end of the file, or 0 with read_all."""
    start = F.coalesce("logoffset", F.lit(0) if read_all else F.col("length"))
    return files.join(state.select(*key, "logoffset"), key, "left").select(*key, start.cast("long").alias("start_at"))


def dedupe_files(files: DataFrame, key: list = KEY) -> DataFrame:
    """One of the files of the same fingerprint and length, then one of the same path: the newest."""
    w = lambda *by: Window.partitionBy(*key, *by).orderBy(F.desc("mtime"), F.desc("path"))
    once = files.withColumn("_n", F.row_number().over(w("fingerprint", "length"))).filter("_n = 1")
    return once.withColumn("_n", F.row_number().over(w("path"))).filter("_n = 1").drop("_n")


def relevant_files(files: DataFrame, state: DataFrame, key: list = KEY) -> DataFrame:
    """Archives not older than the saved logtime, and the current log last: file_seq is their order."""
    new = files.join(state.select(*key, "logtime"), key, "left").filter(F.col("current") | F.col("logtime").isNull() | (F.col("mtime") >= F.col("logtime")))
    w = Window.partitionBy(*key).orderBy("current", "mtime", "path")
    return new.withColumn("file_seq", F.row_number().over(w) - 1).drop("logtime")


def starts(files: DataFrame, state: DataFrame, key: list = KEY) -> DataFrame:
    """files with start, the offset to read on from (end, if nothing is to be read), and seen, the lines before it.

    files: key, file_seq, end, rows, fingerprint, current, and the options rotating, read_all and
    virtual of their searches; state: key, logoffset, fingerprint, loglines.

    - A source without state is read from its start with read_all, else from its end on.
    - A virtual source is read whole in each run.
    - Of a rotating log the file with the saved fingerprint is read on, older ones are done with, newer ones are
      read whole; if there is no such file all are. Without a saved fingerprint the oldest is the one.
    - A log that does not rotate is read on if its fingerprint is the saved one.
    - A file that ends before the saved offset is read whole.
    - A source that shares a position with others (shared of state) and has no file with its fingerprint is one without state.
    """
    shared = F.col("shared") if "shared" in state.columns else F.lit(False)
    saved = state.select(*key, "logoffset", F.col("fingerprint").alias("_print"), "loglines", F.lit(True).alias("_known"), shared.alias("_shared"))
    both = files.join(saved, key, "left")
    at, end, seq = F.coalesce("logoffset", F.lit(0)), F.col("end"), F.col("file_seq")
    same = F.when(F.col("_print").isNull(), seq == 0).otherwise(F.coalesce(F.col("fingerprint") == F.col("_print"), F.lit(False)))
    last = F.min(F.when(same, seq)).over(Window.partitionBy(*key))  # over the files of a log
    both = both.withColumn("_last", F.when(F.col("rotating"), last).when(same, seq))
    on = F.when(at <= end, at).otherwise(0)
    start = (
        F.when(F.col("virtual"), 0)
        .when(F.col("_known").isNull() | F.col("logoffset").isNull() | (F.col("_shared") & F.col("_print").isNotNull() & F.col("_last").isNull()), F.when(F.col("read_all"), 0).otherwise(end))
        .when(F.col("_last").isNull() | (seq > F.col("_last")), 0)
        .when(seq < F.col("_last"), end)
        .otherwise(on)
    )
    both = both.withColumn("start", start.cast("long"))
    seen = F.when(F.col("start") == end, F.col("rows")).when(F.col("start") == 0, 0).otherwise(F.coalesce("loglines", F.lit(0)))
    return both.withColumn("seen", seen.cast("long")).drop("logoffset", "_print", "loglines", "_known", "_last", "_shared")


def apply_offset(lines: DataFrame, state: DataFrame, key: list = KEY) -> DataFrame:
    """Lines of the oldest file from the saved offset on, of later files all; an oldest file that ends before the offset is read whole.

    The starts are a row a source; if they are few enough they go to the lines, which are not shuffled then.
    """
    first = lines.filter("file_seq = 0").groupBy(*key).agg(F.max("end_offset").alias("_size"))
    saved = state.select(*key, "logoffset").filter("logoffset > 0")
    start = written(first.join(saved, key).filter(F.col("logoffset") <= F.col("_size")).select(*key, F.col("logoffset").alias("_start")))
    out = lines.join(broadcast_if_small(start), key, "left")
    return out.filter((F.col("file_seq") > 0) | (F.col("start_offset") >= F.coalesce("_start", F.lit(0)))).drop("_start")


def advance_state(state: DataFrame, read: DataFrame, run_ts, key: list = KEY) -> DataFrame:
    """The state after a run. read: key, file_seq, end_offset, mtime, fingerprint, current of the files read.

    The position is that in the last file; (0, now) if only archives were there; sources that
    were not read keep theirs. runcount goes up by one and runtime is the run's.
    """
    last = read.groupBy(*key).agg(F.max_by(F.struct("end_offset", "mtime", "fingerprint", "current"), "file_seq").alias("r"))
    both = state.select(*key, "logoffset", "logtime", "fingerprint", "runcount").join(last, key, "full")
    only_archives = ~F.col("r.current")
    return both.select(
        *key,
        F.when(F.col("r").isNull(), F.col("logoffset")).when(only_archives, 0).otherwise(F.col("r.end_offset")).cast("long").alias("logoffset"),
        F.when(F.col("r").isNull(), F.col("logtime")).when(only_archives, F.lit(run_ts)).otherwise(F.col("r.mtime")).alias("logtime"),
        F.when(F.col("r").isNull(), F.col("fingerprint")).otherwise(F.col("r.fingerprint")).alias("fingerprint"),
        (F.coalesce("runcount", F.lit(0)) + 1).cast("long").alias("runcount"),
        F.lit(run_ts).alias("runtime"),
    )


def situation_rotating(files: DataFrame, state: DataFrame, key: list = KEY) -> DataFrame:
    """key, situation of rotating logs (files: key, file_seq, length, fingerprint, current): as in classify_source for the file that was read last.

    new, same or grown: that file is still the log; rotated: it is an archive now; replaced: it is
    gone and other files are there; only_archives: the log itself is missing; missing: no file at all.
    """
    saved = state.select(*key, "logoffset", F.col("fingerprint").alias("_print"), F.lit(True).alias("_known"))
    one = files.join(saved, key, "left").groupBy(*key).agg(
        F.max(F.when(F.col("current"), F.struct("length", "fingerprint"))).alias("log"), F.max(F.when(F.col("fingerprint") == F.col("_print"), True)).alias("found"), F.first("_known").alias("_known"), F.first("_print").alias("_print"), F.first("logoffset").alias("logoffset")
    )
    gone = saved.join(files.select(*key).distinct(), key, "left_anti").select(*key, F.lit("missing").alias("situation"))
    still = F.col("log.fingerprint") == F.col("_print")
    what = (
        F.when(F.col("log").isNull(), "only_archives")
        .when(F.col("_known").isNull(), "new")
        .when(still & (F.col("log.length") > F.col("logoffset")), "grown")
        .when(still & (F.col("log.length") == F.col("logoffset")), "same")
        .when(F.col("found"), "rotated")
        .otherwise("replaced")
    )
    return one.select(*key, what.alias("situation")).unionByName(gone)


def missing_sources(searches: DataFrame, files: DataFrame, level: str = "UNKNOWN", key: list = KEY, shown: Column | None = None) -> DataFrame:
    """key, level, message of the searches without any file; shown: how a log is named."""
    gone = searches.select(*key).join(files.select(*key).distinct(), key, "left_anti")
    return gone.select(*key, F.lit(level).alias("level"), F.concat(F.lit("could not find logfile "), F.col("logfile") if shown is None else shown).alias("message"))


def stale_sources(state: DataFrame, now, maxage: int, key: list = KEY, shown: Column | None = None) -> DataFrame:
    """key, level, message of the sources whose last log time is maxage seconds old or older."""
    old = F.unix_timestamp("logtime") <= F.unix_timestamp(F.lit(now)) - maxage
    return state.filter(old).select(*key, F.lit("CRITICAL").alias("level"), F.format_string(f"logfile %s is too old (> {maxage} s)", F.col("logfile") if shown is None else shown).alias("message"))


def rewind(state: DataFrame, tags: list[str]) -> DataFrame:
    """The state with these tags at the start of their logs."""
    hit = F.col("tag").isin(tags)
    return state.withColumns({"logoffset": F.when(hit, 0).otherwise(F.col("logoffset")).cast("long"), "logtime": F.when(hit, F.timestamp_seconds(F.lit(0))).otherwise(F.col("logtime"))})


def unstick(state: DataFrame, tags: list[str]) -> DataFrame:
    """The state without the sticky matches of these tags; positions stay."""
    return state.withColumn("sticky", F.when(F.col("tag").isin(tags), F.slice("sticky", 1, 0)).otherwise(F.col("sticky")))
