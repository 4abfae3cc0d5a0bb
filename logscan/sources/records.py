"""Lines as records: syslog, event XML, comma dumps, kernel rings, listings with ids, alert tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logscan.tables import broadcast_if_small, written

# Fixed value: Mon dd HH:MM:SS host process[pid] message.
SYSLOG = r"^(\w{3})\s+(\d{1,2}) (\d{2}:\d{2}:\d{2}) (\S+) ([^\s:\[]+)(?:\[(\d+)\])?:? ?(.*)$"


def parse_syslog(df: DataFrame, year: int, column: str = "line") -> DataFrame:
    """df with ts (the year is the run's), host, process, pid and message; lines of another form have nulls."""
    part = lambda i: F.nullif(F.regexp_extract(column, SYSLOG, i), F.lit(""))
    stamp = F.concat_ws(" ", F.lit(str(year)), part(1), F.lpad(part(2), 2, "0"), part(3))
    ts = F.try_to_timestamp(F.when(F.col(column).rlike(SYSLOG), stamp), F.lit("yyyy MMM dd HH:mm:ss"))
    return df.withColumns({"ts": ts, "host": part(4), "process": part(5), "pid": part(6).cast("int"), "message": part(7)})


def read_event_xml(spark: SparkSession, paths: list[str]) -> DataFrame:
    raw = spark.read.option("lineSep", "</Event>").text(paths).filter(F.trim("value") != "")
    return parse_event_xml(raw, "value")


def parse_event_xml(df: DataFrame, column: str) -> DataFrame:
    """source, event_id, event_type, generated, computer, category, message of records with a Level; 2 is an error, 3 a warning."""
    tag = lambda p: F.nullif(F.regexp_extract(column, p, 1), F.lit(""))
    level = tag(r"<Level>(\d+)</Level>").cast("int")
    data = F.array_join(F.regexp_extract_all(column, F.lit(r"<Data[^>]*>([^<]*)</Data>"), F.lit(1)), ", ")
    return df.select(
        tag(r"<Provider Name=['\"]([^'\"]*)").alias("source"),
        tag(r"<EventID[^>]*>(\d+)</EventID>").cast("long").alias("event_id"),
        F.when(level == 2, "error").when(level == 3, "warning").when(level.isNotNull(), "information").alias("event_type"),
        F.try_to_timestamp(F.substring(tag(r"<TimeCreated SystemTime=['\"]([^'\"]*)"), 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")).alias("generated"),
        tag(r"<Computer>([^<]*)</Computer>").alias("computer"),
        tag(r"<Task>([^<]*)</Task>").alias("category"),
        F.coalesce(tag(r"(?s)<Message>(.*?)</Message>"), data).alias("message"),
    ).filter(F.col("event_type").isNotNull())


def parse_event_csv(df: DataFrame, column: str = "line") -> DataFrame:
    """The nine fields of a comma dump; the last keeps its commas. Dates are d.m.y with 24 hours or m/d/y with AM and PM."""
    f = F.split(column, ",", 9)
    stamp = F.concat_ws(" ", F.trim(f[0]), F.trim(f[1]))
    forms = ["dd.MM.yy HH:mm:ss", "d.M.yyyy H:mm:ss", "M/d/yy h:mm:ss a", "M/d/yyyy h:mm:ss a"]
    ts = F.coalesce(*[F.try_to_timestamp(stamp, F.lit(p)) for p in forms])
    names = ["event_type", "category", "event_id", "source", "user", "computer", "message"]
    cols = {n: F.trim(f[i + 2]) for i, n in enumerate(names)}
    cols |= {"event_type": cols["event_type"].try_cast("int"), "event_id": cols["event_id"].try_cast("long")}
    return df.filter(F.size(f) == 9).select(ts.alias("generated"), *[c.alias(n) for n, c in cols.items()])


def parse_kernel_lines(df: DataFrame, boot_ts, column: str = "line") -> DataFrame:
    """ts, facility, event_type, message of `facility :level : [sec.frac] text`; other lines are dropped."""
    rx = r"^(\w+)\s*:(\w+)\s*: \[\s*(\d+(?:\.\d+)?)\] (.*)$"
    at = F.unix_micros(F.lit(boot_ts).cast("timestamp")) + (F.regexp_extract(column, rx, 3).cast("double") * 1_000_000).cast("long")
    rows = df.filter(F.col(column).rlike(rx))
    return rows.select(F.timestamp_micros(at).alias("ts"), F.regexp_extract(column, rx, 1).alias("facility"), F.regexp_extract(column, rx, 2).alias("event_type"), F.regexp_extract(column, rx, 4).alias("message"))


def new_by_id(df: DataFrame, seen: DataFrame, id_col: str, key: tuple = ()) -> DataFrame:
    """Rows whose id was not there in the last run (seen: key and id)."""
    return df.join(seen.select(*key, id_col), [*key, id_col], "left_anti")


def id_listing(df: DataFrame, column: str = "line") -> DataFrame:
    """id and line (with ; for |) of a listing `id | date | ...`; lines without an id are dropped."""
    rx = r"^\s*(\w+)\s*\|"
    return df.filter(F.col(column).rlike(rx)).select(F.regexp_extract(column, rx, 1).alias("id"), F.replace(column, F.lit("|"), F.lit(";")).alias("line"))


def since_line(lines: DataFrame, state: DataFrame, key: tuple) -> DataFrame:
    """Lines from the saved number on (state: key, next_line); a source that now ends before it has rotated and is read from its start."""
    ends = lines.groupBy(*key).agg(F.max("line_no").alias("_end"))
    start = F.when(F.col("next_line") <= F.col("_end") + 1, F.col("next_line")).otherwise(0)
    starts = written(ends.join(state.select(*key, "next_line"), list(key)).select(*key, start.alias("_start")).filter("_start > 0"))
    return lines.join(broadcast_if_small(starts), list(key), "left").filter(F.col("line_no") >= F.coalesce("_start", F.lit(0))).drop("_start")


def read_alert_table(rows: DataFrame, last, now, ts: str = "ts", text: str = "message") -> DataFrame:
    """Rows newer than last and older than a second before now, without empty texts, ts on whole seconds. rows may be a JDBC table; the bounds are pushed down."""
    inside = rows.filter((F.col(ts) > F.lit(last)) & (F.col(ts) < F.lit(now) - F.expr("interval 1 second")))
    return inside.filter(F.col(text) != "").withColumn(ts, F.date_trunc("second", F.expr(f"{ts} + interval 500 milliseconds")))


def error_report(rows: DataFrame, last, now, ts: str = "ts", **equal: str) -> DataFrame:
    """Records of an error report from the minute of last to the minute before now, both whole, with the given columns equal: the minute in progress is left for the next run."""
    floor = lambda t: F.date_trunc("minute", F.lit(t).cast("timestamp"))
    out = rows.filter((F.date_trunc("minute", F.col(ts)) >= floor(last)) & (F.date_trunc("minute", F.col(ts)) < floor(now)))
    for column, value in equal.items():
        out = out.filter(F.col(column) == value)
    return out


def skip_report_header(lines: DataFrame, header: str, **equal: str) -> DataFrame:
    """Rows of a report without its header lines, with the given columns equal."""
    out = lines.filter(~F.col("line").rlike(header))
    for column, value in equal.items():
        out = out.filter(F.col(column) == value)
    return out
