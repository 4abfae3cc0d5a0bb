"""Records as sources of a run: events, journals, reports, alert tables and listings, each taken up where the last run stopped.

A feed is a table of records with what tells old ones from new ones: a time, a time by whole minutes or up to a second ago, an id, or
the number of a line. What a run has reached is the source's cursor in the state: one time for a feed, as all its hosts are read up to
the run's time, and a number or the ids of the last listing for each host. Bounds of times are literals, so
they reach the scan of a table, a partitioned folder or a JDBC source.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logscan.model import KEY
from logscan.operators import events
from logscan.sources import records

#: What a source has reached.
CURSOR = "map<string,string>"
LINES = "tag string, host string, logfile string, file_seq int, line_no long, line string"


@dataclass(frozen=True)
class Feed:
    """Records and how they are read.

    rows: a table, or a function of the window's begin and end that gives one (for sources that are best asked for a window). cursor and column:

    - time: begin <= column < the run's time; minute: the same by whole minutes, the one in progress is left for the next run; second: a
      row younger than a second is left for the next run. A first run looks back lookback, else as events.since says.
    - id: records whose id the last listing of their host did not have. line: lines whose number is the next of their host or more; a host
      whose lines end before it is read from its start. A first run takes these as known, unless its search reads all.

    line: the text of a record, its column line if None. host: the column of its host, if it has one; records without are the run's host's. chosen: which records count.
    """

    rows: DataFrame | Callable[[datetime, datetime], DataFrame]
    cursor: str
    column: str
    line: Column | None = None
    host: str | None = None
    chosen: Column | None = None
    lookback: str | int | None = None
    kind: str = "event"


def event_feed(rows: DataFrame, host: str | None = None, included: Column | None = None, excluded: Column | None = None, fmt: str = "%g %i %m", ts: str = "generated", lookback: str | int | None = None) -> Feed:
    """Event records (of XML, dumps, tables), rendered as lines."""
    tests = [*([] if included is None else [included]), *([] if excluded is None else [~excluded])]
    return Feed(rows, "time", ts, events.render_event(fmt), host, _all(tests), lookback)


def journal_feed(rows: DataFrame, units: list[str] | None = None, unit: str = "unit", ts: str = "ts", line: str = "message", host: str | None = None, lookback: str | int | None = None) -> Feed:
    return Feed(rows, "time", ts, F.col(line), host, F.col(unit).isin(units) if units else None, lookback)


def report_feed(rows: DataFrame, ts: str = "ts", line: str = "message", host: str | None = None, lookback: str | int | None = None, **equal: str) -> Feed:
    """Records of an error report with the given columns equal."""
    return Feed(rows, "minute", ts, F.col(line), host, _all([F.col(c) == v for c, v in equal.items()]), lookback, "report")


def alert_feed(rows: DataFrame | Callable[[datetime, datetime], DataFrame], ts: str = "ts", line: str = "message", host: str | None = None, lookback: str | int | None = None) -> Feed:
    """A table of alerts, without those of empty text."""
    return Feed(rows, "second", ts, F.col(line), host, F.col(line) != "", lookback, "report")


def kernel_feed(rows: DataFrame, host: str | None = None) -> Feed:
    """The lines of kernel rings (line_no, line)."""
    return Feed(rows, "line", "line_no", None, host)


def listing_feed(lines: DataFrame, host: str | None = None) -> Feed:
    """A listing `id | date | ...`."""
    rx = r"^\s*(\w+)\s*\|"
    rows = lines.filter(F.col("line").rlike(rx)).withColumn("id", F.regexp_extract("line", rx, 1))
    return Feed(rows, "id", "id", F.replace("line", F.lit("|"), F.lit(";")), host)


def _all(tests: list[Column]) -> Column | None:
    out = None
    for t in tests:
        out = t if out is None else out & t
    return out


def jdbc_rows(spark: SparkSession, url: str, table: str, ts: str = "ts", partitions: int = 8, **options: str) -> Callable[[datetime, datetime], DataFrame]:
    """A JDBC table as rows of a feed: a window is read in so many slices of time at once, and the source filters by its bounds."""

    def rows(begin: datetime, end: datetime) -> DataFrame:
        reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=ts, lowerBound=str(begin), upperBound=str(end), numPartitions=str(partitions), **options)
        return reader.load()

    return rows


def _window(feed: Feed, known: DataFrame, now: datetime, read_all: bool) -> tuple[datetime, datetime]:
    """Where the window of a run begins and ends."""
    last = known.agg(F.max(F.col("cursor")["at"].cast("long"))).first()[0]
    at = now.replace(second=0, microsecond=0) if feed.cursor == "minute" else now - timedelta(seconds=1) if feed.cursor == "second" else now
    if last is not None:
        return datetime.fromtimestamp(last / 1_000_000), at
    begin = known.sparkSession.range(1).select(events.since(None, now, feed.lookback, read_all, feed.kind)).first()[0]
    return begin.replace(second=0, microsecond=0) if feed.cursor == "minute" else begin, at


def read(feed: Feed, name: str, tag: str, host: str, state: DataFrame, now: datetime, read_all: bool = False) -> tuple[DataFrame, DataFrame]:
    """The new records as lines (tag, host, logfile, file_seq, line_no, line), and the cursors (key, cursor) after them.

    state: key and cursor of the last run. Each record is in one run: windows meet without a gap, and ids and
    numbers are kept by host.
    """
    own = lambda rows: rows.select(F.lit(tag).alias("tag"), (F.coalesce(F.col(feed.host).cast("string"), F.lit(host)) if feed.host else F.lit(host)).alias("host"), F.lit(name).alias("logfile"), F.lit(0).alias("file_seq"), *more, (F.col("line") if feed.line is None else feed.line).alias("line"))
    known = state.filter((F.col("tag") == tag) & (F.col("logfile") == name) & F.col("cursor").isNotNull())
    if feed.cursor in ("time", "minute", "second"):
        begin, end = _window(feed, known, now, read_all)
        rows = feed.rows(begin, end) if callable(feed.rows) else feed.rows
        inside = rows.filter((F.col(feed.column) >= F.lit(begin)) & (F.col(feed.column) < F.lit(end)))
        inside = inside if feed.chosen is None else inside.filter(feed.chosen)
        more = [F.unix_micros(F.col(feed.column).cast("timestamp")).alias("line_no")]
        cursors = state.sparkSession.createDataFrame([(tag, host, name, {"at": str(round(end.timestamp() * 1_000_000))})], f"tag string, host string, logfile string, cursor {CURSOR}")
        return own(inside), cursors
    rows = feed.rows if feed.chosen is None else feed.rows.filter(feed.chosen)
    first = not read_all and not known.limit(1).count()
    if feed.cursor == "line":
        more = [F.col(feed.column).cast("long").alias("line_no")]
        all_ = own(rows)
        next_ = all_.groupBy(*KEY).agg(F.create_map(F.lit("next"), (F.max("line_no") + 1).cast("string")).alias("cursor"))
        new = records.since_line(all_, known.select(*KEY, F.col("cursor")["next"].cast("long").alias("next_line")), KEY)
        return new.limit(0) if first else new, next_
    more = [F.monotonically_increasing_id().alias("line_no"), F.col(feed.column).cast("string").alias("id")]
    all_ = own(rows)
    seen = all_.groupBy(*KEY).agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct(F.col("id"), F.lit(""))))).alias("cursor"))  # as large as a host's listing
    new = records.new_by_id(all_, known.select(*KEY, F.explode(F.map_keys("cursor")).alias("id")), "id", KEY).drop("id")
    return new.limit(0) if first else new, seen
