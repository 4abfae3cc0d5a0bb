"""Counters, states, messages and reports from matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logscan.functions.text import html_escape
from logscan.model import LEVELS, ORD, SEVERITY, VISITED

#: Colours of rows of a report.
COLOURS = {"OK": "#90ee90", "WARNING": "#ffff99", "CRITICAL": "#ff9999", "UNKNOWN": "#ffcc99"}


def severity(level: Column) -> Column:
    out = F.lit(0)
    for name, rank in SEVERITY.items():
        out = F.when(level == name, rank).otherwise(out)
    return out


def code(level: Column) -> Column:
    out = F.lit(0)
    for name, n in LEVELS.items():
        out = F.when(level == name, n).otherwise(out)
    return out


def _counts() -> list[Column]:
    return [F.count_if(F.col("level") == level).alias(name) for level, name in zip(VISITED, ("criticals", "warnings", "unknowns"), strict=True)]


def perf_counters(lines: DataFrame, matches: DataFrame, key: str = "tag") -> DataFrame:
    """key, lines, criticals, warnings, unknowns; lines count before any prefilter, and keys without matches have zeros."""
    return counters(lines.groupBy(key).agg(F.count(F.lit(1)).alias("lines")), matches, key)


def level_rollup(matches: DataFrame, key: str = "tag") -> DataFrame:
    """The counts of each key, and of all with a null key."""
    return matches.rollup(key).agg(*_counts())


def search_result(matches: DataFrame, key: tuple = ("tag",), order: tuple = (*ORD, "pat_pos")) -> DataFrame:
    """key, level, code and message: the worst level and the last message of that level."""
    worst = matches.groupBy(*key).agg(F.max_by(F.struct("level", "message"), F.struct(severity(F.col("level")), *order)).alias("w"))
    return worst.select(*key, F.col("w.level").alias("level"), code(F.col("w.level")).alias("code"), F.col("w.message").alias("message"))


def last_message(matches: DataFrame, key: tuple = ("tag",), order: tuple = (*ORD, "pat_pos")) -> DataFrame:
    """The last message of each key and level, with ` ...` if there are more."""
    last = matches.groupBy(*key, "level").agg(F.max_by("message", F.struct(*order)).alias("m"), F.count(F.lit(1)).alias("n"))
    return last.select(*key, "level", F.when(F.col("n") != 1, F.concat("m", F.lit(" ..."))).otherwise(F.col("m")).alias("message"), "n")


def preview(matches: DataFrame, n: int, order: tuple) -> DataFrame:
    """preview: the newest n messages of the worst level, newest first, joined by `, `. Only n rows of each level leave the tasks."""
    worst = F.struct(severity(F.col("level")).alias("rank"), *order)
    top = matches.withColumn("_o", worst).orderBy(F.desc("_o")).limit(n)
    level = Window.orderBy(F.desc("_o"))  # over n rows
    kept = top.withColumn("_first", F.first("level").over(level)).filter(F.col("level") == F.col("_first"))
    sorted_ = F.reverse(F.array_sort(F.collect_list(F.struct("_o", "message"))))
    return kept.agg(F.array_join(F.transform(sorted_, lambda x: x["message"]), ", ").alias("preview"))


def service_result(matches: DataFrame, previewed: DataFrame | None = None, hit_count: bool = True) -> DataFrame:
    """level, code and text of the run: `LEVEL - (n errors, m warnings, k unknown) - preview ...`, or all well."""
    totals = matches.agg(*[F.coalesce(c, F.lit(0)).alias(n) for c, n in zip(_counts(), ("criticals", "warnings", "unknowns"), strict=True)])
    c, w, u = F.col("criticals"), F.col("warnings"), F.col("unknowns")
    level = F.when(c > 0, "CRITICAL").when(w > 0, "WARNING").when(u > 0, "UNKNOWN").otherwise("OK")
    rows = totals.crossJoin(previewed) if previewed is not None else totals.withColumn("preview", F.lit(""))  # a row each
    parts = [F.when(c > 0, F.concat(c, F.lit(" errors"))), F.when(w > 0, F.concat(w, F.lit(" warnings"))), F.when(u > 0, F.concat(u, F.lit(" unknown")))]
    counts = F.concat(F.lit(" - ("), F.concat_ws(", ", *parts), F.lit(")")) if hit_count else F.lit("")
    more = F.when(c + w + u > 1, " ...").otherwise(" ")
    text = F.when(level == "OK", "OK - no errors or warnings").otherwise(F.concat(level, counts, F.lit(" - "), F.coalesce("preview", F.lit("")), more))
    return rows.select(level.alias("level"), code(level).alias("code"), F.replace(text, F.lit("|"), F.lit("//")).alias("text"), c, w, u)


def long_report(matches: DataFrame, maxlength: int = 4096, order: tuple = (*ORD, "pat_pos")) -> DataFrame:
    """seq, tag, level, text: a header for each tag, then its messages in the order of levels, cut at the first row past maxlength characters.

    No tag can bring more rows than maxlength, and neither can the report: tasks send no more
    than that of a tag, and the running lengths are taken over so few rows. An empty message
    counts as one character.
    """
    place = F.array_position(F.array(*[F.lit(v) for v in VISITED]), F.col("level"))
    body = matches.select("tag", "level", place.alias("p"), F.struct(*order).alias("o"), F.col("message").alias("text"))
    worst = matches.groupBy("tag").agg(F.max(F.struct(severity(F.col("level")).alias("r"), "level")).alias("w"))
    empty = F.struct(*[F.lit(None).cast("long").alias(c) for c in order])
    head = worst.select("tag", F.col("w.level").alias("level"), F.lit(0).cast("long").alias("p"), empty.alias("o"), F.concat(F.lit("tag "), "tag", F.lit(" "), "w.level").alias("text"))
    body = body.withColumn("o", F.struct(*[F.col(f"o.{c}").cast("long").alias(c) for c in order]))
    own, size = Window.partitionBy("tag").orderBy("p", "o", "text"), F.greatest(F.length("text"), F.lit(1))
    first = head.unionByName(body).withColumn("nth", F.row_number().over(own)).filter(F.col("nth") <= maxlength)
    cut = first.withColumn("run", F.sum(size).over(Window.partitionBy("tag").orderBy("nth"))).filter(F.col("run") < maxlength)
    whole = Window.orderBy("tag", "nth")  # over so many rows
    top = cut.orderBy("tag", "nth").limit(maxlength)
    return top.withColumn("total", F.sum(size).over(whole)).withColumn("seq", F.row_number().over(whole)).filter(F.col("total") < maxlength).select("seq", "tag", "level", "text")


def html_report(report: DataFrame) -> DataFrame:
    """seq, html: a table row for each row of a long report, coloured by level; the texts are escaped."""
    colour = F.lit(COLOURS["OK"])
    for level, c in COLOURS.items():
        colour = F.when(F.col("level") == level, c).otherwise(colour)
    return report.select("seq", F.concat(F.lit('<tr style="background-color: '), colour, F.lit('"><td>'), html_escape(F.col("text")), F.lit("</td></tr>")).alias("html"))


def counters(read: DataFrame, matches: DataFrame, key: str = "tag") -> DataFrame:
    """key, lines, criticals, warnings, unknowns from read (key, lines), the lines before any prefilter; keys without matches have zeros."""
    found = matches.groupBy(key).agg(*_counts())
    names = ["lines", "criticals", "warnings", "unknowns"]
    return read.join(found, key, "full").select(key, *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def perf_text(counters: DataFrame, key: str = "tag") -> DataFrame:
    """key, perf: `'tag_lines'=n 'tag_warnings'=...`."""
    parts = [F.format_string(f"'%s_{n}'=%d", key, n) for n in ("lines", "warnings", "criticals", "unknowns")]
    return counters.select(key, F.concat_ws(" ", *parts).alias("perf"))


def alert_rate(matches: DataFrame, period: str, slide: str | None = None, key: tuple = (), when: str = "when") -> DataFrame:
    """key, window_start, n: alerts in tumbling or sliding windows; on a stream after withWatermark."""
    w = F.window(when, period, slide) if slide else F.window(when, period)
    return matches.groupBy(*key, w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(*key, F.col("w.start").alias("window_start"), "n")
