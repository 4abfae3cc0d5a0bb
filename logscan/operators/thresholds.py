"""Every-Nth thresholds with carry between runs.

The counter of a level needs no loop: with the count c carried over (0 after an all-clear
line) the k-th match is reported if (c + k) mod N = 0, and (c + total) mod N is carried on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logscan.model import KEY, ORD, Search
from logscan.tables import BROADCAST_ROWS

#: Lines of a file that a hot key's matches are numbered in at a time.
RUN = 100_000


def with_every(matches: DataFrame, searches: list[Search]) -> DataFrame:
    """matches (tag, level) with every, the threshold of its tag and level, 1 if there is none: a table of rows, so that the plan does not grow with the searches."""
    rows = [(s.tag, level.upper(), n) for s in searches for level, n in s.threshold.items() if n > 1]
    if not rows:
        return matches.withColumn("every", F.lit(1))
    given = matches.sparkSession.createDataFrame(rows, "tag string, level string, every int")
    joined = matches.join(F.broadcast(given) if len(rows) <= BROADCAST_ROWS else given, ["tag", "level"], "left").select(*matches.columns, "every")
    return joined.withColumn("every", F.coalesce("every", F.lit(1)))


def run_of_lines() -> Column:
    """A run of lines of one file, for numbering in runs."""
    return F.struct("file_seq", F.floor(F.col("line_no") / RUN).alias("part"))


def numbered(matches: DataFrame, key: tuple = (*KEY, "level"), order: tuple = (*ORD, "pat_pos"), hot: str | None = None) -> DataFrame:
    """matches with k, the place of each in its key.

    With hot, a column that splits a key into runs in the order of scan (such as file_seq), a
    key's matches are counted per run first, the runs' sums are added up, and rows are numbered
    within runs only, so that a key with most of the matches is not sorted in one task.
    """
    if hot is None:
        return matches.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    runs = matches.groupBy(*key, hot).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*key).orderBy(hot).rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*key, hot).orderBy(*order))
    return matches.withColumn("_in", inside).join(runs, [*key, hot]).withColumn("k", F.col("_before") + F.col("_in")).drop("_in", "_before")


def apply_threshold(matches: DataFrame, n: int | Column, carry: DataFrame | None = None, key: tuple = (*KEY, "level"), order: tuple = (*ORD, "pat_pos"), hot: str | None = None) -> DataFrame:
    """Every n-th match of a key, counted on from carry (key, carry); n may be a column that the key determines."""
    if isinstance(n, int) and n <= 1:
        return matches
    rows = numbered(matches, key, order, hot)
    if carry is not None:
        rows = rows.join(carry.select(*key, F.col("carry").alias("_c")), list(key), "left")
    c = F.coalesce(F.col("_c"), F.lit(0)) if carry is not None else F.lit(0)
    return rows.filter((c + F.col("k")) % n == 0).drop("k", "_c")


def next_carry(matches: DataFrame, n: int | Column | list[Search], carry: DataFrame | None = None, key: tuple = (*KEY, "level"), now=None) -> DataFrame:
    """key, carry: what the next run counts on from; n may be a column over the key, or the searches that have it.

    With now, the time of this run's matches, also threshold_times: when the hits carried on came, n - 1 at most.
    """
    total = matches.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    if carry is not None:
        total = total.join(carry.select(*key, "carry", *(["threshold_times"] if now is not None else [])), list(key), "full")
    if isinstance(n, list):
        total, n = with_every(total, n), F.col("every")
    c = F.coalesce("carry", F.lit(0)) if carry is not None else F.lit(0)
    hits = F.coalesce("_n", F.lit(0))
    after = ((c + hits) % n).cast("long")
    if now is None:
        return total.select(*key, after.alias("carry"))
    none = F.array().cast("array<timestamp>")
    before = F.coalesce("threshold_times", none) if carry is not None else none
    times = F.concat(before, F.array_repeat(F.lit(now).cast("timestamp"), F.least(hits, F.lit(n) if isinstance(n, int) else n).cast("int")))
    last = F.slice(times, F.size(times) - after.cast("int") + 1, after.cast("int"))
    return total.select(*key, after.alias("carry"), last.alias("threshold_times"))


def live_times(state: DataFrame, now, expiry: int) -> DataFrame:
    """state with the threshold_times that are not older than expiry seconds."""
    return state.withColumn("threshold_times", F.filter("threshold_times", lambda t: F.unix_timestamp(F.lit(now)) - F.unix_timestamp(t) <= expiry))


def live_carry(state: DataFrame, now, expiry: int, key: tuple = (*KEY, "level")) -> DataFrame:
    """key, carry from threshold_times: hits older than expiry seconds no longer count."""
    return live_times(state, now, expiry).select(*key, F.size("threshold_times").cast("long").alias("carry"))


def live_counts(hits: DataFrame, now, expiry: int, key: tuple = (*KEY, "level"), when: str = "when") -> DataFrame:
    """key, carry from a table of hits, a row each: the same without any list of times."""
    return hits.groupBy(*key).agg(F.count_if(F.unix_timestamp(F.lit(now)) - F.unix_timestamp(when) <= expiry).alias("carry"))
