"""Sticky alerts: matches that stay over runs until an all-clear line or until they are too old."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logscan.model import KEY, TEN_YEARS


def apply_sticky(new: DataFrame, kept: DataFrame, clear: DataFrame, now, seconds: int = TEN_YEARS, key: tuple = KEY, also: tuple = ()) -> DataFrame:
    """key, level, when, message (and the columns also) that stand after this run.

    new and kept have these columns; of kept those of keys with an all-clear line (clear: key,
    ok_when) or older than seconds go, of new those not after that line.
    """
    cols = [*key, "level", "when", "message", *also]
    both = kept.select(*cols, F.lit(True).alias("_old")).unionByName(new.select(*cols, F.lit(False).alias("_old")))
    held = both.join(clear.select(*key, "ok_when"), list(key), "left")
    young = F.unix_timestamp(F.lit(now)) - F.unix_timestamp("when") <= seconds
    after = F.col("ok_when").isNull() | (~F.col("_old") & (F.col("when") > F.col("ok_when")))
    return held.filter(after & (young | ~F.col("_old"))).select(*cols)


def compact_sticky(matches: DataFrame, key: tuple = KEY) -> DataFrame:
    """key, level, when (whole seconds), n, and the level's last message, for short reports."""
    rows = matches.withColumn("when", F.date_trunc("second", "when"))
    per_second = rows.groupBy(*key, "level", "when").agg(F.count(F.lit(1)).alias("n"))
    last = matches.groupBy(*key, "level").agg(F.max_by("message", F.struct("when", "message")).alias("last_message"))
    return per_second.join(last, [*key, "level"])
