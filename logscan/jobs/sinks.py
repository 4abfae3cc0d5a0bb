"""Protocols, states and results as tables."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logscan.model import VISITED

#: Versions of a state that stay; the older ones go.
KEPT = 2


def _names(spark: SparkSession, path: str) -> list[str]:
    """The names of what is in a folder, none if there is no such folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(place)] if fs.exists(place) else []


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def protocol(matches: DataFrame, run_ts) -> DataFrame:
    """run_date, tag, header, level, message of a run's matches."""
    header = F.concat("level", F.lit(" Errors in "), "logfile", F.lit(" (tag "), "tag", F.lit(")"))
    return matches.select(F.to_date(F.lit(run_ts)).alias("run_date"), "tag", header.alias("header"), "level", "file_seq", "line_no", "message")


def write_protocol(matches: DataFrame, path: str, run_ts, run: str = "0") -> None:
    """The protocol of a run, under its date and its name. A run that died and is repeated under its name takes the place of what it has written before."""
    spark = matches.sparkSession
    place = F.array_position(F.array(*[F.lit(v) for v in VISITED]), F.col("level"))
    rows = protocol(matches, run_ts).sortWithinPartitions("tag", place, "file_seq", "line_no")
    for day in _names(spark, path):
        if f"run={run}" in (_names(spark, f"{path}/{day}") if day.startswith("run_date=") else ()):
            _remove(spark, f"{path}/{day}/run={run}")
    rows.drop("run_date").write.mode("overwrite").partitionBy("tag").parquet(f"{path}/run_date={run_ts:%Y-%m-%d}/run={run}")


def text_protocol(rows: DataFrame) -> DataFrame:
    """tag, place, text: the lines of a protocol as text, a header before the matches of each tag and level."""
    head = rows.groupBy("tag", "level", "header").agg(F.count(F.lit(1)).alias("_n")).select("tag", "level", F.lit(-1).cast("long").alias("file_seq"), F.lit(-1).cast("long").alias("line_no"), F.concat(F.lit("#"), "header").alias("text"))
    body = rows.select("tag", "level", F.col("file_seq").cast("long").alias("file_seq"), "line_no", F.col("message").alias("text"))
    place = F.struct(F.array_position(F.array(*[F.lit(v) for v in VISITED]), F.col("level")).alias("level"), "file_seq", "line_no")
    return head.unionByName(body).select("tag", place.alias("place"), "text")


def keep_protocol(rows: DataFrame, today: date, days: int = 7, column: str = "run_date") -> DataFrame:
    """Rows of the last days."""
    return rows.filter(F.col(column) >= F.lit(today - timedelta(days=days)))


def drop_protocol(spark: SparkSession, path: str, today: date, days: int = 7) -> list[str]:
    """Removes the days of a protocol that keep_protocol would not keep, and names them."""
    first = f"run_date={today - timedelta(days=days):%Y-%m-%d}"
    old = sorted(n for n in _names(spark, path) if n.startswith("run_date=") and n < first)
    for n in old:
        _remove(spark, f"{path}/{n}")
    return old


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The states that are written to their end, ascending."""
    return sorted(int(n[8:]) for n in _names(spark, path) if n.startswith("version=") and "_SUCCESS" in _names(spark, f"{path}/{n}"))


def state_version(spark: SparkSession, path: str) -> int:
    """The number of the newest state, 0 before the first run."""
    return max(_versions(spark, path), default=0)


def save_state(state: DataFrame, path: str) -> int:
    """Writes a new version; it counts from when it is complete, so a run that dies before leaves the old state in force. Old versions go."""
    spark, new = state.sparkSession, state_version(state.sparkSession, path) + 1
    state.write.mode("overwrite").parquet(f"{path}/version={new}")
    for n in _versions(spark, path)[:-KEPT]:
        _remove(spark, f"{path}/version={n}")
    return new


def load_state(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest state, or None before the first run."""
    newest = state_version(spark, path)
    return spark.read.parquet(f"{path}/version={newest}") if newest else None


def write_results(results: DataFrame, path: str, run_ts) -> None:
    results.withColumn("runtime", F.lit(run_ts)).write.mode("append").parquet(path)
