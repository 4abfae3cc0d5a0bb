"""The ends of logs that have grown: lines from a byte on, where Spark's own text reader begins with the file.

A log whose first line is still the saved one is read on at the saved offset, so a run costs what has
come since the last one and not what the log holds. The ranges to read are the partitions of a
data source; a long tail is cut like any file, at most maxPartitionBytes a task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from logscan.sources.lines import COMPRESSED, decoded_line, width
from logscan.tables import is_small, written

#: What marks the file_path of lines that are read from a tail.
MARK = "tail:"
#: Bytes that are read at once, first and at most, multiples of the width of every line feed, and lines of a batch.
FIRST, CHUNK, BATCH = 64 << 10, 4 << 20, 10_000
#: File systems that a task can read from a byte on.
SCHEMES = r"^(?:/|file:|hdfs://|viewfs://|s3://|gs://)"


def can_seek(path: str) -> Column:
    """Whether a file of that path can be read from a byte on; others are read whole by Spark."""
    return F.col(path).rlike(SCHEMES) & ~F.col(path).rlike(COMPRESSED)


def _opened(path: str):
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if path.startswith("/"):
        return fs.LocalFileSystem().open_input_file(path)
    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def lines_from(file: BinaryIO, begin: int, stop: int, end: int, feed: bytes) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of the lines that begin in [begin, stop), read up to end at most.

    A line begins at begin if that is 0 or a line feed stands before it. A feed counts only at a multiple of its width, as in
    wider encodings its bytes can be parts of two signs. begin is such a multiple.
    """
    at = max(begin - len(feed), 0)
    file.seek(at)
    inside, parts, start, size = begin == 0, [], at, FIRST
    while at < end:
        chunk = file.read(min(size, end - at))
        size = min(2 * size, CHUNK)
        if not chunk:
            break
        cut, found = 0, chunk.find(feed)
        while found >= 0:
            if found % len(feed):
                found = chunk.find(feed, found + 1)
                continue
            if inside:
                yield start, b"".join([*parts, chunk[cut:found]])
            inside, parts, cut = True, [], found + len(feed)
            start = at + cut
            if start >= stop:
                return
            found = chunk.find(feed, cut)
        if inside:
            parts.append(chunk[cut:])
        at += len(chunk)
    if inside and start < min(stop, at):
        yield start, b"".join(parts)


class Tails(DataSource):
    """Lines of ranges of files. Options: groups (JSON: what each partition reads, a list of path, begin, stop and end), feed (hex), skip (files that cannot be read give no lines)."""

    @classmethod
    def name(cls) -> str:
        return "log_tails"

    def schema(self) -> str:
        return "path string, begin long, start_offset long, n long, line binary"

    def reader(self, schema) -> DataSourceReader:
        return TailsReader(dict(self.options))


class TailsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.groups, self.feed, self.skip = json.loads(options["groups"]), bytes.fromhex(options["feed"]), options["skip"] == "true"

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(g) for g in self.groups]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        for path, begin, stop, end in partition.value:
            try:
                with _opened(path) as file:
                    yield from self._batches(path, begin, lines_from(file, begin, stop, end, self.feed))
            except OSError:
                if not self.skip:
                    raise

    def _batches(self, path: str, begin: int, lines: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        starts, values, size, n = [], [], 0, 0
        while True:
            line = next(lines, None)
            if values and (line is None or len(values) == BATCH or size > CHUNK):
                k = len(values)
                yield pa.RecordBatch.from_arrays([pa.array([path] * k), pa.array([begin] * k, pa.int64()), pa.array(starts, pa.int64()), pa.array(range(n, n + k), pa.int64()), pa.array(values, pa.binary())], names=["path", "begin", "start_offset", "n", "line"])
                starts, values, size, n = [], [], 0, n + k
            if line is None:
                return
            starts.append(line[0])
            values.append(line[1])
            size += len(line[1])


def _grouped(spark: SparkSession, ranges: list[tuple[str, int, int, int]]) -> list[list[tuple[str, int, int, int]]]:
    """Ranges for each task: cut and packed by Spark's own settings for files."""
    conf = spark._jsparkSession.sessionState().conf()
    most, cost = max(conf.filesMaxPartitionBytes() // 4 * 4, 4), conf.filesOpenCostInBytes()
    cut = [(p, b, min(b + most, stop), end) for p, begin, stop, end in ranges for b in range(begin, stop, most)]
    slots = max(spark.sparkContext.defaultParallelism, 1)
    target = min(most, max(cost, sum(stop - b + cost for _, b, stop, _ in cut) // slots))
    out, size = [], target
    for r in cut:
        if size + r[2] - r[1] > target:
            out.append([])
            size = 0
        out[-1].append(r)
        size += r[2] - r[1] + cost
    return out


def read_ranges(spark: SparkSession, ranges: list[tuple[str, int, int, int]], encoding: str | None = None, skip: bool = False) -> DataFrame:
    """path, begin (of the part that a task reads), start_offset, n (from 0, in that part) and line (bytes) of the lines that begin in [begin, stop) of files up to end; ranges are (path, begin, stop, end)."""
    spark.dataSource.register(Tails)
    reader = spark.read.format("log_tails").option("groups", json.dumps(_grouped(spark, ranges))).option("feed", "\n".encode(encoding or "UTF-8").hex())
    return reader.option("skip", str(skip).lower()).load()


def measure(spark: SparkSession, files: list[tuple[str, int, int]], encoding: str | None = None) -> DataFrame:
    """path, begin, rows and fingerprint (of the first line, where begin is 0) of the first lines and of the parts of the tails of files (path, begin, end), written.

    Nothing between is read. A tail without a line that begins there has no part. Files that cannot be read are left out.
    """
    heads = [(p, 0, width(encoding), end) for p, _, end in files]
    rows = read_ranges(spark, heads + [(p, begin, end, end) for p, begin, end in files], encoding, skip=True)
    first = F.max(F.when(F.col("begin") == 0, F.xxhash64("line"))).cast("string").alias("fingerprint")
    return written(rows.groupBy("path", "begin").agg(F.count(F.lit(1)).alias("rows"), first))


def read_tails(spark: SparkSession, files: list[tuple[str, int, int, int]], parts: DataFrame, encoding: str | None = None) -> DataFrame:
    """file_path, line_no, start_offset, line of the tails of files (path, begin, end, lines before begin); parts as measured."""
    given = spark.createDataFrame([(p, seen) for p, _, _, seen in files], "path string, seen long")
    small = is_small(parts, size=64 << 20)
    before = Window.partitionBy("path").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)  # over the parts of a tail
    own = parts.filter("begin > 0").withColumn("base", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    bases = own.join(given, "path").select("path", "begin", (F.col("base") + F.col("seen")).alias("base"))
    text = read_ranges(spark, [(p, begin, end, end) for p, begin, end, _ in files], encoding)
    line = F.col("line").cast("string") if not encoding else _decoded(encoding)("line")
    rows = text.join(F.broadcast(bases) if small else bases, ["path", "begin"])
    return rows.select(F.concat(F.lit(MARK), "path").alias("file_path"), (F.col("base") + F.col("n")).alias("line_no"), "start_offset", line.alias("line"))


def _decoded(encoding: str):
    return F.pandas_udf(lambda lines: lines.map(lambda b: decoded_line(bytes(b), encoding)), "string")


def grown() -> Column:
    """Whether a log (with current, virtual, alone, length, logoffset, loglines, _print, path) can be read on at its offset, if its first line is still the same."""
    known = F.col("logoffset").isNotNull() & F.col("loglines").isNotNull() & F.col("_print").isNotNull()
    longer = (F.col("logoffset") > 0) & (F.col("length") > F.col("logoffset"))
    return F.coalesce(F.col("current") & ~F.col("virtual") & F.col("alone") & known & longer & can_seek("path"), F.lit(False))
