"""Log text as ordered lines."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import datetime
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logscan.tables import broadcast_if_small, written

COMPRESSED = r"\.(gz|bz2)$"


def _changed(spark: SparkSession, name: str) -> datetime:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return datetime.fromtimestamp(path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getModificationTime() / 1000)


def list_files(spark: SparkSession, paths: list[str], recursive: bool = True, glob: str | None = None, levels: int | None = None) -> DataFrame:
    """path, mtime, length of files; their content is not read. levels: how many folders below paths are looked into."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    found = reader.load(paths)
    files = found.select(F.col("path"), F.col("modificationTime").alias("mtime"), F.col("length"))
    # the reader passes over empty files
    names = spark.createDataFrame([(unquote(n),) for n in found.inputFiles()], "name string")
    empty = [r["name"] for r in names.join(files, plain_path("name") == plain_path("path"), "left_anti").collect()]
    if empty:
        files = files.unionByName(spark.createDataFrame([(n, _changed(spark, n), 0) for n in empty], "path string, mtime timestamp, length long"))
    if levels is None:
        return files
    depth = lambda p: F.size(F.split(F.regexp_replace(p, "^[a-z]+:/*|^/+", ""), "/"))
    within = [F.contains(F.col("path"), F.lit(p.rstrip("/") + "/")) & (depth(F.col("path")) - depth(F.lit(p.rstrip("/"))) <= levels + 1) for p in paths]
    out = within[0]
    for w in within[1:]:
        out = out | w
    return files.filter(out)


def plain_path(name: str) -> Column:
    """A path as it is, whichever way a local one is written."""
    return F.regexp_replace(name, "^file:/+", "/")


def metadata_path(name: str) -> Column:
    """The same for a path as Spark's readers tell it of a row, where some signs are encoded."""
    return F.regexp_replace(F.url_decode(F.replace(F.col(name), F.lit("+"), F.lit("%2B"))), "^file:/+", "/")


def width(encoding: str | None) -> int:
    """Bytes of a line feed."""
    n = len("\n".encode(encoding or "UTF-8"))
    if len("\n\n".encode(encoding or "UTF-8")) != 2 * n:  # it writes a mark in front
        raise ValueError(f"{encoding}: name the order of bytes, as in {encoding}LE")
    return n


def _text(spark: SparkSession, paths: list[str], recursive: bool, encoding: str | None = None) -> DataFrame:
    """The lines of files, cut at line feeds of the encoding, as the bytes that they are."""
    reader = spark.read.option("lineSep", "\n").option("recursiveFileLookup", str(recursive).lower())
    text = (reader.option("encoding", encoding) if width(encoding) > 1 else reader).text(paths)
    meta = [F.col(f"_metadata.{a}").alias(b) for a, b in (("file_path", "file_path"), ("file_modification_time", "file_mtime"), ("file_size", "size"), ("file_block_start", "block"))]
    return text.select(*meta, F.col("value").alias("line"))


def measure(spark: SparkSession, paths: list[str], recursive: bool = True, larger: int | None = None, encoding: str | None = None) -> DataFrame:
    """file_path, size, block, rows, bytes (line feeds included), first (a hash of the first line) and content (one of all) of each split of the files.

    One pass over the text; only these sums are shuffled. larger: only files of more bytes.
    """
    rows = _text(spark, paths, recursive, encoding)
    rows = rows if larger is None else rows.filter(F.col("size") > larger)
    hashed = F.xxhash64("line")
    sums = [F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("line") + width(encoding)).alias("bytes"), F.min_by(hashed, F.col("_id")).alias("first"), F.sum(hashed.cast("decimal(20,0)")).alias("content")]
    return rows.withColumn("_id", F.monotonically_increasing_id()).groupBy("file_path", "size", "block").agg(*sums)


#: Files that cannot be read are found one by one, so many times; if there are more, halves of the rest are tried apart.
ONE_BY_ONE = 3


def measure_each(spark: SparkSession, names: list[str], encoding: str | None = None) -> tuple[DataFrame | None, list[str]]:
    """What measure tells of the files, written (None if there are none), and the files that cannot be read.

    All are read in one pass. If it fails at a file, that one is left out and the others are read again; with many such files
    halves of the rest are, so that one costs a number of passes over ever smaller parts that is logarithmic.
    """
    good, bad, todo = [], [], [list(names)] if names else []
    while todo:
        part = todo.pop()
        try:
            good.append(written(measure(spark, part, encoding=encoding)))
        except Exception as e:
            if "FAILED_READ_FILE" not in str(e) and "FILE_NOT_EXIST" not in str(e):
                raise
            told = unquote(str(e))
            named = [n for n in part if f"{_plain(n)}" in told] if len(part) > 1 else part
            named = [max(named, key=len)] if named else []
            bad += named
            rest = [n for n in part if n not in named]
            half = len(rest) // 2
            todo += [x for x in ([rest] if named and len(bad) <= ONE_BY_ONE else [rest[:half], rest[half:]]) if x]
    out = None
    for g in good:
        out = g if out is None else out.unionByName(g)
    return out, sorted(bad)


def _plain(path: str) -> str:
    return re.sub("^file:/+", "/", path)


def measured_files(splits: DataFrame) -> DataFrame:
    """file_path, rows, end (the offset after the last line), fingerprint (of the first line, null if that may not be complete) and content of each file."""
    files = splits.groupBy("file_path").agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.max("size").alias("size"), F.min_by("first", "block").alias("first"), F.sum("content").alias("content"))
    plain = ~F.col("file_path").rlike(COMPRESSED)
    whole = (F.col("rows") > 1) | ~plain | (F.col("bytes") <= F.col("size"))
    return files.select("file_path", "rows", F.when(plain, F.least("bytes", "size")).otherwise(F.col("bytes")).alias("end"), F.when(whole, F.col("first").cast("string")).alias("fingerprint"), F.col("content").cast("string").alias("content"))


def decoded_line(line: bytes, encoding: str) -> str:
    """The text of a line; signs beyond ASCII become `?`, and carriage returns line feeds."""
    text = line.decode(encoding, "replace").replace("\r\n", "\n").replace("\r", "\n")
    return text.removesuffix("\n").encode("ascii", "replace").decode()


def _numbered(encoding: str | None) -> Callable:
    """Adds the number of each line in its split and the bytes up to its end; the lines of a split follow on each other in a task.

    With an encoding lines are decoded, signs beyond ASCII become `?`, and carriage returns line feeds. A line feed that begins
    within a sign is none: the lines around it are of odd length, and are put together again.
    """
    feed = width(encoding)

    def decoded(values: list[bytes], held: list[bytes]) -> list[str | None]:
        """The texts; None for a part that goes on in the next line. held: such parts so far."""
        out = []
        for value in values:
            held.append(value)
            whole = "\n".encode(encoding).join(held)
            if len(whole) % feed and len(held) == 1:
                out.append(None)
                continue
            held.clear()
            out.append(decoded_line(whole, encoding))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, bytes_, held = None, 0, 0, []
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            path, block = batch.column("file_path"), batch.column("block").to_numpy(zero_copy_only=False)
            sizes = pc.binary_length(batch.column("line")).to_numpy(zero_copy_only=False).astype(np.int64) + feed
            new = np.zeros(n, dtype=bool)
            new[0] = key != (path[0].as_py(), block[0])
            new[1:] = (block[1:] != block[:-1]) | pc.not_equal(path.slice(1), path.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            total, place = np.cumsum(sizes), np.arange(1, n + 1)
            starts = np.flatnonzero(new)
            of = np.cumsum(new) - 1  # -1: goes on from the batch before
            number, end = place.copy(), total.copy()
            if len(starts):
                later = of >= 0
                number[later] -= starts[of[later]]
                end[later] -= (total - sizes)[starts[of[later]]]
            number[of < 0] += rows
            end[of < 0] += bytes_
            key, rows, bytes_ = (path[n - 1].as_py(), block[n - 1]), int(number[-1]), int(end[-1])
            columns = dict(zip(batch.schema.names, batch.columns, strict=True)) | {"n": pa.array(number), "bytes": pa.array(end)}
            if encoding:
                raw, texts, at = columns["line"].to_pylist(), [], 0
                for stop in [*(int(x) for x in starts if x), n]:
                    if new[at]:
                        held.clear()
                    texts += decoded(raw[at:stop], held)
                    at = stop
                columns["line"] = pa.array(texts, pa.string())
            out = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
            yield out if not encoding else out.filter(pc.is_valid(columns["line"]))

    return run


def _smallest_split(spark: SparkSession) -> int:
    """Bytes of a file that is never split."""
    context = spark._jsparkSession.sessionState().conf()
    return min(context.filesOpenCostInBytes(), context.filesMaxPartitionBytes())


def read_lines(spark: SparkSession, paths: list[str], host: str | None = None, encoding: str | None = None, recursive: bool = True, splits: DataFrame | None = None) -> DataFrame:
    """host, logfile, file_path, file_mtime, line_no (from 0), start_offset, end_offset, line.

    Only line feeds end a line. .gz and .bz2 files are read by their suffix. Lines are numbered
    where they are read, in one pass over each split, and no text is shuffled. A split of a larger file
    begins where those before it end: splits (of measure) tells, else the larger files are
    measured first. With an encoding lines are decoded, and signs beyond ASCII become `?`; offsets are those of the file. What
    is split before it is decoded needs no task to hold a file, so files of all encodings are read in splits.
    """
    rows = _text(spark, paths, recursive, encoding)
    if splits is None:
        splits = measure(spark, paths, recursive, larger=_smallest_split(spark), encoding=encoding)
    bases = None
    if splits.filter("block > 0").limit(1).count():
        before = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # over the splits of a file
        sums = splits.select(F.xxhash64("file_path").alias("file"), "block", F.sum("rows").over(before).alias("base_rows"), F.sum("bytes").over(before).alias("base"))
        bases = written(sums.filter("base is not null"))
    line = F.col("line").cast("binary") if encoding else F.col("line")
    rows = rows.select("file_path", "file_mtime", "size", "block", line.alias("line"), (F.octet_length("line") + width(encoding)).cast("long").alias("took"))
    out = rows.mapInArrow(_numbered(encoding), "file_path string, file_mtime timestamp, size long, block long, line string, took long, n long, bytes long")
    if bases is not None:
        out = out.withColumn("file", F.xxhash64("file_path")).join(broadcast_if_small(bases, rows=2_000_000, size=64 << 20), ["file", "block"], "left")
        out = out.withColumns({"base_rows": F.coalesce("base_rows", F.lit(0)), "base": F.coalesce("base", F.lit(0))})
    else:
        out = out.withColumns({"base_rows": F.lit(0).cast("long"), "base": F.lit(0).cast("long")})
    end = F.col("base") + F.col("bytes")
    compressed = F.col("file_path").rlike(COMPRESSED)
    return out.select(
        F.lit(host).alias("host"),
        F.regexp_extract("file_path", r"([^/]+)$", 1).alias("logfile"),
        "file_path",
        "file_mtime",
        (F.col("base_rows") + F.col("n") - 1).alias("line_no"),
        (end - F.col("took")).alias("start_offset"),
        F.when(compressed, end).otherwise(F.least(end, F.col("size"))).alias("end_offset"),
        "line",
    )


def fingerprint(lines: DataFrame) -> DataFrame:
    """file_path, fingerprint: a hash of the first line, as object stores have no inodes."""
    return lines.filter("line_no = 0").select("file_path", F.xxhash64("line").cast("string").alias("fingerprint"))


def text_lines(docs: DataFrame, text: str, logfile: str, seq: str) -> DataFrame:
    """Lines of a table of texts: logfile, file_seq and line_no from 0."""
    return docs.select(F.lit("all").alias("host"), F.col(logfile).cast("string").alias("logfile"), F.col(seq).cast("long").alias("file_seq"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))
