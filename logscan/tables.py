"""Tables between jobs: written intermediate tables, and broadcasts of checked size."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest table that is broadcast, in rows and in bytes of its values; both are measured first.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; on a local master, where it is unset, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="logscan-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/logscan-{spark.sparkContext.applicationId}"


def written(df: DataFrame) -> DataFrame:
    """df, computed once into a Parquet table of the shared folder and read from there.

    It cuts the lineage so that a lost executor costs a reread and not a rerun. The
    tables go with the application's folder, which a cluster clears after the run.
    """
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _width(value: Column, kind: T.DataType) -> Column:
    """Bytes of a value, about: 8 for numbers, and the lengths of what varies."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 8
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.aggregate(value, F.lit(0).cast("long"), lambda n, x: n + _width(x, kind.elementType)), F.lit(0)) + 8
    if isinstance(kind, T.StructType):
        return reduce(add, [_width(value[f.name], f.dataType) for f in kind.fields], F.lit(8))
    return F.lit(8)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether df, which should be written(), has no more rows and bytes than that; no more than rows + 1 rows are looked at."""
    found = df.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(reduce(add, [_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields]))).first()
    return found[0] <= rows and (found[1] or 0) <= size


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it is small, else df for a shuffled join. df should be written()."""
    return F.broadcast(df) if is_small(df, rows, size) else df
