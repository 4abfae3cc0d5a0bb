"""What the operators share: reading tables, names that are free, columns made in Python by batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from logscan.tables import broadcast_if_small, is_small, shared_dir, written

__all__ = ["broadcast_if_small", "fresh", "is_small", "shared_dir", "table", "with_columns_from", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """names, each with underscores in front until docs has no column of it."""
    taken, out = {c.lower() for c in docs.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return out


def with_columns_from(docs: DataFrame, columns: dict[str, str], run: Callable[[pa.RecordBatch], list[pa.Array]], rows: int = 1000, done: Callable[[], None] | None = None) -> DataFrame:
    """docs with columns (name: SQL type) that run makes of Arrow batches of so many rows, last and in place of columns of these names; done ends a task.

    Spark bounds what goes to Python at a time in bytes (spark.sql.execution.arrow.maxBytesPerBatch);
    such a batch is handled in slices here, and the session's settings are left as they are.
    """
    lower = {c.lower() for c in columns}
    quoted = lambda n: f"`{n.replace('`', '``')}`"
    rest = [(i, f) for i, f in enumerate(docs.schema.fields) if f.name.lower() not in lower]
    schema = ", ".join([*(f"{quoted(f.name)} {f.dataType.simpleString()}" for _, f in rest), *(f"{quoted(n)} {t}" for n, t in columns.items())])
    places, names = [i for i, _ in rest], [*(f.name for _, f in rest), *columns]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in it:
                for at in range(0, batch.num_rows, rows):
                    part = batch.slice(at, rows)
                    yield pa.RecordBatch.from_arrays([*(part.column(i) for i in places), *run(part)], names=names)
        finally:
            if done:
                done()

    return docs.mapInArrow(batches, schema)
