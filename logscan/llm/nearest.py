"""Nearest neighbours of a query set by a block matrix join over int8 tiles.

Vectors are dealt by hash of their id into blocks of bounded size, packed into one row
each. Query blocks meet all candidate blocks tile by tile: stripes of candidate blocks are
joined with query blocks on (dimension, query block, stripe), so the query set is never
broadcast. In a tile both sides are quantised to int8; the integer product gives every
inner product up to the bound |x| |y - y'| + |x - x'| |y'|, where x' and y' are what the
int8 values stand for. Pairs whose upper bound reaches the k-th largest lower bound are
recomputed in double precision from the original vectors, and heaps merge them: within a
task over the tiles of a stripe, then over the stripes by a top-k window per query.

The answer is exact: no pair that can be among the k nearest is lost. Of vectors that are
equal a tile keeps the k + 1 smallest ids, as no other copy can be among k results.

Vectors that are null, all zero, or hold null or non-finite components take no part, nor
do rows without id; vectors meet only those of the same dimension. Rows that repeat an id
count once, with the largest of their vectors. Equal scores rank by the smaller id. An
empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logscan.llm.common import broadcast_if_small, written

#: Vectors of a block, and bytes of a block's vectors, at most.
BLOCK, BLOCK_BYTES = 2048, 4 << 20
STRIPES = 8


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, dim, v (array<double>) of the vectors that take part."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.filter(F.col("id").isNotNull() & v.isNotNull() & finite & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def once(rows: DataFrame) -> DataFrame:
    """The largest vector of each id and dimension. Ids are counted first, so that only vectors of ids that repeat are shuffled for it; those of an id are reduced where they are before they meet."""
    key = ["id", "dim"]
    again = written(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*key))
    if not again.limit(1).count():
        return rows
    again = broadcast_if_small(again)
    largest = rows.join(again, key, "left_semi").groupBy(*key).agg(F.max("v").alias("v"))
    return rows.join(again, key, "left_anti").select(*key, "v").unionByName(largest)


def _pack(table: pa.Table) -> pa.Table:
    """One block: ids ascending, and the matrix of their vectors."""
    ids = table.column("id").to_numpy()
    dim = table.column("dim")[0].as_py()
    v = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    order = np.argsort(ids)
    return pa.table({"dim": pa.array([dim], pa.int32()), "block": table.column("block").slice(0, 1), "ids": pa.array([ids[order].tobytes()], pa.binary()), "vectors": pa.array([np.ascontiguousarray(v[order]).tobytes()], pa.binary())})


def _blocks(rows: DataFrame, count: int) -> DataFrame:
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(count)).cast("int"))
    return dealt.groupBy("dim", "block").applyInArrow(_pack, "dim int, block int, ids binary, vectors binary")


def _quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, their scale, and the norms of what they stand for and of the rest."""
    scale = np.maximum(np.abs(x).max(axis=1), 1e-300) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    stand = q * scale[:, None]
    return q, scale, np.linalg.norm(stand, axis=1), np.linalg.norm(x - stand, axis=1)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The integer product of int8 matrices; float32 holds it without rounding for 1,024 columns at a time."""
    out = np.zeros((len(a), len(b)), np.float64)
    for at in range(0, a.shape[1], 1024):
        out += a[:, at : at + 1024].astype(np.float32) @ b[:, at : at + 1024].astype(np.float32).T
    return out


def tile(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple[int, list[tuple[float, int]]]]:
    """For each query its k nearest of the tile as (-score, id), by position of the query."""
    kinds, kind = np.unique(c, axis=0, return_inverse=True)
    if len(kinds) < len(c):
        order = np.argsort(kind, kind="stable")  # ids ascend
        nth = np.arange(len(c)) - np.searchsorted(kind[order], kind[order])
        keep = np.sort(order[nth <= k])
        ids, c = ids[keep], c[keep]
    (qa, sa, _, ra), (qb, sb, nb, rb) = _quantised(q), _quantised(c)
    guess = _product(qa, qb) * sa[:, None] * sb[None, :]
    bound = np.linalg.norm(q, axis=1)[:, None] * rb[None, :] + ra[:, None] * nb[None, :]
    bound += 1e-9 * np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(c, axis=1)[None, :]
    own = query_ids[:, None] == ids[None, :]
    low = np.where(own, -np.inf, guess - bound)
    at_least = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k] if low.shape[1] > k else np.full(len(q), -np.inf)
    i, j = np.nonzero((guess + bound >= at_least[:, None]) & ~own)
    score = np.zeros(len(i))
    for d in range(q.shape[1]):
        score += q[i, d] * c[j, d]
    ends = np.searchsorted(i, np.arange(len(q) + 1))
    for n in range(len(q)):
        part = slice(ends[n], ends[n + 1])
        yield n, heapq.nsmallest(k, zip((-score[part]).tolist(), ids[j[part]].tolist(), strict=True))


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _tiles(k: int):
    """Of joined blocks the k nearest of each query, merged over the tiles of a query block that follow on each other."""

    def flush(ids: np.ndarray, best: list[list[tuple[float, int]]]) -> pa.RecordBatch:
        rows = [(int(i), x[1], -x[0]) for i, found in zip(ids, best, strict=True) for x in found]
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in enumerate(_FOUND.types)], schema=_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, query_ids, q, best = None, None, None, []
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name: batch.column(name)[row].as_py()  # noqa: B023, E731
                dim = get("dim")
                if key != (dim, get("query_block"), get("stripe")):
                    if key is not None:
                        yield flush(query_ids, best)
                    key = (dim, get("query_block"), get("stripe"))
                    query_ids = np.frombuffer(get("query_ids"), np.int64)
                    q = np.frombuffer(get("query_vectors"), np.float64).reshape(-1, dim)
                    best = [[] for _ in query_ids]
                ids, c = np.frombuffer(get("ids"), np.int64), np.frombuffer(get("vectors"), np.float64).reshape(-1, dim)
                for n, found in tile(query_ids, q, ids, c, k):
                    best[n] = heapq.nsmallest(k, best[n] + found) if best[n] else found
        if key is not None:
            yield flush(query_ids, best)

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: of each row where is_query holds the k others of the largest inner product."""
    rows = once(usable(vectors, id_col, vector_col))
    queries = once(usable(vectors.filter(is_query), id_col, vector_col))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max("dim").alias("dim")).first()
    asked = queries.count()
    per_block = max(32, min(BLOCK, BLOCK_BYTES // (8 * max(1, size["dim"] or 1))))
    n_blocks, n_query_blocks = max(1, math.ceil(size["n"] / per_block)), max(1, math.ceil(asked / per_block))
    stripes = min(n_blocks, max(STRIPES, math.isqrt(n_blocks)))
    c = _blocks(rows, n_blocks).withColumn("stripe", F.col("block") % stripes).withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(n_query_blocks - 1))))
    q = _blocks(queries, n_query_blocks).select("dim", F.col("block").alias("query_block"), F.col("ids").alias("query_ids"), F.col("vectors").alias("query_vectors"))
    q = q.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
    joined = c.hint("merge").join(q, ["dim", "query_block", "stripe"]).select("dim", "query_block", "stripe", "ids", "vectors", "query_ids", "query_vectors")
    found = joined.mapInArrow(_tiles(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
