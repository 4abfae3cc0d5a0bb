"""Clusters of integer vectors around centroids, by Lloyd's rounds that only follow changes.

Assignments are kept as a written table, and so are the vectors with them; the sums and
counts of all clusters are kept as exact integers. In a round a vector whose centroid stayed
where it was compares its distance with the changed centroids alone; only vectors whose
centroid changed look at all. Vectors that go from one cluster to another are summed with
sign, in each task first, and these transfers are added to the sums. When no centroid
changed the rounds end early, as nothing can change any more.

Distances are squared Euclidean, ties go to the smaller number, and a new centroid is the
exact floor of sum / count in each component; one without vectors stays. Everything on the
driver is bounded by centroids x components.

Vectors that are null, of another number of components, or that hold null or non-finite ones
take no part. A component x becomes floor(scale * x); what does not fit 64 bits becomes the nearest
that does, and distances and their sums beyond 64 bits become the largest 64-bit number, after
they were compared exactly. Rows that repeat an id are vectors of their own, and those without id
too. Fewer vectors than centroids make as many centroids as there are vectors. An empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logscan.llm.common import written

LARGEST = (1 << 63) - 1
STATE = "id {}, v array<bigint>, cluster int, distance bigint, was int"


def usable(vectors: DataFrame, dim: int = 64, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id and v, the components as integers, of the vectors that take part."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(F.size("v") == dim)
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    return rows.select("id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, dim)


def distances(v: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Squared distances of the rows of v to centroids: exact, as 64-bit integers if they fit, else as Python's."""
    c = np.array(centroids, dtype=object).reshape(len(centroids), -1)
    largest = max(*(abs(int(x)) for x in (v.min(), v.max(), c.min(), c.max()) if v.size), 0, 0) if c.size and v.size else 0
    bits = largest.bit_length() + 1
    if 2 * bits + v.shape[1].bit_length() <= 52:  # every sum is exact in a double
        a, b = v.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)
    kind = np.int64 if 2 * bits + v.shape[1].bit_length() <= 62 else object
    a, b = v.astype(kind), c.astype(kind)
    return np.stack([((a - row) ** 2).sum(axis=1) for row in b], axis=1)


def nearest(v: np.ndarray, centroids: list[list[int]], changed: list[int], owner: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cluster and the distance of each vector, from its owner's number (-1: none yet) and its distance to that before the centroids of changed moved."""
    cluster, least = owner.copy(), distance.astype(object)
    again = (owner < 0) | np.isin(owner, changed)
    for rows, among in ((np.flatnonzero(again), list(range(len(centroids)))), (np.flatnonzero(~again), changed)):
        if not len(rows) or not among:
            continue
        found = distances(v[rows], [centroids[j] for j in among])
        best = found.argmin(axis=1)  # the first of equal ones
        number, value = np.array(among)[best], found[np.arange(len(rows)), best]
        if among is changed:
            better = (value < least[rows]) | ((value == least[rows]) & (number < cluster[rows]))
            rows, number, value = rows[better.astype(bool)], number[better.astype(bool)], value[better.astype(bool)]
        cluster[rows], least[rows] = number, value
    return cluster, least


def _assigned(state: DataFrame, centroids: list[list[int]], changed: list[int], dim: int) -> DataFrame:
    """state after its vectors have looked for nearer centroids; was is the cluster before."""
    kind = state.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = dict(zip(batch.schema.names, batch.columns, strict=True))
            owner, v = get["cluster"].to_numpy(zero_copy_only=False), _matrix(get["v"], dim)
            # a distance that was cut to 64 bits is computed anew
            kept = get["distance"].to_numpy(zero_copy_only=False)
            cluster, least = nearest(v, centroids, changed, np.where(kept == LARGEST, -1, owner), kept)
            capped = np.minimum(least, LARGEST).astype(np.int64)
            yield pa.RecordBatch.from_arrays([get["id"], get["v"], pa.array(cluster, pa.int32()), pa.array(capped), pa.array(owner, pa.int32())], names=["id", "v", "cluster", "distance", "was"])

    return written(state.mapInArrow(run, STATE.format(kind)))


def _transfers(state: DataFrame, dim: int) -> dict[int, tuple[int, list[int]]]:
    """By cluster, how many vectors came less how many left, and the same for their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # halves of 32 bits: sums of a task fit 64 bits whatever the components
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            get = dict(zip(batch.schema.names, batch.columns, strict=True))
            v = _matrix(get["v"], dim)
            parts = np.concatenate([np.ones((len(v), 1), np.int64), v >> 32, v & 0xFFFFFFFF], axis=1)
            for name, sign in (("cluster", 1), ("was", -1)):
                of = get[name].to_numpy(zero_copy_only=False)
                for j in np.unique(of[of >= 0]):
                    total[int(j)] = total.get(int(j), 0) + sign * parts[of == j].sum(axis=0)
        for j, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([j] * len(sums), pa.int32()), pa.array(np.arange(len(sums)), pa.int32()), pa.array(sums)], names=["cluster", "i", "n"])

    moved = state.filter("cluster <> was").select("v", "cluster", "was")
    sums = moved.mapInArrow(run, "cluster int, i int, n bigint").groupBy("cluster", "i").agg(F.sum(F.col("n").cast("decimal(20,0)")).alias("n"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in sums.collect():  # centroids x (1 + 2 x components) rows at most
        n, parts = out.setdefault(r["cluster"], (0, [0] * dim))
        if r["i"] == 0:
            out[r["cluster"]] = (int(r["n"]), parts)
        else:
            parts[(r["i"] - 1) % dim] += int(r["n"]) << (32 if r["i"] <= dim else 0)
    return out


def seeds(vectors: DataFrame, k: int, seed: int = 1) -> list[list[int]]:
    """The k vectors of the smallest hash of seed:id, ties by the vectors themselves."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    return [list(r["v"]) for r in vectors.select(key.alias("h"), "v").orderBy("h", "v").limit(k).collect()]


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """id, v, cluster, distance of the vectors that take part after so many rounds, and the centroids."""
    start = written(usable(vectors, dim, scale, id_col, vector_col))
    centroids = seeds(start, k)
    state = start.select("id", "v", F.lit(-1).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(-1).alias("was"))
    if not centroids:
        return state.select("id", "v", "cluster", "distance"), centroids
    counts, sums = [0] * len(centroids), [[0] * dim for _ in centroids]
    state = _assigned(state, centroids, list(range(len(centroids))), dim)
    for _ in range(rounds):
        for j, (n, parts) in _transfers(state, dim).items():
            counts[j] += n
            sums[j] = [a + b for a, b in zip(sums[j], parts, strict=True)]
        new = [[s // n for s in total] if n else old for n, total, old in zip(counts, sums, centroids, strict=True)]
        changed = [j for j, (a, b) in enumerate(zip(new, centroids, strict=True)) if a != b]
        if not changed:
            break
        centroids = new
        state = _assigned(state, centroids, changed, dim)
    return state.select("id", "v", "cluster", "distance"), centroids


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def with_inertia(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """assigned with cluster_inertia, inertia (sums of distances) and centroid_sha256."""
    each = {r["cluster"]: int(r["n"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("n")).collect()}
    total = min(LARGEST, sum(each.values()))
    rows = [(j, min(LARGEST, n), total, digest(centroids[j])) for j, n in each.items()]
    told = assigned.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(told), "cluster")  # a row for each centroid
