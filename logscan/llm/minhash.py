"""MinHash near-dedup with circulant permutations.

A document is the set of its distinct shingles. One permutation of the 32-bit hashes scatters
them, a second one, shifted circularly by k, gives signature coordinate k: all coordinates
come from two permutations. Bands of coordinates put documents into buckets; with 28 bands of
4 rows a pair of similarity 0.8 misses all buckets with a chance of 4e-7.

Equal sets become one class first, with the smallest doc_id for all its members, so copies
cost one row. Then links are confirmed on full shingle sets:

1. In every bucket each member is compared with the bucket's smallest, the hub; a hub of many
   members is copied for each thousand of them.
2. Components of these links are found. A bucket of one component is done; in the others all
   pairs across components are compared, in tiles: members are dealt into blocks of bounded
   bytes and bounded numbers of members, and each pair of blocks is one task that multiplies the incidence matrices of the
   shingles that several members share. A tile sends the links that join components within it.

So no bucket is gathered in one task and no pair between different sets is lost for the
components; pairs in one component already are not compared again.

A null text, or one without words, has no shingles and is linked with nothing. A text with
fewer words than a shingle has its whole sequence as its only one. Rows without doc_id are
linked with nothing: component_id is null and kept true. Rows that repeat a doc_id with the
same shingles are one class and are kept or dropped together. An empty table gives no rows.
Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logscan.llm.common import broadcast_if_small, written
from logscan.llm.components import components
from logscan.llm.tokens import U64, Words, chunks, grams, mix

BANDS, ROWS = 28, 4
#: Bytes of shingle hashes of a block of a bucket.
BLOCK_BYTES = 4 << 20
#: Members of a block, on average; a tile's matrix has twice as many rows and columns.
BLOCK_MEMBERS = 2000
#: Pairs of a bucket's hub that are confirmed with one copy of its set.
PAIRS = 1000
#: Rows of a tile's matrix that are compared at a time.
STRIP = 256
U32 = np.uint32


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, ascending, and where each text's begin and the last ones end."""
    docs = len(words.counts)
    n = max(0, len(words.hash) - size + 1)
    g, doc = grams(words.hash, size), words.doc[:n]
    whole = doc == words.doc[size - 1 :][:n]
    parts, of = [g[whole]], [doc[whole]]
    for short in range(1, size):
        at = np.flatnonzero(words.counts == short)
        if len(at):
            parts.append(mix(grams(words.hash, short)[words.first[at]] + U64(short)))
            of.append(at)
    g, doc = np.concatenate(parts), np.concatenate(of)
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    new = np.ones(len(g), dtype=bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    g, doc = g[new], doc[new]
    return g, np.searchsorted(doc, np.arange(docs + 1))


def signatures(g: np.ndarray, begins: np.ndarray, coordinates: int) -> np.ndarray:
    """A row of signature coordinates for each set; begins: where the sets, none of them empty, begin in g."""
    x = (g >> U64(32)).astype(U32)
    x ^= x >> U32(15)
    x *= U32(0x2C1B3C6D)
    x ^= x >> U32(12)
    x *= U32(0x297A2D39)  # the first permutation
    out, t, s = np.empty((coordinates, len(begins)), U32), np.empty_like(x), np.empty_like(x)
    for k in range(coordinates):
        np.subtract(x, U32(k), out=t)  # the second one, shifted by k
        np.right_shift(t, U32(16), out=s)
        t ^= s
        t *= U32(0x85EBCA6B)
        np.right_shift(t, U32(13), out=s)
        t ^= s
        t *= U32(0xC2B2AE35)
        np.minimum.reduceat(t, begins, out=out[k])
    return out.T


def _sketch(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, bounds in chunks(batch.column("text")):
                g, at = shingle_sets(Words(data, bounds, lower=True), size)
                n = np.diff(at)
                some = np.flatnonzero(n)
                a, b, keys = np.zeros(len(n), U64), np.zeros(len(n), U64), np.empty((0, bands), U64)
                if len(some):
                    begins = at[:-1][some]
                    a[some] = np.add.reduceat(mix(g + U64(1)), begins)
                    b[some] = np.add.reduceat(mix(g ^ U64(0x5851F42D4C957F2D)), begins)
                    sig = signatures(g, begins, bands * rows).astype(U64).reshape(len(some), bands, rows)
                    keys = np.zeros((len(some), bands), U64)
                    for r in range(rows):
                        keys = mix(keys + sig[:, :, r] + U64(r + 1))
                ends = np.cumsum(np.where(n > 0, bands, 0))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
                cols = [batch.column("doc_id").slice(row, end - row), pa.array(n, pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), lists]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "a", "b", "bands"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, bounds in chunks(batch.column("text")):
                g, at = shingle_sets(Words(data, bounds, lower=True), size)
                sets = pa.array([g[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, end - row), sets], names=["doc_id", "shingles"])

    return run


def _confirm(percent: int):
    """Of rows (a, b, x, y: the sets of a and b) the links."""

    def linked(x: bytes, y: bytes) -> bool:
        p, q = np.frombuffer(x, U64), np.frombuffer(y, U64)
        if len(p) > len(q):
            p, q = q, p
        if not len(p):
            return False
        at = np.searchsorted(q, p)
        at[at == len(q)] = 0
        both = int((q[at] == p).sum())
        return 100 * both >= percent * (len(p) + len(q) - both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            keep = pa.array([linked(x[i].as_py(), y[i].as_py()) for i in range(batch.num_rows)], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    return run


def _tile(percent: int):
    """Of a tile (rep, component, block, shingles of its members) links that join different components."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rep")
        rep, comp = table.column("rep").to_numpy(), table.column("component").to_numpy()
        sets = [np.frombuffer(x, U64) for x in table.column("shingles").to_pylist()]
        n = np.array([len(s) for s in sets])
        member = np.repeat(np.arange(len(sets)), n)
        _, kind, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = times[kind] > 1
        column = np.cumsum(times > 1) - 1
        kind, member = column[kind[shared]], member[shared]
        both = np.zeros((len(sets), len(sets)), np.float32)
        order = np.argsort(kind, kind="stable")
        kind, member = kind[order], member[order]
        width = max(1, (16 << 20) // max(1, len(sets)))
        for at in range(0, int(kind[-1]) + 1 if len(kind) else 0, width):
            part = slice(*np.searchsorted(kind, [at, at + width]))
            m = np.zeros((len(sets), width), np.float32)
            m[member[part], kind[part] - at] = 1
            both += m @ m.T
        links, label = [], comp.copy()  # label: the component with what the tile has joined so far
        for at in range(0, len(sets), STRIP):
            common = both[at : at + STRIP].astype(np.int64)
            near = 100 * common >= percent * (n[at : at + STRIP, None] + n[None, :] - common)
            for p, row in enumerate(near, at):
                while len(other := np.flatnonzero(row[p + 1 :] & (label[p + 1 :] != label[p]))):
                    q = p + 1 + other[0]
                    links.append((int(rep[p]), int(rep[q])))
                    label[label == label[q]] = label[p]
        return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links), kept (doc_id = component_id).

    Documents are linked if 100 * intersection >= percent * union of their sets of distinct shingles of size words.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = written(docs.mapInArrow(_sketch(size, bands, rows), "doc_id long, n long, a long, b long, bands array<long>"))
    named = sketches.filter("n > 0 and doc_id is not null")
    classes = written(named.groupBy("a", "b", "n").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")))

    placed = classes.select("rep", "n", F.posexplode("bands").alias("band", "key"))
    buckets = placed.groupBy("band", "key").agg(F.min(F.struct("rep", "n")).alias("hub"), F.count(F.lit(1)).alias("members"), F.sum(F.xxhash64("rep").cast("decimal(20,0)")).alias("bucket"), F.sum("n").alias("total"))
    # buckets of the same members in several bands are one
    buckets = buckets.filter("members > 1").groupBy("bucket", "hub", "members", "total").agg(F.min(F.struct("band", "key")).alias("at"))
    buckets = written(buckets.select("bucket", F.col("hub.rep").alias("hub"), F.col("hub.n").alias("hub_n"), "members", "total", F.col("at.band").alias("band"), F.col("at.key").alias("key")))
    inside = written(placed.join(broadcast_if_small(buckets), ["band", "key"]).select("bucket", "rep", "n", "hub", "hub_n", "members", "total"))

    wanted = broadcast_if_small(written(inside.select(F.col("rep").alias("wanted")).distinct()))
    texts = docs.join(wanted, F.col("doc_id") == F.col("wanted")).select("doc_id", "text")
    sets = written(texts.mapInArrow(_sets(size), "doc_id long, shingles binary"))

    near = 100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")
    pairs = written(inside.filter((F.col("rep") != F.col("hub")) & near).select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct())
    # the set of a hub goes out once for so many of its pairs, so that those of a large bucket are in many tasks
    hubs = broadcast_if_small(written(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS).cast("int").alias("copies"))))
    pairs = pairs.join(hubs, "a").withColumn("copy", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int")).drop("copies")
    left = sets.withColumnRenamed("doc_id", "a").join(hubs, "a").select("a", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.col("shingles").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    links = written(pairs.join(right, "b").join(left, ["a", "copy"]).select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a long, b long"))
    roots = components(links)

    component = F.coalesce("v", "rep").alias("component")
    inside = inside.filter("members > 2").join(roots, F.col("rep") == F.col("u"), "left").select("bucket", "rep", "members", "total", component)
    split = written(inside.groupBy("bucket").agg(F.min("component").alias("p"), F.max("component").alias("q")).filter("p <> q").select("bucket"))
    open_ = written(inside.join(broadcast_if_small(split), "bucket").withColumn("blocks", F.ceil(F.greatest(F.col("total") * 8 / BLOCK_BYTES, F.col("members") / BLOCK_MEMBERS)).cast("int")))
    if open_.limit(1).count():
        dealt = open_.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        tiles = dealt.join(sets, F.col("rep") == F.col("doc_id")).select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "rep", "component", "shingles")
        more = tiles.groupBy("bucket", "i", "j").applyInArrow(_tile(percent), "a long, b long")
        links = written(links.union(more))
        roots = components(links)

    found = classes.join(roots, F.col("rep") == F.col("u"), "left").select(F.col("a").alias("ca"), F.col("b").alias("cb"), F.col("n").alias("cn"), component)
    same = (F.col("a") == F.col("ca")) & (F.col("b") == F.col("cb")) & (F.col("n") == F.col("cn"))
    out = sketches.select("doc_id", "n", "a", "b").join(found, same, "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
