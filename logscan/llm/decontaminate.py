"""Benchmark decontamination: SimHash windows of an item's size, multi-index Hamming blocks, exact weighted shingles.

1. Texts become lower-case words (runs of letters and digits) and hashes of their word
   shingles. The shingles of all documents meet those of the benchmark in one broadcast join, so
   the corpus is never shuffled. A larger benchmark sends a Bloom filter of its shingles, of bounded size, instead, and only
   what passes it, hits and a few in a hundred others, is shuffled to meet it. Either way the corpus is read once for this.
2. Windows of n shingles are taken for an item of n shingles where they can be similar at
   all. A window of similarity t shares 2 t n / (1 + t) shingles or more with the item (of
   a shorter document, t / (1 + t) times the sum of both sizes), so
   its first hit lies no deeper than n (1 - t) / (1 + t), and from that hit on so many hits
   follow within n shingles. Windows with fewer hits, which are nearly all that merely share
   a phrase, end here. The others get SimHash fingerprints, every shingle weighted by its count.
3. Distinct fingerprints meet those of items of the same size on any of radius + 1 blocks of
   bits: two fingerprints within the radius agree on a block at least, so all such pairs
   are found; the distance is then computed.
4. What is left is verified by the exact weighted similarity sum(min) / sum(max) of shingle
   counts. At similarity 0.8 fingerprints differ in 10 of 64 bits on average; 21, the radius,
   is four standard deviations off. In so wide a radius blocks of two or three bits sift
   little by themselves; it is step 2 that keeps the number of fingerprints near that of leaks.

DataFrame functions only. The texts are read twice, for all documents and for those with
hits, whatever the size of the benchmark; without many hits they are never shuffled.

Null texts and null items have no words. Items of fewer words than a shingle take no part.
A document shorter than an item is one window. Rows that repeat a doc_id are looked at one
by one and give one result if their texts are equal; rows without doc_id give results with a null
doc_id. Copies of an item are found each. Empty tables give no rows. Only doc_id, item_id and text are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logscan.llm.common import broadcast_if_small, written

#: Bytes of the benchmark's shingles, with the sizes of their items, that are broadcast; bits of the filter for more, for each shingle
#: and in all; and how many of them stand for a shingle.
BLOCK_BYTES = 8 << 20
BITS_EACH, BITS_MOST, HASHES = 12, 1 << 29, 3
SIZE, THRESHOLD, RADIUS = 5, 0.8, 21
LANES = 0x0001000100010001


def with_shingles(rows: DataFrame, size: int) -> DataFrame:
    """rows with sh: the hash of every size consecutive words of text."""
    words = F.array_remove(F.split(F.lower(F.col("text").cast("string")), r"[^\p{L}\p{N}]+"), "")
    w = F.col("_w")
    shingles = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[w[i + k] for k in range(size)]))
    return rows.withColumn("_w", words).withColumn("sh", F.when(F.size(w) >= size, shingles).otherwise(F.array().cast("array<bigint>"))).drop("_w", "text")


def _lane_sums(h: Column) -> list[Column]:
    """Sixteen sums, each with the counts of four bits of h in lanes of 16 bits."""
    return [F.sum(F.shiftrightunsigned(h, j).bitwiseAND(F.lit(LANES))).alias(f"s{j}") for j in range(16)]


def _fingerprint(total: Column) -> Column:
    """The bits that more than half of the weight has, from the lane sums."""
    bits = [F.when(F.shiftrightunsigned(f"s{j}", 16 * lane).bitwiseAND(F.lit(0xFFFF)) * 2 > total, F.lit(1 << (16 * lane + j) if 16 * lane + j < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")) for j in range(16) for lane in range(4)]
    while len(bits) > 1:
        bits = [a.bitwiseOR(b) for a, b in zip(bits[::2], bits[1::2], strict=True)]
    return bits[0]


def fingerprints(shingles: DataFrame, *keys: str) -> DataFrame:
    """SimHash fp of the shingles h of each key."""
    return shingles.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *_lane_sums(F.col("h"))).select(*keys, _fingerprint(F.col("_n")).alias("fp"))


def _blocks(fp: Column, radius: int) -> Column:
    """(block, its bits) for radius + 1 blocks that share out the 64 bits."""
    m = radius + 1
    cuts = [64 * k // m for k in range(m + 1)]
    parts = [F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("bits")) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    return F.explode(F.array(*parts)).alias("at")


def within_radius(windows: DataFrame, items: DataFrame, radius: int) -> DataFrame:
    """(n, fp, item_id) for the fingerprints (n, fp) of windows and those of items (item_id, n, item_fp) at most radius bits apart."""
    left = windows.select("n", "fp", _blocks(F.col("fp"), radius)).select("n", "fp", "at.block", "at.bits")
    right = items.select("item_id", "n", "item_fp", _blocks(F.col("item_fp"), radius)).select("item_id", "n", "item_fp", "at.block", "at.bits")
    met = left.join(broadcast_if_small(written(right)), ["n", "block", "bits"])
    return met.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius).select("n", "fp", "item_id").distinct()


def possible(hits: DataFrame, threshold: float) -> DataFrame:
    """doc_id, tag, start, n of the windows that hold hits enough for an item of their size. hits: doc_id, tag, m (the document's shingles), pos and the sizes of items with this shingle."""
    need = lambda n: F.ceil(threshold * (n + F.least(n, F.col("m"))) / (1 + threshold) - 1e-9).cast("int")
    # a document's own hits; those of rows that repeat it stand there once
    each = hits.groupBy("doc_id", "tag", "m").agg(F.array_sort(F.collect_set(F.struct("pos", "sizes"))).alias("hits"))
    follows = lambda i, pos, n: F.get("hits", i + need(n) - 1)["pos"] < pos + n
    sizes = F.transform("hits", lambda x, i: F.struct(x["pos"].alias("pos"), F.filter(x["sizes"], lambda n: follows(i, x["pos"], n)).alias("n")))
    first = each.select("doc_id", "tag", "m", F.explode(F.filter(sizes, lambda x: F.size(x["n"]) > 0)).alias("x")).select("doc_id", "tag", "m", "x.pos", F.explode("x.n").alias("n"))
    slack = F.floor(F.col("n") * (1 - threshold) / (1 + threshold) + 1e-9).cast("int")
    starts = first.filter(F.col("m") >= F.col("n") * threshold).withColumn("j", F.explode(F.sequence(F.lit(0), slack)))
    return starts.select("doc_id", "tag", F.greatest(F.lit(0), F.least(F.col("pos") - F.col("j"), F.col("m") - F.col("n"))).cast("int").alias("start"), "n").distinct()


def _bits(h: Column, n: int) -> list[Column]:
    """The bits of a filter of n bits that stand for a shingle."""
    return [F.pmod(F.xxhash64(h, F.lit(i)), F.lit(n)) for i in range(HASHES)]


def bloom(shingles: DataFrame, count: int) -> tuple[DataFrame, int]:
    """A row with the words (of 64 bits) of a Bloom filter of the shingles h, written, and its bits."""
    n = min(BITS_MOST, -(-BITS_EACH * count // 64) * 64)
    at = shingles.select(F.explode(F.array(*_bits(F.col("h"), n))).alias("bit"))
    one = F.expr("shiftleft(1L, cast(bit % 64 as int))")
    words = at.groupBy(F.floor(F.col("bit") / 64).cast("int").alias("i")).agg(F.bit_or(one).alias("w"))
    # every word, set or not, in its place: at most BITS_MOST / 8 bytes
    full = shingles.sparkSession.range(n // 64).select(F.col("id").cast("int").alias("i")).join(words, "i", "left")
    row = full.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("w", F.lit(0)).alias("w")))), lambda x: x["w"]).alias("words"))
    return written(row), n


def passing(hits: DataFrame, filter_: DataFrame, n: int) -> DataFrame:
    """The rows whose shingle h the filter may hold; the filter is one row, sent to all tasks."""
    kept = hits.join(F.broadcast(filter_), F.lit(True))  # one row
    tests = [F.get("words", F.floor(b / 64).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (b % 64).cast("int"))) != 0 for b in _bits(F.col("h"), n)]
    return kept.filter(reduce(lambda a, b: a & b, tests)).drop("words")


def find_leaks(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, similarity, start (word of the best window), n_windows: of each document and item with a window of similarity threshold or more."""
    items = written(with_shingles(benchmark.select("item_id", "text").filter("item_id is not null").distinct(), size).filter(F.size("sh") > 0))
    item_shingles = items.select("item_id", F.size("sh").alias("n"), F.explode_outer("sh").alias("h"))

    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("tag"))
    # the outer form, as the inner one would first test the array's size and so make it twice
    hits = with_shingles(docs, size).select("doc_id", "tag", "sh", F.size("sh").alias("m")).select("doc_id", "tag", "m", F.posexplode_outer("sh").alias("pos", "h"))
    by_size = written(item_shingles.groupBy("h").agg(F.collect_set("n").alias("sizes")))
    size_bytes = by_size.agg(F.sum(24 + 8 * F.size("sizes"))).first()[0] or 0
    if size_bytes <= BLOCK_BYTES:
        met = hits.join(F.broadcast(by_size), "h")
    else:
        met = written(passing(hits, *bloom(by_size, by_size.count()))).join(by_size, "h")
    hits = written(met.select("doc_id", "tag", "m", "pos", "sizes"))
    asked = possible(hits, threshold).select(F.col("doc_id").alias("at_doc"), F.col("tag").alias("at_tag"), "start", "n").distinct()
    asked = written(asked.groupBy("at_doc", "at_tag").agg(F.collect_list(F.struct("start", "n")).alias("asked")))
    here = F.col("doc_id").eqNullSafe(F.col("at_doc")) & (F.col("tag") == F.col("at_tag"))
    found = docs.join(broadcast_if_small(asked), here).select("doc_id", "tag", "text", "asked").dropDuplicates(["doc_id", "tag"])
    cut = F.transform("asked", lambda w: F.struct(w["start"].alias("start"), w["n"].alias("n"), F.slice("sh", w["start"] + 1, w["n"]).alias("sh")))
    spans = with_shingles(found, size).select("doc_id", "tag", F.explode_outer(cut).alias("w"))
    windows = written(spans.select("doc_id", "tag", "w.start", "w.n", F.explode_outer("w.sh").alias("h")))

    key = ["doc_id", "tag", "start", "n"]
    prints = written(fingerprints(windows, *key))
    item_prints = fingerprints(item_shingles, "item_id", "n").withColumnRenamed("fp", "item_fp")
    pairs = written(within_radius(prints.select("n", "fp").distinct(), item_prints, radius))
    candidates = prints.join(broadcast_if_small(pairs), ["n", "fp"]).select(*key, "item_id")

    counts = windows.groupBy(*key, "h").agg(F.count(F.lit(1)).alias("c"))
    item_counts = broadcast_if_small(written(item_shingles.groupBy("item_id", "h").agg(F.count(F.lit(1)).alias("ic"))))
    total = windows.groupBy(*key).agg(F.count(F.lit(1)).alias("m"))
    null_safe = [F.col(f"c.{k}").eqNullSafe(F.col(f"w.{k}")) for k in key]
    both = candidates.alias("c").join(counts.alias("w"), null_safe).select("c.*", "h", "c").join(item_counts, ["item_id", "h"]).groupBy("item_id", *key).agg(F.sum(F.least("c", "ic")).alias("both"))
    both = both.alias("c").join(total.alias("w"), null_safe).select("c.*", "m")
    similarity = F.col("both") / (F.col("n") + F.col("m") - F.col("both"))
    best = both.withColumn("similarity", similarity).filter(F.col("similarity") >= threshold).groupBy("doc_id", "item_id")
    return best.agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best"), F.count(F.lit(1)).alias("n_windows")).select(
        "doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.back")).alias("start"), "n_windows"
    )
