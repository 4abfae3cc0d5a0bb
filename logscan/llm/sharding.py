"""Sharding by extendible hashing: a directory over hash-prefix bits.

Each row has a 60-bit hash of its key. The directory starts with one bucket; a bucket over
the byte limit, and only such a one, splits on another bit of the hash until every bucket
fits. The splits are decided on sums: sizes are added up once by a prefix some bits deeper
than the mean shard, each prefix adds its sum to all shorter ones, and the leaves are the
buckets that fit while their parent does not. Where the deepest of these buckets are still
too large, the rows in them alone are summed by their whole hash and split on, down to
the last bit. Rows whose hashes are equal cannot be told apart: they stay in one shard,
marked oversized. Finally each row looks up its shard in the directory.

Keys may repeat: the hash is taken over key and salt columns, and with the text as a salt
even a key that holds a third of all rows is spread. A row larger than the limit is an
oversized shard. Null keys count as the empty text, null texts as empty and of size 0. An
empty table gives no rows. All columns pass through; shard, depth, shard_bytes and
oversized take the place of columns of these names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logscan.llm.common import fresh, is_small, written

BITS = 60
#: Bits by which the first sums are deeper than the mean shard.
SPARE = 6


def hash60(*columns: Column) -> Column:
    """The first 60 bits of the MD5 of the columns as text, joined by a line feed."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("\n", *parts)), 1, 15), 16, 10).cast("long")


def _leaves(sums: DataFrame, limit: int, top: int, deepest: int) -> tuple[DataFrame, DataFrame]:
    """The leaves of depths top to deepest for sums (fine: a prefix of deepest bits, bytes, rows), and the prefixes (over) that are too large even there."""
    depths = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.shiftright("fine", deepest - d).alias("prefix")) for d in range(top, deepest + 1)])).alias("at")
    buckets = sums.select(depths, "bytes", "rows").groupBy("at.depth", "at.prefix").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    fits = (F.col("bytes") <= limit) | (F.col("rows") == 1) | (F.col("depth") == BITS)
    buckets = written(buckets.withColumn("fits", fits))
    split = buckets.filter(~F.col("fits"))
    children = split.select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
    fit = buckets.filter("fits").drop("fits")
    leaves = fit.filter(F.col("depth") == top).union(fit.filter(F.col("depth") > top).join(children, ["depth", "prefix"], "left_semi"))
    return leaves, split.filter(F.col("depth") == deepest).select(F.col("prefix").alias("over"))


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """The leaves (depth, prefix, bytes, rows) for rows of h and size."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    deepest = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + SPARE)
    added = [F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")]
    sums = rows.groupBy(F.shiftright("h", BITS - deepest).alias("fine")).agg(*added)
    leaves, over = _leaves(sums, limit, 0, deepest)
    if deepest < BITS and over.limit(1).count():
        over = F.broadcast(over) if is_small(over) else over
        rest = rows.join(over, F.shiftright("h", BITS - deepest) == F.col("over"), "left_semi").groupBy(F.col("h").alias("fine")).agg(*added)
        leaves = leaves.union(_leaves(rest, limit, deepest + 1, BITS)[0])
    return written(leaves)


def shard(docs: DataFrame, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with shard (the bits of its prefix, '' for the only shard), depth, shard_bytes and oversized; no shard holds over limit bytes of text unless oversized."""
    own = {"shard", "depth", "shard_bytes", "oversized"}
    kept = [c for c in docs.columns if c.lower() not in own]
    h, size, at, d, p = fresh(docs, "_h", "_size", "_at", "_depth", "_prefix")
    content = F.col(text).cast("string")
    rows = docs.select(*kept).withColumns({h: hash60(F.col(key), F.md5(F.coalesce(content, F.lit("")))), size: F.coalesce(F.octet_length(content), F.lit(0)).cast("long")})
    leaves = directory(rows.select(F.col(h).alias("h"), F.col(size).alias("size")), limit)
    depths = sorted(r[0] for r in leaves.select("depth").distinct().collect()) or [0]
    bits = F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.conv(F.col("prefix").cast("string"), 10, 2), F.col("depth"), "0"))
    leaves = leaves.select("depth", F.col("depth").alias(d), F.col("prefix").alias(p), F.col("bytes").alias("shard_bytes"), bits.alias("shard"))
    tried = F.explode(F.array(*[F.struct(F.lit(n).alias("d"), F.shiftright(h, BITS - n).alias("p")) for n in depths])).alias(at)
    found = (F.col(f"{at}.d") == F.col(d)) & (F.col(f"{at}.p") == F.col(p))  # of one leaf among the prefixes of a hash
    if is_small(leaves):
        out = rows.select("*", tried).join(F.broadcast(leaves), found)
    else:
        out = rows.join(rows.select(h).distinct().select(h, tried).join(leaves, found), h)
    return out.select(*kept, "shard", "depth", "shard_bytes", (F.col("shard_bytes") > limit).alias("oversized"))
