"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logscan.llm.common import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """u, v for links (a, b): v is the smallest id that u is linked with, directly or not; ids that are such a v have no row.

    Every step groups with map-side sums and joins back, so that no node's neighbours are gathered in one place.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("at")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = written(both.filter("v > u").join(least, F.col("u") == F.col("at")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy(F.col("u").alias("at")).agg(F.min("v").alias("m"))
        small = large.join(least, F.col("u") == F.col("at"))
        edges = written(small.select("u", F.col("m").alias("v")).union(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
        before, state = state, _state(edges)
        if state == before:
            break
    return edges
