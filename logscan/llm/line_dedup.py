"""Line dedup: lines whose normalised form stands in many documents are dropped everywhere.

1. Lines are exploded in normalised form and hashed, each hash once a row, and the rows of
   each hash are counted with partial sums on the map side, so a line of every document
   costs one row a task. No hash stands in more documents than rows: what stays below the
   threshold here is done with.
2. Of the hashes left the places (document, position) are written, and their distinct
   documents are counted: pairs of hash and document first, then hashes, so that not even a
   line of all documents is gathered in one task.
3. The documents are reassembled by position from their own text: the runs of lines between
   dropped positions are put together, in time linear in the document's lines.

DataFrame functions only.

A document is a doc_id: rows that repeat a doc_id count once for a line, whether their
texts are equal or not, and rows without doc_id are not counted. A row loses its own lines, with or
without a doc_id. A null or empty text is one empty line. A document that loses all its
lines has the text ''. An empty table gives no rows. Lines of any length and documents of
any number of lines are taken whole. All columns of the input are kept, whatever their
names; the two counts are added under n_lines and n_dropped, in place of columns of these
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logscan.llm.common import broadcast_if_small, fresh, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def without(lines: Column, gone: Column) -> Column:
    """The array lines without those at the positions gone."""
    first = F.concat(F.array(F.lit(-1)), F.array_sort(gone))
    after = F.concat(F.array_sort(gone), F.array(F.size(lines)))
    # an array of one array, so that the lines are split once and not for each run
    return F.flatten(F.transform(F.array(lines), lambda x: F.flatten(F.zip_with(first, after, lambda a, b: F.slice(x, a + 2, b - a - 1)))))


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """docs, its text without the lines whose key has min_chars code points and stands in min_docs documents; n_lines before, n_dropped."""
    d, t, g = fresh(docs, "_doc", "_tag", "_drop")
    text, doc = F.col("text").cast("string"), [F.col("doc_id").alias(d), F.xxhash64("text").alias(t)]
    keys = F.transform(lines_of(text), line_key)
    hashed = F.transform(keys, lambda k: F.when(F.length(k) >= min_chars, F.md5(k)))
    # the outer forms, as the inner ones would first test the array's size and so make it twice
    seen = docs.select(F.explode_outer(F.array_distinct(hashed)).alias("hash")).filter("hash is not null")
    often = written(seen.groupBy("hash").count().filter(F.col("count") >= min_docs).select("hash"))
    placed = docs.select(*doc, F.posexplode_outer(hashed).alias("pos", "hash")).filter("hash is not null")
    placed = written(placed.join(broadcast_if_small(often), "hash"))
    pairs = placed.filter(F.col(d).isNotNull()).select("hash", d).distinct()
    common = written(pairs.groupBy("hash").count().filter(F.col("count") >= min_docs).select("hash"))
    drops = placed.join(broadcast_if_small(common), "hash").groupBy(d, t).agg(F.collect_set("pos").alias(g))
    lines, gone = lines_of(text), F.col(g)
    joined = docs.join(drops, F.col("doc_id").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(t)), "left")
    return joined.withColumns(
        {
            "n_lines": F.size(lines).cast("long"),
            "n_dropped": F.coalesce(F.size(gone), F.lit(0)).cast("long"),
            "text": F.when(gone.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(without(lines, gone), "\n")),
        }
    ).drop(d, t, g)
