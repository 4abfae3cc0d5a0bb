"""A corpus pipeline: language ID, line dedup, near-dedup, benchmark decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's docs. All but the last return the columns of docs.
Extra columns of docs pass through under their names, whatever the operators use inside.
Stages are judged each on its own input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logscan.llm import bpe, decontaminate, language_id, line_dedup, minhash
from logscan.llm.common import broadcast_if_small, fresh, table, written
from logscan.llm.queries import vocabulary


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with its own columns of these names under free ones, and what gives a result the columns of docs again."""
    lower = {n.lower() for n in names}
    moved = {c: new for c, new in zip(docs.columns, fresh(docs, *(f"_own_{c}" for c in docs.columns)), strict=True) if c.lower() in lower}
    back = lambda out: out.select(*[F.col(f"`{moved.get(c, c)}`").alias(c) for c in docs.columns])
    return docs.withColumnsRenamed(moved), back


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that are in no language: null and empty texts and texts without a letter (`und`). Where lang is null it becomes the language found.

    The model learns from the rows of docs whose language is known and that are not held out;
    without any such row no language can be told, and all texts with a letter stay as they are. An empty table gives no rows.
    """
    own, back = _aside(docs, "lang_pred", "score")
    model = language_id.train(own.filter(language_id.remainder(4) != 2))
    if model.families is None:
        return back(own.filter(F.col("text").rlike(r"\p{L}")))
    out = language_id.identify(own, model).filter(F.col("lang_pred") != language_id.UNKNOWN)
    return back(out.withColumn("lang", F.coalesce("lang", "lang_pred")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the lines that stand in ten documents or more; n_chars follows the text. Documents stay, even if nothing is left of them; a null text becomes ''."""
    own, back = _aside(docs, "n_lines", "n_dropped")
    out = line_dedup.dedup_lines(own)
    return back(out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the doc_ids of gone; rows without doc_id stay."""
    (name,) = fresh(docs, "_gone")
    gone = broadcast_if_small(written(gone.select(F.col("doc_id").alias(name)).distinct()))
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near copies (shingles of 5 words, similarity 0.8), and all without doc_id or without words."""
    return _without(docs, minhash.near_duplicates(docs).filter(~F.col("kept")))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a passage of the benchmark. Rows without doc_id stay, as no result can name them; null texts and an empty benchmark leak nothing."""
    return _without(docs, decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids (of the tokens), n_tokens and decoded (the text that the ids stand for). A null text has no tokens and is decoded as ''; an empty table gives no rows."""
    path = vocabulary()
    # written between, so that a task has one Python worker at a time and not two with a vocabulary each
    encoded = written(bpe.encode(docs, path).select("doc_id", "lang", "source", "ids"))
    out = bpe.decode(encoded, path)
    return out.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), "decoded")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontamination", drop_leaks),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs


#: SQL expresses neither the classifier nor BPE.
ORACLE_SQL = None
