from __future__ import annotations

import random
import re

import pytest
from oracle import same

from pyspark.sql import functions as F

from logscan.llm.queries import oracle_sql, queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, name):
    same(spark, queries()[name], oracle_sql()[name], SMALL)


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == columns, name
        before, after = docs.count(), out.count()
        assert 0.8 * before <= after <= before, name
        docs = out
    out = p.run(spark, SMALL)
    assert out.count() == docs.count()
    assert out.filter("n_tokens <> size(ids)").count() == 0
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    assert all(texts[r["doc_id"]] == r["decoded"] for r in out.select("doc_id", "decoded").collect())


def _fixture(spark, folder):
    """Documents with planted junk, repeated lines, near copies and a passage of the benchmark; and what is to come of them."""
    r = random.Random(11)
    syllables = {"en": "th er on an in the ing and", "de": "sch ch ei und der ung keit ss"}
    prose = lambda lang, n: " ".join("".join(r.choice(syllables[lang].split()) for _ in range(r.randrange(2, 5))) for _ in range(n))
    item = prose("en", 30)
    rows = [(i, prose("en" if i % 2 else "de", 60) + ("\nShare this page" if i < 12 else ""), "en" if i % 2 else "de", "s", 1) for i in range(40)]
    rows += [(40, rows[3][1], "en", "s", 1), (41, rows[20][1] + " tail", "de", "s", 1), (42, f"{prose('en', 20)} {item} {prose('en', 20)}", "en", "s", 1)]
    rows += [(43, "12 34 !!", "en", "s", 1), (44, None, None, "s", None), (45, "", "de", None, 0), (None, prose("en", 30), None, "s", 1), (46, prose("de", 50), None, "s", 1), (46, prose("de", 50), "de", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline as p
    from tokenizers import Tokenizer

    rows = _fixture(spark, str(tmp_path))
    want = []
    for i, text, lang, source, _ in rows:
        if text and re.search("[a-z]", text) and i not in (40, 41, 42):
            want.append([i, text.replace("\nShare this page", ""), source])
    out = p.run(spark, str(tmp_path)).collect()
    assert sorted(([x["doc_id"], x["decoded"], x["source"]] for x in out), key=repr) == sorted(want, key=repr)
    encoder = Tokenizer.from_file(p.vocabulary())
    assert all(x["ids"] == encoder.encode(x["decoded"], add_special_tokens=False).ids and x["n_tokens"] == len(x["ids"]) for x in out)
    assert {(x["doc_id"], x["lang"]) for x in out if x["doc_id"] in (None, 46)} == {(None, "en"), (46, "de")}  # what was null is told


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    import corpus_pipeline as p

    _fixture(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = "score lang_pred n_lines n_dropped _gone kept ids Tag n decoded _own_score".split()
    wide = docs.withColumns({n: F.concat(F.lit(f"{n} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for n in names})
    long = spark.createDataFrame([(99, "und der ing " * 60_000, "de", "s", 1)], docs.schema)
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, wide.unionByName(long, allowMissingColumns=True), str(tmp_path))
        assert out.columns == wide.columns, name
        got = out.filter("doc_id <> 99").collect()
        assert got and all(x[n] == f"{n} {x['doc_id']}" for x in got for n in names), name
        assert out.filter("doc_id = 99").count() == 1, name
        assert stage(spark, wide.limit(0), str(tmp_path)).count() == 0, name
    assert p.STAGES[-1][1](spark, wide.limit(0), str(tmp_path)).count() == 0


def test_a_corpus_without_labels_keeps_its_texts(spark, tmp_path):
    import corpus_pipeline as p

    rows = [(i, f"some words of document {i}", None, "s", 1) for i in range(10)] + [(10, "12 34", None, "s", 1), (11, None, None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = p.identify_language(spark, docs, str(tmp_path)).collect()
    assert sorted(x["doc_id"] for x in out) == list(range(10)) and {x["lang"] for x in out} == {None}
