"""The registered queries against their SQL, and the pipeline against its stages' own rules."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from agree import duck, rows_of

import corpus_pipeline
from tidemark.llm import decontam, queries  # noqa: F401
from tidemark.llm.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the given tables are not here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_its_sql(spark, name):
    got = QUERIES[name](spark, SF)
    done = duck(SF).execute(ORACLES[name])
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of([d[0] for d in done.description], done.fetchall())


def test_stages_keep_clean_documents_and_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    passage = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    shared = "first shared line\nsecond shared line\nthird shared line\n"
    body = " ".join(f"word{i}" for i in range(300))
    made = [(9001, None, "en", "s", 0), (9002, "!!! 123", "en", "s", 7), (9003, shared + "end of one", "en", "s", 0), (9004, shared + "end of two", "en", "s", 0),
            (9005, body, "en", "s", 0), (9006, body.replace("word150", "other"), "en", "s", 0), (9007, passage + " tail words", "en", "s", 0)]
    out = docs.union(spark.createDataFrame(made, docs.schema)).cache()
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, out, SF)
        if name != "best_fit_packing":
            assert result.columns == docs.columns
        out = result.cache()
        seen[name] = {r.doc_id: r.text for r in out.collect()} if name != "best_fit_packing" else out.collect()
    assert {9001, 9002}.isdisjoint(seen["language_id"]) and len(seen["language_id"]) >= 200 + 5 - 1
    assert seen["line_dedup"][9003] == shared + "end of one" and seen["line_dedup"][9004] == "end of two"
    assert 9005 in seen["near_dedup"] and 9006 not in seen["near_dedup"]
    assert 9007 in seen["near_dedup"] and 9007 not in seen["decontamination"] and 9005 in seen["decontamination"]
    packed = [d for row in seen["best_fit_packing"] for d in row.doc_ids]
    assert set(packed) == {d for d, text in seen["decontamination"].items() if text.split()}


def test_pipeline_runs_whole(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.agg(F.sum("n_words")).first()[0] > 0 and rows.filter("n_words > capacity").count() == 0
