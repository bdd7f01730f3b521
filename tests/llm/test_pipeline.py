"""Registered queries against their SQL, and the pipeline stage by stage."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op3_chat_format", "op8_substring_doubling", "op10_signature_join", "op11_merkle_manifest", "op13_document_tree"])
def test_matches_sql(name, spark, duck):
    from check import compare

    from panelspark.llm.queries import ORACLES, QUERIES

    ok, note = compare(QUERIES[name](spark, SF), duck, ORACLES[name])
    assert ok, note


def test_every_operator_and_the_pipeline_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14))
    assert "pipeline" in names


def test_pipeline_stages_take_effect_and_keep_columns(spark, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    columns, before = docs.dtypes, docs
    for k, (name, stage) in enumerate(p.STAGES):
        after = stage(spark, before, SMALL)
        after.write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        if name != "packing":
            assert after.dtypes == columns
            assert after.join(before, "doc_id", "left_anti").isEmpty()
        if name == "toxicity":
            clean = before.join(labels.filter("toxic = 0"), "doc_id", "left_semi")
            assert clean.join(after, "doc_id", "left_anti").isEmpty(), "clean documents stay"
            assert after.count() < before.count()
        if name == "pii":
            assert after.count() == before.count()
            assert after.filter(F.col("text").rlike(r"AKIA[0-9A-Z]{16}")).join(before, ["doc_id", "text"]).isEmpty()
        if name == "packing":
            assert after.select("doc_id").distinct().count() == before.count()
        before = after


def test_pipeline_passes_nulls_and_empty_tables(spark, tmp_path):
    import corpus_pipeline as p

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([], [(None, None, None, None, None), (1, "", None, "s", 0), (1, "", None, "s", 0), (2, "some words here", "en", None, 15)]):
        docs = spark.createDataFrame(rows, schema)
        for k, (_, stage) in enumerate(p.STAGES):
            docs = stage(spark, docs, SMALL)
            path = str(tmp_path / f"{len(rows)}-{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
        assert docs.count() == len(rows)
