"""Stages on tables with nulls, repeated ids, no rows, and columns named like what the stages add."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"
FILTERS = [(name, stage) for name, stage in corpus_pipeline.STAGES if name != "best_fit_packing"]
CLASHES = {
    "score": 7.5,
    "Lang_Pred": "mine",
    "predicted": "p",
    "gone": 1,
    "hash": "h",
    "kept": "k",
    "pii_base": "b",
    "pii_base_0": "b0",
    "pii_spans": "s",
    "column 1": "one",
    "set_key": None,
}


@pytest.fixture(scope="module")
def docs(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    text = given.where("doc_id = 0").first()["text"]
    more = spark.createDataFrame(
        [(900_001, None, None, None, None), (None, text, "en", None, 3), (900_002, "", None, "s", 0),
         (900_003, text, None, None, None), (900_003, "call +44 20 7946 0958 or mail a.b@example.org " + text[::-1], "en", "s", None)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    return given.unionByName(more, allowMissingColumns=True).select(*given.columns).withColumns(
        {name: F.lit(value).cast("string") for name, value in CLASHES.items()}
    ).cache()


@pytest.mark.parametrize("name, stage", FILTERS)
def test_own_columns_come_back(spark, docs, name, stage):
    found = stage(spark, docs, SF)
    assert found.columns == docs.columns and dict(found.dtypes) == dict(docs.dtypes)
    rows, given = found.collect(), {tuple(r) for r in docs.collect()}
    assert rows
    at = docs.columns.index("text"), docs.columns.index("n_chars")
    rest = [i for i in range(len(docs.columns)) if i not in at]
    assert {tuple(r[i] for i in rest) for r in rows} <= {tuple(r[i] for i in rest) for r in given}
    if name != "redact_pii":
        assert {tuple(r) for r in rows} <= given


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_empty_table(spark, docs, name, stage):
    assert stage(spark, docs.limit(0), SF).collect() == []


def test_a_text_that_shares_its_id_with_a_copy_stays(spark, docs):
    left = corpus_pipeline.near_dedup(spark, docs, SF).where("doc_id = 900003").collect()
    assert len(left) == 1 and left[0]["text"].startswith("call +44")


def test_redacted_texts_and_their_sizes(spark, docs):
    row = corpus_pipeline.redact_pii(spark, docs.where("doc_id = 900003 AND text LIKE 'call%'"), SF).first()
    assert "a.b@example.org" not in row["text"] and "7946" not in row["text"]
    assert row["n_chars"] == len(row["text"])
