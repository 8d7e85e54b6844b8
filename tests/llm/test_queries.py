"""Queries that SQL can express, against it."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(__file__)))
from oracle import compare, connect  # noqa: E402

from siltstone.llm import queries  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    compare(spark, connect(SF), SF, queries.QUERIES[name], queries.ORACLE_SQL[name])


@pytest.mark.parametrize(("name", "columns"), [
    ("op3_url_filter", ["page_id", "host", "path", "rule", "verdict"]),
    ("op4_toxicity", ["doc_id", "held_out", "score", "predicted"]),
    ("op6_language_id", ["doc_id", "held_out", "lang_pred", "score"]),
    ("op7_pii", ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]),
    ("op9_near_dedup", ["doc_id", "class_id"]),
])
def test_one_row_for_each_input_row(spark, name, columns):
    df = queries.QUERIES[name](spark, SF)
    assert df.columns[: len(columns)] == columns
    assert df.count() == spark.read.parquet(f"{SF}/{'pages' if 'url' in name else 'documents'}.parquet").count()
