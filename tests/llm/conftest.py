import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from llm_fixtures import EDGES  # noqa: E402

SF = "/root/testdata/sf0.001"

@pytest.fixture(scope="module")
def edges(spark):
    """The edge rows, with columns beside them whose names clash with those that operators use."""
    df = spark.createDataFrame(EDGES, "doc_id long, text string, lang string, source string")
    extra = "1L AS n", "'x' AS size", "'y' AS key", "2L AS cls", "'z' AS TEXT", "'w' AS Doc_Id", "3L AS mark", "4L AS gone"
    return df.selectExpr("*", "length(text) AS n_chars", *extra)


@pytest.fixture(scope="module")
def nothing(edges):
    return edges.where("false")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}
