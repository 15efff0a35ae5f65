import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.abspath(__file__)), os.path.dirname(os.path.dirname(os.path.abspath(__file__)))]

from samples import DOCS, odd_rows  # noqa: E402

@pytest.fixture
def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def no_labels(spark, tmp_path_factory):
    """A table folder whose documents and labels are empty."""
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path
