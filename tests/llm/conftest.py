import os

import pytest

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


@pytest.fixture(scope="session")
def sf() -> str:
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark, sf):
    """doc_id: text of the smallest table."""
    return dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
