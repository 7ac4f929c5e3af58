from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def docs(spark):
    from cases import documents

    return documents(spark).cache()


@pytest.fixture(scope="session")
def empty(spark):
    from cases import nothing

    return nothing(spark)


@pytest.fixture(scope="session")
def corpus(spark):
    """The small corpus of the driver's tables."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
