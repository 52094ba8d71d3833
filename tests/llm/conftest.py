from __future__ import annotations

import os

import pytest
from llm_support import FOLDER, ODD, documents


@pytest.fixture(scope="session")
def odd(spark):
    return documents(spark, ODD)


@pytest.fixture(scope="session")
def nothing(spark):
    return documents(spark, [])


@pytest.fixture(scope="session")
def given(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test data")
    return lambda name: spark.read.parquet(f"{FOLDER}/{name}.parquet")
