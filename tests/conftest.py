from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session("4")


@pytest.fixture(scope="session")
def sales(spark):
    """The sales table of the smallest test data, kept in memory."""
    from workload.tables import sales as read

    df = read(spark, SMALL).cache()
    df.count()
    return df
