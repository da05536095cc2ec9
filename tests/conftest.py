import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tocsin.session import local_session
    s = local_session("*", shuffle_partitions=8, app="tocsin-tests")
    yield s
    s.stop()


SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(autouse=True)
def _uncached(request):
    """Queries keep small intermediate tables; drop them after each test."""
    yield
    if "spark" in request.fixturenames:
        request.getfixturevalue("spark").catalog.clearCache()


@pytest.fixture(autouse=True, scope="module")
def _released(request):
    """Delete after each module what its queries have written."""
    yield
    from pyspark.sql import SparkSession
    from tocsin.session import release
    active = SparkSession.getActiveSession()
    if active is not None:
        release(active)
