import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tessella.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return build_session("tests", 8, 4)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session", autouse=True)
def _scratch(request):
    """The tests own their session: what they wrote goes when they end."""
    yield
    from pyspark.sql import SparkSession

    from tessella.session import clear_scratch

    if (session := SparkSession.getActiveSession()) is not None:
        clear_scratch(session)
