import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [HERE, os.path.dirname(HERE)]

from oracle import spark_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from loomframe.session import configure

    session = configure(spark_session())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
