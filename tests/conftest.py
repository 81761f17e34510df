import os
import sys

os.environ.setdefault("OMP_NUM_THREADS", "1")

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from quern.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", 2)
    s.sparkContext.setLogLevel("ERROR")
    return s
