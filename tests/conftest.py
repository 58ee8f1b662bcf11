import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from berthwise.session import checkpoint_dir, get_spark  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"
PORT_DOC = os.path.join(os.path.dirname(os.path.abspath(__file__)), "port.json")


@pytest.fixture(scope="session")
def spark():
    s = get_spark("local[4]", 4)
    checkpoint_dir(s)
    yield s
    s.stop()
