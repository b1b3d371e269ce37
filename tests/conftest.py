import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from tierlift.session import local_session
    s = local_session("4", shuffle_partitions=8, app="tierlift-tests")
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tierlift-test-ckpt-"))
    yield s
    s.stop()
