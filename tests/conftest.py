import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from seatflow.session import build_session

    s = build_session("local[8]", shuffle_partitions=8)
    if not s.sparkContext.getCheckpointDir():
        # tests only: the cluster names a shared folder in spark.checkpoint.dir
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="seatflow-test-ckpt-"))
    yield s
    s.stop()
