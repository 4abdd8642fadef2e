import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from linkloom.session import checkpoint_dir, local_session

    s = local_session(4, shuffle_partitions=4, app="linkloom-tests")
    checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture()
def tmp(tmp_path):
    return str(tmp_path)


@pytest.fixture(scope="session")
def sf():
    return SF


def rows(df, *cols):
    return [tuple(r[c] for c in cols) if cols else tuple(r) for r in df.collect()]


@pytest.fixture(scope="session")
def scratch():
    return tempfile.mkdtemp(prefix="linkloom-test-")
