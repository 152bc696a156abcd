import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from loopdex.session import checkpoint_dir, get_spark

    s = get_spark("local[4]", shuffle_partitions=4, app="loopdex-tests")
    checkpoint_dir(s)
    yield s


@pytest.fixture
def tmp_dir(tmp_path):
    return str(tmp_path)
