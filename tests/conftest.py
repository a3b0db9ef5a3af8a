import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shiftlens.session import checkpoint_dir, get_spark  # noqa: E402

SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = get_spark("local[4]", shuffle_partitions=8)
    # tests only: a local checkpoint folder where the session names none
    checkpoint_dir(s, default=tempfile.mkdtemp(prefix="shiftlens-ckpt-"))
    yield s
