import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pedalytics.session import checkpoint_root, local_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores="*", shuffle_partitions=8, app="pedalytics-tests")
    checkpoint_root(s)  # the session's shared folder, or a fresh temp one when unset
    yield s


@pytest.fixture()
def tmp_root(tmp_path):
    return str(tmp_path)
