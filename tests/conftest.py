import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
#: Folder with published per-model summary rows; the checks that need them are defined only where it is set.
GOLDEN_DIR = os.environ.get("SCORELAB_GOLDEN_DIR", "")


@pytest.fixture(scope="session")
def spark():
    from scorelab.session import local_session

    s = local_session("*", shuffle_partitions=8, app="scorelab-tests")
    yield s


def rows(df, order=None):
    out = [r.asDict() for r in (df.orderBy(*order) if order else df).collect()]
    return out


def local_scratch(spark, name):
    """A fresh scratch folder as a local path (tests write files with plain Python)."""
    from scorelab.session import scratch_path

    p = scratch_path(spark, name)
    return p[len("file:"):] if p.startswith("file:") else p
