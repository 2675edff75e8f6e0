import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tagloom.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", partitions=4, memory="4g")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def inputs(spark):
    from workload.queries import Inputs

    return Inputs(spark, SMALL)


def rows(frame, *columns):
    """Rows as sorted tuples."""
    picked = frame.select(*columns) if columns else frame
    return sorted((tuple(r) for r in picked.collect()), key=repr)
