import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tidewell.session import get_session, work_dir  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = get_session("tests", 8)
    session.sparkContext.setLogLevel("ERROR")
    # Tiny inputs: most of a test is the start of its tasks.
    session.conf.set("spark.sql.shuffle.partitions", "2")
    work_dir(session)
    return session


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def rows():
    """Rows of a frame as sorted tuples."""
    return lambda df, *cols: sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)


@pytest.fixture
def plan():
    """Executed plan as text."""
    return lambda df: df._jdf.queryExecution().executedPlan().toString()
