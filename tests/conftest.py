import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from reelmill.session import _scratch_roots, drop_scratch, local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "tests")
    yield session
    for root in list(_scratch_roots):
        drop_scratch(session, root)
    session.stop()


@pytest.fixture
def rows():
    """Rows as tuples, in a stable order."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
