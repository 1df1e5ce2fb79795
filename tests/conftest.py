import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tagloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tagloom-tests")
    yield session
    session.stop()


def rows(df):
    """All rows as plain tuples, sorted."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
