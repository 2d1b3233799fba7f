from __future__ import annotations

import pytest

from mound.plans.session import build_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Collected rows as sorted tuples, nulls last."""

    def collect(df, *columns):
        found = [tuple(r) for r in df.select(*columns).collect()]
        return sorted(found, key=lambda t: [(v is None, str(v)) for v in t])

    return collect
