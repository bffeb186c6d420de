import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from workbench.compare import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return session("8", 8)


@pytest.fixture
def rows():
    """Rows of a table as sorted dictionaries."""

    def read(df, *order):
        found = [row.asDict() for row in df.collect()]
        return sorted(found, key=lambda row: tuple(str(row[name]) for name in order)) if order else found

    return read
