import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from leakfree.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[8]", 8)
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


def rows(df, *cols):
    """Collected rows as tuples, sorted; a shorthand for small frames."""
    d = df.select(*cols) if cols else df
    return sorted([tuple(r) for r in d.collect()], key=lambda t: tuple((v is None, str(type(v)), v if v is not None else 0) for v in t))


def by(df, key, value):
    return {r[key]: r[value] for r in df.collect()}
