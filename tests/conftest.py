import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from corpusgauge.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(4, "tests")


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


def rows(df, *cols):
    """Rows as sorted tuples."""
    got = df.select(*cols).collect() if cols else df.collect()
    return sorted((tuple(r) for r in got), key=lambda t: tuple((x is None, str(x)) for x in t))


def by(df, key):
    """Rows as dictionaries keyed by one column, or by several."""
    keys = (key,) if isinstance(key, str) else tuple(key)
    out = {}
    for r in df.collect():
        d = r.asDict(recursive=True)
        k = tuple(d[x] for x in keys)
        out[k[0] if len(k) == 1 else k] = d
    return out
