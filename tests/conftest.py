import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from phonelens.session import local_session
    s = local_session(cpus=4, shuffle_partitions=4, app="phonelens-tests")
    yield s
    s.stop()


def rows(df, *cols):
    """Collect as sorted tuples of the given columns."""
    cols = cols or df.columns
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def by_key(df, key="phone_no_m"):
    return {r[key]: r.asDict() for r in df.collect()}
