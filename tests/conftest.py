import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from airsignal.session import local_session

    s = local_session("*", 8)
    yield s


def collect_sorted(df, keys):
    return [tuple(r) for r in df.orderBy(*keys).collect()]


def approx_rows(a, b, tol=1e-9):
    assert len(a) == len(b), (len(a), len(b))
    for x, y in zip(a, b):
        assert len(x) == len(y)
        for u, v in zip(x, y):
            if isinstance(u, float) and isinstance(v, float):
                assert abs(u - v) <= tol * max(1.0, abs(u), abs(v)), (x, y)
            else:
                assert u == v, (x, y)
