"""Every query of provider results and the mail agent against its SQL, none of them on no rows."""

import pytest

from larkspur.plans.result_queries import QUERIES, SQL
from tests.test_driver_queries import DIR, duck, plain, pytestmark  # noqa: F401


@pytest.mark.parametrize("name", list(SQL))
def test_same_rows(spark, duck, name):  # noqa: F811
    got = QUERIES[name](spark, DIR)
    want = duck.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = lambda data: sorted((tuple(plain(v) for v in r) for r in data), key=repr)
    expected = rows(want.fetchall())
    assert expected and rows(got.select(columns).collect()) == expected
