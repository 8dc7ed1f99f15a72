"""Every query of the posting operators against its SQL, none of them on no rows."""

import pytest

from larkspur.plans.posting_queries import QUERIES, SQL
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


def test_made_rows_are_many_tasks(spark):
    """The table is one file with one row group, which alone would be one task."""
    from pyspark.sql import functions as F

    from larkspur.plans.made_tables import Made

    rows = Made("part", "p_partkey", [("x", "string", 1, ["a", "b"])]).rows(spark, "/root/testdata/sf0.01")
    sizes = rows.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and sum(r["count"] for r in sizes) == 2000
