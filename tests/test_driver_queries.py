"""Every query with SQL against DuckDB on the driver's smallest tables."""

import math
import os

import pytest

from larkspur.plans.driver_queries import QUERIES, SQL

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables are not here")


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or hasattr(v, "item"):
        return round(float(v), 6)
    return str(v)


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(DIR):
        p = f"{DIR}/{f}"
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


@pytest.mark.parametrize("name", list(SQL))
def test_same_rows(spark, duck, name):
    got = QUERIES[name](spark, DIR)
    want = duck.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = lambda data: sorted((tuple(plain(v) for v in r) for r in data), key=repr)
    assert rows(got.select(columns).collect()) == rows(want.fetchall())


def test_entry_without_llm():
    """The registry works where the llm folders were taken out."""
    import subprocess
    import sys

    code = (
        "import sys, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path, target=None):\n"
        "        if name in ('corpus_pipeline', 'larkspur.llm'):\n"
        "            raise ModuleNotFoundError(f'No module named {name!r}', name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "q = e.queries(); assert q and not any(k.startswith('op') for k in q) and 'pipeline' not in q and e.oracle_sql()\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
