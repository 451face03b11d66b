"""Every registered query against its SQL equivalent on the smallest given tables."""

import glob
import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
import __spark_entry__ as entry  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="given tables not found")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(frame):
    columns = sorted(frame.columns)

    def value(v):
        if v is None or v != v:
            return None
        if isinstance(v, (bool, str)):
            return str(v)
        return float(v) if math.isfinite(float(v)) else str(v)

    rows = frame[columns].astype(object).where(frame[columns].notna(), None)
    return columns, sorted(repr([value(v) for v in row]) for row in rows.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_sql(spark, sql, name):
    got = entry.queries()[name](spark, SF_DIR).toPandas()
    oracle = entry.oracle_sql().get(name)
    if oracle is None:
        assert len(got)
    else:
        assert plain(got) == plain(sql.execute(oracle).fetchdf())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
