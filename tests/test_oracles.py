"""Every registered query on the smallest data, against its SQL where there is one."""

import os

import duckdb
import pytest

import __spark_entry__ as driver
import check
from rowloom import plans
from rowloom.plans.fixtures import TABLES

FOLDER = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def connection():
    found = duckdb.connect()
    for name in TABLES:
        found.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    yield found
    found.close()


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query(spark, connection, name):
    told = check.compare(spark, connection, FOLDER, name)
    assert not told.startswith("FAILED"), told


def test_entry(spark):
    rows = driver.entry(spark).collect()
    assert {r["run"] for r in rows} == {"good", "weak"} and len(rows) == 2 * 5
