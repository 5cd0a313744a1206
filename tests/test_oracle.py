"""Every registered query that has SQL gives the SQL's rows."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry_points  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    import check

    return check.connect(SF)


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, con, name):
    import check

    state, _, _, detail = check.compare(spark, con, SF, name, QUERIES[name], ORACLES[name])
    assert state == "ok", detail


def test_entry_has_rows(spark):
    rows = entry_points.entry(spark).collect()
    assert rows and {"product_category", "r1", "min_cell"} <= set(rows[0].asDict())
