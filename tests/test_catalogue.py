"""Every catalogue query beside its SQL in DuckDB, on the small tables."""

import os

import duckdb
import pytest

from quillgrid.plans import catalogue, catalogue_fields, catalogue_more, catalogue_relief, catalogue_segments, catalogue_water  # noqa: F401
from quillgrid.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def normal(rows):
    return sorted((tuple(round(float(v), 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = [tuple(r[c] for c in columns) for r in df.collect()]
    found = duck.execute(catalogue.ORACLES[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert normal(mine) == normal([tuple(r[i] for i in at) for r in found.fetchall()])


def test_every_query_has_a_stable_schema(spark):
    for name, f in catalogue.QUERIES.items():
        assert f(spark, SF).columns, name
