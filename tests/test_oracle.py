"""Every registered query of the environmental part must equal DuckDB on the same parquet (sf0.001)."""

import pytest

from airsignal.plans import catalog
from airsignal.plans.registry import round_doubles
from scripts.check_oracle import TABLES, rows
from tests.conftest import SF

REGISTRY = catalog.registry()


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_sql():
    assert [n for n, q in REGISTRY.items() if q.sql is None] == []


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_matches_oracle(spark, con, name):
    q = REGISTRY[name]
    df = q.fn(spark, SF)
    # doubles rounded on the Spark side must also be rounded in the SQL (same digits)
    doubles = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    assert doubles <= set(q.digits), sorted(doubles - set(q.digits))
    s, o = round_doubles(df, q.digits).toPandas(), con.sql(q.sql).df()
    assert sorted(s.columns) == sorted(o.columns)
    assert len(s) == len(o)
    assert rows(s) == rows(o)
