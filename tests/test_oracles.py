"""Every query of the library against its SQL in DuckDB."""

import os

import duckdb
import pytest

from folio import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(data, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(value(r[i]) for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    found = duck.execute(queries.oracle_sql()[name])
    names = [x[0] for x in found.description]
    kinds = {x[0]: str(x[1]) for x in found.description}
    assert sorted(names) == sorted(df.columns)
    assert all(TYPES[k] == kinds[c] for c, k in df.dtypes)
    assert rows(map(tuple, df.collect()), df.columns) == rows(found.fetchall(), names)


def test_every_query_without_sql_is_known():
    assert set(queries.queries()) - set(queries.oracle_sql()) == {"login_limiter", "html_chapters", "chapter_search_bytes"}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_plans_are_bounded(spark, name):
    """A plan that copies its own expressions grows past all bounds; none is nearly as large as these."""
    plan = queries.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 40_000 and plan.count("RLIKE") + plan.count("regexp") < 60
