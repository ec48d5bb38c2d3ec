"""Every domain query with SQL gives the SQL's rows; the others run."""

import math

import pytest

from grovespan.plans import queries


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(x):
        return round(x, 8) if isinstance(x, float) and math.isfinite(x) else x

    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, duck, data, name):
    out = queries.QUERIES[name](spark, data)
    want = duck.sql(queries.SQL[name])
    assert sorted(out.columns) == sorted(want.columns)
    assert rows_of(out.columns, [tuple(r) for r in out.collect()]) == rows_of(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, data, name):
    assert queries.QUERIES[name](spark, data).count() >= 0
