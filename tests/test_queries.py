"""Each query against its DuckDB oracle on the smallest data."""

import pytest

from tessera.plans import registry

KIND = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN"}


def key(row):
    return tuple((x is None, str(x)) for x in row)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_its_oracle(spark, data, duck, name):
    df = registry.QUERIES[name](spark, data)
    q = duck.execute(registry.ORACLES[name])
    columns, kinds = [d[0] for d in q.description], {d[0]: str(d[1]) for d in q.description}
    want = q.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert {c: KIND.get(t, t) for c, t in df.dtypes} == kinds
    got = [[r[c] for c in columns] for r in df.collect()]
    assert sorted(got, key=key) == sorted(map(list, want), key=key)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_gives_rows(spark, data, name):
    assert registry.QUERIES[name](spark, data).count() > 0
