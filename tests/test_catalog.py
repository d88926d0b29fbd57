"""Every registered query of the engine's own operators against its SQL on the smallest tables."""

import datetime
import decimal
import math

import pytest

from weirflow.operators.pipeline import WindowedPipeline
from weirflow.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    link = duckdb.connect()
    for t in TABLES:
        link.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return link


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    if isinstance(x, decimal.Decimal):
        return round(float(x), 6)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_against_sql(spark, db, name):
    want = db.execute(catalog.SQL[name])
    names = [c[0] for c in want.description]
    got = catalog.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


def test_every_query_has_its_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)


def test_topn_keeps_few_records(spark, monkeypatch):
    """The function of window_apply_topn on a window's records holds about as many as it returns."""
    held, alive, most = [], [0], [0]
    monkeypatch.setattr(WindowedPipeline, "apply", lambda self, f, schema: held.append(f))
    catalog.window_apply_topn(spark, SF)

    class Row(dict):
        def __init__(self, *a, **b):
            super().__init__(*a, **b)
            alive[0] += 1
            most[0] = max(most[0], alive[0])

        def __del__(self):
            alive[0] -= 1

    got = held[0](Row(event_id=i * 7 % 1000, value=float(i * 7 % 1000 % 100)) for i in range(1000))
    assert got == [{"event_id": i, "value": 99.0} for i in (99, 199, 299)] and most[0] < 20
