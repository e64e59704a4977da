"""Every registered query of the matching engine against its SQL in DuckDB, on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from rolecast import plans

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.exists(f"{DATA}/part.parquet"):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return repr(round(float(v), 6) + 0.0)
    if isinstance(v, datetime.datetime):
        return str(v.replace(tzinfo=None))
    if isinstance(v, (list, tuple)):
        return [norm(x) for x in v]
    return str(v)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([norm(r[i]) for i in order] for r in values)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, DATA)
    result = duck.execute(plans.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, result.fetchall())


def test_names():
    assert set(plans.ORACLES) <= set(plans.QUERIES)
    assert set(plans.QUERIES) == set(plans.ORACLES)


def test_fixed_values():
    """Values that the SQL shares with the operators, pinned by hand."""
    from rolecast.functions import dictionaries as D

    assert D.BRIDGES["vue"] and D.DEGREE_RANK["bachelor"] == 3 and D.BACHELOR == 3
    assert "大模型" in D.SPECIALIZED_KEYWORDS and "架构师" in D.LEAD_KEYWORDS and D.MAJOR_CITIES[:2] == ("北京", "上海")
