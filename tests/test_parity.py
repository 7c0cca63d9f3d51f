"""Every query that has SQL gives the same rows as DuckDB does."""

import datetime
import decimal

import duckdb
import pandas as pd
import pytest

from quillstone.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return pd.Timestamp(v).tz_localize(None).isoformat()
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_rows(spark, data, duck, name):
    found = registry.queries()[name](spark, data)
    columns = sorted(found.columns)
    rows = sorted((tuple(map(plain, r)) for r in found.select(*columns).collect()), key=str)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return
    asked = duck.execute(sql)
    names = [c[0] for c in asked.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in asked.fetchall()), key=str)


def test_entities_are_all_listed(spark, tmp_path):
    """A brand whose list is longer than any of the test tables' gives what the SQL gives."""
    n = 5000
    part = pd.DataFrame({"p_partkey": range(n), "p_name": [f"part of some length {i}" for i in range(n)], "p_brand": [f"Brand#{i % 2}" for i in range(n)], "p_type": "STANDARD ANODIZED TIN"})
    part.to_parquet(tmp_path / "part.parquet")
    found = dict(map(tuple, registry.queries()["parse_and_format_entities"](spark, str(tmp_path)).select("kb_uid", "t").collect()))
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet'")
    expected = dict(con.execute(f"SELECT kb_uid, t FROM ({registry.oracle_sql()['parse_and_format_entities']})").fetchall())
    assert found == expected and min(map(len, found.values())) > 100_000
