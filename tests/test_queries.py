"""Every query with SQL gives the rows of its SQL; the others run."""

import math
import os

import duckdb
import pytest

from sparkloom.plans.oracles import ORACLES
from sparkloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return str(v) if hasattr(v, "year") else v


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = ordered(df.select(*columns).collect())
    if name in ORACLES:
        q = duck.execute(ORACLES[name])
        names = [d[0] for d in q.description]
        assert sorted(names) == columns
        order = sorted(range(len(names)), key=lambda i: names[i])
        assert got == ordered([r[i] for i in order] for r in q.fetchall())
