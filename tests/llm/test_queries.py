"""The registered queries of the problems on the smallest tables, against their SQL where there is any."""

import math
import os

import duckdb
import pytest

from switchback.llm import queries as Q

SF = "/root/testdata/sf0.001"


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return None if v is None else str(v)


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, name):
    df = Q.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    if name not in Q.oracle_sql():
        assert rows
        return
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    r = c.execute(Q.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    assert rows == sorted((tuple(plain(x[names.index(k)]) for k in cols) for x in r.fetchall()), key=str)
