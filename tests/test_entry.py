"""Each registered query of the library against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from switchback.plans import queries as core

SF = "/root/testdata/sf0.001"


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return None if v is None else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(spark, duck, name):
    df = core.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    assert name in core.oracle_sql()
    r = duck.execute(core.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    assert rows == sorted((tuple(plain(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=str)


def test_library_needs_no_llm():
    import pathlib

    root = pathlib.Path(core.__file__).parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "switchback.llm" not in p.read_text(), p
