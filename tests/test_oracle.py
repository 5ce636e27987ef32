"""Every core query with a SQL twin, against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from paperlake.queries import core_oracles, core_queries

ROOT = os.environ.get("PAPERLAKE_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings papers paper_text bib chunks chunk_vec opens eval_items subjects subject_labels".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{ROOT}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{ROOT}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda x: "null" if x is None else repr(round(x, 9)) if isinstance(x, float) and not math.isnan(x) else str(x)
    return sorted(columns), sorted(tuple(value(r[i]) for i in order) for r in data)


@pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables")
@pytest.mark.parametrize("name", sorted(core_oracles()))
def test_twin(spark, duck, name):
    df = core_queries()[name](spark, ROOT)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(core_oracles()[name])
    want = rows([c[0] for c in cursor.description], cursor.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1]), (len(got[1]), len(want[1]))
    assert got[1] == want[1]
