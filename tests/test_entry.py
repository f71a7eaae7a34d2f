import os
import re

import pytest

import __spark_entry__ as entry

#: Small tables hide what larger ones show, so the second size is taken.
DIR = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if v is None or isinstance(v, float) and v != v:
        return None
    if isinstance(v, float):
        return int(v) if v == int(v) else round(v, 6)
    return v


def _of_llm(name):
    return name == "pipeline" or re.match(r"op\d+_", name)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(k for k in entry.oracle_sql() if not _of_llm(k)))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    df = entry.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    cur = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    want = sorted(repr([_plain(r[names.index(c)]) for c in cols]) for r in cur.fetchall())
    assert sorted(repr([_plain(r[c]) for c in cols]) for r in df.collect()) == want


def test_entry(spark):
    if os.path.isdir(DIR):
        assert entry.entry(spark).count() > 0
