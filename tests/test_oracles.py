"""Every query of the catalogue against its SQL."""

import duckdb
import pytest

from scorelake.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    cur = con.execute(catalogue.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    want = sorted(str([r[cols.index(c)] for c in sorted(cols)]) for r in cur.fetchall())
    df = catalogue.queries()[name](spark, DATA)
    assert sorted(df.columns) == sorted(cols)
    got = sorted(str([r[c] for c in sorted(cols)]) for r in df.collect())
    assert got == want
