"""Every query with an oracle against DuckDB on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from foldview import catalogue

D = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, (float, decimal.Decimal)):
        return repr(round(float(v), 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return f"[{','.join(map(norm, v))}]"
    return repr(v)


@pytest.mark.skipif(not os.path.isdir(D), reason="needs the driver's tables")
@pytest.mark.parametrize("name", [n for n in catalogue.oracle_sql() if not n.startswith("stream_")] + ["stream_ledger"])
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events conversations".split():
        con.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    got = catalogue.queries()[name](spark, D)
    want = con.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    at = sorted(columns)
    assert sorted(tuple(norm(r[c]) for c in at) for r in got.collect()) == sorted(tuple(norm(r[columns.index(c)]) for c in at) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
