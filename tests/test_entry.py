import os
import re

import duckdb
import pytest

from stratamill import registry

SF = "/root/testdata/sf0.001"


def rows(frame):
    plain = lambda x: None if x is None or x != x else round(x, 5) if isinstance(x, float) else str(x)
    found = (tuple(map(plain, r)) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))
    return sorted(found, key=lambda r: [(x is None, 0 if x is None else x) for x in r])


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_its_sql(spark, name):
    got = registry.queries()[name](spark, SF).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.sql(f"CREATE VIEW {re.sub(r'[.].*', '', f)} AS SELECT * FROM '{SF}/{f}'")
    want = db.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
