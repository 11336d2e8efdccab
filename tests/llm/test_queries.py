import re

import duckdb
import pytest

from stratamill.llm import queries

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages"


def rows(frame):
    return sorted(tuple(str(x) for x in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES.split():
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(db.sql(queries.ORACLE_SQL[name]).df())


def test_every_operator_has_a_query():
    assert {int(re.match(r"op([0-9]+)_", n)[1]) for n in queries.QUERIES} == set(range(1, 11))
