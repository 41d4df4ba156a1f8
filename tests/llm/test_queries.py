"""The package's SQL against its queries."""

import duckdb
import pytest
from millrace.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = con.sql(ORACLE[name]), QUERIES[name](spark, SF)
    order = sorted(got.columns)
    assert sorted(want.columns) == order
    assert sorted(map(str, want.select(*order).fetchall())) == sorted(str(tuple(r)) for r in got.select(*order).collect())


def test_every_operator_is_there():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
