"""Every registered query of the engine's own operators: the SQL's rows where there is SQL, else a stable schema and some rows."""

import pytest
from tests.oracle import spark_rows, sql_rows

from quarryline.plans.catalog import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    names, got = spark_rows(df)
    if name not in ORACLE_SQL:
        assert got
        return
    columns, want = sql_rows(ORACLE_SQL[name], sf_dir)
    assert names == columns
    assert len(got) == len(want)
    different = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    assert not different, different[:3]
