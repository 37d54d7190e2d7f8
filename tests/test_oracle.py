"""Every registered query with SQL gives the SQL's rows at the smallest scale."""

import duckdb
import pandas as pd
import pytest

from folioscope.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()

    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "NULL"
        return f"{float(v):.6g}" if isinstance(v, int | float) and not isinstance(v, bool) else str(v)

    for c in df.columns:
        df[c] = df[c].map(cell)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, duck, small, name):
    got, want = normal(registry.queries()[name](spark, small).toPandas()), normal(duck.sql(registry.oracle_sql()[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_has_rows(spark, small, name):
    assert registry.queries()[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["document_id", "hit_rank", "position", "window_end", "content"]
