"""Every query with an oracle against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from flowlake.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def text(value) -> str:
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
        return "null"
    if isinstance(value, bool) or type(value).__name__ in ("bool", "bool_"):
        return str(bool(value))
    if hasattr(value, "tolist") and not hasattr(value, "__len__"):
        value = value.tolist()
    return f"{float(value):.9g}" if isinstance(value, (int, float)) or type(value).__name__ == "Decimal" else str(value)


def plain(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    return sorted(tuple(text(v) for v in row) for row in frame[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_have_rows(spark, name):
    assert QUERIES[name](spark, SF).limit(5).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(ORACLES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_minute_documents_at_the_keys_of_a_late_copy(spark, tmp_path):
    """Orders of the sixtieth copy, cameras as they are: values have 18 digits in thousandths."""
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in ("lineitem", "events", "supplier"):
        moved = "* replace (l_orderkey + 59 * 150000 as l_orderkey)" if t == "lineitem" else "*"
        con.execute(f"copy (select {moved} from '/root/testdata/sf0.01/{t}.parquet') to '{tmp_path}/{t}.parquet'")
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    got, want = QUERIES["minute_documents"](spark, str(tmp_path)).toPandas(), con.execute(ORACLES["minute_documents"]).df()
    assert want["spatial"].notna().any() and plain(got) == plain(want)
