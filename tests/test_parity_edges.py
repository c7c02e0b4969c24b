"""Registered queries give DuckDB's rows on small tables of keys and values that sf0.001 lacks."""

import duckdb
import pytest

import __spark_entry__


@pytest.fixture
def same(spark, tmp_path):
    """Writes a table from SQL and asserts that a query and its SQL give the same rows of it, values told apart by their text."""

    def check(name, table, sql):
        con = duckdb.connect()
        con.execute(f"COPY ({sql}) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
        df = __spark_entry__.queries()[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
        assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))

    return check


def test_states_beyond_four_bytes_of_hz(same):
    keys = "1, 4294, 4295, 20000, 1200000, 4294954, 4294955, 2147477000"
    same("voltage_states", "part", f"SELECT unnest([{keys}])::BIGINT AS p_partkey, unnest(range(1, 9))::INT AS p_size")


#: (value - 20) * 10^(id % 9 - 4), every value with every power: ties in doubles above and below them, and exact ones
TIES = """SELECT row_number() OVER (ORDER BY value, i)::BIGINT AS event_id, value
  FROM range(9) r(i), (SELECT unnest([25.0, 15.0, 35.0, 5.0, 22.5, 20.5, 19.5, 20.0, 20.005, 488.15])::DOUBLE AS value)"""


def test_roundings_of_ties(same):
    same("roundings", "events", TIES)


def test_unit_texts_of_ties(same):
    same("unit_texts", "events", TIES)


def test_unit_texts_of_none_and_of_large_values(same):
    same("unit_texts", "events", """SELECT row_number() OVER (ORDER BY value, i)::BIGINT AS event_id, value
      FROM range(9) r(i), (SELECT unnest([NULL, 10019.99, 10020.0, 10020.01, 1e5 + 20, 123456.75, 98765432.1, 2e9, 1e12, -2e9])::DOUBLE AS value)""")  # fmt: skip
    same("unit_texts", "events", "SELECT unnest([NULL, 4])::BIGINT AS event_id, unnest([25.0, NULL])::DOUBLE AS value")


def test_unit_texts_columns_in_the_order_of_the_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    want = [c[0] for c in con.execute(__spark_entry__.oracle_sql()["unit_texts"]).description]
    assert __spark_entry__.queries()["unit_texts"](spark, folder).columns == want
