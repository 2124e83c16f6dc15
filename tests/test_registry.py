"""Registered queries: none of the SQL gives an empty table, which would agree with anything."""

import duckdb

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_no_sql_is_empty():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(found)
    assert [n for n, q in sql.items() if not con.sql(q).limit(1).fetchall()] == []
