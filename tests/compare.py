"""Spark rows against DuckDB's over the same parquet files."""

from pathlib import Path

import duckdb


def same_rows(df, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    wanted = con.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(wanted.columns)
    rows = lambda found: sorted(map(repr, found))
    assert rows(tuple(r) for r in df.select(*columns).collect()) == rows(wanted.select(*columns).fetchall())
