"""Runs oracle SQL in DuckDB on the same tables."""

from pathlib import Path

import duckdb


def rows(sql: str, sf: str, columns: list[str]) -> list:
    con = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "labels", "conversations", "embeddings"):
        p = Path(sf) / f"{name}.parquet"
        con.sql(f"create view {name} as select * from read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return sorted(con.sql(f"select {', '.join(columns)} from ({sql})").fetchall(), key=str)
