"""Comparing a query with DuckDB."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        return f"{v + 0.0:.6f}" if isinstance(v, float) else str(v)

    return sorted(tuple(one(v) for v in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))


def same(spark_df, con, sql: str) -> None:
    got, want = spark_df.toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    for c in got.columns:  # a column of whole numbers with gaps comes as floats from one side
        if got[c].dtype != want[c].dtype and "loat" in str(got[c].dtype) + str(want[c].dtype):
            got[c], want[c] = got[c].astype(float), want[c].astype(float)
    assert canonical(got) == canonical(want)
