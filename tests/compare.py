"""Running a query and its SQL side by side."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sf_dir: str, sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.sql(sql).df()


def _cell(v):
    if v is None or v is pd.NaT or v is pd.NA or v != v:
        return "null"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    try:
        return f"{float(v):.4f}" if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(_cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


def same(left: pd.DataFrame, right: pd.DataFrame) -> None:
    assert sorted(left.columns) == sorted(right.columns)
    a, b = rows(left), rows(right)
    assert len(a) == len(b)
    assert a == b
