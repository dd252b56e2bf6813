"""Every screening query beside its SQL, at the smallest scale factor."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from tamis.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(df: pd.DataFrame) -> list[str]:
    text = lambda v: "null" if not hasattr(v, "__len__") and pd.isna(v) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted("|".join(map(text, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    if name in catalogue.SQL:
        want = db.sql(catalogue.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)
