"""Every registered query of the engine against its SQL twin in DuckDB on a small table set."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from lodestone.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    return sorted([tuple(None if pd.isna(x) is True else str(x) for x in r) for r in df.itertuples(index=False)], key=str)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_twin(spark, con, name):
    got, want = catalog.QUERIES[name](spark, DATA).toPandas(), con.execute(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_split_oversized_keeps_lines(spark):
    from lodestone.operators.chunks import split_oversized

    text = "\n".join(f"w{i} " * 30 for i in range(40))
    df = spark.createDataFrame([(1, text), (2, None), (3, "short")], "id long, content string")
    got = split_oversized(df, 100).orderBy("id", "part").collect()
    assert "\n".join(r.content for r in got if r.id == 1) == text
    assert [r.content for r in got if r.id != 1] == ["", "short"]
