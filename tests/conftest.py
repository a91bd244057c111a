import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


def oracle(sql: str, sf: str = SF):
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c.execute(sql).df()


def multiset(df):
    import collections

    import pandas as pd

    def cell(v):
        if not pd.api.types.is_scalar(v):
            return repr(v)
        if pd.isna(v):
            return None
        return int(v) if isinstance(v, float) and v == int(v) else round(v, 6) if isinstance(v, float) else v

    df = df[sorted(df.columns)].astype(object)
    return list(df.columns), collections.Counter(tuple(map(cell, r)) for r in df.itertuples(index=False))
