import os
import sys
import tempfile

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    conf = {"spark.master": "local[8]", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-"), "spark.driver.memory": "4g"}
    session = SparkSession.builder.config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("OFF")
    return session


@pytest.fixture(scope="session")
def data():
    return DATA


def _text(x) -> str:
    if x is None or x != x:
        return "None"
    if isinstance(x, float):
        return f"{x + 0.0:.9g}"
    return str(x)[:10] if hasattr(x, "year") else str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(_text(float(r[i]) if isinstance(r[i], int) and not isinstance(r[i], bool) else r[i]) for i in order) for r in rows)


@pytest.fixture(scope="session")
def agree():
    """Asserts that a DataFrame has the rows of a SQL text over the same tables."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")

    def check(df, sql):
        got = con.execute(sql)
        names = [c[0] for c in got.description]
        assert sorted(df.columns) == sorted(names)
        assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, got.fetchall())

    return check
