import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    found = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    found.sparkContext.setLogLevel("ERROR")
    from liftline.session import ship

    ship(found)
    return found


@pytest.fixture(scope="session")
def small():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def medium():
    return f"{DATA}/sf0.01"


@pytest.fixture(scope="session")
def duck(small):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small}/{f}'")
    return con


def rows_of(frame):
    """Rows as sorted tuples by column name; floats rounded."""
    columns = sorted(frame.columns)

    def plain(x):
        if x is None or type(x).__name__ in ("NaTType", "NAType") or x != x:
            return None
        if hasattr(x, "item"):
            x = x.item()
        return round(x, 6) + 0.0 if isinstance(x, float) else str(x) if type(x).__name__ in ("Timestamp", "datetime") else x

    rows = [tuple(plain(x) for x in r) for r in frame[columns].itertuples(index=False)]
    return columns, sorted(rows, key=lambda r: tuple((x is not None, str(type(x)), x if x is not None else 0) for x in r))


@pytest.fixture(scope="session")
def same():
    def check(got, wanted):
        a, b = rows_of(got), rows_of(wanted)
        assert a[0] == b[0]
        assert len(a[1]) == len(b[1])
        for x, y in zip(a[1], b[1], strict=True):
            assert x == pytest.approx(y, abs=2e-6), (a[0], x, y)

    return check
