import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tiny():
    folder = DATA / "sf0.001"
    if not folder.exists():
        pytest.skip("no test tables here")
    return str(folder)


@pytest.fixture(scope="session")
def oracle(tiny):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in Path(tiny).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return v if v != v else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return v


def assert_same(df, con, sql):
    """The rows of a DataFrame are those of a SQL text, columns matched by name, order ignored."""
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(_plain(r[names.index(c)]) for c in df.columns) for r in got.fetchall()), key=repr)
    have = sorted((tuple(_plain(x) for x in r) for r in df.collect()), key=repr)
    assert have == want


@pytest.fixture(scope="session")
def same():
    return assert_same
