import os
import sys
from decimal import Decimal
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    builder = SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
    session = builder.config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _plain(v):
    v = float(v) if isinstance(v, Decimal) else v
    if v is None or (isinstance(v, float) and v != v):
        return None
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19].replace("T00:00:00", "")
    return round(float(v), 4) if isinstance(v, float) else v


def rows_of(columns, rows):
    """Rows as sorted tuples by column name, for any engine."""
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    #: Floats come last in the sort, as their last digits may differ.
    plain = [tuple(_plain(r[k]) for k in order) for r in rows]
    return sorted(plain, key=lambda r: (repr([v for v in r if not isinstance(v, float)]), repr([round(v, 2) for v in r if isinstance(v, float)])))


@pytest.fixture(scope="session")
def same(spark, duck):
    def check(f, sql):
        got = f(spark, SF)
        want = duck.execute(sql)
        names = [d[0] for d in want.description]
        assert sorted(got.columns) == sorted(names)
        a, b = rows_of(got.columns, [tuple(r) for r in got.collect()]), rows_of(names, want.fetchall())
        assert len(a) == len(b)
        for x, y in zip(a, b):
            for u, v in zip(x, y):
                assert u == v or (isinstance(u, float) and v is not None and abs(u - float(v)) <= 1e-3 * (1 + abs(u)))

    return check
