import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def plain(rows):
    """Rows as sorted tuples of comparable values."""
    import datetime
    import decimal
    import math

    def value(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return None
        if isinstance(x, (bool, str)):
            return x
        if isinstance(x, (int, float, decimal.Decimal)):
            return round(float(x), 6)
        if isinstance(x, datetime.datetime):
            return x.isoformat()
        return str(x)

    return sorted((tuple(map(value, r)) for r in rows), key=repr)


@pytest.fixture(scope="session")
def same(spark, duck):
    def compare(query, sql):
        df = query(spark, SF)
        names = sorted(df.columns)
        found = duck.sql(sql)
        assert names == sorted(found.columns)
        at = [found.columns.index(c) for c in names]
        assert plain(df.select(*(f"`{c}`" for c in names)).collect()) == plain([[r[i] for i in at] for r in found.fetchall()])

    return compare
