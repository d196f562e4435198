import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = sys.path[0] + os.pathsep + os.environ.get("PYTHONPATH", "")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", tempfile.mkdtemp()).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def same_rows(spark, name, sf_dir=SF):
    """The query's rows and those of its SQL are the same."""
    import numbers

    import duckdb
    import pandas as pd

    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations", "events"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")

    def plain(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        return bool(v) if "bool" in str(type(v)) else round(float(v), 9) if isinstance(v, numbers.Number) else v

    a, b = entry.queries()[name](spark, sf_dir).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    rows = lambda df: sorted(repr(tuple(map(plain, r))) for r in df[cols].itertuples(index=False, name=None))
    assert rows(a) == rows(b)
