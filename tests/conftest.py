import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


def rounded(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(rounded(x) for x in v)
    return v


@pytest.fixture(scope="session")
def same_as_sql(spark, sf_dir):
    """Compare the rows of a query with those of its SQL."""
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")

    def check(f, sql):
        df = f(spark, sf_dir)
        names = sorted(df.columns)
        mine = sorted(repr(tuple(rounded(r[c]) for c in names)) for r in df.collect())
        other = con.sql(sql)
        at = [other.columns.index(c) for c in names]
        theirs = sorted(repr(tuple(rounded(r[i]) for i in at)) for r in other.fetchall())
        assert sorted(other.columns) == names
        assert mine == theirs

    return check
