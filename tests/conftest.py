import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).parents[1]))
SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


@pytest.fixture(scope="session")
def same(spark, duck):
    """Asserts that a query and its SQL give the same rows over the smallest tables."""

    def check(query, oracle: str) -> int:
        df = query(spark, SMALL)
        names = sorted(df.columns)
        found = sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)
        cursor = duck.execute(oracle)
        columns = [c[0] for c in cursor.description]
        assert sorted(columns) == names
        wanted = sorted((tuple(r[columns.index(n)] for n in names) for r in cursor.fetchall()), key=str)
        assert found == wanted
        return len(found)

    return check
