import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).parents[1]))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
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
    return s


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def text_of(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def same_rows(df, relation):
    """Whether a DataFrame and a DuckDB result have the same columns and rows in any order."""
    cols = sorted(df.columns)
    assert cols == sorted(relation.columns)
    got = sorted(tuple(map(text_of, r)) for r in df.select(cols).collect())
    at = [relation.columns.index(c) for c in cols]
    want = sorted(tuple(text_of(r[i]) for i in at) for r in relation.fetchall())
    assert got == want
