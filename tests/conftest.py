import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    base = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(base / "shared"))
        .config("spark.sql.warehouse.dir", str(base / "warehouse"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not SF.exists():
        pytest.skip("no test tables here")
    return str(SF)


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def rows(frame):
    """Rows as sorted text, for frames of Spark or DuckDB in any order."""
    import pandas as pd

    def plain(v):
        if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
            return None
        return round(float(v), 6) if hasattr(v, "__float__") and not isinstance(v, str) else str(v)

    columns = sorted(frame.columns)
    return columns, sorted(repr(tuple(plain(v) for v in r)) for r in frame[columns].itertuples(index=False))


@pytest.fixture(scope="session")
def same_rows():
    return rows
