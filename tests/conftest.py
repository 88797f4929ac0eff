import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from linkloom import get_spark

    s = get_spark("tests", master="local[4]", spark_sql_shuffle_partitions=4, spark_sql_adaptive_coalescePartitions_parallelismFirst="false")
    yield s
    s.stop()


@pytest.fixture
def df(spark):
    """Makes a DataFrame of rows and a DDL schema."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)


def rows_of(frame, *cols):
    """The rows as sorted tuples, null first."""
    got = [tuple(r[c] for c in cols) if cols else tuple(r) for r in frame.collect()]
    return sorted(got, key=lambda r: tuple((x is not None, x) for x in r))
