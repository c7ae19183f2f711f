import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    ckpt = tempfile.mkdtemp(prefix="spanfold-test-ckpt-", dir="/tmp")
    s = (
        SparkSession.builder.master("local[*]")
        .appName("spanfold-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", ckpt)
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def ranges_df(spark, rows, cols=("doc_id", "source", "start", "end")):
    schema = ", ".join(f"{c} {'string' if c in ('source', 'coder', 'text') else 'long'}" for c in cols)
    return spark.createDataFrame(rows, schema)


def char_set(rows, key_idx=(0,), start_idx=-2, end_idx=-1):
    """{key: set of offsets} from range rows."""
    out = {}
    for r in rows:
        k = tuple(r[i] for i in key_idx)
        out.setdefault(k, set()).update(range(r[start_idx], r[end_idx]))
    return out
