import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from quire.session import ensure_checkpoint_dir, get_spark
    s = get_spark("local[4]", 4, app="quire-tests")
    ensure_checkpoint_dir(s, tempfile.mkdtemp(prefix="quire-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate a Column expression over a one-row DataFrame of named string inputs."""
    def run(expr, **cols):
        names = list(cols) or ["x"]
        df = spark.createDataFrame([tuple(cols.values()) or (None,)], ", ".join(f"{n} string" for n in names))
        return df.select(expr.alias("out")).first()["out"]
    return run
