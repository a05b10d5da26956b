import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
# Scorers defined in test modules are looked up by the Python workers.
os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(os.path.abspath(__file__)), os.environ.get("PYTHONPATH", "")])

from gradeloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("4", "tests", shuffle_partitions=4)
    yield s
    s.stop()


@pytest.fixture
def col(spark):
    """Evaluate one Column expression over a list of strings."""
    def run(build, values, schema="v string"):
        df = spark.createDataFrame([(v,) for v in values], schema)
        return [r[0] for r in df.select(build(df["v"]).alias("r")).collect()]
    return run
