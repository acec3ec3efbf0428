import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from driftfield.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "6g"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def cloud(spark):
    """Clustered points with copies: a dense clump, a sparse rest and a position that holds a third of the rows."""
    import numpy as np

    rng = np.random.default_rng(7)
    dense = rng.normal(0.5, 0.002, (60, 3))
    sparse = rng.uniform(-2, 3, (60, 3))
    copies = np.repeat(rng.uniform(0, 1, (1, 3)), 60, axis=0)
    xyz = np.vstack([dense, sparse, copies])
    rows = [(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(xyz)]
    return rows, spark.createDataFrame(rows, "id bigint, x double, y double, z double")
