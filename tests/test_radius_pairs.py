"""F16: what a radius join writes for a pair does not grow with the table; crowded cells meet as matrices, in bounded pieces."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftfield.operators import cells

XYZ = "id bigint, x double, y double, z double"


def dist(p, q):
    dx, dy, dz = ((a - b) * (a - b) for a, b in zip(p[1:], q[1:]))
    return math.sqrt(dx + dy + dz)


def brute(queries, points, r):
    return sorted((p[0], q[0], dist(p, q)) for p in queries for q in points if dist(p, q) <= r)


@pytest.fixture
def small_groups(monkeypatch):
    monkeypatch.setattr(cells, "GROUP_PAIRS", 300)
    monkeypatch.setattr(cells, "SORTED", 50)
    monkeypatch.setattr(cells, "BLOCK", 40)


@pytest.mark.parametrize("crowded", [0, 100])
@pytest.mark.parametrize("radius", [0.0, 0.05, 0.4])
def test_matrices_in_many_groups_equal_brute_force(spark, cloud, small_groups, radius, crowded):
    rows, _ = cloud
    rows = rows + [(500, 0.0, -0.0, 0.0), (501, -0.0, 0.0, 0.0), (502, 1e3, 0.0, 0.0), (503, -0.4, 0.0, 0.0)]
    df = spark.createDataFrame([*rows, (504, float("nan"), 0.0, 0.0), (505, None, 0.0, 0.0), (506, float("inf"), 0.0, 0.0)], XYZ)
    asked = [p for p in rows if p[0] % 2 == 0 or p[0] > 100]
    got = cells.radius_join(df.filter("id % 2 = 0 OR id > 100"), df, radius, crowded=crowded, least=0).collect()
    assert sorted(map(tuple, got)) == brute(asked, rows, radius)


def test_ids_of_other_types_and_null_ids(spark):
    points = spark.createDataFrame([(f"p{i}", i * 0.1, 0.0, 0.0) for i in range(30)], "id string, x double, y double, z double")
    asked = spark.createDataFrame([(None, 0.0, 0.0, 0.0), (7, 1.0, 0.0, 0.0)], XYZ)
    got = {(r["q_id"], r["p_id"]) for r in cells.radius_join(asked, points, 0.15, crowded=1, least=0).collect()}
    assert got == {(None, "p0"), (None, "p1"), (7, "p9"), (7, "p10"), (7, "p11")}


def test_no_pairs(spark, cloud):
    _, df = cloud
    far = df.withColumns({"x": F.col("x") + 50.0})
    assert cells.radius_join(far, df, 0.4, least=0).count() == 0 and cells.radius_join(df.limit(0), df, 0.4, least=0).count() == 0


def test_bytes_of_a_pair_do_not_grow_with_the_table(spark, tmp_path):
    """Distances of a crowded table, rounded as the queries do, were stored with eight bytes each."""
    rng = np.random.default_rng(5)
    sizes = []
    for n in (3000, 6000):
        df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(rng.normal(0.0, 0.125, (n, 3)))], XYZ).repartition(4)
        out = str(tmp_path / str(n))
        cells.radius_join(df, df, 0.2).withColumn("d", F.round("d", 6)).write.parquet(out)
        files = [f for f in (tmp_path / str(n)).iterdir() if f.suffix == ".parquet"]
        sizes.append(sum(f.stat().st_size for f in files) / spark.read.parquet(out).count())
    assert sizes[1] < 5.0 and sizes[1] < 1.1 * sizes[0]
