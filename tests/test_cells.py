import math

import pytest
from pyspark.sql import functions as F

from driftfield.model import Box
from driftfield.operators import cells

XYZ = "id bigint, x double, y double, z double"


def dist(p, q):
    return math.sqrt(sum((a - b) ** 2 for a, b in zip(p[1:], q[1:])))


@pytest.mark.parametrize("hot", [None, 7])
def test_radius_join_equals_brute_force_with_and_without_split_cells(cloud, hot):
    rows, df = cloud
    got = {(r["q_id"], r["p_id"]) for r in cells.radius_join(df, df, 0.4, hot).collect()}
    assert got == {(p[0], q[0]) for p in rows for q in rows if dist(p, q) <= 0.4}


def test_split_join_keeps_each_pair_once(spark):
    left = spark.range(90).select(F.col("id").alias("l"), F.when(F.col("id") < 60, 0).otherwise(F.col("id")).alias("k"))
    right = spark.range(40).select(F.col("id").alias("r"), F.when(F.col("id") < 30, 0).otherwise(F.col("id") + 50).alias("k"))
    plain = sorted(tuple(r) for r in left.join(right, "k").select("l", "r").collect())
    assert sorted(tuple(r) for r in cells.spread_join(left, right, ["k"], hot=8).select("l", "r").collect()) == plain


def test_points_on_edges_outside_and_not_finite(spark):
    rows = [(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, -1.0, 0.0, 0.0), (3, float("nan"), 0.0, 0.0), (4, None, 0.0, 0.0), (5, 1e9, 0.0, 0.0)]
    df = spark.createDataFrame(rows, XYZ)
    got = {(r["q_id"], r["p_id"]) for r in cells.radius_join(df, df, 1.0).collect()}
    assert got == {(0, 0), (1, 1), (2, 2), (5, 5), (0, 1), (1, 0), (0, 2), (2, 0)}


@pytest.mark.parametrize("k", [1, 5])
def test_knn_equals_brute_force_on_clusters_and_copies(cloud, k):
    rows, df = cloud
    got = {}
    for r in cells.knn(df, df, k, hot=20).collect():
        got.setdefault(r["q_id"], []).append((r["rank"], r["p_id"]))
    for p in rows:
        want = [q[0] for q in sorted(rows, key=lambda q: (dist(p, q), q[0]))[:k]]
        assert [i for _, i in sorted(got[p[0]])] == want


def test_knn_edges(spark):
    one = spark.createDataFrame([(7, 1.0, 1.0, 1.0)], XYZ)
    far = spark.createDataFrame([(1, 1e6, -1e6, 0.0), (2, 1.0, 1.0, 1.0)], XYZ)
    assert {(r["q_id"], r["p_id"]) for r in cells.knn(far, one, 3).collect()} == {(1, 7), (2, 7)}
    assert cells.knn(far, one.limit(0), 2).count() == 0
    line = spark.createDataFrame([(i, float(i), 0.0, 0.0) for i in range(9)], XYZ)
    mid = spark.createDataFrame([(0, 3.5, 0.0, 0.0)], XYZ)
    assert cells.nearest(mid, line).first()["p_id"] == 3  # tie goes to the lower id


def test_knn_does_not_depend_on_partitions(cloud):
    _, df = cloud
    one = sorted(map(tuple, cells.knn(df.repartition(1), df.repartition(1), 3).collect()))
    many = sorted(map(tuple, cells.knn(df.repartition(17), df.repartition(17).orderBy(F.desc("id")), 3).collect()))
    assert one == many


def test_neighbour_counts_merge_copies(cloud):
    rows, df = cloud
    got = {r["id"]: r["n_near"] for r in cells.neighbour_counts(df, df, 0.3, hot=10).collect()}
    assert got == {p[0]: sum(dist(p, q) <= 0.3 for q in rows) for p in rows}


def test_box_intersections_of_very_different_sizes(spark):
    import random

    rnd = random.Random(3)
    boxes = []
    for i in range(60):
        lo = [rnd.uniform(0, 10) for _ in range(3)]
        size = rnd.choice([0.0, 0.01, 0.5, 6.0])
        boxes.append((i, *lo, *[v + size for v in lo]))
    df = spark.createDataFrame(boxes, "id bigint, lo_x double, lo_y double, lo_z double, hi_x double, hi_y double, hi_z double")
    got = sorted((r["a_id"], r["b_id"]) for r in cells.box_intersections(df, df, cells.Frame.of(Box((0, 0, 0), (16, 16, 16))), hot=9).collect())
    want = sorted((a[0], b[0]) for a in boxes for b in boxes if all(a[1 + i] <= b[4 + i] and b[1 + i] <= a[4 + i] for i in range(3)))
    assert got == want


def test_exploded_sides_are_never_broadcast(spark, capsys):
    """a small table's estimate says nothing of the 27 cells that each of its rows is written into."""
    df = spark.createDataFrame([(i, i * 0.1, 0.0, 0.0) for i in range(50)], XYZ)
    for pairs in (
        cells.radius_join(df, df, 0.25),
        cells.neighbour_counts(df, df, 0.25),
        cells.box_intersections(*[df.select("id", *[F.col(a).alias(f"lo_{a}") for a in "xyz"], *[(F.col(a) + 0.2).alias(f"hi_{a}") for a in "xyz"])] * 2, cells.Frame.of(Box((0, 0, 0), (5, 5, 5)))),
    ):
        pairs.explain()
        lines = capsys.readouterr().out.splitlines()
        assert not any("BroadcastHashJoin" in line and "cx" in line for line in lines) and any("SortMergeJoin" in line for line in lines)
