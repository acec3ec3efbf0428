import pytest
from pyspark.sql import functions as F

from driftfield.operators import sample


@pytest.fixture(scope="module")
def mesh(spark):
    """Two tetrahedra that share a face, a degenerate one, and values u = x + 2y + 3z."""
    xyz = [(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 0.0, 0.0, 1.0), (4, 1.0, 1.0, 1.0)]
    nodes = spark.createDataFrame(xyz, "node_id bigint, x double, y double, z double")
    elements = spark.createDataFrame([(5, [1, 2, 3, 4]), (3, [0, 1, 2, 3]), (1, [0, 1, 1, 2])], "elem_id bigint, nodes array<bigint>")
    values = nodes.select("node_id", (F.col("x") + 2 * F.col("y") + 3 * F.col("z")).alias("u"), F.lit(1.0).alias("v"), F.col("x").alias("w"))
    pts = spark.createDataFrame(
        [(0, 0.1, 0.2, 0.3), (1, 0.5, 0.5, 0.5), (2, 0.0, 0.0, 0.0), (3, 1 / 3, 1 / 3, 1 / 3), (4, 2.0, 2.0, 2.0), (5, -1.0, -1.0, -1.0), (6, None, 0.0, 0.0)],
        "id bigint, x double, y double, z double",
    )
    return nodes, elements, values, pts


def test_lowest_containing_element_and_shared_faces(mesh):
    nodes, elements, _, pts = mesh
    got = {r["id"]: r["elem_id"] for r in sample.point_in_element(pts, elements, nodes).collect()}
    assert got == {0: 3, 1: 5, 2: 3, 3: 3}
    found = {r["id"]: r["lam"] for r in sample.point_in_element(pts, elements, nodes).collect()}
    assert all(sum(lam) == pytest.approx(1.0) for lam in found.values())


@pytest.mark.parametrize("fallback,far,low", [("nearest_node", 6.0, 0.0), ("nearest_element_node", 6.0, 0.0), ("zero", 0.0, 0.0)])
def test_values_inside_and_outside(mesh, fallback, far, low):
    nodes, elements, values, pts = mesh
    good = elements.filter("elem_id > 1")
    got = {r["id"]: r["u"] for r in sample.fem_sample(pts, good, nodes, values, fallback=fallback).collect()}
    assert got[0] == pytest.approx(1.4) and got[1] == pytest.approx(3.0) and got[2] == pytest.approx(0.0)
    assert got[4] == pytest.approx(far) and got[5] == pytest.approx(low)


def test_strict_centroid_elements_give_zero_outside(mesh):
    nodes, elements, values, pts = mesh
    good = elements.filter("elem_id > 1")
    got = {r["id"]: r["u"] for r in sample.centroid_sample(pts, good, nodes, values, "tet4", strict_inside=True).collect()}
    assert got[0] == pytest.approx(1.4) and got[4] == 0.0 and got[6] == 0.0


def test_mesh_check_counts_bad_elements(spark, mesh):
    nodes, elements, _, _ = mesh
    bad = elements.unionByName(spark.createDataFrame([(9, [0, 1, 77])], "elem_id bigint, nodes array<bigint>"))
    row = sample.mesh_check(bad, nodes, "tet4").first()
    assert (row["n_elements"], row["n_wrong_width"], row["n_dangling"]) == (4, 1, 1)
