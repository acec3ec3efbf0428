"""Cells of mesh elements: a point meets few elements, and all that hold it."""

import numpy as np
from pyspark.sql import functions as F

from driftfield.operators import sample as smp
from driftfield.operators.cells import locate

TETS = ((4, 6), (4, 5), (2, 6), (2, 3), (1, 5), (1, 3))


def _cubes(n):
    at = lambda i, j, k: (i * (n + 1) + j) * (n + 1) + k
    nodes = [(at(i, j, k), float(i), float(j), float(k)) for i in range(n + 1) for j in range(n + 1) for k in range(n + 1)]
    corner = lambda c, i, j, k: at(i + (c >> 2 & 1), j + (c >> 1 & 1), k + (c & 1))
    cells = [(i, j, k) for i in range(n) for j in range(n) for k in range(n)]
    elements = [(6 * m + o, [corner(c, *cell) for c in (0, a, b, 7)]) for m, cell in enumerate(cells) for o, (a, b) in enumerate(TETS)]
    return nodes, elements


def test_a_point_meets_few_elements_and_all_that_hold_it(spark):
    n = 5
    nodes, elements = _cubes(n)
    index = smp.mesh_index(spark.createDataFrame(elements, "elem_id bigint, nodes array<bigint>"), spark.createDataFrame(nodes, "node_id bigint, x double, y double, z double"))
    rng = np.random.default_rng(5)
    # inside, on faces and edges, and on nodes
    xyz = np.vstack([rng.uniform(0, n, (300, 3)), np.round(rng.uniform(0, n, (60, 3)) * 2) / 2, np.round(rng.uniform(0, n, (40, 3)))])
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "id bigint, x double, y double, z double")
    met = locate(points, index.frame, index.levels).join(index.cells, ["level", "cx", "cy", "cz"])
    assert met.filter(F.col("id") < 300).count() < 30 * 300
    found = {r["id"]: r["elem_id"] for r in smp.find_elements(points, index).collect()}
    place = {r[0]: np.array(r[1:]) for r in nodes}
    corners = np.array([[place[c] for c in e[1]] for e in elements])
    inv = np.linalg.inv(np.transpose(corners[:, 1:] - corners[:, :1], (0, 2, 1)))
    for i, p in enumerate(xyz):
        lam = np.einsum("eab,eb->ea", inv, p - corners[:, 0])
        lam = np.hstack([1 - lam.sum(1, keepdims=True), lam])
        assert found[i] == elements[int(np.argmax(lam.min(1) >= -1e-9))][0]
