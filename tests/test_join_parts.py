"""what a task of a neighbour search sorts does not grow with the tables; partitions follow the rows, not the cores."""

import math

import pytest

from driftfield.operators import cells

XYZ = "id bigint, x double, y double, z double"


def dist(p, q):
    dx, dy, dz = ((a - b) * (a - b) for a, b in zip(p[1:], q[1:]))
    return math.sqrt(dx + dy + dz)


@pytest.fixture
def small_parts(monkeypatch):
    monkeypatch.setattr(cells, "PART_ROWS", 150)
    monkeypatch.setattr(cells, "RANKED_ROWS", 20)


@pytest.mark.parametrize(("k", "hot"), [(1, 250_000), (3, 250_000), (3, 20), (3, None)])
def test_knn_in_many_partitions_equals_brute_force(spark, cloud, small_parts, k, hot):
    rows, _ = cloud
    rows = rows + [(500, 0.0, -0.0, 0.0), (501, -0.0, 0.0, 0.0), (502, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, XYZ)
    asked = df.filter("id % 2 = 0 OR id > 118")  # copies among them, so positions with over 20 queries
    got = {}
    for r in cells.knn(asked, df, k, hot).collect():
        got.setdefault(r["q_id"], []).append((r["rank"], r["p_id"], r["d"]))
    wanted = [p for p in rows if p[0] % 2 == 0 or p[0] > 118]
    assert set(got) == {p[0] for p in wanted}
    for p in wanted:
        want = [(q[0], dist(p, q)) for q in sorted(rows, key=lambda q: (dist(p, q), q[0]))[:k]]
        assert [(i, d) for _, i, d in sorted(got[p[0]])] == want


def test_partitions_follow_the_rows(spark, cloud, small_parts, capsys):
    _, df = cloud
    places = df.select("x", "y", "z").distinct().count()
    cells.knn(df.filter("id >= 0"), df, 3).explain()
    plan = capsys.readouterr().out
    assert f"{math.ceil(3 * places / 20)}), REPARTITION_BY_NUM" in plan and f"{math.ceil(27 * places / 150)}), REPARTITION_BY_NUM" in plan


def test_small_tables_are_left_to_spark(spark, cloud):
    assert cells.parts_of(cloud[1], 1000, cells.PART_ROWS) is None
    assert cells.parts_of(cloud[1], 10 * cells.PART_ROWS, cells.PART_ROWS) == 10
