"""What is prepared once for many steps, rows that own much of the weight, and slabs: same results as without."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from driftfield import session
from driftfield.model import Box
from driftfield.operators import cells, density, move, paths, points as gen, rules

XYZ = "id bigint, x double, y double, z double"
NODES = "node_id bigint, x double, y double, z double"
VALUES = "node_id bigint, u double, v double, w double"


@pytest.fixture(scope="module")
def scattered():
    """Nodes in a clump and spread out, with two at one place; points among and outside them, one without coordinates."""
    rng = np.random.default_rng(11)
    at = np.vstack([rng.normal(0.5, 0.01, (60, 3)), rng.uniform(0, 1, (60, 3))])
    at[7] = at[3]
    values = rng.normal(size=(120, 3))
    start = np.vstack([rng.uniform(-0.2, 1.2, (30, 3)), rng.normal(0.5, 0.02, (10, 3))])
    return at, values, start


def tables(spark, at, values, start):
    nodes = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(at)], NODES)
    vals = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(values)], VALUES)
    pts = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(start)] + [(99, None, 0.0, 0.0)], XYZ)
    return nodes, vals, pts


def walk(at, values, start, dt, steps, box):
    """Midpoint rule on the nearest node, wrapped into the box."""
    near = lambda p: values[np.argmin(((p[:, None] - at[None]) ** 2).sum(-1), axis=1)]
    out = [start]
    for _ in range(steps):
        p = out[-1]
        p = p + dt * near(p + dt / 2 * near(p))
        lo, w = np.array(box.lo), np.array(box.width)
        out.append(lo + np.mod(p - lo, w))
    return out


@pytest.mark.parametrize("few", [True, False])
def test_nodes_found_from_the_node_before(spark, scattered, monkeypatch, few):
    """Two-stage steps with points wrapped across the box, so that some lose their node: the same as a search of all nodes."""
    if not few:
        monkeypatch.setattr(cells, "SMALL_CELLS", 0)
    nodes, vals, pts = tables(spark, *scattered)
    box = Box((-0.2, -0.2, -0.2), (1.2, 1.2, 1.2))
    got = move.advect(pts, move.NodeField(nodes, vals), 0.1, 3, "rk2", rules.wrap_periodic(box))
    got = {(r["particle_id"], r["t_idx"]): (r["x"], r["y"], r["z"]) for r in got.collect()}
    for n, p in enumerate(walk(*scattered, 0.1, 3, box)):
        for i in range(len(p)):
            assert got[i, n] == pytest.approx(tuple(p[i]))
    assert got[99, 3][0] is None


def test_node_series_equals_its_mixture(spark, scattered):
    at, values, start = scattered
    nodes, vals, pts = tables(spark, at, values, start)
    series = vals.select(F.lit(0).alias("t_idx"), "*").union(vals.select(F.lit(1).alias("t_idx"), "node_id", *[(F.col(c) * 3).alias(c) for c in "uvw"]))
    times = spark.createDataFrame([(0, 0.0), (1, 1.0)], "t_idx int, t double")
    got = move.advect(pts, move.NodeSeriesField(nodes, series, times), 0.25, 2, "euler")
    got = {(r["particle_id"], r["t_idx"]): (r["x"], r["y"], r["z"]) for r in got.collect()}
    p = start
    for n in range(2):
        near = values[np.argmin(((p[:, None] - at[None]) ** 2).sum(-1), axis=1)]
        p = p + 0.25 * near * (1 + 2 * 0.25 * n)
        for i in range(len(p)):
            assert got[i, n + 1] == pytest.approx(tuple(p[i]))


def test_nodes_are_located_once(spark, scattered, monkeypatch):
    nodes, vals, pts = tables(spark, *scattered)
    made = []
    plain = cells.locate
    monkeypatch.setattr(cells, "locate", lambda df, frame, levels: made.append(len(levels)) or plain(df, frame, levels))
    move.advect(pts, move.NodeField(nodes, vals), 0.01, 4, "rk4").collect()
    # the probe of the depth, the stored cells, and the first search's positions: nothing for further stages or steps
    assert len(made) <= 4


def test_only_recorded_steps_stay_on_disk(spark, scattered):
    nodes, vals, pts = tables(spark, *scattered)
    before = set(session._WRITTEN.get(spark.sparkContext.applicationId, []))
    got = move.advect(pts, move.NodeField(nodes, vals), 0.01, 7, "euler", record_every=3)
    assert sorted(r["t_idx"] for r in got.select("t_idx").distinct().collect()) == [0, 3, 6, 7]
    (folder,) = [p for p in session._WRITTEN[spark.sparkContext.applicationId] if "/advect-" in p and p not in before]
    kept = [d for top in ("steps", "between") for d in os.listdir(f"{folder}/{top}")]
    assert len(kept) <= 4 + 1


@pytest.mark.parametrize("hot", [None, 50])
def test_draws_with_a_row_that_owns_half(spark, hot):
    """A row with half of the weight among many: its interval is written to three cells at most, and draws follow the weights."""
    n = 4000
    df = spark.range(n).select("id", F.when(F.col("id") == 17, F.lit(float(n))).otherwise(1.0).alias("weight"))
    drawn = {r["draw"]: r["id"] for r in gen.choose_with(df, "id", F.col("weight"), 3000, 5, hot=hot).collect()}
    assert len(drawn) == 3000 and 0.45 < sum(v == 17 for v in drawn.values()) / 3000 < 0.55
    plain = {r["draw"]: r["id"] for r in gen.choose_with(df, "id", F.col("weight"), 3000, 5, cells=1, hot=hot).collect()}
    assert drawn == plain


def test_draws_next_to_rows_without_weight(spark, tmp_path):
    """A row of weight 0 starts where the next one does: never drawn, but by start it takes the draws of that interval, as in the query's SQL."""
    duck = duckdb.connect()
    given = "/root/testdata/sf0.001"
    weights = "CASE WHEN event_id % 5 IN (1, 2) THEN 0.0 ELSE round(value) END"
    duck.execute(f"COPY (SELECT * REPLACE ({weights} AS value) FROM '{given}/events.parquet') TO '{tmp_path}/events.parquet'")
    duck.execute(f"COPY (SELECT * FROM '{given}/part.parquet') TO '{tmp_path}/part.parquet'")
    for name in ("events", "part"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    want = duck.execute(entry.oracle_sql()["choose_with"]).fetchall()
    assert sorted(tuple(r) for r in entry.queries()["choose_with"](spark, str(tmp_path)).collect()) == sorted(want)
    rows = spark.read.parquet(f"{tmp_path}/events.parquet").select(F.col("event_id").alias("id"), F.col("value").alias("w"))
    drawn = gen.choose_with(rows, "id", F.col("w"), 200, 14).join(rows, "id")
    assert drawn.count() == 200 and drawn.filter("w <= 0").isEmpty()


@pytest.mark.parametrize("h", [0.004, 0.2])
def test_slabs_get_the_points_that_reach_them(spark, h):
    rng = np.random.default_rng(6)
    p = np.vstack([rng.uniform(0, 1, (80, 3)), rng.normal(0.1, 0.001, (80, 3))])
    pts = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(p)], XYZ)
    axes = [np.linspace(0, 1, n).tolist() for n in (13, 11, 3)]
    grid = np.stack(np.meshgrid(*axes, indexing="ij"), axis=-1)
    want = np.exp(-0.5 * ((grid[..., None, :] - p) ** 2).sum(-1) / h**2).sum(-1)
    got = np.zeros(want.shape)
    for r in density._kde_grid_sums(pts, axes, h, slab_nodes=20).collect():
        got[r["gx"], r["gy"], r["gz"]] = r["s"]
    assert got == pytest.approx(want, rel=1e-9, abs=1e-300)
    box = Box((0.0, 0.0, 0.0), (1.0, 1.0, 1.0))
    assert density.kde_grid(pts, h, (13, 11, 3), box=box, normalize=False).count() == 13 * 11 * 3


def test_centres_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(7)
    p = np.vstack([rng.normal(c, 0.1, (40, 3)) for c in (0, 3, 6)])
    pts = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(p)] + [(900, None, 0.0, 0.0)], XYZ)
    one, many = (paths.kmeans_centers(pts.repartition(n), 3, "id") for n in (1, 7))
    assert np.allclose(sorted(one), sorted(many)) and np.allclose(sorted(one), [p[:40].mean(0), p[40:80].mean(0), p[80:].mean(0)])
    assert len(paths.kmeans_centers(pts.filter("id < 2"), 5, "id")) == 2 and paths.kmeans_centers(pts.limit(0), 3, "id") == []
