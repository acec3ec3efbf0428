"""Results that must not depend on plan, size or skew."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftfield.model import Box, GridMeta
from driftfield.operators import cells, density, move, paths, ranks, rules, sample

META = GridMeta((0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (3, 3, 2))
XYZ = "id bigint, x double, y double, z double"
GRID = "i int, j int, k int, u double, v double, w double"


@pytest.fixture(scope="module")
def seeds(spark):
    return spark.createDataFrame([(0, 0.25, 0.5, 0.5), (1, 1.5, 1.0, 0.0), (2, 1.9, 0.1, 1.0), (3, None, 0.0, 0.0)], XYZ)


def rows_of(df):
    return {(r["particle_id"], r["t_idx"]): tuple(r[a] for a in "xyz") for r in df.collect()}


def same(a, b):
    assert a.keys() == b.keys()
    for key, p in a.items():
        assert (p[0] is None and b[key][0] is None) or p == pytest.approx(b[key])


def grid_rows(extra=(), skip=()):
    rows = [(i, j, k, 1.0 + 0.1 * i, 0.2 * j - 0.1, 0.1 * k) for i in range(3) for j in range(3) for k in range(2) if (i, j, k) not in skip]
    return rows + list(extra)


CASES = {
    "null value": grid_rows([(1, 1, 1, None, 0.5, None)], skip=[(1, 1, 1)]),
    "missing node": grid_rows(skip=[(0, 0, 0), (2, 2, 1)]),
    "rows outside the shape": grid_rows([(-1, 0, 0, 9.0, 9.0, 9.0), (3, 0, 0, 9.0, 9.0, 9.0), (0, 0, 7, 9.0, 9.0, 9.0)]),
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("outside", ["clamp", "zero", "nan", "periodic"])
def test_grid_plans_agree(spark, seeds, case, outside):
    field = move.GridField(spark.createDataFrame(CASES[case], GRID), META, outside)
    same(*[rows_of(move.advect(seeds, field, 0.4, 2, "rk2", plan=p)) for p in ("broadcast", "joins")])


@pytest.mark.parametrize("stamps", [[1.0], [0.0, 1.0], [0.0, 0.5, 0.5, 2.0]])
@pytest.mark.parametrize("outside_time", sample.EXTRAPOLATE)
def test_series_plans_agree(spark, seeds, stamps, outside_time):
    rows = [(n, *r[:3], r[3] * (n + 1), r[4], r[5]) for n in range(len(stamps)) for r in grid_rows()] + [(99, 0, 0, 0, 5.0, 5.0, 5.0)]
    series = spark.createDataFrame(rows, "t_idx int, " + GRID)
    times = spark.createDataFrame(list(enumerate(stamps)), "t_idx int, t double")
    field = move.GridSeriesField(series, times, META, outside_time=outside_time)
    same(*[rows_of(move.advect(seeds, field, 0.3, 3, "euler", t0=0.2, plan=p)) for p in ("broadcast", "joins")])


def test_a_node_that_occurs_twice_is_refused(spark, seeds):
    field = move.GridField(spark.createDataFrame(grid_rows([(0, 0, 0, 1.0, 1.0, 1.0)]), GRID), META)
    for plan in ("broadcast", "joins"):
        with pytest.raises(ValueError):
            move.advect(seeds, field, 0.1, 1, plan=plan)


def test_staged_closed_form_steps(seeds, monkeypatch):
    from driftfield.functions import analytic

    field = move.AnalyticField(analytic.rotation())
    want = rows_of(move.advect(seeds, field, 0.05, 60, "rk2", record_every=7))
    monkeypatch.setattr(move, "STAGE", 25)
    got = rows_of(move.advect(seeds, field, 0.05, 60, "rk2", record_every=7))
    assert {t for _, t in got} == {*range(0, 60, 7), 60}
    same(want, got)


def test_rotation_on_scattered_nodes(spark):
    """A 15 x 15 sheet of nodes turning about its middle, 25 points, reflected at the rim."""
    side = np.linspace(-1, 1, 15)
    nodes = [(i * 15 + j, float(x), float(y), 0.0) for i, x in enumerate(side) for j, y in enumerate(side)]
    times = spark.createDataFrame([(n, float(t)) for n, t in enumerate(np.linspace(0, 2, 5))], "t_idx int, t double")
    values = spark.createDataFrame([(t, n, -y, x, 0.0) for t in range(5) for n, x, y, _ in nodes], "t_idx int, node_id bigint, u double, v double, w double")
    field = move.NodeSeriesField(spark.createDataFrame(nodes, "node_id bigint, x double, y double, z double"), values, times)
    start = [(i, float(x), float(y), 0.0) for i, (x, y) in enumerate((x, y) for x in np.linspace(-0.8, 0.8, 5) for y in np.linspace(-0.8, 0.8, 5))]
    box = Box((-1, -1, 0), (1, 1, 0))
    got = rows_of(move.advect(spark.createDataFrame(start, XYZ), field, 0.02, 3, "rk4", rules.reflect(box)))
    node_xy = np.array([n[1:3] for n in nodes])

    def velocity(p):
        d = np.hypot(*(node_xy[None] - p[:, None]).transpose(2, 0, 1)).round(12)
        near = node_xy[d.argmin(1)]
        return np.stack([-near[:, 1], near[:, 0]], 1)

    p = np.array([s[1:3] for s in start])
    for n in range(1, 4):
        k1 = velocity(p)
        k2 = velocity(p + 0.01 * k1)
        k3 = velocity(p + 0.01 * k2)
        p = p + 0.02 * (k1 + 2 * k2 + 2 * k3 + velocity(p + 0.02 * k3)) / 6
        assert max(abs(got[i, n][a] - p[i, a]) for i in range(25) for a in range(2)) < 0.02 * 0.15 * n  # a tie may take another node


def test_time_dependent_mesh_equals_its_mixture(spark):
    nodes = [(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0), (3, 0.0, 0.0, 1.0)]
    elements = spark.createDataFrame([(0, [0, 1, 2, 3])], "elem_id bigint, nodes array<bigint>")
    rows = [(t, n, float(n + t), float(t), -float(n)) for t in (0, 1) for n in range(4)]
    field = move.MeshSeriesField(
        elements, spark.createDataFrame(nodes, "node_id bigint, x double, y double, z double"),
        spark.createDataFrame(rows, "t_idx int, node_id bigint, u double, v double, w double"), spark.createDataFrame([(0, 0.0), (1, 2.0)], "t_idx int, t double"), fallback="zero",
    )
    pts = spark.createDataFrame([(0, 0.2, 0.3, 0.1, 0.5), (1, 2.0, 2.0, 2.0, 0.5), (2, None, 0.1, 0.1, 0.5), (3, 0.2, 0.3, 0.1, 9.0)], XYZ + ", t double")
    got = {r["id"]: (r["u"], r["v"], r["w"]) for r in move.with_velocity(pts, field).collect()}
    node = 0.2 * 1 + 0.3 * 2 + 0.1 * 3
    assert got[0] == pytest.approx((node + 0.25, 0.25, -node)) and got[3] == pytest.approx((node + 1.0, 1.0, -node))
    assert got[1] == (0.0, 0.0, 0.0) and got[2] == (None, None, None)


@pytest.mark.parametrize("n", [4, 5, 9, 40])
def test_banded_spline_equals_a_dense_one(n):
    rng = np.random.default_rng(n)
    x = np.cumsum(rng.uniform(0.3, 2, n))
    at = rng.uniform(x[0] - 1, x[-1] + 1, 25)
    knots = x[2:-2]
    basis = lambda t: np.concatenate([np.stack([t**p for p in range(4)], 1), np.maximum(t[:, None] - knots[None], 0) ** 3], 1)
    want = basis(np.clip(at, x[0], x[-1])) @ np.linalg.pinv(basis(x))
    m = sample._second_derivatives(x, np.eye(n))
    held = np.clip(at, x[0], x[-1])
    k = np.clip(np.searchsorted(x, held, side="right") - 1, 0, n - 2)
    h = (x[k + 1] - x[k])[:, None]
    q = (held - x[k])[:, None] / h
    p = 1 - q
    got = p * np.eye(n)[k] + q * np.eye(n)[k + 1] + h * h / 6 * ((p**3 - p) * m[k] + (q**3 - q) * m[k + 1])
    assert got == pytest.approx(want, abs=1e-6)


def test_spline_of_groups_of_nodes(spark, monkeypatch):
    """Nodes in several groups, missing and NULL values, two snapshots at one time; a table of times and each row's own time agree."""
    monkeypatch.setattr(sample, "SPLINE_ROWS", 40)
    rng = np.random.default_rng(5)
    stamps = [0.0, 0.7, 1.0, 1.0, 2.5, 3.0, 4.2]
    values = rng.normal(size=(len(stamps), 12, 3))
    values[1, 3], values[5, 4, 0] = 0.0, 0.0
    rows = [(i, n, *[None if (i, n, c) == (5, 4, 0) else float(values[i, n, c]) for c in range(3)]) for i in range(len(stamps)) for n in range(12) if (i, n) != (1, 3)]
    samples = spark.createDataFrame(rows + [(99, 0, 1.0, 1.0, 1.0)], "t_idx int, node_id bigint, u double, v double, w double")
    times = spark.createDataFrame(list(enumerate(stamps)), "t_idx int, t double")
    kept = [0, 1, 3, 4, 5, 6]
    x = np.array(stamps)[kept]
    at = [-1.0, 0.0, 0.3, 1.0, 1.7, 4.2, 9.0]
    knots = x[2:-2]
    basis = lambda t: np.concatenate([np.stack([t**p for p in range(4)], 1), np.maximum(t[:, None] - knots[None], 0) ** 3], 1)
    weights = basis(np.clip(np.array(at), x[0], x[-1])) @ np.linalg.pinv(basis(x))
    want = np.einsum("ts,snc->tnc", weights, values[kept])
    got = {(r["t"], r["node_id"]): (r["u"], r["v"], r["w"]) for r in sample.interp_time_cubic(samples, times, at).collect()}
    assert len(got) == len(at) * 12
    for i, t in enumerate(at):
        for n in range(12):
            assert got[t, n] == pytest.approx(want[i, n], abs=1e-9)
    visits = [(i * 12 + n, n, t) for i, t in enumerate(at) for n in range(12)] + [(1000, 3, None)]
    asked = spark.createDataFrame(visits, "id bigint, node_id bigint, t double")
    own = {r["id"]: (r["u"], r["v"], r["w"]) for r in sample.sample_cubic(asked, sample.spline_table(samples, times), times).collect()}
    assert own.pop(1000) == (None, None, None)
    assert all(own[i] == pytest.approx(got[t, n]) for i, n, t in visits[:-1])


@pytest.mark.parametrize("per_range", [1, 3, 1000])
def test_as_of_by_ranges_equals_binary_search(spark, per_range):
    """Snapshots bunched, repeated and spread; a few of them to a range, so gaps cross ranges and ranges hold none."""
    rng = np.random.default_rng(8)
    stamps = np.sort(np.concatenate([rng.uniform(0, 1, 30), np.repeat(0.5, 6), rng.uniform(0.5, 0.500001, 20), [7.0, 7.0]]))
    times = spark.createDataFrame([(i, float(t)) for i, t in enumerate(stamps)], "t_idx int, t double").repartition(3)
    at = np.concatenate([stamps, rng.uniform(-1, 8, 200), rng.uniform(0.5, 0.500001, 50)])
    rows = spark.createDataFrame([(i, float(t)) for i, t in enumerate(at)] + [(9999, None), (9998, float("nan"))], "id bigint, t double")
    got = {r["id"]: r for r in sample.time_bracket(rows, sample.time_index(times, per_range)).collect()}
    assert len(got) == len(at) + 2 and got[9999]["left"] is None
    starts = [i for i in range(len(stamps) - 1) if stamps[i + 1] > stamps[i]]
    for i, t in enumerate(at):
        held = min(max(t, stamps[0]), stamps[-1])
        left = max((s for s in starts if stamps[s] <= held), key=lambda s: s)
        r = got[i]
        assert (r["left"], r["right"]) == (left, left + 1)
        assert r["w_right"] == pytest.approx((held - stamps[left]) / (stamps[left + 1] - stamps[left])) and r["w_left"] == pytest.approx(1 - r["w_right"])


def test_knn_of_points_far_from_a_clump(spark):
    rng = np.random.default_rng(1)
    p = np.vstack([rng.normal(0.5, 0.001, (1500, 3)), rng.uniform(0, 1, (20, 3)), np.repeat([[0.5, 0.5, 0.5]], 300, 0)])
    q = np.vstack([rng.uniform(-3, 4, (80, 3)), rng.normal(0.5, 0.002, (80, 3))])
    table = lambda a: spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(a)], XYZ)
    d = np.sqrt(((q[:, None] - p[None]) ** 2).sum(-1))
    for k in (1, 4):
        got = {}
        for r in cells.knn(table(q), table(p), k).collect():
            got.setdefault(r["q_id"], {})[r["rank"]] = r["d"]
        for i in range(len(q)):
            assert [got[i][m + 1] for m in range(k)] == pytest.approx(list(np.sort(d[i])[:k]))


def test_own_cells_hold_few_sites(spark):
    """However sites clump, a cell that bounds a query's distance holds at most LIGHT times the wanted number."""
    rng = np.random.default_rng(2)
    p = np.vstack([rng.normal(0.5, 1e-4, (3000, 3)), rng.uniform(0, 1, (40, 3))])
    where = spark.createDataFrame([tuple(map(float, r)) for r in p], "x double, y double, z double").distinct()
    asked = spark.createDataFrame([tuple(map(float, r)) for r in rng.uniform(-1, 2, (60, 3))], "x double, y double, z double")
    index = cells.site_index(where.withColumn("id", F.monotonically_increasing_id()), 2)
    frame = index.frame
    own = cells._own_cells(asked, index, None)
    assert own.select("bx", "by", "bz").distinct().count() == 60 == own.count()
    used = own.select(*cells.CELL).distinct()
    held = cells.locate(where, frame, cells.used_levels(used)).join(used, cells.CELL).groupBy(*cells.CELL).count().agg(F.min("count"), F.max("count")).first()
    assert 2 <= held[0] and held[1] <= cells.LIGHT * 2


def test_one_large_box_does_not_pair_all_small_ones(spark):
    rng = np.random.default_rng(3)

    def boxes(seed, n=800):
        lo = np.random.default_rng(seed).uniform(0, 60, (n, 3))
        rows = [(i, *map(float, c), *map(float, c + 1)) for i, c in enumerate(lo)] + [(n, -1.0, -1.0, -1.0, 70.0, 70.0, 70.0)]
        return rows, spark.createDataFrame(rows, "id bigint, lo_x double, lo_y double, lo_z double, hi_x double, hi_y double, hi_z double")

    (a, da), (b, db) = boxes(1), boxes(2)
    frame = cells.Frame((-1.0, -1.0, -1.0), 71.0)
    made = []
    plain = cells.spread_join

    def counted(left, right, on, hot=None):
        out = plain(left, right, on, hot)
        made.append(out.count())
        return out

    cells.spread_join = counted
    try:
        got = {(r["a_id"], r["b_id"]) for r in cells.box_intersections(da, db, frame).collect()}
    finally:
        cells.spread_join = plain
    x, y = np.array([r[1:] for r in a]), np.array([r[1:] for r in b])
    hit = ((x[:, None, :3] <= y[None, :, 3:]) & (y[None, :, :3] <= x[:, None, 3:])).all(-1)
    assert got == set(zip(*map(list, np.nonzero(hit)))) and sum(made) < 10 * len(got)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys_are_dealt_out(spark, how):
    rows = spark.range(2000).select("id", F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    per_key = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    want = sorted(map(tuple, rows.join(per_key, "k", how).select("id", "k", "v").collect()))
    joined = ranks.join_per_key(rows, per_key, "k", how, hot=100)
    assert sorted(map(tuple, joined.select("id", "k", "v").collect())) == want
    dealt = rows.groupBy("k").count().agg(F.max("count")).first()[0]
    assert dealt == 1000 and joined.count() == len(want)


def test_speed_spread_of_fast_particles(spark):
    """Speeds near a million that differ by one: their spread must not drown in rounding."""
    rows = [(p, t, float(t), 1e6 * t + (t % 2), 0.0, 0.0) for p in range(3) for t in range(50)]
    traj = spark.createDataFrame(rows, "particle_id bigint, t_idx bigint, t double, x double, y double, z double")
    v = np.abs(np.diff([r[3] for r in rows[:50]]))
    got = paths.trajectory_stats(traj).first()
    assert got["speed_std"] == pytest.approx(v.std(), rel=1e-9) and got["speed_mean"] == pytest.approx(v.mean())


def test_grid_density_by_slabs_and_far_points(spark):
    rng = np.random.default_rng(4)
    pts = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rng.normal(size=(60, 3)))], XYZ)
    axes = density.grid_axes(Box((-2, -2, -2), (9, 2, 2)), (7, 5, 3))
    sums = lambda n: {(r["gx"], r["gy"], r["gz"]): r["s"] for r in density._kde_grid_sums(pts, axes, 0.6, n).collect()}
    whole, cut = sums(1000), sums(7)
    assert whole.keys() == cut.keys() and all(cut[k] == pytest.approx(v, rel=1e-9) for k, v in whole.items())
    one = spark.createDataFrame([(0, 0.0, 0.0, 0.0)], XYZ)
    far = spark.createDataFrame([(0, 9.0, 0.0, 0.0), (1, 20.0, 0.0, 0.0)], XYZ)
    got = {r["id"]: r["rho"] for r in density.kde_at(one, far, 1.0).collect()}
    assert all(got[i] == pytest.approx((2 * math.pi) ** -1.5 * math.exp(-d * d / 2), rel=1e-9) for i, d in ((0, 9.0), (1, 20.0)))


def test_scratch_tables_go_when_asked(spark):
    import os

    from driftfield.session import cut_lineage, drop_scratch

    df = cut_lineage(spark.range(5))
    path = os.path.dirname(df.inputFiles()[0].removeprefix("file://"))
    assert df.count() == 5 and os.path.isdir(path)
    assert drop_scratch(spark) >= 1 and not os.path.exists(path) and drop_scratch(spark) == 0
