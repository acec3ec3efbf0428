import numpy as np
import pytest
from pyspark.sql import functions as F

from driftfield.functions import analytic, kernels
from driftfield.model import Box, GridMeta, SchemaError, check
from driftfield.operators import density, move, points, rules, sample

META = GridMeta((-2.0, -2.0, -1.0), (0.5, 0.5, 1.0), (9, 9, 3))


@pytest.fixture(scope="module")
def rotation_grid(spark):
    rows = [(i, j, k, 2.0 - 0.5 * j, -2.0 + 0.5 * i, 0.0) for i in range(9) for j in range(9) for k in range(3)]
    return spark.createDataFrame(rows, "i int, j int, k int, u double, v double, w double")


@pytest.fixture(scope="module")
def seeds(spark):
    return spark.createDataFrame([(0, 1.0, 0.0, 0.0), (1, 0.0, 0.5, 0.5), (2, -0.7, 0.3, -0.2)], "id bigint, x double, y double, z double")


def rows_of(df):
    return {(r["particle_id"], r["t_idx"]): (r["x"], r["y"], r["z"]) for r in df.collect()}


@pytest.mark.parametrize("method,least", [("euler", 1.7), ("rk2", 3.5), ("rk4", 12.0)])
def test_order_of_the_steppers(seeds, method, least):
    def error(n):
        dt = 2 * np.pi / n
        end = move.advect(seeds, move.AnalyticField(analytic.rotation()), dt, n, method).filter(F.col("t_idx") == n)
        start = {r["id"]: (r["x"], r["y"]) for r in seeds.collect()}
        return max(np.hypot(r["x"] - start[r["particle_id"]][0], r["y"] - start[r["particle_id"]][1]) for r in end.collect())

    assert error(60) / error(120) > least


@pytest.mark.parametrize("rule", [None, rules.reflect(Box((-0.6, -0.6, -1.0), (0.6, 0.6, 1.0))), rules.absorb(Box((-0.6, -0.6, -1.0), (1.0, 1.0, 1.0)))])
def test_the_three_plans_agree(seeds, rotation_grid, rule):
    field = move.GridField(rotation_grid, META)
    plans = [
        rows_of(move.advect(seeds, move.AnalyticField(analytic.rotation()), 0.3, 3, "rk4", rule)),
        rows_of(move.advect(seeds, field, 0.3, 3, "rk4", rule, plan="broadcast")),
        rows_of(move.advect(seeds, field, 0.3, 3, "rk4", rule, plan="joins")),
    ]
    for other in plans[1:]:
        assert other.keys() == plans[0].keys()
        for key, p in plans[0].items():
            if p[0] is None:
                assert other[key] == (None, None, None)
            else:
                assert other[key] == pytest.approx(p, abs=1e-9)


def test_absorbed_points_stay_absorbed(seeds):
    out = rows_of(move.advect(seeds, move.AnalyticField(analytic.uniform((1.0, 0, 0))), 0.5, 4, "euler", rules.absorb(Box((-1, -1, -1), (1, 1, 1)))))
    assert out[(0, 0)][0] == 1.0 and all(out[(0, n)] == (None, None, None) for n in range(1, 5))
    assert out[(2, 1)][0] == pytest.approx(-0.2)


def test_recorded_steps_and_plan_choice(seeds, rotation_grid):
    field = move.GridField(rotation_grid, META)
    got = move.advect(seeds, field, 0.1, 7, "euler", record_every=3)
    assert sorted({r["t_idx"] for r in got.collect()}) == [0, 3, 6, 7]
    with pytest.raises(ValueError):
        move.advect(seeds, field, 0.1, 2, plan="broadcast", broadcast_bytes=10)


def test_series_field_in_both_plans(spark, seeds, rotation_grid):
    series = rotation_grid.withColumn("t_idx", F.explode(F.array(*map(F.lit, (0, 1, 2))))).withColumns({c: F.col(c) * (F.col("t_idx") + 1) for c in "uvw"})
    times = spark.createDataFrame([(0, 0.0), (1, 0.4), (2, 1.0)], "t_idx int, t double")
    field = move.GridSeriesField(series, times, META)
    a = rows_of(move.advect(seeds, field, 0.35, 4, "rk2", plan="broadcast"))
    b = rows_of(move.advect(seeds, field, 0.35, 4, "rk2", plan="joins"))
    assert a.keys() == b.keys()
    for key in a:
        assert a[key] == pytest.approx(b[key], abs=1e-9)


def test_cubic_interpolation_reproduces_cubics(spark):
    stamps = [0.0, 0.7, 1.5, 2.0, 3.1, 4.0]
    poly = lambda t: 1 + 2 * t - t**2 + 0.25 * t**3
    times = spark.createDataFrame(list(enumerate(stamps)), "t_idx int, t double")
    samples = spark.createDataFrame([(i, t, 5, poly(t), -poly(t), 0.0) for i, t in enumerate(stamps)], "t_idx int, t double, node_id bigint, u double, v double, w double")
    at = [0.0, 0.3, 1.9, 3.99, 4.0, 9.0]
    got = {r["t"]: r["u"] for r in sample.interp_time_cubic(samples, times, at).collect()}
    assert got == pytest.approx({t: poly(min(t, 4.0)) for t in at})
    few = sample.interp_time_cubic(samples.filter("t_idx < 2"), times.filter("t_idx < 2"), [0.35]).first()
    assert few["u"] == pytest.approx((poly(0.0) + poly(0.7)) / 2)


def test_time_bracket_edges(spark):
    at = spark.createDataFrame([(0, -1.0), (1, 0.0), (2, 1.0), (3, 2.0), (4, 5.0), (5, None)], "id bigint, t double")
    twice = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, 1.0), (3, 2.0)], "t_idx bigint, t double")
    got = {r["id"]: (r["left"], r["right"], r["w_left"], r["w_right"]) for r in sample.time_bracket(at, twice).collect()}
    assert got[2][:2] == (2, 3) and got[2][2:] == pytest.approx((1.0, 0.0))
    assert got[0] == (0, 1, 1.0, 0.0) and got[3][2:] == pytest.approx((0.0, 1.0)) and got[4] == (2, 3, 0.0, 1.0)
    single = sample.time_bracket(at, twice.filter("t_idx = 0"), "zero").collect()
    assert {r["id"]: r["w_left"] for r in single} == {0: 0.0, 1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0, 5: 1.0}
    tie = sample.nearest_time(spark.createDataFrame([(0.5,)], "t double"), twice).first()
    assert tie["t_idx"] == 0


def test_flat_grid_and_missing_points(spark):
    flat = spark.createDataFrame([(i, j, 0, float(i), float(j), 1.0) for i in range(3) for j in range(3)], "i int, j int, k int, u double, v double, w double")
    meta = GridMeta((0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (3, 3, 1))
    pts = spark.createDataFrame([(0, 0.25, 1.5, 0.0), (1, 2.0, 2.0, 0.0), (2, None, 0.0, 0.0), (3, 9.0, -3.0, 4.0)], "id bigint, x double, y double, z double")
    got = {r["id"]: (r["u"], r["v"], r["w"]) for r in sample.trilinear_sample(pts, flat, meta).collect()}
    assert got == {0: (0.25, 1.5, 1.0), 1: (2.0, 2.0, 1.0), 2: (None, None, None), 3: (2.0, 0.0, 1.0)}


@pytest.mark.parametrize("dim", [2, 3])
def test_kernels_integrate_to_one(spark, dim):
    n, h, top = 4000, 0.7, 7.0
    r = (F.col("id") + 0.5) * (top / n)
    shell = F.lit(2 * np.pi) * r if dim == 2 else F.lit(4 * np.pi) * r * r
    forms = [kernels.cubic_spline(r, h, dim), kernels.wendland_c2(r, h, dim), kernels.wendland_c2(r, h, dim, "h"), kernels.sph_gaussian(r, h, dim)]
    got = spark.range(n).agg(*[F.sum(f * shell * (top / n)) for f in forms]).first()
    assert list(got) == pytest.approx([1.0] * 4, abs=1e-4)


@pytest.mark.parametrize("block", [7, 2048])
def test_kde_grid_equals_kde_at_and_counts_copies(cloud, block, monkeypatch):
    monkeypatch.setattr(density, "BLOCK", block)
    rows, df = cloud
    box = Box((-2.0, -2.0, -2.0), (3.0, 3.0, 3.0))
    grid = density.kde_grid(df, 0.4, (4, 5, 3), 3, box, normalize=False)
    at = density.kde_at(df, density.grid_nodes(df, box, (4, 5, 3)), 0.4)
    nodes = density.grid_nodes(df, box, (4, 5, 3)).join(at, "id")
    a = {(r["gx"], r["gy"], r["gz"]): r["rho"] for r in grid.collect()}
    b = {(r["gx"], r["gy"], r["gz"]): r["rho"] for r in nodes.collect()}
    assert a == pytest.approx(b, abs=1e-12) and len(a) == 60
    p = np.array([r[1:] for r in rows])
    q = np.array([-2.0 + 5 / 3, -2.0 + 2 * 5 / 4, 0.5])
    want = ((2 * np.pi) ** -1.5 * np.exp(-0.5 * ((p - q) ** 2).sum(1) / 0.16)).mean()
    assert a[(1, 2, 1)] == pytest.approx(want)


def test_sph_equals_brute_force_with_mixed_sizes(cloud):
    rows, df = cloud
    src = df.withColumns({"mass": F.lit(2.0), "h": F.when(F.col("id") % 3 == 0, 0.05).otherwise(0.9)})
    got = {r["id"]: r["rho"] for r in density.sph_at(src, df, "cubic_spline", hot=11).collect()}
    p = np.array([r[1:] for r in rows])
    h = np.array([0.05 if r[0] % 3 == 0 else 0.9 for r in rows])
    for r in rows[::13]:
        q = np.sqrt(((p - np.array(r[1:])) ** 2).sum(1)) / h
        w = np.where(q <= 1, 1 - 1.5 * q**2 + 0.75 * q**3, np.where(q <= 2, 0.25 * (2 - q) ** 3, 0)) / (np.pi * h**3)
        assert got[r[0]] == pytest.approx((2.0 * w).sum())


def test_weighted_points_follow_the_field(spark):
    nodes = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0, 9.0)], "node_id bigint, x double, y double, z double, weight double")
    got = points.field_weighted_points(spark, 40, Box((0, 0, 0), (1, 0.1, 0.1)), nodes, seed=5).collect()
    assert len(got) == 40 and sum(r["x"] > 0.5 for r in got) == 40


def test_generators_do_not_depend_on_partitions(spark):
    box = Box((0, 0, 0), (1, 2, 3))
    a = sorted(map(tuple, points.random_points(spark, 50, box, 3).collect()))
    b = sorted(map(tuple, points.random_points(spark, 50, box, 3).repartition(11).collect()))
    assert a == b and all(0 <= r[1] < 1 and 0 <= r[2] < 2 and 0 <= r[3] < 3 for r in a)


@pytest.mark.parametrize("share", [0.1, 0.5, 0.7, 0.9, 1.0])
def test_smoothing_equals_joint_by_joint_blending(spark, share):
    per, n = 6, 3
    rng = np.random.default_rng(1)
    data = rng.normal(size=per * n)
    rows = [(t, float(t), 1, float(data[t]), 0.0, 0.0) for t in range(per * n)]
    df = spark.createDataFrame(rows, "t_idx bigint, t double, node_id bigint, u double, v double, w double")
    got = {r["t_idx"]: r["u"] for r in move.smooth_joints(df, per, n, share).collect()}
    want, k = data.copy(), min(max(1, round(share * per)), per - 1)
    for p in range(1, n):
        for i in range(k):
            a = (i + 1) / k
            want[p * per + i] = a * want[p * per + i] + (1 - a) * want[p * per - 1 - i]
    assert got == pytest.approx(dict(enumerate(want)))


def test_contracts(spark):
    with pytest.raises(SchemaError):
        check(spark.range(3), "points")
    with pytest.raises(ValueError):
        Box((1, 0, 0), (0, 1, 1))
    assert Box.of([0, 0], [1, 1]).hi == (1.0, 1.0, 0.0)


@pytest.mark.parametrize("kind,reach", [("cubic_spline", 2.0), ("wendland", 1.0), ("gaussian", 2.0)])
def test_crowded_cells_meet_as_arrays(spark, cloud, kind, reach):
    """No row per pair, and the same sums as pair by pair, also with h of 0 and split cells."""
    rows, df = cloud
    src = df.withColumns({"mass": F.lit(2.0), "h": F.when(F.col("id") % 5 == 0, 0.05).when(F.col("id") == 7, 0.0).otherwise(0.9)})
    asked = df.unionByName(spark.createDataFrame([(900, float("nan"), 0.0, 0.0), (901, None, 0.0, 0.0), (902, 500.0, 0.0, 0.0)], df.schema))
    one = {r["id"]: r["rho"] for r in density.sph_at(src, asked, kind, dense=1e9).collect()}
    many = {r["id"]: r["rho"] for r in density.sph_at(src, asked, kind, dense=0).collect()}
    assert one.keys() == many.keys() and all(many[i] == pytest.approx(one[i], rel=1e-12, abs=1e-12) for i in one)
    sites = density.sites(src, F.col("h")).select("x", "y", "z", "h", "mass")
    frame = density._frame_of_reach(0.9 * reach)
    cut = {tuple(r)[:3]: r["s"] for r in density._kernel_sums(sites, df.select("x", "y", "z").distinct(), kind, 3, reach, frame, dense=0, rows=7).collect()}
    assert all(cut[r[1:]] == pytest.approx(one[r[0]], rel=1e-12) for r in rows)
    plan = density._kernel_sums(sites, df.select("x", "y", "z").distinct(), kind, 3, reach, frame, dense=0)._jdf.queryExecution().toString()
    assert "CoGroupsInArrow" in plan


def test_mean_kernel_as_arrays_and_by_pairs(spark, cloud):
    rows, df = cloud
    src = density.sites(df.withColumn("mass", F.lit(1.0))).select("x", "y", "z", F.lit(0.3).alias("h"), F.col("n").cast("double").alias("mass"))
    asked, frame = df.select("x", "y", "z").distinct(), density._frame_of_reach(0.3 * density.WHOLE_REACH)
    a, b = ({tuple(r)[:3]: r["s"] for r in density._kernel_sums(src, asked, "mean", 3, density.WHOLE_REACH, frame, dense=d, rows=20).collect()} for d in (0, 1e9))
    p = np.array([r[1:] for r in rows])
    for at in a:
        want = (2 * np.pi) ** -1.5 * np.exp(-0.5 * ((p - np.array(at)) ** 2).sum(1) / 0.09).sum()
        assert a[at] == pytest.approx(want, rel=1e-11) and b[at] == pytest.approx(want, rel=1e-11)


def test_kernel_sums_of_a_group_keep_the_rim_and_tiny_balls():
    """Grid points lie exactly on the rim of balls; balls far smaller than the chunk, of size 0 and of several sizes meet their own place."""
    import numpy as np
    import pyarrow as pa

    from driftfield.functions.kernels import kernel_of_square
    from driftfield.operators.density import _sums_of_group

    side = np.arange(7) * 0.1
    grid = np.stack([g.ravel() for g in np.meshgrid(side, side, side)])
    rng = np.random.default_rng(3)
    for h in (np.full(343, 0.1), np.full(343, 0.15), np.full(343, 1e-7), np.zeros(343), 0.05 * 2.0 ** rng.integers(0, 2, 343)):
        for kind, reach in (("cubic_spline", 2.0), ("wendland", 1.0), ("gaussian", 2.0)):
            radius, w, floored = h * reach, rng.random(343), np.maximum(h, 1e-12)
            left = pa.table(dict(zip("xyz", grid)))
            right = pa.table({"bx": grid[0], "by": grid[1], "bz": grid[2], "h": floored, "w": w, "_radius": radius})
            got = _sums_of_group(kind, reach, left, right).column("s").to_numpy()
            d2 = (grid[0][:, None] - grid[0]) ** 2 + (grid[1][:, None] - grid[1]) ** 2 + (grid[2][:, None] - grid[2]) ** 2
            want = (np.where(np.sqrt(d2) <= radius, kernel_of_square(kind, d2 / floored**2), 0.0) * w).sum(1)
            np.testing.assert_allclose(got, want, rtol=1e-12, atol=1e-13)


@pytest.mark.parametrize("axis", [0, 1, 2])
def test_queries_of_few_values_on_an_axis_form_no_pairs(spark, monkeypatch, axis):
    """Sources of few places across the axis, with copies, queries far off and rows without coordinates: the sums are those over all pairs."""
    rng = np.random.default_rng(21)
    p, q = rng.integers(0, 6, (3000, 3)).astype(float), rng.uniform(-1, 7, (400, 3))
    p[:, axis], q[:, axis] = rng.uniform(-30, 30, 3000), rng.integers(-2, 3, 400) * 1.5
    p[-20:], q[0] = p[:20], [500.0, 500.0, 500.0]
    q[0, axis] = 3.0
    make = lambda rows, *odd: spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)] + list(odd), "id bigint, x double, y double, z double")
    monkeypatch.setattr(density, "BLOCK", 50)
    monkeypatch.setattr(density, "_kernel_sums", lambda *a, **b: pytest.fail("pairs were formed"))
    got = {r["id"]: r["rho"] for r in density.kde_at(make(p), make(q, (900, None, 1.0, 1.0)), 0.8).collect()}
    gaps = ((q[:, None] - p[None]) ** 2).sum(2) / 0.64
    want = np.exp(-0.5 * gaps).sum(1) * (2 * np.pi) ** -1.5 / 3000
    assert got.pop(900) == 0.0 and len(got) == 400
    assert np.allclose([got[i] for i in range(400)], want, rtol=1e-12, atol=1e-300)
