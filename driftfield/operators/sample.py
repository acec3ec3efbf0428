"""Field sampling: interpolation in time and space as equi-joins and weighted sums."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from driftfield.functions import shape as sh
from driftfield.functions.vector import distance, magnitude
from driftfield.model import AXES, Box, GridMeta, check
from driftfield.operators.cells import CELL, HOT_ROWS, Frame, SiteIndex, cover, knn, locate, site_index, spread_join, used_levels
from driftfield.operators.ranks import join_per_key
from driftfield.session import cut_lineage

UVW = ("u", "v", "w")
BROADCAST_BYTES = 64 * 1024 * 1024
CORNER_ROW_BYTES = 8 * (24 + 4)  # 24 values, the cell triple and a step number
EXTRAPOLATE = ("constant", "linear", "zero", "nan")

# ---------------------------------------------------------------------------------------------------
# time


def small_table(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Broadcast a table whose row count is bounded by ``rows``; beyond the limit leave it to a shuffle join."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


STAMPS_PER_RANGE = 64
MOST_RANGES = 10_000


@dataclass(frozen=True)
class TimeIndex:
    """Snapshot times prepared for as-of lookups.

    ``gaps`` has a row per range of times: the gaps (t0, t1, left, right) that begin in it, in order, and before them the last gap that began
    earlier. Ranges begin at snapshot times. Only the cut points (MOST_RANGES at most) and the ends come to the driver.
    """

    times: DataFrame
    n: int
    t_min: float | None
    t_max: float | None
    first: int | None
    last: int | None
    cuts: list[float]
    gaps: DataFrame | None


def time_index(times: "DataFrame | TimeIndex", stamps_per_range: int = STAMPS_PER_RANGE) -> TimeIndex:
    """Two snapshots at one time: the later one starts the next gap.

    Times are cut into ranges; a range's snapshots are sorted on their own, and the gap across its end comes from a summary with one row per
    range, as does the last gap before it. So no task sees all snapshots.
    """
    if isinstance(times, TimeIndex):
        return times
    times = cut_lineage(times.select("t_idx", F.col("t").cast("double").alias("t")))
    by_time = F.struct("t", "t_idx")
    t_min, t_max, n, first, last = times.agg(F.min("t"), F.max("t"), F.count(F.lit(1)), F.min_by("t_idx", by_time), F.max_by("t_idx", by_time)).first()
    if n < 2 or t_max <= t_min:
        return TimeIndex(times, n, t_min, t_max, first, last, [], None)
    ranges = min(-(-n // stamps_per_range), MOST_RANGES)
    cuts: list[float] = []
    if ranges > 1:
        at = [i / ranges for i in range(1, ranges)]
        cuts = sorted(set(times.agg(F.percentile_approx("t", at, max(10_000, 10 * ranges))).first()[0]) - {t_min})
    placed = _in_range(times, "t", cuts, "_range").groupBy("_range").agg(F.sort_array(F.collect_list(by_time)).alias("s"))
    order = W.orderBy("_range")  # one row per range
    ahead = F.lead(F.element_at("s", 1)).over(order)
    after = lambda i: F.coalesce(F.try_element_at(F.col("s"), i + 2), F.col("ahead"))
    gap = lambda s, i: F.struct(s["t"].alias("t0"), after(i)["t"].alias("t1"), s["t_idx"].alias("left"), after(i)["t_idx"].alias("right"))
    own = F.filter(F.transform("s", gap), lambda g: g["t1"] > g["t0"])
    gaps = placed.withColumn("ahead", ahead).select("_range", own.alias("own"))
    before = F.last(F.try_element_at("own", F.lit(-1)), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    gaps = gaps.select("_range", F.concat(F.array_compact(F.array(before)), F.col("own")).alias("gaps"))
    return TimeIndex(times, n, t_min, t_max, first, last, cuts, cut_lineage(gaps))


def _in_range(df: DataFrame, col: str, cuts: list[float], name: str) -> DataFrame:
    """Number of the range that ``col`` lies in; NULL where it is NULL or NaN."""
    known = F.col(col).isNotNull() & ~F.isnan(col)
    if not cuts:
        return df.withColumn(name, F.when(known, 0))
    search = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol=col, outputCol="_range_d", handleInvalid="keep")
    return search.transform(df).withColumn(name, F.when(known, F.col("_range_d").cast("int"))).drop("_range_d")


def time_bracket(at: DataFrame, times: DataFrame | TimeIndex, outside: str = "constant") -> DataFrame:
    """Add left, right (t_idx) and w_left, w_right to every row of ``at`` by its column t.

    An as-of join: a row finds its range of times by binary search among the ranges' beginnings, and its gap among the range's few. The table
    of ranges is broadcast if the number of snapshots proves it small; else rows and ranges are shuffled, crowded ranges dealt out.
    Outside the first and last snapshot: constant holds the end value, linear extends the last gap,
    zero has weights 0, nan has NULL weights.
    """
    if outside not in EXTRAPOLATE:
        raise ValueError(f"outside must be one of {EXTRAPOLATE}")
    index = time_index(times)
    t_min, t_max, last = index.t_min, index.t_max, index.last
    t = F.col("t").cast("double")
    if index.gaps is None:
        off = (t != F.lit(t_min)) if outside in ("zero", "nan") else F.lit(False)
        gone = F.lit(0.0) if outside == "zero" else F.lit(None).cast("double")
        return at.withColumns(
            {"left": F.lit(last), "right": F.lit(last), "w_left": F.when(off, gone).otherwise(F.lit(1.0)), "w_right": F.lit(0.0)}
        )
    held = at.withColumn("_t", F.when(t.isNotNull(), F.least(F.greatest(t, F.lit(t_min)), F.lit(t_max))))
    held = _in_range(held, "_t", index.cuts, "_range")
    if index.n * 40 <= BROADCAST_BYTES:
        joined = held.join(F.broadcast(index.gaps), "_range", "left")
    else:
        joined = join_per_key(held, index.gaps, "_range", "left")
    joined = joined.withColumn("_gap", F.try_element_at(F.filter("gaps", lambda g: g["t0"] <= F.col("_t")), F.lit(-1)))
    t0, t1 = F.col("_gap.t0"), F.col("_gap.t1")
    alpha = (t - t0) / F.greatest(t1 - t0, F.lit(1e-12))
    low, high = t < F.lit(t_min), t > F.lit(t_max)
    if outside == "linear":
        wl, wr = F.lit(1.0) - alpha, alpha
    else:
        gone = {"constant": None, "zero": F.lit(0.0), "nan": F.lit(None).cast("double")}[outside]
        wl_low, wl_high = (F.lit(1.0), F.lit(0.0)) if gone is None else (gone, gone)
        wr_low, wr_high = (F.lit(0.0), F.lit(1.0)) if gone is None else (gone, gone)
        wl = F.when(low, wl_low).when(high, wl_high).otherwise(F.lit(1.0) - alpha)
        wr = F.when(low, wr_low).when(high, wr_high).otherwise(alpha)
    own = [f"`{c}`" for c in at.columns]
    return joined.select(*own, F.col("_gap.left").alias("left"), F.col("_gap.right").alias("right"), wl.alias("w_left"), wr.alias("w_right"))


def _weight_rows(bracket: DataFrame) -> DataFrame:
    """Two (t_idx, weight) rows per bracketed row."""
    pair = F.array(
        F.struct(F.col("left").alias("t_idx"), F.col("w_left").alias("weight")),
        F.struct(F.col("right").alias("t_idx"), F.col("w_right").alias("weight")),
    )
    return bracket.select(*[c for c in bracket.columns if c not in ("left", "right", "w_left", "w_right")], F.inline(pair))


def interp_time(samples: DataFrame, times: DataFrame, at: DataFrame, method: str = "linear", outside: str = "constant") -> DataFrame:
    """Field of every node at every time of ``at(t)``: (t, node_id, u, v, w).

    Linear: the weight rows meet the samples on t_idx, and weight * value is summed per (t, node), which
    Spark does in part before the shuffle. Nearest: the closest snapshot, the earlier one on ties.
    """
    check(samples, "samples")
    if method == "nearest":
        picks = nearest_time(at, times)
        return picks.join(samples.drop("t"), "t_idx").select("t", "node_id", *UVW)
    weights = _weight_rows(time_bracket(at.select("t").distinct(), times, outside))
    joined = weights.join(samples.drop("t"), "t_idx")
    blank = F.max(F.col("weight").isNull())  # outside='nan': no value rather than a partial sum
    return (
        joined.groupBy("t", "node_id")
        .agg(*[F.when(~blank, F.sum(F.col("weight") * F.col(c))).alias(c) for c in UVW])
    )


def nearest_time(at: DataFrame, times: DataFrame) -> DataFrame:
    """(t, t_idx of the closest snapshot); the lower t_idx on ties."""
    index = time_index(times)
    b = time_bracket(at.select("t").distinct(), index, "constant")
    stamps = index.times.select("t_idx", F.col("t").alias("_ts"))
    pair = F.array(F.col("left"), F.col("right"))
    cand = b.select("t", F.explode(pair).alias("t_idx")).join(stamps, "t_idx")
    return cand.groupBy("t").agg(F.min_by("t_idx", F.struct(F.abs(F.col("_ts") - F.col("t")), F.col("t_idx"))).alias("t_idx"))


def time_derivative(samples: DataFrame, times: DataFrame, t: float, dt: float) -> DataFrame:
    """(node_id, u, v, w) of d/dt at time t: central, else one-sided at an end, else 0."""
    spark = samples.sparkSession
    t_min, t_max = times.agg(F.min("t").cast("double"), F.max("t").cast("double")).first()
    lo = t - dt if t - dt >= t_min else t
    hi = t + dt if t + dt <= t_max else t
    if hi <= lo:
        return samples.select("node_id").distinct().withColumns({c: F.lit(0.0) for c in UVW})
    at = spark.range(2).select(F.element_at(F.lit([float(lo), float(hi)]), (F.col("id") + 1).cast("int")).alias("t"))
    sign = F.when(F.col("t") == hi, F.lit(1.0)).otherwise(F.lit(-1.0)) / F.lit(hi - lo)
    both = interp_time(samples, times, at).withColumn("_s", sign)
    return both.groupBy("node_id").agg(*[F.sum(F.col("_s") * F.col(c)).alias(c) for c in UVW])


SPLINE_ROWS = 1 << 20


def spline_table(samples: DataFrame, times: DataFrame) -> DataFrame:
    """(t_idx, t, node_id, u, v, w, mu, mv, mw): every node's values and second derivatives of its not-a-knot cubic spline, at all snapshots.

    Nodes are dealt to groups of about SPLINE_ROWS rows; a group is a matrix of snapshots by nodes, and one pass of the tridiagonal solver
    over the snapshots serves all its nodes and components. A missing or NULL value counts as 0. Of snapshots at one time the one with the
    highest t_idx counts. Needs four snapshots.
    """
    stamps = cut_lineage(times.groupBy(F.col("t").cast("double").alias("t")).agg(F.max("t_idx").cast("bigint").alias("t_idx")))
    groups = max(1, -(-samples.count() // SPLINE_ROWS))
    group = F.pmod(F.xxhash64("node_id"), F.lit(groups)).cast("int")
    rows = samples.select(group.alias("g"), F.col("t_idx").cast("bigint").alias("t_idx"), F.col("node_id").cast("bigint").alias("node_id"), *[F.col(c).cast("double").alias(c) for c in UVW])
    grid = stamps.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("h"), F.col("t_idx").alias("s_idx"), "t")

    def run(key, left, right):
        import numpy as np
        import pyarrow as pa

        t, step = right["t"].to_numpy(), right["s_idx"].to_numpy()
        order = np.argsort(t)
        t, step = t[order], step[order]
        nodes, node = np.unique(left["node_id"].to_numpy(), return_inverse=True)
        by_step = np.argsort(step)
        at = by_step[np.minimum(np.searchsorted(step[by_step], left["t_idx"].to_numpy()), len(step) - 1)]
        known = step[at] == left["t_idx"].to_numpy()
        values = np.zeros((len(t), len(nodes), 3))
        for n, c in enumerate(UVW):
            values[at[known], node[known], n] = np.nan_to_num(left[c].to_numpy(zero_copy_only=False)[known], nan=0.0)
        second = _second_derivatives(t, values)
        wide = {"t_idx": np.repeat(step, len(nodes)), "t": np.repeat(t, len(nodes)), "node_id": np.tile(nodes, len(t))}
        wide |= {c: values[:, :, n].ravel() for n, c in enumerate(UVW)} | {f"m{c}": second[:, :, n].ravel() for n, c in enumerate(UVW)}
        return pa.table(wide)

    schema = "t_idx bigint, t double, node_id bigint, " + ", ".join(f"{c} double" for c in (*UVW, *[f"m{c}" for c in UVW]))
    return rows.groupBy("g").cogroup(grid.groupBy("h")).applyInArrow(run, schema)


def _second_derivatives(x, y):
    """Second derivatives at x of the not-a-knot splines through y[x, ...]: one elimination over x for all columns."""
    import numpy as np

    n = len(x)
    h = np.diff(x)
    wide = h.reshape(-1, *[1] * (y.ndim - 1))
    slope = np.diff(y, axis=0) / wide
    low, main, up = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy()
    # at each end the third derivative goes on over the first inner snapshot
    main[0] += h[0] * (h[0] + h[1]) / h[1]
    up[0] -= h[0] ** 2 / h[1]
    main[-1] += h[-1] * (h[-1] + h[-2]) / h[-2]
    low[-1] -= h[-1] ** 2 / h[-2]
    z = 6 * np.diff(slope, axis=0)
    m = n - 2
    for i in range(1, m):
        f = low[i] / main[i - 1]
        main[i] -= f * up[i - 1]
        z[i] -= f * z[i - 1]
    z[m - 1] /= main[m - 1]
    for i in range(m - 2, -1, -1):
        z[i] = (z[i] - up[i] * z[i + 1]) / main[i]
    first = z[0] * (h[0] + h[1]) / h[1] - z[1] * h[0] / h[1]
    last = z[-1] * (h[-1] + h[-2]) / h[-2] - z[-2] * h[-1] / h[-2]
    return np.concatenate([first[None], z, last[None]])


def interp_time_cubic(samples: DataFrame, times: DataFrame, at: "DataFrame | list[float]", table: DataFrame | None = None) -> DataFrame:
    """Not-a-knot cubic spline per node and component at every time of ``at(t)``: (t, node_id, u, v, w). Fewer than 4 snapshots: linear.

    Times beyond the ends are held there. ``table`` is a written ``spline_table`` of the same samples, if there is one.
    """
    spark = samples.sparkSession
    wanted = spark.createDataFrame([(float(t),) for t in at], "t double") if isinstance(at, list) else at.select(F.col("t").cast("double").alias("t"))
    index = time_index(times)
    if index.times.select("t").distinct().count() < 4:
        return interp_time(samples, index, wanted)
    table = spline_table(samples, index.times) if table is None else table
    joined = _spline_terms(wanted.distinct(), index).join(table.drop("t"), "t_idx")
    return joined.groupBy("t", "node_id").agg(*[F.sum(F.col("_value") * F.col(c) + F.col("_second") * F.col(f"m{c}")).alias(c) for c in UVW])


def sample_cubic(rows: DataFrame, table: DataFrame, times: DataFrame | TimeIndex) -> DataFrame:
    """``rows(id, node_id, t, ...)`` with u, v, w of each row's node at each row's own time, from a ``spline_table`` (four snapshots or more).

    Two snapshots per row are met by (t_idx, node_id) and summed per id; a NULL time gives NULL.
    """
    terms = _spline_terms(rows.select("id", "node_id", "t"), time_index(times)).join(table.drop("t"), ["t_idx", "node_id"])
    sums = terms.groupBy("id").agg(*[F.sum(F.col("_value") * F.col(c) + F.col("_second") * F.col(f"m{c}")).alias(c) for c in UVW])
    return rows.join(sums, "id", "left")


def _spline_terms(at: DataFrame, index: TimeIndex) -> DataFrame:
    """Two rows per row of ``at``: a snapshot and the factors of its value and of its second derivative."""
    bracket = time_bracket(at, index, "constant")
    h = F.col("_h")
    q = F.least(F.greatest(F.col("w_right"), F.lit(0.0)), F.lit(1.0))
    p = 1.0 - q
    of = lambda step, w: F.struct(F.col(step).alias("t_idx"), w.alias("_value"), (h * h / 6.0 * (w * w * w - w)).alias("_second"))
    stamps = index.times.select("t_idx", "t")
    ends = bracket.join(stamps.select(F.col("t_idx").alias("left"), F.col("t").alias("_t0")), "left").join(stamps.select(F.col("t_idx").alias("right"), F.col("t").alias("_t1")), "right")
    return ends.withColumn("_h", F.col("_t1") - F.col("_t0")).select(*at.columns, F.inline(F.array(of("left", p), of("right", q))))


# ---------------------------------------------------------------------------------------------------
# regular grids


def cell_corners(grid: DataFrame, meta: GridMeta, periodic: bool = False, key: tuple[str, ...] = ()) -> DataFrame:
    """One row per grid cell with the values of its 8 corners (u0..u7, v0.., w0..); a missing node counts as 0.

    Corner number is 4 * di + 2 * dj + dk. With this table a sample is one equi-join and a column
    expression: points are neither multiplied by 8 nor grouped again.
    """
    check(grid, "grid")
    spread = grid.select(*key, *"ijk", *UVW)
    steps, cells, held = [], [], []
    for c, n in zip("ijk", meta.shape):
        steps.append(f"explode(array({0 if n == 1 else '0, 1'})) AS d{c}")
        cells.append(f"CAST({f'pmod({c} - d{c}, {n})' if periodic else f'{c} - d{c}'} AS bigint) AS c{c}")
        held.append(f"c{c} BETWEEN 0 AND {n - 1 if periodic else max(n - 2, 0)}")
    for step in steps:
        spread = spread.selectExpr("*", step)
    spread = spread.selectExpr(*key, *UVW, *cells, "4 * di + 2 * dj + dk AS corner").filter(" AND ".join(held))
    return spread.groupBy(*key, "ci", "cj", "ck").agg(
        *[F.expr(f"coalesce(max(CASE WHEN corner = {n} THEN {c} END), 0D)").alias(f"{c}{n}") for c in UVW for n in range(8)]
    )


def _grid_position(meta: GridMeta, periodic: bool) -> tuple[list[str], list[str], list[str]]:
    """SQL of the grid coordinate g?, then of the cell index c?, then of the fraction f? per axis."""
    at, cell, part = [], [], []
    for a, c, o, s, n in zip(AXES, "ijk", meta.origin, meta.spacing, meta.shape):
        g = f"({a} - {float(o)!r}D) / {float(s)!r}D"
        at.append(f"pmod({g}, {float(n)!r}D) AS g{c}" if periodic else f"least(greatest({g}, 0D), {float(n - 1)!r}D) AS g{c}")
        cell.append(f"CAST(least(floor(g{c}), {n - 1 if periodic else max(n - 2, 0)}) AS bigint) AS c{c}")
        part.append(f"g{c} - c{c} AS f{c}")
    return at, cell, part


def _corner_weight(n: int) -> str:
    return " * ".join(f"f{c}" if bit else f"(1D - f{c})" for c, bit in zip("ijk", (n >> 2 & 1, n >> 1 & 1, n & 1)))


def trilinear_sample(points: DataFrame, grid: DataFrame, meta: GridMeta, outside: str = "clamp", key: tuple[str, ...] = ()) -> DataFrame:
    """Add u, v, w at every point of ``points``. ``outside``: clamp, zero, nan (NULL) or periodic (period n * spacing).

    ``key`` names further equal columns, e.g. a t_idx that both sides have.
    """
    corners = cell_corners(grid, meta, outside == "periodic", key)
    return sample_corners(points, corners, meta, outside, key, None if key else 1)


def sample_corners(
    points: DataFrame, corners: DataFrame, meta: GridMeta, outside: str = "clamp", key: tuple[str, ...] = (), snapshots: int | None = 1
) -> DataFrame:
    """``trilinear_sample`` with the corner table already at hand.

    The grid's shape bounds the corner table: shape x ``snapshots`` rows. If that is small it is broadcast and
    the points are not shuffled at all; otherwise (or with snapshots unknown, None) both sides meet by cell.
    """
    if outside not in ("clamp", "zero", "nan", "periodic"):
        raise ValueError("outside must be clamp, zero, nan or periodic")
    at, cell, part = _grid_position(meta, outside == "periodic")
    own = [f"`{c}`" for c in points.columns]
    placed = points.selectExpr(*own, *at).selectExpr("*", *cell)
    nx, ny, nz = meta.shape
    cell_key = [*key, "ci", "cj", "ck"]
    if snapshots is not None and nx * ny * nz * max(snapshots, 1) * CORNER_ROW_BYTES <= BROADCAST_BYTES:
        joined = placed.join(F.broadcast(corners), cell_key, "left")
    else:
        joined = join_per_key(placed, corners, cell_key, "left")  # points may crowd at an inlet or a wall
    joined = joined.selectExpr("*", *part)
    weighted = joined.selectExpr("*", *[f"{_corner_weight(n)} AS w_{n}" for n in range(8)])
    lost = "x IS NULL OR y IS NULL OR z IS NULL"
    within = " AND ".join(f"{a} BETWEEN {lo!r}D AND {hi!r}D" for a, lo, hi in meta.box.axes())
    out = {"zero": f"WHEN NOT ({within}) THEN 0D", "nan": f"WHEN NOT ({within}) THEN NULL"}.get(outside, "")
    blend = lambda c: " + ".join(f"w_{n} * coalesce({c}{n}, 0D)" for n in range(8))
    return weighted.selectExpr(*own, *[f"CASE WHEN {lost} THEN NULL {out} ELSE {blend(c)} END AS {c}" for c in UVW])


def sample_grid_series(points: DataFrame, series: DataFrame, times: DataFrame, meta: GridMeta, outside: str = "clamp", outside_time: str = "constant", corners: DataFrame | None = None) -> DataFrame:
    """Points with their own time t in a grid series (t_idx, i, j, k, u, v, w): trilinear in space, linear in time."""
    if corners is None:
        corners = cell_corners(series, meta, outside == "periodic", ("t_idx",))
    index = time_index(times)
    b = time_bracket(points, index, outside_time)
    n = index.n
    left = sample_corners(b.withColumn("t_idx", F.col("left")), corners, meta, outside, ("t_idx",), n)
    left = left.withColumnsRenamed({c: f"{c}_l" for c in UVW})
    both = sample_corners(left.withColumn("t_idx", F.col("right")), corners, meta, outside, ("t_idx",), n)
    mix = {c: F.col("w_left") * F.col(f"{c}_l") + F.col("w_right") * F.col(c) for c in UVW}
    return both.select(*[F.col(c) for c in points.columns], *[v.alias(c) for c, v in mix.items()])


def grid_from_rows(rows: DataFrame, meta: GridMeta) -> DataFrame:
    """Grid table from rows with x, y, z, u, v, w: index = nearest node of the axis."""
    idx = {c: F.round((F.col(a) - F.lit(float(o))) / F.lit(float(s))).cast("int") for c, a, o, s in zip("ijk", AXES, meta.origin, meta.spacing)}
    return rows.withColumns(idx).select(*"ijk", *UVW)


def grid_from_flat(rows: DataFrame, shape, id_col: str = "node_id") -> DataFrame:
    """Grid table from rows numbered with k fastest."""
    _, ny, nz = shape
    n = F.col(id_col)
    idx = {"i": F.floor(n / (ny * nz)).cast("int"), "j": (F.floor(n / nz) % ny).cast("int"), "k": (n % nz).cast("int")}
    return rows.withColumns(idx).select(*"ijk", *UVW)


# ---------------------------------------------------------------------------------------------------
# scattered nodes


def nearest_node_sample(points: DataFrame, nodes: DataFrame, values: DataFrame, hot: int | None = HOT_ROWS) -> DataFrame:
    """Add node_id, u, v, w of the nearest node to every point; lowest node id on ties."""
    near = knn(points.select("id", *AXES), nodes.select(F.col("node_id").alias("id"), *AXES), 1, hot)
    picked = near.select(F.col("q_id").alias("id"), F.col("p_id").alias("node_id"))
    return points.join(picked, "id", "left").join(values.select("node_id", *UVW), "node_id", "left").select(
        *[points[c] for c in points.columns], "node_id", *UVW
    )


# ---------------------------------------------------------------------------------------------------
# finite elements


def element_corners(elements: DataFrame, nodes: DataFrame, kind: str) -> DataFrame:
    """(elem_id, corners, nodes): corner positions as an ordered array; every element has at most 10 nodes."""
    check(elements, "elements")
    n = sh.CORNERS[kind]
    long = elements.select("elem_id", F.posexplode(F.slice("nodes", 1, n)).alias("pos", "node_id"))
    return (
        long.join(nodes.select("node_id", *AXES), "node_id")
        .groupBy("elem_id")
        .agg(F.sort_array(F.collect_list(F.struct("pos", *AXES))).alias("corners"))
        .join(elements.select("elem_id", "nodes"), "elem_id")
        .filter(F.size("corners") == n)
    )


def element_boxes(corners: DataFrame) -> DataFrame:
    """Add lo_x .. hi_z and the centroid m_x, m_y, m_z of the corners."""
    cols = {}
    for a in AXES:
        arr = F.col(f"corners.{a}")
        cols[f"lo_{a}"], cols[f"hi_{a}"] = F.array_min(arr), F.array_max(arr)
        cols[f"m_{a}"] = F.aggregate(arr, F.lit(0.0), lambda s, v: s + v) / F.size(arr)
    return corners.withColumns(cols)


def element_cells(boxes: DataFrame, frame: Frame, tol: float = sh.TOL, finer: int = 0) -> DataFrame:
    """Each element once per cell its box touches, at the level that fits the box, or ``finer`` levels below (at most 8 or, one level below, 27 cells)."""
    size = F.greatest(*[F.col(f"hi_{a}") - F.col(f"lo_{a}") for a in AXES])
    pad = size * F.lit(tol * 10) + F.lit(1e-12)
    return cover(
        boxes, frame, [F.col(f"lo_{a}") - pad for a in AXES], [F.col(f"hi_{a}") + pad for a in AXES],
        frame.level_with_side(size + pad + pad) + F.lit(finer),
    )


FINER = 1  # levels below an element's own: cells that hold few elements, so that a point meets few


def _reaching(cells: DataFrame, frame: Frame, kind: str, tol: float) -> DataFrame:
    """Drop cells in all of which some barycentric weight of the element is below -tol, with room for rounding."""
    half = F.lit(float(frame.side) / 2) / F.pow(F.lit(2.0), F.col("level"))
    mid = [F.lit(float(o)) + (F.lit(2.0) * F.col(f"c{a}") + F.lit(1.0)) * half for o, a in zip(frame.origin, AXES)]
    rows = F.col("rows")
    own = [[rows[r][c] for c in range(4)] for r in range(sh.CORNERS[kind] - 1)]
    last = [F.lit(1.0) - sum((r[0] for r in own[1:]), own[0][0]), *[-sum((r[c] for r in own[1:]), own[0][c]) for c in range(1, 4)]]
    keep = F.lit(True)
    for row in [last, *own]:
        terms = [row[0], *[c * m for c, m in zip(row[1:], mid)]]
        spread = sum((F.abs(c) for c in row[2:]), F.abs(row[1])) * half
        size = sum((F.abs(v) for v in terms[1:]), F.abs(terms[0])) + spread
        keep = keep & (sum(terms[1:], terms[0]) + spread >= -(F.lit(10 * tol) + F.lit(1e-9) * size))
    return cells.filter(keep)


def _weights(kind: str) -> list[Column]:
    return sh.affine_weights(F.col("rows"), [F.col(a) for a in AXES], sh.CORNERS[kind])


@dataclass(frozen=True)
class MeshIndex:
    """Tables that searches in a mesh read, written once: element cells with their affine rows, and centroids."""

    elements: DataFrame
    nodes: DataFrame
    kind: str
    frame: Frame
    cells: DataFrame
    levels: list[int]
    sites: SiteIndex | None = None


def mesh_index(elements: DataFrame, nodes: DataFrame, kind: str = "tet4", tol: float = sh.TOL, with_sites: bool = False) -> MeshIndex:
    """``with_sites`` also prepares the search for the nearest node, for meshes that are searched often."""
    elements, nodes = cut_lineage(elements), cut_lineage(nodes)  # searches and fallbacks read them again
    boxes = element_boxes(element_corners(elements, nodes, kind))
    frame = Frame.of(Box.around(nodes))
    rows = sh.affine_rows(boxes, "corners", sh.CORNERS[kind]).drop("corners", "m_x", "m_y", "m_z")
    cells = cut_lineage(_reaching(element_cells(rows, frame, tol, FINER), frame, kind, tol))
    sites = site_index(nodes.select(F.col("node_id").alias("id"), *AXES)) if with_sites else None
    return MeshIndex(elements, nodes, kind, frame, cells, used_levels(cells), sites)


def point_in_element(points: DataFrame, elements: DataFrame, nodes: DataFrame, kind: str = "tet4", tol: float = sh.TOL, hot: int | None = HOT_ROWS) -> DataFrame:
    """(id, elem_id, lam, nodes) of the containing element with the lowest id; points outside all elements have no row.

    For triangles the point also has to lie in the plane (within tol of the element size).
    """
    return find_elements(points, mesh_index(elements, nodes, kind, tol), tol, hot)


def find_elements(points: DataFrame, index: MeshIndex, tol: float = sh.TOL, hot: int | None = HOT_ROWS) -> DataFrame:
    """``point_in_element`` with the index at hand."""
    kind = index.kind
    placed = locate(points.select("id", *AXES), index.frame, index.levels or [0])
    joined = spread_join(placed, index.cells, CELL, hot)
    size = F.greatest(*[F.col(f"hi_{a}") - F.col(f"lo_{a}") for a in AXES])
    ok = ~F.col("flat")
    for a in AXES:
        ok = ok & F.col(a).between(F.col(f"lo_{a}") - size * tol, F.col(f"hi_{a}") + size * tol)
    lam = _weights(kind)
    for v in lam:
        ok = ok & (v >= F.lit(-tol))
    if sh.CORNERS[kind] == 3:
        ok = ok & (F.abs(sh.affine_value(F.col("rows"), 2, [F.col(a) for a in AXES])) <= size * F.lit(tol) + F.lit(1e-12))
    return (
        joined.filter(ok)
        .select("id", "elem_id", F.array(*lam).alias("lam"), "nodes")
        .groupBy("id")
        .agg(F.min_by(F.struct("elem_id", "lam", "nodes"), F.col("elem_id")).alias("hit"))
        .select("id", "hit.*")
    )


def nearest_centroid_element(points: DataFrame, elements: DataFrame, nodes: DataFrame, kind: str, strict_inside: bool = False, hot: int | None = HOT_ROWS) -> DataFrame:
    """(id, elem_id, lam, nodes): the element with the nearest centroid; with ``strict_inside`` only if it contains the point."""
    boxes = cut_lineage(sh.affine_rows(element_boxes(element_corners(elements, nodes, kind)), "corners", sh.CORNERS[kind]))
    centers = boxes.select(F.col("elem_id").alias("id"), *[F.col(f"m_{a}").alias(a) for a in AXES])
    near = knn(points.select("id", *AXES), centers, 1, hot).select(F.col("q_id").alias("id"), F.col("p_id").alias("elem_id"))
    found = points.select("id", *AXES).join(near, "id").join(boxes.select("elem_id", "rows", "nodes", "flat"), "elem_id")
    lam = _weights(kind)
    if strict_inside:
        ok = ~F.col("flat")
        for v in lam:
            ok = ok & (v >= F.lit(-sh.TOL))
        found = found.filter(ok)
    return found.select("id", "elem_id", F.array(*lam).alias("lam"), "nodes")


def element_weights(found: DataFrame, kind: str, width: int | None = None) -> DataFrame:
    """(id, elem_id, node_id, weight): shape functions of the element's nodes.

    A quadratic kind over elements that list their corners only takes the corner weights.
    """
    lam = [F.col("lam")[n] for n in range(sh.CORNERS[kind])]
    full = F.array(*sh.shapes(kind, lam))
    linear = F.array(*lam)
    weights = F.when(F.size("nodes") >= sh.WIDTH[kind], full).otherwise(linear)
    pairs = F.arrays_zip(F.slice("nodes", 1, sh.WIDTH[kind]).alias("node_id"), weights.alias("weight"))
    return found.select("id", "elem_id", F.inline(pairs).alias("node_id", "weight"))


def weighted_values(weights: DataFrame, values: DataFrame, by: tuple[str, ...] = ("id",)) -> DataFrame:
    """Sum of weight * value per key: the last step of every interpolation."""
    joined = weights.join(values.select("node_id", *UVW), "node_id")
    return joined.groupBy(*by).agg(*[F.sum(F.col("weight") * F.col(c)).alias(c) for c in UVW])


def fem_sample(
    points: DataFrame, elements: DataFrame, nodes: DataFrame, values: DataFrame, kind: str = "tet4",
    fallback: str = "nearest_node", hot: int | None = HOT_ROWS,
) -> DataFrame:
    """(id, elem_id, u, v, w) at every point. Outside the mesh (elem_id NULL): the nearest node, the nearest
    node of the element with the nearest centroid, or 0."""
    if fallback not in ("nearest_node", "nearest_element_node", "zero"):
        raise ValueError("fallback must be nearest_node, nearest_element_node or zero")
    index, values = mesh_index(elements, nodes, kind), cut_lineage(values.select("node_id", *UVW))
    # both the inside part and the remainder read the containing elements: written once
    found = cut_lineage(find_elements(points, index, hot=hot))
    inside = weighted_values(element_weights(found, kind), values, ("id", "elem_id"))
    rest = cut_lineage(points.join(found.select("id"), "id", "left_anti"))
    none = F.lit(None).cast("bigint").alias("elem_id")
    if fallback == "zero":
        outside = rest.select("id", none, *[F.lit(0.0).alias(c) for c in UVW])
    else:
        pick = _fallback_node(rest, index, fallback, hot)
        outside = rest.select("id").join(pick, "id", "left").join(values.select("node_id", *UVW), "node_id", "left").select("id", none, *UVW)
    return inside.unionByName(outside)


def _fallback_node(rest: DataFrame, index: MeshIndex, fallback: str, hot: int | None) -> DataFrame:
    """(id, node_id): the nearest node, or the nearest node of the element with the nearest centroid; lowest id on ties."""
    if fallback == "nearest_node":
        near = knn(rest.select("id", *AXES), index.sites or index.nodes.select(F.col("node_id").alias("id"), *AXES), 1, hot)
        return near.select(F.col("q_id").alias("id"), F.col("p_id").alias("node_id"))
    near = nearest_centroid_element(rest, index.elements, index.nodes, index.kind, hot=hot)
    long = near.select("id", F.explode("nodes").alias("node_id")).join(
        index.nodes.select("node_id", *[F.col(a).alias(f"n{a}") for a in AXES]), "node_id"
    ).join(rest.select("id", *AXES), "id")
    d = distance(F.col("nx"), F.col("ny"), F.col("nz"), F.col("x"), F.col("y"), F.col("z"))
    return long.groupBy("id").agg(F.min_by("node_id", F.struct(d, F.col("node_id"))).alias("node_id"))


def mesh_weights(points: DataFrame, index: MeshIndex, fallback: str = "nearest_node", hot: int | None = HOT_ROWS) -> DataFrame:
    """(id, node_id, weight): which nodes make up the field at every point; none outside the mesh with fallback zero."""
    if fallback not in ("nearest_node", "nearest_element_node", "zero"):
        raise ValueError("fallback must be nearest_node, nearest_element_node or zero")
    found = cut_lineage(find_elements(points, index, hot=hot))
    inside = element_weights(found, index.kind).select("id", "node_id", "weight")
    if fallback == "zero":
        return inside
    rest = cut_lineage(points.join(found.select("id"), "id", "left_anti"))
    return inside.unionByName(_fallback_node(rest, index, fallback, hot).select("id", "node_id", F.lit(1.0).alias("weight")))


def centroid_sample(points: DataFrame, elements: DataFrame, nodes: DataFrame, values: DataFrame, kind: str, strict_inside: bool = False, hot: int | None = HOT_ROWS) -> DataFrame:
    """(id, u, v, w) with the element of the nearest centroid; strict: 0 where it does not contain the point."""
    found = nearest_centroid_element(points, elements, nodes, kind, strict_inside, hot)
    hit = weighted_values(element_weights(found, kind), values)
    return points.select("id").join(hit, "id", "left").select("id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in UVW])


def pseudo_elements(points: DataFrame, nodes: DataFrame, kind: str, hot: int | None = HOT_ROWS) -> DataFrame:
    """Mesh without elements: each point's k nearest nodes, in distance order, as its own element."""
    n = sh.CORNERS[kind]
    near = knn(points.select("id", *AXES), nodes.select(F.col("node_id").alias("id"), *AXES), n, hot)
    ordered = near.groupBy("q_id").agg(F.sort_array(F.collect_list(F.struct("rank", "p_id"))).alias("_n"))
    elements = ordered.select(F.col("q_id").alias("elem_id"), F.col("_n.p_id").alias("nodes"))
    corners = sh.affine_rows(element_corners(elements, nodes, kind), "corners", n)
    found = points.select("id", *AXES).join(corners, F.col("id") == F.col("elem_id"))
    return found.select("id", "elem_id", F.array(*_weights(kind)).alias("lam"), "nodes")


def mesh_check(elements: DataFrame, nodes: DataFrame, kind: str) -> DataFrame:
    """One row: elements, elements of wrong width, references to nodes that do not exist."""
    long = elements.select(F.explode("nodes").alias("node_id"))
    missing = long.join(nodes.select("node_id"), "node_id", "left_anti").agg(F.count(F.lit(1)).alias("n_dangling"))
    sizes = elements.agg(F.count(F.lit(1)).alias("n_elements"), F.count_if(F.size("nodes") != sh.WIDTH[kind]).alias("n_wrong_width"))
    return sizes.withColumn("n_dangling", missing.scalar())


def tetra_cells(cells: DataFrame, cell_type: int = 10) -> DataFrame:
    """Cells of one type code. 5 = 3-node triangle, 10 = 4-node tetrahedron, 22 and 24 = their quadratic forms."""
    return cells.filter(F.col("cell_type") == cell_type)


def sampling_profile(samples: DataFrame) -> DataFrame:
    """One row: speed and component statistics and finite, NaN and infinite counts over sampled velocities."""
    speed = magnitude(*[F.col(c) for c in UVW])
    nan = reduce(lambda a, b: a | b, [F.col(c).isNull() | F.coalesce(F.isnan(c), F.lit(False)) for c in UVW])
    inf = reduce(lambda a, b: a | b, [F.coalesce(F.abs(c) == F.lit(float("inf")), F.lit(False)) for c in UVW])
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(speed).alias("speed_mean"), F.stddev_pop(speed).alias("speed_std"),
            F.min(speed).alias("speed_min"), F.max(speed).alias("speed_max")]
    for c in UVW:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std")]
    aggs += [F.count_if(~nan & ~inf).alias("n_finite"), F.count_if(nan).alias("n_nan"), F.count_if(inf).alias("n_infinite")]
    return samples.agg(*aggs)
