"""Projections and scalar math on point columns (x, y, z) and vectors (u, v, w)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from driftfield.model import AXES, Box
from driftfield.operators.ranks import exact_percentiles, first_rows

PLANES = {"xy": ("x", "y", "z"), "xz": ("x", "z", "y"), "yz": ("y", "z", "x")}


def magnitude(*parts: Column) -> Column:
    """Euclidean length of a vector."""
    total = parts[0] * parts[0]
    for p in parts[1:]:
        total = total + p * p
    return F.sqrt(total)


def distance(ax, ay, az, bx, by, bz) -> Column:
    return magnitude(ax - bx, ay - by, az - bz)


def is_finite(c: Column) -> Column:
    """True for a number that is neither NaN nor infinite (NULL gives false)."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def as_points(df: DataFrame) -> DataFrame:
    """x, y, z as doubles; a missing z column, or NULL in it, becomes 0."""
    z = F.coalesce(F.col("z").cast("double"), F.lit(0.0)) if "z" in df.columns else F.lit(0.0)
    return df.withColumns({"x": F.col("x").cast("double"), "y": F.col("y").cast("double"), "z": z})


def pad_vector3(arr: Column) -> list[Column]:
    """First three entries of an array, missing ones 0."""
    return [F.coalesce(F.get(arr, F.lit(i)).cast("double"), F.lit(0.0)) for i in range(3)]


def inside(box: Box, tol: float = 0.0) -> Column:
    """Inclusive containment of x, y, z."""
    cond = F.lit(True)
    for a, lo, hi in box.axes():
        cond = cond & F.col(a).between(lo - tol, hi + tol)
    return cond


def in_box(df: DataFrame, box: Box) -> DataFrame:
    return df.filter(inside(box))


def expand_box(box: Box, margin: float) -> Box:
    return Box(tuple(v - margin for v in box.lo), tuple(v + margin for v in box.hi))


def box_size(box: Box) -> tuple[float, float, float]:
    return box.width


def fraction_box(box: Box, fractions: dict[str, tuple[float, float]]) -> Box:
    """Sub-box by a (low, high) fraction per axis; axes not named keep their whole width."""
    lo, hi = [], []
    for a, b, t in box.axes():
        f0, f1 = fractions.get(a, (0.0, 1.0))
        lo.append(b + f0 * (t - b))
        hi.append(b + f1 * (t - b))
    return Box(tuple(lo), tuple(hi))


def clamp_points(df: DataFrame, box: Box) -> DataFrame:
    return df.withColumns({a: F.least(F.greatest(F.col(a), F.lit(lo)), F.lit(hi)) for a, lo, hi in box.axes()})


def translate(df: DataFrame, shift) -> DataFrame:
    return df.withColumns({a: F.col(a) + F.lit(float(s)) for a, s in zip(AXES, shift)})


def scale(df: DataFrame, factor) -> DataFrame:
    factors = factor if isinstance(factor, (list, tuple)) else (factor,) * 3
    return df.withColumns({a: F.col(a) * F.lit(float(s)) for a, s in zip(AXES, factors)})


def _apply_matrix(df: DataFrame, m) -> DataFrame:
    """Row vector times transposed matrix: new_a = sum_b m[a][b] * old_b."""
    return df.withColumns(
        {a: sum((F.lit(float(m[r][c])) * F.col(b) for c, b in enumerate(AXES)), F.lit(0.0)) for r, a in enumerate(AXES)}
    )


def _axis_rotation(axis: str, angle: float):
    c, s = math.cos(angle), math.sin(angle)
    return {
        "x": [[1, 0, 0], [0, c, -s], [0, s, c]],
        "y": [[c, 0, s], [0, 1, 0], [-s, 0, c]],
        "z": [[c, -s, 0], [s, c, 0], [0, 0, 1]],
    }[axis]


def euler_matrix(angles, order: str = "xyz"):
    """Product of axis rotations; the first letter acts on the points first."""
    m = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    for axis, angle in zip(order.lower(), angles):
        r = _axis_rotation(axis, angle)
        m = [[sum(r[i][k] * m[k][j] for k in range(3)) for j in range(3)] for i in range(3)]
    return m


def rotate2d(df: DataFrame, angle: float) -> DataFrame:
    """Counter-clockwise rotation of x, y; z stays."""
    return _apply_matrix(df, _axis_rotation("z", angle))


def rotate3d_euler(df: DataFrame, angles, order: str = "xyz") -> DataFrame:
    return _apply_matrix(df, euler_matrix(angles, order))


def similarity(df: DataFrame, factor: float, matrix, shift) -> DataFrame:
    """Scale, then rotate, then shift."""
    return df.transform(scale, factor).transform(_apply_matrix, matrix).transform(translate, shift)


def grid_cell(df: DataFrame, origin, size: float) -> DataFrame:
    """Integer cell triple cx, cy, cz of each point."""
    return df.withColumns(
        {f"c{a}": F.floor((F.col(a) - F.lit(float(o))) / F.lit(float(size))) for a, o in zip(AXES, origin)}
    )


# The three multipliers of the usual prime-XOR cell hash.
CELL_PRIMES = (73856093, 19349663, 83492791)


def cell_key(cx: Column, cy: Column, cz: Column) -> Column:
    """One 64-bit number per cell triple. Collisions are possible: join on the triple, not on this."""
    a, b, c = (v.cast("bigint") * F.lit(p) for v, p in zip((cx, cy, cz), CELL_PRIMES))
    return a.bitwiseXOR(b).bitwiseXOR(c)


def plane_project(df: DataFrame, plane: str = "xy") -> DataFrame:
    """Columns p, q: the two coordinates of the plane."""
    a, b, _ = PLANES[plane]
    return df.withColumns({"p": F.col(a), "q": F.col(b)})


def flatten_axis(df: DataFrame, plane: str = "xy") -> DataFrame:
    """Zero the coordinate that is not in the plane."""
    return df.withColumn(PLANES[plane][2], F.lit(0.0))


def slab_filter(df: DataFrame, plane: str, position: float, thickness: float, all_if_empty: bool = False) -> DataFrame:
    """Rows within half a thickness of the plane, projected by p, q; with ``all_if_empty`` every row if none is."""
    near = F.abs(F.col(PLANES[plane][2]) - F.lit(float(position))) <= F.lit(thickness / 2.0)
    if not all_if_empty:
        return plane_project(df.filter(near), plane)
    any_near = df.agg(F.coalesce(F.max(near), F.lit(False)).alias("hit"))
    kept = df.withColumn("_hit", any_near.scalar()).filter(near | ~F.col("_hit")).drop("_hit")
    return plane_project(kept, plane)


def drop_still_nodes(df: DataFrame, eps: float = 1e-12) -> DataFrame:
    """Rows whose speed exceeds eps; rows carry their node id, so positions stay aligned."""
    return df.filter(magnitude(F.col("u"), F.col("v"), F.col("w")) > F.lit(eps))


def subsample_rows(df: DataFrame, id_col: str, step: int = 1, cap: int | None = None) -> DataFrame:
    """Every step-th id, then the first ``cap`` rows by id."""
    kept = df.filter(F.col(id_col) % F.lit(step) == 0)
    return kept if cap is None else first_rows(kept, id_col, cap)


def plot_frame(df: DataFrame, margin: float = 0.02) -> DataFrame:
    """One row with the padded bounds of all points."""
    agg = df.agg(*[f(a).alias(f"{n}{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))])
    cols = []
    for a in AXES:
        pad = F.lit(margin) * (F.col(f"hi{a}") - F.col(f"lo{a}"))
        cols += [(F.col(f"lo{a}") - pad).alias(f"lo{a}"), (F.col(f"hi{a}") + pad).alias(f"hi{a}")]
    return agg.select(*cols)


def percentile_clip(df: DataFrame, col: str, low: float = 0.0, high: float = 95.0) -> DataFrame:
    """Clip a column at two exact percentiles (linear interpolation). 0 and 100 do nothing."""
    lo, hi = exact_percentiles(df, col, [low / 100.0, high / 100.0])
    if lo is None:
        return df
    value = F.col(col)
    if low > 0:
        value = F.greatest(value, F.lit(lo))
    if high < 100:
        value = F.least(value, F.lit(hi))
    return df.withColumn(col, value)
