"""Density estimates: pair sums between sources and query points."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from driftfield.functions.kernels import gaussian_kernel, kernel_factor, kernel_of_square, kernel_shape, sph_kernel
from driftfield.functions.vector import PLANES, percentile_clip, slab_filter
from driftfield.model import AXES, Box
from driftfield.operators.cells import CELL, HOT_ROWS, Frame, _finite, _padded, _touched, ball_pairs, cogroup_slots, cover, group_plan, group_sizes, knn, locate, sites
from driftfield.session import cut_lineage

SLAB_NODES = 1_000_000  # grid nodes that one task holds
#: Beyond this many bandwidths a Gaussian is 0 in double precision.
WHOLE_REACH = 38.7


def bandwidths(points: DataFrame, axes=AXES) -> DataFrame:
    """One row (n, scott, silverman): mean sample std over the axes times n^(-1/(d+4)); Silverman adds (4/(d+2))^(1/(d+4))."""
    d = len(axes)
    spread = sum((F.coalesce(F.stddev_samp(a), F.lit(0.0)) for a in axes), F.lit(0.0)) / d
    row = points.agg(F.count(F.lit(1)).alias("n"), spread.alias("_s"))
    scott = F.when(F.col("n") > 1, F.col("_s") * F.pow(F.col("n").cast("double"), F.lit(-1.0 / (d + 4)))).otherwise(F.lit(1.0))
    return row.select("n", scott.alias("scott"), (scott * F.lit((4.0 / (d + 2)) ** (1.0 / (d + 4)))).alias("silverman"))


def scott_bandwidth(points: DataFrame, axes=AXES) -> float:
    return bandwidths(points, axes).first()["scott"]


def silverman_bandwidth(points: DataFrame, axes=AXES) -> float:
    return bandwidths(points, axes).first()["silverman"]


def as_plane(df: DataFrame, plane: str = "xy") -> DataFrame:
    """Two-dimensional points: x, y are the plane's coordinates, z is 0."""
    a, b, _ = PLANES[plane]
    return df.withColumns({"x": F.col(a), "y": F.col(b), "z": F.lit(0.0)})


def slab_plane(df: DataFrame, plane: str, position: float, thickness: float, all_if_empty: bool = False) -> DataFrame:
    """Points of a slab as two-dimensional points; with ``all_if_empty`` all points if it has none."""
    near = slab_filter(df, plane, position, thickness, all_if_empty)
    return near.withColumns({"x": F.col("p"), "y": F.col("q"), "z": F.lit(0.0)}).drop("p", "q")


BLOCK = 16_384  # balls and queries that meet in one group
CHUNK = 32, 2048  # queries and balls of one matrix: small enough for a core's cache
VALUES = 4096  # values of the queries on an axis that is collapsed
PLACES = 1 << 20  # sums that a task holds then, one per value and place
GAIN = 4  # share of all pairs, as one in so many, from which on collapsing an axis pays
DENSE = 64  # balls that share a cell, seen by the average ball, from which on arrays pay


def squared_gaps(q, p):
    d = q[0] - p[0]
    d *= d
    for n in (1, 2):
        t = q[n] - p[n]
        t *= t
        d += t
    return d


def _within(k, q, p, r, over):
    """Which of the squared distances k, in units of each ball's h, are at most its radius; those too near to say are computed from differences."""
    end = r * r * over
    inside, sure = k <= end * (1.0 + 1e-9), k <= end * (1.0 - 1e-9)
    if inside.sum() != sure.sum():
        i, j = (inside & ~sure).nonzero()
        inside[i, j] = squared_gaps(q[:, i], p[:, j]) ** 0.5 <= r[j]
    return inside


def _sums_of_group(kind: str, reach: float, left, right):
    """Kernel sums of one group: queries and balls as Arrow tables."""
    import numpy as np
    import pyarrow as pa

    col = lambda t, c: t.column(c).to_numpy()
    asked = np.stack([col(left, a) for a in AXES])
    balls = np.stack([col(right, f"b{a}") for a in AXES])
    h, w, r = (col(right, c) for c in ("h", "w", "_radius"))
    far = (r * (1.0 + 1e-9) + 1e-12) ** 2
    # queries in the order of small cells, so that those of a chunk are near each other and few balls reach them
    side = max(1, round((asked.shape[1] / CHUNK[0]) ** (1 / 3)))
    low, wide = asked.min(1, initial=np.inf, keepdims=True), np.ptp(asked, axis=1, keepdims=True) if asked.size else 1.0
    cell = np.minimum(np.floor((asked - low) / np.where(wide > 0, wide, 1.0) * side), side - 1)
    order = np.argsort((cell[0] * side + cell[1]) * side + cell[2], kind="stable")
    out = np.zeros(asked.shape[1])
    for start in range(0, len(order), CHUNK[0]):
        rows = order[start : start + CHUNK[0]]
        q = asked[:, rows]
        lo, hi = q.min(1)[:, None], q.max(1)[:, None]
        gap = np.maximum(np.maximum(lo - balls, balls - hi), 0.0)
        near = np.flatnonzero((gap * gap).sum(0) <= far)
        for first in range(0, len(near), CHUNK[1]):
            at = near[first : first + CHUNK[1]]
            p, ph = balls[:, at], h[at]
            if kind == "mean":
                # squared distances as one matrix product about the middle of the chunk
                mid = (lo + hi) / 2
                qs, ps = (q - mid) / ph[0], (p - mid) / ph[0]  # one h for all
                one = lambda v: np.ones((1, v.shape[1]))
                k = np.vstack([qs, (qs * qs).sum(0)[None], one(qs)]).T @ np.vstack([-2.0 * ps, one(ps), (ps * ps).sum(0)[None]])
                outside = k > reach * reach if reach < WHOLE_REACH else None
                np.maximum(k, 0.0, out=k)
                k *= -0.5
                np.exp(k, out=k)
                if outside is not None:
                    k[outside] = 0.0
            elif ((hi - lo) ** 2).sum() > 64.0 * ph.min() ** 2 or ph.min() <= 1e-12:
                # balls far smaller than the chunk: differences keep what a matrix product would lose
                d = np.sqrt(squared_gaps(q[:, :, None], p[:, None, :]))
                outside = d > r[at]
                d /= ph
                k = kernel_shape(kind, d)
                k[outside] = 0.0
            else:
                mid = (lo + hi) / 2
                qs, ps = q - mid, p - mid
                over = 1.0 / (ph * ph)
                k = np.vstack([qs, (qs * qs).sum(0)[None], np.ones((1, qs.shape[1]))]).T @ (np.vstack([-2.0 * ps, np.ones((1, ps.shape[1])), (ps * ps).sum(0)[None]]) * over)
                np.maximum(k, 0.0, out=k)
                inside = _within(k, q, p, r[at], over) if kind == "gaussian" else None  # the other kernels end at 0
                k = kernel_of_square(kind, k)
                if inside is not None:
                    k *= inside
            out[rows] += k @ w[at]
    return pa.table({**{a: v for a, v in zip(AXES, asked)}, "s": out})


def met_in_groups(balls: DataFrame, asked: DataFrame, frame: Frame, levels: list[int], rows: int, ours, theirs, fn, schema: str) -> DataFrame:
    """What ``fn`` makes of Arrow tables of asked (columns ``ours``) and balls (``theirs``), in groups of at most about ``rows`` rows of one cell a side.

    Queries go into their one cell per level, balls(bx, by, bz, _radius, level) into those they touch. A cell with more rows is cut into slots
    dealt out by a hash, and each slot of one side meets each of the other. So what a task holds does not grow with the data, and no row is
    made for a pair.
    """
    r = _padded(F.col("_radius"))
    covered = cover(balls, frame, [F.col(f"b{a}") - r for a in AXES], [F.col(f"b{a}") + r for a in AXES], F.col("level")).filter(_touched(frame))
    located = locate(asked.select(*ours), frame, levels)
    slots, _, parts = group_plan(group_sizes(located, covered), rows, asked.sparkSession.sparkContext.defaultParallelism)
    return cogroup_slots(located, covered, slots, parts, ours, theirs, fn, schema)


def _dense_sums(balls: DataFrame, asked: DataFrame, frame: Frame, levels: list[int], kind: str, reach: float, rows: int) -> DataFrame:
    """(x, y, z, s) over balls(bx, by, bz, h, w, _radius, level): a group is one call, cut into matrices that fit a cache."""
    fn = lambda q, p: _sums_of_group(kind, reach, q, p)
    return met_in_groups(balls, asked, frame, levels, rows, AXES, ("bx", "by", "bz", "h", "w", "_radius"), fn, "x double, y double, z double, s double")


def _kernel_sums(
    src: DataFrame, asked: DataFrame, kind: str, dim: int, reach: float, frame: Frame, hot: int | None = HOT_ROWS,
    dense: float = DENSE, rows: int | None = None,
) -> DataFrame:
    """(x, y, z, s): sums of mass times kernel at distinct positions over sources(x, y, z, h, mass); both tables are written.

    Sources whose cells are crowded meet the queries as arrays, the others pair by pair.
    """
    radius = F.col("h") * F.lit(float(reach))
    balls = src.select(*[F.col(a).alias(f"b{a}") for a in AXES], "h", "mass").withColumn("_radius", radius)
    balls = balls.withColumn("level", frame.level_with_side(_padded(F.col("_radius"))))
    own = [frame.index(F.col(f"b{a}"), n, F.col("level")).alias(f"c{a}") for n, a in enumerate(AXES)]
    counts = balls.select("level", *own).groupBy(*CELL).agg(F.count(F.lit(1)).cast("double").alias("m"))
    crowd = counts.groupBy("level").agg((F.sum(F.col("m") * F.col("m")) / F.sum("m")).alias("seen")).collect()  # a row per level
    levels = [c["level"] for c in crowd if c["level"] is not None and c["seen"] >= dense]
    arrays = F.coalesce(F.col("level").isin(levels) & (F.col("_radius") >= 0.0) & (F.col("_radius") < float("inf")), F.lit(False))
    parts = []
    if levels:
        weighted = balls.filter(arrays).withColumn("w", (F.col("mass") * kernel_factor(kind, F.col("h"), dim)).cast("double"))
        weighted = weighted.withColumn("h", F.greatest(F.col("h"), F.lit(1e-12)).cast("double"))
        parts.append(_dense_sums(weighted.drop("mass"), asked, frame, levels, kind, reach, rows or BLOCK))
    if len(levels) < len(crowd) or not levels:
        pairs = ball_pairs(balls.filter(~arrays).drop("_radius", "level"), asked, radius, frame, hot)
        h, d = F.col("h"), F.col("d")
        value = gaussian_kernel(d * d / (h * h), dim) if kind == "mean" else sph_kernel(kind, d, h, dim)
        parts.append(pairs.select(*AXES, (F.col("mass") * value).alias("s")))
    return reduce(DataFrame.unionByName, parts).groupBy(*AXES).agg(F.sum("s").alias("s"))


def _frame_of_reach(top: float) -> Frame:
    return Frame((0.0, 0.0, 0.0), max(top, 1e-9) * (1 + 2e-9) + 2e-12)


def _axis_to_collapse(src: DataFrame, asked: DataFrame) -> str | None:
    """The axis by which ``_collapsed_sums`` has least to do, if that is a small share of all pairs and its table stays small; else None."""
    across = {a: [b for b in AXES if b != a] for a in AXES}
    q = asked.agg(F.count(F.lit(1)).alias("n"), *[F.approx_count_distinct(a).alias(a) for a in AXES]).first()
    p = src.agg(F.count(F.lit(1)).alias("n"), *[F.approx_count_distinct(F.xxhash64(*across[a])).alias(a) for a in AXES]).first()
    work = {a: q[a] * p["n"] + q["n"] * p[a] for a in AXES if q[a] <= VALUES and 0 < q[a] * p[a] <= PLACES}
    best = min(work, key=work.get, default=None)
    return best if best and work[best] * GAIN <= q["n"] * p["n"] else None


def _collapsed_sums(src: DataFrame, asked: DataFrame, axis: str, h: float, dim: int) -> DataFrame:
    """(x, y, z, s): as ``_kernel_sums`` of uncut Gaussians of one h, for queries that take few values on ``axis``.

    A Gaussian is a product over the axes. Per value the sources of a place (the other two coordinates) are summed with the axis' factor first,
    each task its own and Spark those of all tasks; queries of that value then meet places instead of sources. The work is values x sources
    and queries x places. A task holds values x places sums, or the places of one value and at most about ``BLOCK`` queries.
    """
    b, c = (a for a in AXES if a != axis)
    cores = src.sparkSession.sparkContext.defaultParallelism
    values = sorted(r[0] for r in asked.select(axis).distinct().collect())  # at most about VALUES
    schema = f"{axis} double, {b} double, {c} double, w double"

    def collapse(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        at, known, sums = np.array(values), {}, np.zeros((64, len(values)))
        high = max(1, (1 << 20) // len(at))
        for batch in batches:
            for start in range(0, batch.num_rows, high):
                x, y, z, m = (batch.column(k).to_numpy()[start : start + high] for k in (axis, b, c, "mass"))
                order = np.lexsort((z, y))
                y, z = y[order], z[order]
                first = np.flatnonzero(np.r_[True, (y[1:] != y[:-1]) | (z[1:] != z[:-1])])
                gap = (x[order][:, None] - at) / h
                part = np.add.reduceat(np.exp(-0.5 * gap * gap) * m[order][:, None], first)
                rows = np.array([known.setdefault(place, len(known)) for place in zip((y[first] + 0.0).tolist(), (z[first] + 0.0).tolist())])
                while len(known) > len(sums):
                    sums = np.vstack([sums, np.zeros_like(sums)])
                sums[rows] += part
        if known:
            y, z = np.array(list(known)).T
            for n, value in enumerate(values):
                out = [np.full(len(known), value), y, z, sums[: len(known), n]]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in out], names=[axis, b, c, "w"])

    def meet(left, right):
        import numpy as np
        import pyarrow as pa

        q, p = ([t.column(k).to_numpy() / h for k in (b, c)] for t in (left, right))
        w = right.column("w").to_numpy()
        out = np.zeros(left.num_rows)
        for start in range(0, len(out), CHUNK[0]):
            rows = slice(start, start + CHUNK[0])
            for first in range(0, len(w), CHUNK[1]):
                part = slice(first, first + CHUNK[1])
                k, t = (q[n][rows, None] - p[n][part] for n in (0, 1))
                k *= k
                t *= t
                k += t
                k *= -0.5
                out[rows] += np.exp(k, out=k) @ w[part]
        return pa.table({**{a: left.column(a) for a in AXES}, "s": out})

    places = src.select(*AXES, "mass").coalesce(cores).mapInArrow(collapse, schema).groupBy(axis, b, c).agg(F.sum("w").alias("w"))
    places = places.withColumn("w", F.col("w") * kernel_factor("mean", F.lit(1.0), dim))
    slots = cut_lineage(asked.groupBy(axis).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_of")))
    parts = max(1, min(16 * cores, slots.agg(F.sum("_of")).first()[0] or 0))
    slots = F.broadcast(slots)  # a row per value
    dealt = asked.select(*AXES).join(slots, axis).withColumn("_slot", F.pmod(F.xxhash64(b, c), F.col("_of"))).drop("_of")
    repeated = places.join(slots, axis).withColumn("_slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_of") - 1))).drop("_of")
    keys = [axis, "_slot"]
    sides = [df.repartition(parts, *keys).groupBy(*keys) for df in (dealt, repeated)]
    return sides[0].cogroup(sides[1]).applyInArrow(meet, "x double, y double, z double, s double")


def kde_at(
    points: DataFrame, queries: DataFrame, h: float, dim: int = 3, scale: str = "kernel_mean", reach: float = WHOLE_REACH
) -> DataFrame:
    """(id, rho): mean Gaussian kernel of all points at every query.

    Every pair whose kernel is not 0 in double precision counts. A smaller ``reach`` (in bandwidths) leaves pairs out: at 8.5 each of them
    is below 2.1e-16 of the kernel's peak. Copies of a position are merged first. Where queries take few values on some axis and sources few
    places across it, no pairs are formed (see ``_collapsed_sums``). ``scale='density'`` divides by h^d.
    """
    src = cut_lineage(sites(points.withColumn("mass", F.lit(1.0))).select(*AXES, F.lit(float(h)).alias("h"), F.col("n").cast("double").alias("mass")))
    n = points.count()
    asked = cut_lineage(_finite(queries).select(*AXES).distinct())
    axis = _axis_to_collapse(src, asked) if reach >= WHOLE_REACH and h > 1e-12 else None
    rho = _collapsed_sums(src, asked, axis, float(h), dim) if axis else _kernel_sums(src, asked, "mean", dim, reach, _frame_of_reach(h * reach))
    rho = rho.withColumnsRenamed({a: f"_{a}" for a in AXES})
    value = F.coalesce(F.col("s") / F.lit(float(max(n, 1))), F.lit(0.0))
    if scale == "density":
        value = value / F.lit(h**dim)
    elif scale != "kernel_mean":
        raise ValueError("scale must be kernel_mean or density")
    cond = [queries[a] == rho[f"_{a}"] for a in AXES]
    return queries.join(rho, cond, "left").select(queries["id"], value.alias("rho"))


def kde_slab(points: DataFrame, queries: DataFrame, plane: str, position: float, thickness: float, h: float | None = None, all_if_empty: bool = False) -> DataFrame:
    """(id, rho): two-dimensional density of the points of a slab at queries(id, p, q) in its plane.

    ``all_if_empty`` as in ``slab_filter``. Without ``h`` it is Scott's for the slab's points.
    """
    flat = cut_lineage(slab_plane(points, plane, position, thickness, all_if_empty))
    h = scott_bandwidth(flat, ("x", "y")) if h is None else h
    return kde_at(flat, queries.select("id", F.col("p").alias("x"), F.col("q").alias("y"), F.lit(0.0).alias("z")), h, 2)


def grid_axes(box: Box, shape) -> list[list[float]]:
    return [[lo + i * (hi - lo) / (n - 1) if n > 1 else lo for i in range(n)] for (_, lo, hi), n in zip(box.axes(), shape)]


def grid_nodes(points: DataFrame, box: Box, shape) -> DataFrame:
    """(id, gx, gy, gz, x, y, z) of a density grid; id runs y, x, z (z fastest)."""
    nx, ny, nz = shape
    ax = grid_axes(box, shape)
    df = points.sparkSession.range(nx * ny * nz).withColumns(
        {"gy": F.floor(F.col("id") / (nx * nz)), "gx": F.floor(F.col("id") / nz) % nx, "gz": F.col("id") % nz}
    )
    at = {a: F.element_at(F.lit(vals), (F.col(g) + 1).cast("int")) for a, g, vals in zip(AXES, ("gx", "gy", "gz"), ax)}
    return df.withColumns(at)


def _slabs_near(rows: DataFrame, axis: str, nodes: list[float], wide: int, h: float) -> DataFrame:
    """Each row once per slab of ``wide`` grid nodes along the axis with a node for which its kernel is not 0 in double precision."""
    last = (len(nodes) - 1) // wide
    step = (nodes[-1] - nodes[0]) / (len(nodes) - 1) if len(nodes) > 1 else 0.0
    if last == 0 or step <= 0:
        return rows.withColumn(f"_slab_{axis}", F.explode(F.sequence(F.lit(0), F.lit(last))))
    at = (F.col(axis) - F.lit(nodes[0])) / F.lit(step)
    reach = F.lit(WHOLE_REACH * h / step + 1e-6)
    first, end = F.greatest(F.ceil(at - reach), F.lit(0)), F.least(F.floor(at + reach), F.lit(len(nodes) - 1))
    slab = lambda c: F.floor(c / wide).cast("int")
    return rows.withColumn(f"_slab_{axis}", F.explode(F.when(first <= end, F.sequence(slab(first), slab(end)))))


def _kde_grid_sums(points: DataFrame, axes: list[list[float]], h: float, slab_nodes: int = SLAB_NODES) -> DataFrame:
    """(gx, gy, gz, s): kernel sums on a grid without forming pairs.

    A Gaussian is a product over the axes, so a batch of points contributes one matrix product; every task keeps one array of a slab's
    size and hands it on once, and Spark adds the arrays up. A larger grid is cut into slabs along x and y, each with tasks of its own, and a
    point goes to the slabs that its kernel reaches; there are no more tasks per slab than cores, so what is handed on does not grow with
    the points.
    """
    nx, ny, nz = (len(a) for a in axes)
    wide_y = max(1, min(ny, slab_nodes // nz))
    wide_x = max(1, min(nx, slab_nodes // (nz * wide_y)))
    slabs = [(x, y) for x in range(0, nx, wide_x) for y in range(0, ny, wide_y)]

    def partial(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        gx, gy, gz = (np.array(a) for a in axes)
        totals = {}
        for batch in batches:
            for slab, rows in batch.groupby("slab") if len(slabs) > 1 else [(0, batch)]:
                x0, y0 = slabs[slab]
                sides = gx[x0 : x0 + wide_x], gy[y0 : y0 + wide_y], gz
                total = totals.setdefault(slab, np.zeros(tuple(len(g) for g in sides)))
                for lo in range(0, len(rows), 4096):
                    part = rows.iloc[lo : lo + 4096]
                    ex, ey, ez = (np.exp(-0.5 * ((part[a].to_numpy()[:, None] - g[None, :]) / h) ** 2) for a, g in zip(AXES, sides))
                    for k in range(len(gz)):
                        total[:, :, k] += (ex * ez[:, k : k + 1]).T @ ey
        for slab, total in totals.items():
            x0, y0 = slabs[slab]
            i, j, k = np.meshgrid(*(np.arange(n) for n in total.shape), indexing="ij")
            yield pd.DataFrame({"gx": x0 + i.ravel(), "gy": y0 + j.ravel(), "gz": k.ravel(), "s": total.ravel()})

    rows, cores = points.select(*AXES).na.drop(), points.sparkSession.sparkContext.defaultParallelism
    if len(slabs) > 1:
        n_y = -(-ny // wide_y)
        rows = _slabs_near(_slabs_near(rows, "x", axes[0], wide_x, h), "y", axes[1], wide_y, h)
        rows = rows.select(*AXES, (F.col("_slab_x") * n_y + F.col("_slab_y")).alias("slab"))
        rows = rows.withColumn("_share", F.pmod(F.xxhash64(*AXES), F.lit(cores))).repartition(len(slabs) * cores, "slab", "_share").drop("_share")
    else:
        rows = rows.coalesce(cores).withColumn("slab", F.lit(0))
    out = rows.mapInPandas(partial, "gx bigint, gy bigint, gz bigint, s double")
    return out.groupBy("gx", "gy", "gz").agg(F.sum("s").alias("s"))


def kde_grid(points: DataFrame, h: float, shape, dim: int = 3, box: Box | None = None, normalize: bool = True) -> DataFrame:
    """(gx, gy, gz, x, y, z, rho) on a grid over the data range; normalised values are multiples of the mean density.

    With dim = 2 pass two-dimensional points (z = 0) and a shape whose third entry is 1.
    """
    box = box or Box.around(points)
    nodes = grid_nodes(points, box, shape)
    norm = (2.0 * 3.141592653589793) ** (-dim / 2.0)
    n = points.count()
    sums = _kde_grid_sums(points, grid_axes(box, shape), h)
    rho = nodes.join(sums, ["gx", "gy", "gz"], "left").withColumn("rho", F.coalesce("s", F.lit(0.0)) * F.lit(norm / max(n, 1))).drop("s")
    if normalize:
        rho = _as_multiple(rho, box, shape, dim)
    return rho.select("gx", "gy", "gz", *AXES, "rho")


def _as_multiple(rho: DataFrame, box: Box, shape, dim: int) -> DataFrame:
    cell = area = 1.0
    for w, n in list(zip(box.width, shape))[:dim]:
        cell *= w / max(n - 1, 1)
        area *= w
    total = rho.agg((F.sum("rho") * F.lit(cell)).alias("s")).scalar()
    return rho.withColumn("_s", total).withColumn(
        "rho", F.when(F.col("_s") > 0, F.col("rho") * F.lit(max(area, 1e-12)) / F.col("_s")).otherwise(F.col("rho"))
    ).drop("_s")


def fixed_smoothing(points: DataFrame, dim: int = 3) -> DataFrame:
    """One row (h): clip(2 * mean extent / n^(1/d), 0.01, 0.1 * mean extent)."""
    extent = sum(((F.max(a) - F.min(a)) for a in AXES[:dim]), F.lit(0.0)) / dim
    row = points.agg(extent.alias("_e"), F.count(F.lit(1)).cast("double").alias("_n"))
    h = F.least(F.greatest(F.lit(2.0) * F.col("_e") / F.pow("_n", F.lit(1.0 / dim)), F.lit(0.01)), F.lit(0.1) * F.col("_e"))
    return row.select(h.alias("h"))


def fixed_h(points: DataFrame, dim: int = 3) -> float:
    return fixed_smoothing(points, dim).first()["h"] or 0.01


def adaptive_h(points: DataFrame, neighbours: int = 32, hot: int | None = HOT_ROWS) -> DataFrame:
    """(id, h): 1.2 x the distance to the k-th other point."""
    k = max(1, min(neighbours, points.count() - 1))
    kth = knn(points, points, k + 1, hot).filter(F.col("rank") == k + 1)
    return kth.select(F.col("q_id").alias("id"), (F.lit(1.2) * F.col("d")).alias("h"))


# Reach of each estimator kernel in units of h.
REACH = {"cubic_spline": 2.0, "wendland": 1.0, "gaussian": 2.0}


def sph_at(
    points: DataFrame, queries: DataFrame, kernel: str = "cubic_spline", dim: int = 3, gaussian_reach: float = 2.0,
    hot: int | None = HOT_ROWS, dense: float = DENSE,
) -> DataFrame:
    """(id, rho): sum of mass * W(distance, h) over sources points(id, x, y, z, mass, h); 0 where nothing reaches.

    Each source is a ball of its own h. Sources with equal position and h are merged, queries with equal
    position are answered once, so the pair sum sees distinct places only.
    """
    src = cut_lineage(sites(points, F.col("h")))
    asked = cut_lineage(_finite(queries).select(*AXES).distinct())
    reach = gaussian_reach if kernel == "gaussian" else REACH[kernel]
    top = src.agg(F.max("h")).first()[0]
    rho = _kernel_sums(src, asked, kernel, dim, reach, _frame_of_reach((top or 1.0) * reach), hot, dense)
    named = rho.withColumnRenamed("s", "rho").withColumnsRenamed({a: f"_{a}" for a in AXES})
    cond = [queries[a] == named[f"_{a}"] for a in AXES]
    return queries.join(named, cond, "left").select(queries["id"], F.coalesce("rho", F.lit(0.0)).alias("rho"))


def sph_normalised(rho: DataFrame, n_points: int, queries: DataFrame, dim: int = 3) -> DataFrame:
    """Divide by n / extent of the queries: multiples of the mean density."""
    box = Box.around(queries)
    extent = 1.0
    for w in (box.width if box else (1.0,) * 3)[:dim]:
        extent *= w
    return rho.withColumn("rho", F.col("rho") / F.lit(n_points / max(extent, 1e-12)))


def yz_slice_density(
    points: DataFrame, x0: float | None = None, resolution: int = 50, low: float = 0.0, high: float = 95.0, at_least: int = 0
) -> DataFrame:
    """(gx, gy, x, y, rho): density of the points near x0 on a grid over the y-z range of all points.

    x0 defaults to 0.7 of the largest x, near means within 5 % of the width; fewer than ``at_least`` near points give no rows.
    Here x, y of the output are the points' y and z.
    """
    box = Box.around(points)
    at = 0.7 * box.hi[0] if x0 is None else x0
    near = points.filter(F.abs(F.col("x") - F.lit(at)) < F.lit(0.05 * box.width[0]))
    flat = as_plane(near, "yz")
    n, h = flat.count(), None
    plane = Box((box.lo[1], box.lo[2], 0.0), (box.hi[1], box.hi[2], 0.0))
    h = scott_bandwidth(flat, ("x", "y")) if n > 1 else 1.0
    grid = kde_grid(flat, h, (resolution, resolution, 1), 2, plane, normalize=False)
    if n < at_least:
        return grid.limit(0).select("gx", "gy", "x", "y", "rho")
    return percentile_clip(grid, "rho", low, high).select("gx", "gy", "x", "y", "rho")


def density_report(points: DataFrame, z: float = 0.0, resolution: int = 50, h: float | None = None, kernel: str = "cubic_spline") -> DataFrame:
    """(source, n, mean, min, max): kernel density on an x-y grid at height z, and normalised particle density at the points."""
    box = Box.around(points)
    plane = Box((box.lo[0], box.lo[1], z), (box.hi[0], box.hi[1], z))
    kde = kde_grid(points, scott_bandwidth(points), (resolution, resolution, 1), 3, plane, normalize=False)
    own = fixed_h(points) if h is None else h
    sph = sph_at(points.withColumns({"mass": F.lit(1.0), "h": F.lit(own)}), points, kernel)
    sph = sph_normalised(sph, points.count(), points)
    stats = [F.count(F.lit(1)).alias("n"), F.avg("rho").alias("mean"), F.min("rho").alias("min"), F.max("rho").alias("max")]
    one = kde.agg(*stats).withColumn("source", F.lit("kde"))
    return one.unionByName(sph.agg(*stats).withColumn("source", F.lit("sph")))
