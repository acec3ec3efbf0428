"""Moving points through a field: one step as joins, many steps in the plan that fits the field.

Plans of ``advect``, same result:
  analytic  closed-form field: steps run inside one projection, no join and no shuffle
  arrays    NumPy field: each task walks its own points, no shuffle
  broadcast table field below a checked size: each task walks its own points over a broadcast copy
  joins     any field: every step samples by joins and is written to the shared folder before the next
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from driftfield.functions.analytic import Field
from driftfield.functions.arrays import array_function, evaluate
from driftfield.functions.vector import distance
from driftfield.model import AXES, GridMeta
from driftfield.operators import sample as smp
from driftfield.operators.cells import SiteIndex, nearest_again, nearest_sites, site_index
from driftfield.operators.rules import PerAxis, _fold
from driftfield.session import cut_lineage, drop_path, scratch_path

UVW = smp.UVW
BROADCAST_BYTES = 64 * 1024 * 1024
CHUNK = 24  # steps kept in one array before the next array starts
STAGE = 960  # steps of a closed-form field between two written tables: no row holds more states
METHODS = ("euler", "rk2", "rk4")


# ---------------------------------------------------------------------------------------------------
# fields


@dataclass(frozen=True)
class AnalyticField:
    """Velocity as Column expressions of x, y, z, t."""

    fn: Field

    def sample(self, df: DataFrame) -> DataFrame:
        u, v, w = self.fn(F.col("x"), F.col("y"), F.col("z"), F.col("t"))
        return df.withColumns({"u": u, "v": v, "w": w})


@dataclass(frozen=True)
class ArrayField:
    """Velocity by a NumPy function of declared columns: ``fn(*arrays)`` gives the arrays u, v, w of an Arrow batch.

    Inputs may be x, y, z, t and further columns of the points, which ``displace`` and ``advect`` hand on. Points without coordinates (or with
    another input that is NULL) have no velocity.
    """

    fn: Callable
    inputs: tuple[str, ...] = (*AXES, "t")

    @property
    def extra(self) -> list[str]:
        return [c for c in self.inputs if c not in (*AXES, "t")]

    def sample(self, df: DataFrame) -> DataFrame:
        own = [c for c in df.columns if c not in UVW]
        got = df.withColumn("_velocity", array_function(self.fn, len(self.inputs), UVW)(*self.inputs))
        return got.select(*own, *[F.col(f"_velocity.{c}").alias(c) for c in UVW])


@dataclass(frozen=True)
class GridField:
    """Steady field on a regular grid."""

    grid: DataFrame
    meta: GridMeta
    outside: str = "clamp"
    corners: DataFrame | None = None

    def sample(self, df: DataFrame) -> DataFrame:
        corners = self.corners
        if corners is None:
            corners = smp.cell_corners(self.grid, self.meta, self.outside == "periodic")
        return smp.sample_corners(df, corners, self.meta, self.outside)


@dataclass(frozen=True)
class GridSeriesField:
    """Time-dependent field on a regular grid: series(t_idx, i, j, k, u, v, w) and times(t_idx, t)."""

    series: DataFrame
    times: DataFrame | smp.TimeIndex
    meta: GridMeta
    outside: str = "clamp"
    outside_time: str = "constant"
    corners: DataFrame | None = None

    def sample(self, df: DataFrame) -> DataFrame:
        return smp.sample_grid_series(df, self.series, self.times, self.meta, self.outside, self.outside_time, self.corners)


NEAR = "_near"  # position of a node near the point, carried from one search to the next
NEAR_TYPE = "struct<x: double, y: double, z: double>"


@dataclass(frozen=True)
class NodeField:
    """Steady field on scattered nodes, nearest-node lookup (lowest id on ties).

    With an index (see ``_prepared``) the nodes' values lie beside their positions, and points that carry a node near them are looked up
    with that node's distance as the bound.
    """

    nodes: DataFrame
    values: DataFrame
    index: SiteIndex | None = None

    def sample(self, df: DataFrame) -> DataFrame:
        if self.index is None or NEAR not in df.columns:
            return smp.nearest_node_sample(df, self.nodes, self.values).drop("node_id")
        own = [c for c in df.columns if c not in (*UVW, NEAR)]
        if not self.index.few:
            df = cut_lineage(df)  # the search counts before it joins
        found = nearest_again(df.select("id", *AXES, F.col(NEAR).alias("near")), self.index, UVW).withColumnRenamed("q_id", "id")
        return df.select(*own).join(found, "id", "left").select(*own, *UVW, F.col("near").alias(NEAR))


@dataclass(frozen=True)
class NodeSeriesField:
    """Time-dependent field on scattered nodes: series(t_idx, node_id, u, v, w) and times(t_idx, t).

    The nearest node (lowest id on ties) in space, linear in time. A value that is missing at a snapshot counts as 0.
    """

    nodes: DataFrame
    series: DataFrame
    times: DataFrame | smp.TimeIndex
    outside_time: str = "constant"
    index: SiteIndex | None = None

    def sample(self, df: DataFrame) -> DataFrame:
        if self.index is None or NEAR not in df.columns:
            near = smp.knn(df.select("id", *AXES), self.nodes.select(F.col("node_id").alias("id"), *AXES), 1)
            weights = near.select(F.col("q_id").alias("id"), F.col("p_id").alias("node_id"), F.lit(1.0).alias("weight"))
            return _sampled_in_time(df, weights, self.series, self.times, self.outside_time)
        own = [c for c in df.columns if c not in (*UVW, NEAR)]
        df = cut_lineage(df)  # read by the search and by the join with its result
        found = cut_lineage(nearest_again(df.select("id", *AXES, F.col(NEAR).alias("near")), self.index))
        weights = found.select(F.col("q_id").alias("id"), F.col("p_id").alias("node_id"), F.lit(1.0).alias("weight"))
        got = _sampled_in_time(df.select(*own), weights, self.series, self.times, self.outside_time)
        return got.join(found.select(F.col("q_id").alias("id"), F.col("near").alias(NEAR)), "id", "left")


@dataclass(frozen=True)
class MeshSeriesField:
    """Time-dependent field on a finite-element mesh: shape functions of the containing element, linear in time.

    ``fallback`` outside the mesh as in ``fem_sample``: nearest_node, nearest_element_node or zero.
    """

    elements: DataFrame
    nodes: DataFrame
    series: DataFrame
    times: DataFrame | smp.TimeIndex
    kind: str = "tet4"
    fallback: str = "nearest_node"
    outside_time: str = "constant"
    index: smp.MeshIndex | None = None

    def sample(self, df: DataFrame) -> DataFrame:
        index = self.index or smp.mesh_index(self.elements, self.nodes, self.kind)
        weights = smp.mesh_weights(df.select("id", *AXES), index, self.fallback)
        return _sampled_in_time(df, weights, self.series, self.times, self.outside_time)


def _sampled_in_time(df: DataFrame, weights: DataFrame, series: DataFrame, times: DataFrame | smp.TimeIndex, outside_time: str) -> DataFrame:
    """``df(id, x, y, z, t, ...)`` with u, v, w: for every weights(id, node_id, weight) row two snapshots of the node, summed per point.

    Points without coordinates have no value. A point without weights has velocity 0.
    """
    bracket = smp.time_bracket(df.select("id", "t"), times, outside_time)
    pairs = smp._weight_rows(bracket).withColumnRenamed("weight", "_share")
    rows = weights.join(pairs, "id").join(series.select("t_idx", "node_id", *UVW), ["t_idx", "node_id"], "left")
    # a snapshot with share 0 takes no part, whatever it holds
    part = lambda c: F.when(F.col("_share") == 0, 0.0).otherwise(F.col("weight") * F.col("_share") * F.coalesce(c, F.lit(0.0)))
    blank = F.max(F.col("_share").isNull())  # outside_time = nan
    sums = rows.groupBy("id").agg(*[F.when(~blank, F.sum(part(c))).alias(c) for c in UVW], F.lit(True).alias("_found"))
    there = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()
    value = lambda c: F.when(there, F.when(F.col("_found"), F.col(c)).otherwise(0.0))
    own = [c for c in df.columns if c not in UVW]
    return df.select(*own).join(sums, "id", "left").select(*own, *[value(c).alias(c) for c in UVW])


@dataclass(frozen=True)
class MeshField:
    """Steady field on a finite-element mesh."""

    elements: DataFrame
    nodes: DataFrame
    values: DataFrame
    kind: str = "tet4"
    fallback: str = "nearest_node"
    index: smp.MeshIndex | None = None

    def sample(self, df: DataFrame) -> DataFrame:
        index = self.index or smp.mesh_index(self.elements, self.nodes, self.kind)
        weights = smp.mesh_weights(df.select("id", *AXES), index, self.fallback)
        got = smp.weighted_values(weights, self.values)
        there = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()
        own = [c for c in df.columns if c not in UVW]
        return df.select(*own).join(got, "id", "left").select(*own, *[F.when(there, F.coalesce(c, F.lit(0.0))).alias(c) for c in UVW])


def with_velocity(points: DataFrame, field, t: Column | float | None = None) -> DataFrame:
    """Field value at every row: of its own column t, or at one given time."""
    df = points if t is None else points.withColumn("t", t if isinstance(t, Column) else F.lit(float(t)))
    return field.sample(df)


# ---------------------------------------------------------------------------------------------------
# one step

# Fixed values per method: stage offsets (share of dt) and weights of the stage velocities.
STAGES = {
    "euler": ((0.0,), (1.0,)),
    "rk2": ((0.0, 0.5), (0.0, 1.0)),
    "rk4": ((0.0, 0.5, 0.5, 1.0), (1 / 6, 1 / 3, 1 / 3, 1 / 6)),
}


def displace(points: DataFrame, field, dt: float | str, method: str = "rk4", t: float = 0.0) -> DataFrame:
    """x, y, z after one step from time t.

    ``dt`` is a number, or the name of a column with each point's own step; then stage times use the
    mean step, because all points of a stage share one field time.
    """
    offsets, weights = _stages(method)
    if len(offsets) > 1:
        field = _prepared(field)
    own = F.col(dt) if isinstance(dt, str) else F.lit(float(dt))
    keep = [c for c in points.columns if c not in (*AXES, "t")]
    df = points.withColumns({f"_{a}0": F.col(a) for a in AXES})
    if isinstance(dt, str):
        df = df.withColumn("_mean_dt", points.agg(F.avg(dt)).scalar())
        clock = F.col("_mean_dt")
    else:
        clock = F.lit(float(dt))
    for n, c in enumerate(offsets):
        at = {a: F.col(f"_{a}0") if n == 0 else F.col(f"_{a}0") + F.lit(c) * own * F.col(f"_k{n - 1}{q}") for a, q in zip(AXES, UVW)}
        df = field.sample(df.withColumns({**at, "t": F.lit(float(t)) + F.lit(c) * clock}))
        df = df.withColumnsRenamed({q: f"_k{n}{q}" for q in UVW})
    new = {}
    for a, q in zip(AXES, UVW):
        slope = sum((F.lit(w) * F.col(f"_k{n}{q}") for n, w in enumerate(weights) if w), F.lit(0.0))
        new[a] = F.col(f"_{a}0") + own * slope
    return df.select(*keep, *[v.alias(a) for a, v in new.items()])


def _checked(field):
    """A grid field without rows outside its shape or NULL values. Raises ValueError if a node occurs twice."""
    if not isinstance(field, (GridField, GridSeriesField)) or field.corners is not None:
        return field
    series = isinstance(field, GridSeriesField)
    rows, keys = (field.series, ["t_idx", *"ijk"]) if series else (field.grid, [*"ijk"])
    inside = reduce(lambda a, b: a & b, [F.col(c).between(0, n - 1) for c, n in zip("ijk", field.meta.shape)])
    rows = rows.filter(inside).withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in UVW})
    if series:
        rows = rows.join(smp.time_index(field.times).times.select("t_idx"), "t_idx", "left_semi")
    if not rows.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ValueError("a node occurs twice in the field")
    return replace(field, series=rows) if series else replace(field, grid=rows)


def _prepared(field, many: bool = False):
    """A field with what it looks up written once, so the stages of a step do not each derive it again.

    Corner tables, element cells and the times of snapshots; for ``many`` steps also the cells of nodes, for searches from one node to the next.
    """
    if isinstance(field, GridField) and field.corners is None:
        return replace(field, corners=cut_lineage(smp.cell_corners(field.grid, field.meta, field.outside == "periodic")))
    if getattr(field, "times", None) is not None and not isinstance(field.times, smp.TimeIndex):
        field = replace(field, times=smp.time_index(field.times))
    if isinstance(field, GridSeriesField) and field.corners is None:
        return replace(field, corners=cut_lineage(smp.cell_corners(field.series, field.meta, field.outside == "periodic", ("t_idx",))))
    if isinstance(field, (MeshField, MeshSeriesField)) and field.index is None:
        # values are joined at every stage
        held = {"values": cut_lineage(field.values)} if isinstance(field, MeshField) else {"series": cut_lineage(field.series)}
        return replace(field, **held, index=smp.mesh_index(field.elements, field.nodes, field.kind, with_sites=field.fallback == "nearest_node"))
    if many and isinstance(field, (NodeField, NodeSeriesField)) and field.index is None:
        values = field.values.select(F.col("node_id").alias("id"), *[F.col(c).cast("double").alias(c) for c in UVW]) if isinstance(field, NodeField) else None
        held = {} if isinstance(field, NodeField) else {"series": cut_lineage(field.series)}
        return replace(field, **held, index=site_index(field.nodes.select(F.col("node_id").alias("id"), *AXES), values=values))
    return field


def _stages(method: str):
    if method not in STAGES:
        raise ValueError(f"method must be one of {METHODS}")
    return STAGES[method]


# ---------------------------------------------------------------------------------------------------
# many steps


def advect(
    points: DataFrame, field, dt: float, n_steps: int, method: str = "rk4", rule=None, t0: float = 0.0,
    record_every: int = 1, plan: str | None = None, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Trajectory rows (particle_id, t_idx, t, x, y, z) of ``n_steps`` steps; the start is step 0.

    The rule acts after every step. Steps that are not recorded have no rows. Without ``plan`` the
    field decides: closed form, small enough to broadcast (its shape bounds it), or joins.

    On grids every plan counts a missing node or NULL value as 0, ignores rows outside the shape and refuses a node that occurs twice.
    """
    _stages(method)
    field = _checked(field)
    simple_rule = rule is None or isinstance(rule, PerAxis)
    if plan is None:
        if isinstance(field, AnalyticField) and simple_rule:
            plan = "analytic"
        elif isinstance(field, ArrayField) and simple_rule:
            plan = "arrays"
        elif simple_rule and isinstance(field, (GridField, GridSeriesField)) and _field_bytes(field) <= broadcast_bytes:
            plan = "broadcast"
        else:
            plan = "joins"
    extra = field.extra if isinstance(field, ArrayField) else []
    start = points.select(F.col("id").cast("bigint").alias("particle_id"), *[F.col(a).cast("double").alias(a) for a in AXES], *[F.col(c).cast("double").alias(c) for c in extra])
    if plan == "analytic":
        return _advect_analytic(start, field, dt, n_steps, method, rule, t0, record_every)
    if plan == "arrays":
        return _advect_arrays(start, field, dt, n_steps, method, rule, t0, record_every)
    if plan == "broadcast":
        if _field_bytes(field) > broadcast_bytes:
            raise ValueError("field is larger than broadcast_bytes: use the joins plan")
        return _advect_broadcast(start, field, dt, n_steps, method, rule, t0, record_every)
    if plan == "joins":
        return _advect_joins(start, field, dt, n_steps, method, rule, t0, record_every)
    raise ValueError("plan must be analytic, arrays, broadcast or joins")


def _let(value: Column, body) -> Column:
    """Evaluate a struct once and use it many times inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _point(x, y, z) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))


def _ruled(p: Column, rule: PerAxis | None) -> Column:
    if rule is None:
        return p
    gone = F.lit(False)
    new = []
    for (a, lo, hi), kind in zip(rule.box.axes(), rule.kinds):
        if kind == "absorb":
            gone = gone | (p[a] < lo) | (p[a] > hi)
        new.append(_fold(p[a], lo, hi, kind))
    return F.when(~gone, _point(*new)).otherwise(_point(*[F.lit(None)] * 3))


def _analytic_step(p: Column, t: Column, fn: Field, dt: float, method: str, rule) -> Column:
    offsets, weights = STAGES[method]

    def stage(n: int, sums: Column | None, k: Column | None) -> Column:
        c = F.lit(offsets[n] * dt)
        xyz = [p[a] if k is None else p[a] + c * k[a] for a in AXES]
        vel = _point(*fn(*xyz, t + c))

        def body(v: Column) -> Column:
            add = [F.lit(weights[n]) * v[a] + (sums[a] if sums is not None else F.lit(0.0)) for a in AXES]
            if n + 1 == len(offsets):
                moved = _point(*[p[a] + F.lit(dt) * s for a, s in zip(AXES, add)])
                return _let(moved, lambda q: _ruled(q, rule))
            return _let(_point(*add), lambda s: stage(n + 1, s, v))

        return _let(vel, body)

    return stage(0, None, None)


def _advect_analytic(start, field, dt, n_steps, method, rule, t0, record_every) -> DataFrame:
    """Arrays of CHUNK states each: an array grows by copying, so one array for all steps would be quadratic.

    Of each array only the recorded steps stay, and every STAGE steps the table is written.
    """
    df = start.select("particle_id", _point(*[F.col(a) for a in AXES]).alias("_last"))
    rows = [df.select("particle_id", F.lit(0).cast("bigint").alias("t_idx"), *[F.col(f"_last.{a}").alias(a) for a in AXES])]

    def grow(acc: Column, n: Column) -> Column:
        t = F.lit(float(t0)) + n.cast("double") * F.lit(float(dt))
        return F.concat(acc, F.array(_let(F.element_at(acc, -1), lambda p: _analytic_step(p, t, field.fn, dt, method, rule))))

    for begin in range(0, n_steps, STAGE):
        kept = []
        end = min(begin + STAGE, n_steps)
        for first in range(begin, end, CHUNK):
            count = min(CHUNK, end - first)
            name = f"_s{len(kept)}"
            df = df.withColumn(name, F.slice(F.aggregate(F.sequence(F.lit(first), F.lit(first + count - 1)), F.array("_last"), grow), 2, count))
            df = df.withColumn("_last", F.element_at(name, -1))
            stepped = F.col(name)
            if record_every > 1:
                stepped = F.transform(stepped, lambda p, i: F.struct((i + (first + 1)).cast("bigint").alias("t_idx"), p.alias("p")))
                stepped = F.filter(stepped, lambda s: (s["t_idx"] % record_every == 0) | (s["t_idx"] == n_steps))
            kept.append(stepped)
        df = df.select("particle_id", F.concat(*kept).alias("_states"), "_last")
        if n_steps > STAGE:
            df = cut_lineage(df)
        if record_every > 1:
            states = df.select("particle_id", F.explode("_states").alias("s")).select("particle_id", "s.t_idx", "s.p")
        else:
            states = df.select("particle_id", F.posexplode("_states").alias("n", "p")).select("particle_id", (F.col("n") + (begin + 1)).cast("bigint").alias("t_idx"), "p")
        rows.append(states.select("particle_id", "t_idx", *[F.col(f"p.{a}").alias(a) for a in AXES]))
        df = df.select("particle_id", "_last")
    return _finish(reduce(DataFrame.union, rows), dt, t0, record_every, n_steps)


def _finish(df: DataFrame, dt: float, t0: float, record_every: int, n_steps: int) -> DataFrame:
    if record_every > 1:
        df = df.filter((F.col("t_idx") % record_every == 0) | (F.col("t_idx") == n_steps))
    t = F.lit(float(t0)) + F.col("t_idx").cast("double") * F.lit(float(dt))
    return df.select("particle_id", F.col("t_idx").cast("bigint").alias("t_idx"), t.alias("t"), *AXES)


def _field_bytes(field) -> int:
    """Size of the dense array the field becomes: known from its shape and the number of snapshots."""
    nx, ny, nz = field.meta.shape
    snapshots = smp.time_index(field.times).n if isinstance(field, GridSeriesField) else 1
    return nx * ny * nz * 3 * 8 * max(snapshots, 1)


def _field_arrays(field):
    """(times, values[T, nx, ny, nz, 3]); only for checked fields below the broadcast bound: a row per node of the shape at most."""
    import numpy as np

    if isinstance(field, GridField):
        rows, stamps = field.grid.select(F.lit(0).alias("t_idx"), *"ijk", *UVW).toPandas(), None
        index = {0: 0}
    else:
        times = smp.time_index(field.times).times.orderBy("t", "t_idx").toPandas()
        stamps = times["t"].to_numpy(dtype=float)
        index = {v: n for n, v in enumerate(times["t_idx"])}
        rows = field.series.select("t_idx", *"ijk", *UVW).toPandas()
    values = np.zeros((len(index), *field.meta.shape, 3))
    at = tuple([rows["t_idx"].map(index).to_numpy()] + [rows[c].to_numpy() for c in "ijk"])
    values[at] = rows[list(UVW)].to_numpy(dtype=float)
    return stamps, values


def _grid_velocity(p, t, stamps, values, meta: GridMeta, outside: str, outside_time: str):
    """Field at points p[n, 3] and time t: weights of two snapshots and eight corners."""
    import numpy as np

    if stamps is None:  # a steady field
        stamps = np.array([t])
    last = len(stamps) - 1
    left = int(np.clip(np.searchsorted(stamps, t, side="right") - 1, 0, max(last - 1, 0)))
    gap = stamps[left + 1] - stamps[left] if last else 1.0
    alpha = (t - stamps[left]) / max(gap, 1e-12) if last else 0.0
    if outside_time != "linear":
        alpha = min(max(alpha, 0.0), 1.0)
    beyond = t < stamps[0] or t > stamps[-1]
    if beyond and outside_time in ("zero", "nan"):
        return np.full(p.shape, 0.0 if outside_time == "zero" else np.nan)
    shape = np.array(meta.shape)
    g = (p - np.array(meta.origin)) / np.array(meta.spacing)
    lost = np.isnan(g).any(axis=1)
    g[lost] = 0.0
    if outside == "periodic":
        g = np.mod(g, shape)
        base = np.minimum(np.floor(g), shape - 1).astype(int)
        top = (base + 1) % shape
    else:
        held = np.clip(g, 0, shape - 1)
        out_of_box = (held != g).any(axis=1)
        g = held
        base = np.minimum(np.floor(g), np.maximum(shape - 2, 0)).astype(int)
        top = np.minimum(base + 1, shape - 1)
    f = g - base
    vel = np.zeros(p.shape)
    snaps = [(left, 1.0 - alpha), (left + 1, alpha)] if last else [(0, 1.0)]
    for n in range(8):
        bits = np.array([n >> 2 & 1, n >> 1 & 1, n & 1])
        at = np.where(bits, top, base)
        w = np.where(bits, f, 1.0 - f).prod(axis=1)
        for s, share in snaps:
            if share:
                vel += (share * w)[:, None] * values[s, at[:, 0], at[:, 1], at[:, 2]]
    if outside in ("zero", "nan"):
        vel[out_of_box] = 0.0 if outside == "zero" else np.nan
    vel[lost] = np.nan
    return vel


def _fold_array(p, rule: PerAxis | None):
    import numpy as np

    if rule is None:
        return p
    gone = np.zeros(len(p), dtype=bool)
    for n, ((_, lo, hi), kind) in enumerate(zip(rule.box.axes(), rule.kinds)):
        c, w = p[:, n], hi - lo
        if kind == "absorb":
            gone |= (c < lo) | (c > hi)
        elif kind == "clamp" or (w == 0 and kind != "none"):
            p[:, n] = np.clip(c, lo, hi)
        elif kind == "periodic":
            p[:, n] = lo + np.mod(c - lo, w)
        elif kind == "reflect":
            saw = np.mod(c - lo, 2 * w)
            p[:, n] = lo + np.where(saw > w, 2 * w - saw, saw)
    p[gone] = np.nan
    return p


def _dealt_out(start: DataFrame) -> DataFrame:
    """Points of fewer files than cores, dealt out: a small file is one task, however many steps its points take."""
    cores = start.sparkSession.sparkContext.defaultParallelism
    return start.repartition(4 * cores, "particle_id") if 0 < len(start.inputFiles()) < cores else start


def _walk(start: DataFrame, velocity: Callable, extra: list[str], dt, n_steps, method, rule, t0, record_every) -> DataFrame:
    """Every task walks its own points: ``velocity()`` makes, once per task, a function of (points[n, 3], time, extra columns) to [n, 3]."""
    offsets, weights = STAGES[method]
    start = _dealt_out(start)

    def walk(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        at = velocity()

        def frame(ids, p, n):
            return pd.DataFrame({"particle_id": ids, "t_idx": np.int64(n), **{a: p[:, i] for i, a in enumerate(AXES)}})

        for batch in batches:
            ids = batch["particle_id"].to_numpy()
            p = batch[list(AXES)].to_numpy(dtype=float).copy()
            more = [batch[c].to_numpy(dtype=float) for c in extra]
            yield frame(ids, p, 0)
            for n in range(n_steps):
                t, move, k = t0 + n * dt, 0.0, 0.0
                for c, w in zip(offsets, weights):
                    k = at(p + c * dt * k, t + c * dt, more)
                    move = move + w * k
                p = _fold_array(p + dt * move, rule)
                if (n + 1) % record_every == 0 or n + 1 == n_steps:
                    yield frame(ids, p, n + 1)

    rows = start.mapInPandas(walk, "particle_id bigint, t_idx bigint, x double, y double, z double")
    rows = rows.withColumns({a: F.when(~F.isnan(a), F.col(a)) for a in AXES})
    return _finish(rows, dt, t0, record_every, n_steps)


def _advect_broadcast(start, field, dt, n_steps, method, rule, t0, record_every) -> DataFrame:
    shared = start.sparkSession.sparkContext.broadcast(_field_arrays(field))
    meta, outside = field.meta, field.outside
    outside_time = getattr(field, "outside_time", "constant")

    def velocity() -> Callable:
        stamps, values = shared.value
        return lambda p, t, _: _grid_velocity(p, t, stamps, values, meta, outside, outside_time)

    return _walk(start, velocity, [], dt, n_steps, method, rule, t0, record_every)


def _advect_arrays(start, field: ArrayField, dt, n_steps, method, rule, t0, record_every) -> DataFrame:
    fn, inputs, extra = field.fn, field.inputs, field.extra

    def velocity() -> Callable:
        import numpy as np

        def at(p, t, more):
            known = {**{a: p[:, i] for i, a in enumerate(AXES)}, "t": np.full(len(p), float(t)), **dict(zip(extra, more))}
            arrays = [known[c] for c in inputs]
            got = np.stack(evaluate(fn, arrays, 3, "field"), axis=1)
            # what has no coordinates, or lacks another input, does not move
            got[np.isnan(np.stack(arrays, axis=1)).any(axis=1) | np.isnan(p).any(axis=1)] = np.nan
            return got

        return at

    return _walk(start, velocity, extra, dt, n_steps, method, rule, t0, record_every)


def _advect_joins(start, field, dt, n_steps, method, rule, t0, record_every) -> DataFrame:
    """Every step is written before the next one reads it: a lost executor costs one step, and plans stay short.

    Steps that are not recorded are deleted once the next one is written.
    """
    spark = start.sparkSession
    folder = scratch_path(spark, "advect")
    field = _prepared(field, many=True)
    index = field.index if isinstance(field, (NodeField, NodeSeriesField)) else None
    extra = [c for c in start.columns if c not in ("particle_id", *AXES)]
    kept = "particle_id bigint, x double, y double, z double" + "".join(f", `{c}` double" for c in extra)
    if index is not None:
        extra, kept = [*extra, NEAR], f"{kept}, {NEAR} {NEAR_TYPE}"
        start = start.withColumn(NEAR, F.lit(None).cast(NEAR_TYPE))

    def stored(df: DataFrame, path: str) -> DataFrame:
        df.select("particle_id", *AXES, *extra).write.parquet(path)
        return spark.read.schema(kept).parquet(path)

    now, behind = None, None
    for n in range(n_steps + 1):
        if n == 0:
            moved = start
        else:
            df = now if index is None else _with_near_nodes(now, index)
            moved = displace(df.withColumnRenamed("particle_id", "id"), field, dt, method, t0 + (n - 1) * dt)
            if rule is not None:
                moved = rule(moved) if index is None else _ruled_near_nodes(moved, rule, index)
            moved = moved.withColumnRenamed("id", "particle_id")
        recorded = n % record_every == 0 or n == n_steps
        path = f"{folder}/steps/t_idx={n}" if recorded else f"{folder}/between/{n}"
        now = stored(moved, path)
        if behind is not None:
            drop_path(spark, behind)
        behind = None if recorded else path
    schema = "particle_id bigint, x double, y double, z double, t_idx bigint"
    return _finish(spark.read.schema(schema).parquet(f"{folder}/steps"), dt, t0, record_every, n_steps)


def _with_near_nodes(now: DataFrame, index: SiteIndex) -> DataFrame:
    """Points that have no node near them (at the start, or after a rule has moved them far) are given one."""
    lost = now.filter(f"{NEAR} IS NULL AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
    if lost.isEmpty():
        return now
    found = cut_lineage(nearest_sites(lost.select(F.col("particle_id").alias("id"), *AXES), index)).withColumnRenamed("q_id", "particle_id")
    return cut_lineage(now.join(found, "particle_id", "left").withColumn(NEAR, F.coalesce(NEAR, "near")).drop("near"))


def _ruled_near_nodes(moved: DataFrame, rule, index: SiteIndex) -> DataFrame:
    """Points after the rule. Where it has taken one far away from its node, the search from that node would be wide: it is dropped."""
    gap = distance(*[F.col(a) for a in AXES], *[F.col(f"{NEAR}.{a}") for a in AXES])
    cell = F.lit(index.frame.side / 2.0**index.depth)
    after = rule(moved.withColumn("_gap", gap))
    close = gap <= 4.0 * F.col("_gap") + 8.0 * cell
    return after.withColumn(NEAR, F.when(close, F.col(NEAR))).drop("_gap")


def compare_methods(finals: dict[str, DataFrame], base: str) -> DataFrame:
    """(method, mean, max, std) of the distance of final positions to those of the base method."""
    ref = finals[base].select("particle_id", *[F.col(a).alias(f"b{a}") for a in AXES])
    out = None
    for name, df in finals.items():
        if name == base:
            continue
        d = distance(F.col("x"), F.col("y"), F.col("z"), F.col("bx"), F.col("by"), F.col("bz"))
        row = df.select("particle_id", *AXES).join(ref, "particle_id").agg(
            F.avg(d).alias("mean"), F.max(d).alias("max"), F.stddev_pop(d).alias("std")
        ).select(F.lit(name).alias("method"), "mean", "max", "std")
        out = row if out is None else out.unionByName(row)
    return out


# ---------------------------------------------------------------------------------------------------
# building fields


def field_from_expression(nodes: DataFrame, stamps: list[float], fn: Field) -> DataFrame:
    """samples(t_idx, t, node_id, u, v, w) of a closed-form field on every node at every time."""
    pairs = F.posexplode(F.lit([float(t) for t in stamps])).alias("t_idx", "t")
    df = nodes.select("node_id", *AXES, pairs)
    u, v, w = fn(F.col("x"), F.col("y"), F.col("z"), F.col("t"))
    return df.select(F.col("t_idx").cast("bigint"), "t", "node_id", u.alias("u"), v.alias("v"), w.alias("w"))


def repeat_period(samples: DataFrame, times: DataFrame, n_periods: int = 5, time_slice=None, target: float | None = None) -> tuple[DataFrame, int, int]:
    """Tile the snapshots of a slice: (samples, snapshots per period, periods). Time starts at 0.

    The last time of a period is the first of the next one, so both snapshots exist at each joint.
    """
    import math

    from pyspark.sql import Window as W

    span = times if time_slice is None else times.filter(F.col("t").between(*map(float, time_slice)))
    count, lo, hi = span.agg(F.count(F.lit(1)), F.min("t").cast("double"), F.max("t").cast("double")).first()
    if count == 0:
        raise ValueError("the slice holds no snapshots")
    period = hi - lo
    if target is not None:
        if period <= 0:
            raise ValueError("a target duration needs a period longer than 0")
        n_periods = max(1, math.ceil(target / period))
    numbered = span.select("t_idx", F.col("t").cast("double").alias("_t"), (F.row_number().over(W.orderBy("t", "t_idx")) - 1).alias("_n"))
    tiled = numbered.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(n_periods - 1))))
    out = samples.drop("t").join(tiled, "t_idx").select(
        (F.col("_p") * count + F.col("_n")).cast("bigint").alias("t_idx"),
        (F.col("_t") - F.lit(lo) + F.col("_p") * F.lit(period)).alias("t"),
        "node_id", *UVW,
    )
    return out, int(count), int(n_periods)


def smooth_joints(samples: DataFrame, per_period: int, n_periods: int, share: float) -> DataFrame:
    """Blend the first K snapshots of every later period with their mirror images before the joint.

    Weight (i + 1) / K on the own value, K = share of the period. Joints are blended in the order of time: where K exceeds half a period,
    a mirror image can itself have been blended at the joint before. Written out, a snapshot is then a weighted sum of itself and of its
    mirror image, whose own weights are known, so each snapshot's weights come from a short list and one join applies them all.
    """
    k = max(1, round(share * per_period))
    if share <= 0 or n_periods < 2 or per_period < 2:
        return samples
    k = min(k, per_period - 1)
    weights: dict[int, dict[int, float]] = {}  # snapshot -> shares of original snapshots, for blended ones
    for joint in range(per_period, n_periods * per_period, per_period):
        for i in range(k):
            at, mirror, own = joint + i, joint - 1 - i, (i + 1) / k
            mixed = {at: own}
            for source, w in weights.get(mirror, {mirror: 1.0}).items():
                mixed[source] = mixed.get(source, 0.0) + (1 - own) * w
            weights[at] = {s: w for s, w in mixed.items() if w}
    spark = samples.sparkSession
    listed = spark.createDataFrame([(a, s, w) for a, shares in weights.items() for s, w in shares.items()], "_to bigint, t_idx bigint, _share double")
    # a snapshot whose mirror image is missing keeps its value
    parts = samples.select(F.col("t_idx"), "node_id", *[F.col(c).alias(f"_{c}") for c in UVW]).join(listed, "t_idx")
    sums = parts.groupBy(F.col("_to").alias("t_idx"), "node_id").agg(F.sum("_share").alias("_total"), *[F.sum(F.col("_share") * F.col(f"_{c}")).alias(f"_{c}") for c in UVW])
    new = {c: F.when(F.col("_total") > 1 - 1e-9, F.col(f"_{c}")).otherwise(F.col(c)) for c in UVW}
    return samples.join(sums, ["t_idx", "node_id"], "left").withColumns(new).select(*samples.columns)
