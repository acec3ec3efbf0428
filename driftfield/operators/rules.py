"""Boundary rules: what happens to points that left the domain.

A rule is a callable DataFrame -> DataFrame over x, y, z that keeps the row count. Absorbed points get NULL
coordinates and stay absorbed; ``status`` says what happened last (kept, moved, absorbed, re-entered).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from driftfield.functions.rand import keyed_normal, keyed_uniform
from driftfield.functions.vector import inside, is_finite, magnitude
from driftfield.model import AXES, Box

KINDS = ("periodic", "clamp", "reflect", "absorb", "none")


def _with_status(df: DataFrame, new: dict[str, Column], absorbed: Column | None = None, entered: Column | None = None) -> DataFrame:
    """Write new coordinates and the status that follows from them."""
    moved = F.lit(False)
    for a, c in new.items():
        moved = moved | (c != F.col(a))
    status = F.when(F.col("x").isNull(), F.lit("absorbed"))
    if absorbed is not None:
        status = status.when(absorbed, F.lit("absorbed"))
        new = {a: F.when(~absorbed, new.get(a, F.col(a))) for a in AXES}
    if entered is not None:
        status = status.when(entered, F.lit("re-entered"))
    status = status.when(moved, F.lit("moved")).otherwise(F.lit("kept"))
    return df.withColumns({**new, "status": status})


def _fold(c: Column, lo: float, hi: float, kind: str) -> Column:
    w = hi - lo
    if kind in ("none", "absorb"):
        return c
    if kind == "clamp" or w == 0.0:
        return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))
    if kind == "periodic":
        return F.lit(lo) + F.pmod(c - F.lit(lo), F.lit(w))
    saw = F.pmod(c - F.lit(lo), F.lit(2.0 * w))
    return F.lit(lo) + F.when(saw > w, F.lit(2.0 * w) - saw).otherwise(saw)


@dataclass(frozen=True)
class PerAxis:
    """One rule kind per axis. Leaving through an ``absorb`` axis absorbs the whole point."""

    box: Box
    kinds: tuple[str, str, str]

    def __post_init__(self) -> None:
        unknown = set(self.kinds) - set(KINDS)
        if unknown:
            raise ValueError(f"unknown rule kinds {unknown}; known: {KINDS}")

    def __call__(self, df: DataFrame) -> DataFrame:
        new = {a: _fold(F.col(a), lo, hi, k) for (a, lo, hi), k in zip(self.box.axes(), self.kinds)}
        out = None
        for (a, lo, hi), k in zip(self.box.axes(), self.kinds):
            if k == "absorb":
                gone = (F.col(a) < lo) | (F.col(a) > hi)
                out = gone if out is None else out | gone
        return _with_status(df, new, absorbed=None if out is None else F.coalesce(out, F.lit(False)))


def wrap_periodic(box: Box) -> PerAxis:
    return PerAxis(box, ("periodic",) * 3)


def clamp(box: Box) -> PerAxis:
    return PerAxis(box, ("clamp",) * 3)


def reflect(box: Box) -> PerAxis:
    return PerAxis(box, ("reflect",) * 3)


def absorb(box: Box) -> PerAxis:
    return PerAxis(box, ("absorb",) * 3)


def mixed(box: Box, kinds: dict[str, str]) -> PerAxis:
    """A kind per axis name; axes not named are periodic."""
    return PerAxis(box, tuple(kinds.get(a, "periodic") for a in AXES))


def by_distance(dist, near, far):
    """Rule ``near`` where the signed distance is <= 0, rule ``far`` elsewhere. ``dist`` maps (x, y, z) to a Column."""

    def rule(df: DataFrame) -> DataFrame:
        keep = [c for c in df.columns if c not in (*AXES, "status")]
        d = dist(F.col("x"), F.col("y"), F.col("z"))
        base = df.withColumns({"_d": d, **{f"_{a}": F.col(a) for a in AXES}})
        one = near(base)
        one = one.withColumns({f"_n{c}": F.col(c) for c in (*AXES, "status")})
        two = far(one.withColumns({a: F.col(f"_{a}") for a in AXES}))
        first = F.col("_d") <= 0
        return two.select(
            *keep, *[F.when(first, F.col(f"_n{c}")).otherwise(F.col(c)).alias(c) for c in (*AXES, "status")]
        )

    return rule


def sphere(center, radius: float, kind: str = "reflect"):
    """Points outside a sphere go to its surface (reflect, clamp) or are absorbed."""

    def rule(df: DataFrame) -> DataFrame:
        rel = {a: F.col(a) - F.lit(float(c)) for a, c in zip(AXES, center)}
        r = magnitude(*rel.values())
        out = r > F.lit(float(radius))
        if kind == "absorb":
            return _with_status(df, {}, absorbed=F.coalesce(out, F.lit(False)))
        new = {a: F.when(out, F.lit(float(c)) + F.lit(float(radius)) * rel[a] / r).otherwise(F.col(a)) for a, c in zip(AXES, center)}
        return _with_status(df, new)

    return rule


def cylinder(center, radius: float, axis: str = "z", height: float | None = None, kind: str = "reflect"):
    """Points outside a cylinder go to its surface (reflect, clamp) or are absorbed.

    ``height`` is centred on 0 along the axis; beyond it a point is put on the end face.
    """

    def rule(df: DataFrame) -> DataFrame:
        across = [a for a in AXES if a != axis]
        mid = dict(zip(AXES, map(float, center)))
        rel = {a: F.col(a) - F.lit(mid[a]) for a in across}
        r = magnitude(*rel.values())
        wide = r > F.lit(float(radius))
        tall = F.lit(False) if height is None else F.abs(F.col(axis)) > F.lit(height / 2.0)
        if kind == "absorb":
            return _with_status(df, {}, absorbed=F.coalesce(wide | tall, F.lit(False)))
        new = {a: F.when(wide, F.lit(mid[a]) + F.lit(float(radius)) * rel[a] / r).otherwise(F.col(a)) for a in across}
        if height is not None:
            new[axis] = F.least(F.greatest(F.col(axis), F.lit(-height / 2.0)), F.lit(height / 2.0))
        return _with_status(df, new)

    return rule


def _mirror_once(c: Column, lo: float, hi: float) -> Column:
    return F.when(c < lo, F.lit(2.0 * lo) - c).when(c > hi, F.lit(2.0 * hi) - c).otherwise(c)


def inlet_outlet(box: Box, axis: str = "x", inlet: str = "min", outlet: str = "max"):
    """Absorb past the outlet, put backflow past the inlet at the outlet, mirror the other axes once."""
    lo, hi = {a: (b, t) for a, b, t in box.axes()}[axis]
    end = lo if outlet == "min" else hi

    def rule(df: DataFrame) -> DataFrame:
        c = F.col(axis)
        gone = F.coalesce(c < end if outlet == "min" else c > end, F.lit(False))
        back = c < lo if inlet == "min" else c > hi
        new = {axis: F.when(back, F.lit(end)).otherwise(c)}
        new |= {a: _mirror_once(F.col(a), b, t) for a, b, t in box.axes() if a != axis}
        return _with_status(df, new, absorbed=gone)

    return rule


def snap_index(c: Column, lo: float, hi: float, res: int) -> Column:
    """Index of the nearest of ``res`` evenly spaced coordinates; a tie goes to the lower one."""
    if res <= 1 or hi == lo:
        return F.lit(0).cast("bigint")
    s = (c - F.lit(lo)) / F.lit((hi - lo) / (res - 1))
    return F.least(F.greatest(F.ceil(s - F.lit(0.5)), F.lit(0)), F.lit(res - 1)).cast("bigint")


def snap_coordinate(c: Column, lo: float, hi: float, res: int) -> Column:
    step = (hi - lo) / (res - 1) if res > 1 else 0.0
    return F.lit(lo) + snap_index(c, lo, hi, res).cast("double") * F.lit(step)


def _enter(a: str, lo: float, hi: float, how: str, seed, row_id: Column, res: int) -> Column:
    """Coordinate on the inlet face for a point that comes in again."""
    if how == "uniform":
        return F.lit(lo) + keyed_uniform(seed, row_id, a) * F.lit(hi - lo)
    if how == "gaussian":
        c = F.lit((lo + hi) / 2.0) + keyed_normal(seed, row_id, a) * F.lit((hi - lo) / 6.0)
        return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))
    if how == "grid":
        return snap_coordinate(F.col(a), lo, hi, res)
    raise ValueError("distribution must be uniform, gaussian or grid")


def _through(box: Box, axis: str, direction: str, how: str, counts: dict[str, int], seed, key: Column, backflow) -> object:
    lo, hi = {a: (b, t) for a, b, t in box.axes()}[axis]
    forward = direction == "positive"

    def rule(df: DataFrame) -> DataFrame:
        c = F.col(axis)
        gone = F.coalesce(c > hi if forward else c < lo, F.lit(False))
        back = c < lo if forward else c > hi
        new = {axis: F.when(gone, F.lit(lo if forward else hi)).when(back, backflow(c, lo, hi, forward)).otherwise(c)}
        for a, b, t in box.axes():
            if a != axis:
                fresh = _enter(a, b, t, how, seed, key, max(1, int(counts.get(a, 1))))
                new[a] = F.when(gone, fresh).otherwise(_mirror_once(F.col(a), b, t))
        return _with_status(df, new, entered=gone)

    return rule


def flow_through(box: Box, axis: str = "x", direction: str = "positive", seed=0, key: Column | None = None):
    """A point past the outlet comes in at a random place of the inlet face; backflow is mirrored.

    ``key`` must differ per row and step (default: id), because the place is a function of it.
    """
    mirror = lambda c, lo, hi, forward: F.lit(2.0 * (lo if forward else hi)) - c
    return _through(box, axis, direction, "uniform", {}, seed, F.col("id") if key is None else key, mirror)


def continuous_inlet(
    box: Box,
    axis: str = "x",
    direction: str = "positive",
    distribution: str = "uniform",
    counts: dict[str, int] | None = None,
    seed=0,
    key: Column | None = None,
):
    """As ``flow_through`` with a choice of inlet pattern; backflow is put 0.1 % of the width inside."""
    if distribution == "grid" and counts is None:
        raise ValueError("grid needs points per axis")
    inset = lambda c, lo, hi, forward: F.lit(lo + 0.001 * (hi - lo) if forward else hi - 0.001 * (hi - lo))
    return _through(box, axis, direction, distribution, counts or {}, seed, F.col("id") if key is None else key, inset)


def snap_to_inlet_grid(df: DataFrame, box: Box, axis: str, counts: dict[str, int], position: float) -> DataFrame:
    """Put every row on the inlet face, at the nearest grid coordinate of each other axis."""
    new = {axis: F.lit(float(position))}
    new |= {a: snap_coordinate(F.col(a), b, t, max(1, int(counts.get(a, 1)))) for a, b, t in box.axes() if a != axis}
    return df.withColumns(new)


def chain(*rules):
    """Rules one after another."""
    return lambda df: reduce(lambda d, r: d.transform(r), rules, df)


def violations(df: DataFrame, box: Box, tol: float = 1e-6) -> DataFrame:
    """One row: points outside (with tolerance), their share, and per axis the low and high counts and the range."""
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(~inside(box, tol)).alias("n_out")]
    for a, lo, hi in box.axes():
        aggs += [
            F.count_if(F.col(a) < lo - tol).alias(f"{a}_low"),
            F.count_if(F.col(a) > hi + tol).alias(f"{a}_high"),
            F.min(a).alias(f"{a}_min"),
            F.max(a).alias(f"{a}_max"),
        ]
    out = df.agg(*aggs)
    share = F.when(F.col("n") > 0, F.col("n_out") / F.col("n")).otherwise(F.lit(0.0))
    return out.withColumn("share_out", share)


def rule_audit(df: DataFrame) -> DataFrame:
    """One row: finite, missing (NULL or NaN) and infinite points, and points per status."""
    any_nan, any_inf, finite = F.lit(False), F.lit(False), F.lit(True)
    for a in AXES:
        any_nan = any_nan | F.col(a).isNull() | F.coalesce(F.isnan(a), F.lit(False))
        any_inf = any_inf | F.coalesce((F.abs(a) == F.lit(float("inf"))), F.lit(False))
        finite = finite & is_finite(F.col(a))
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.count_if(finite).alias("n_finite"),
        F.count_if(any_nan).alias("n_missing"),
        F.count_if(any_inf).alias("n_infinite"),
    ]
    if "status" in df.columns:
        aggs += [F.count_if(F.col("status") == s).alias(f"n_{s.replace('-', '_')}") for s in ("kept", "moved", "absorbed", "re-entered")]
    return df.agg(*aggs)
