"""Queries: NumPy functions as fields, densities and distances, beside the SQL of the same formula."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from driftfield.functions.arrays import ArrayFunction
from driftfield.operators import move, points as gen, rules
from driftfield.plans.fixtures import BOX
from driftfield.plans.q_points import _CORNER, _PDF, _dens, q
from driftfield.plans.q_rules import CLAMP, OUT, rule
from driftfield.plans.q_sample import EULER_ROTATION
from driftfield.plans.registry import query


def _rotation(x, y, z, t):
    return -y, x, np.zeros_like(z)


def _swirl(x, y, z, t, spin):
    """Rotation with each point's own spin, rising with time."""
    return -spin * y, spin * x, 0.1 * t + 0.0 * z


query("advect_array_field", EULER_ROTATION, "points", "t x y z", "particle_id t_idx")(
    lambda t: move.advect(t.points(), move.ArrayField(_rotation), 1 / 23.0, 30, "euler")
)

# the midpoint rule from t = 1 with step 0.3, spin = 0.01 * (id % 7); every 11th point has no spin and so no velocity
_SPIN = "CASE WHEN id % 11 > 0 THEN 0.01::DOUBLE*(id % 7) END"
_SWIRL = f"""SELECT id, x+0.3::DOUBLE*(-s*(y+0.15::DOUBLE*s*x)) x, y+0.3::DOUBLE*(s*(x-0.15::DOUBLE*s*y)) y, CASE WHEN s IS NOT NULL THEN z+0.3::DOUBLE*0.1::DOUBLE*1.15::DOUBLE END z
FROM (SELECT *, {_SPIN} s FROM points)"""


def _swirl_points(t):
    return t.points().drop("mass").withColumn("spin", F.when(F.col("id") % 11 > 0, 0.01 * (F.col("id") % 7)))


query("displace_array_field", _SWIRL, "points", "x y z", "id")(
    lambda t: move.displace(_swirl_points(t), move.ArrayField(_swirl, ("x", "y", "z", "t", "spin")), 0.3, "rk2", 1.0).drop("spin")
)
query(
    "with_velocity_array_field", "SELECT id, -0.01::DOUBLE*(id % 7)*y u, 0.01::DOUBLE*(id % 7)*x v, 0.25::DOUBLE w FROM points WHERE id % 11 > 0", "points", "u v w", "id"
)(lambda t: move.with_velocity(_swirl_points(t), move.ArrayField(_swirl, ("x", "y", "z", "t", "spin")), 2.5).filter("u IS NOT NULL").select("id", "u", "v", "w"))

_gauss = ArrayFunction(lambda x, y: np.exp(-((x - 4) ** 2 + (y - 5) ** 2) / 8), ("x", "y"))
q("density_sampled_array", _dens(_PDF, 40), lambda t: gen.density_sampled_points(t.spark, t.n_points(), t.box(), _gauss.with_pdf, 8), "box")
_corner = ArrayFunction(lambda x, y: np.where((x < 1.8) & (y < 2.0), 1.0, 0.0), ("x", "y"))
q("density_sampled_corner_array", _dens(_CORNER, 60), lambda t: gen.density_sampled_points(t.spark, t.n_points(), t.box(), _corner.with_pdf, 8), "box")

# a diamond, and the box away from it
_distance = ArrayFunction(lambda x, y, z: np.abs(x - 4) + np.abs(y - 5) + np.abs(z - 4) - 8.25)
_NEAR = "abs(x-4)+abs(y-5)+abs(z-4)-8.25::DOUBLE <= 0"
rule("by_distance_array", lambda t: rules.by_distance(_distance.at, rules.clamp(BOX), rules.absorb(BOX)),
     {a: f"CASE WHEN {_NEAR} THEN {CLAMP[a]} WHEN NOT ({OUT}) THEN {a} END" for a in "xyz"},
     f"CASE WHEN NOT ({OUT}) THEN 'kept' WHEN {_NEAR} THEN 'moved' ELSE 'absorbed' END")
