"""Closed-form velocity fields: (x, y, z, t) Columns -> (u, v, w) Columns."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, functions as F

Field = Callable[[Column, Column, Column, Column], tuple[Column, Column, Column]]


def uniform(velocity=(1.0, 0.0, 0.0)) -> Field:
    u, v, w = (float(c) for c in velocity)
    # 0 * x keeps absorbed (NULL) points NULL
    return lambda x, y, z, t: (F.lit(u) + F.lit(0.0) * x, F.lit(v) + F.lit(0.0) * y, F.lit(w) + F.lit(0.0) * z)


def vortex(center=(0.0, 0.0), strength: float = 1.0) -> Field:
    """strength * (-dy, dx) / max(r^2, 1e-10)."""

    def field(x, y, z, t):
        dx, dy = x - F.lit(float(center[0])), y - F.lit(float(center[1]))
        r2 = F.greatest(dx * dx + dy * dy, F.lit(1e-10))
        return -F.lit(strength) * dy / r2, F.lit(strength) * dx / r2, F.lit(0.0) * z

    return field


def rotation(omega: float = 1.0) -> Field:
    """Solid-body rotation about the z axis."""
    return lambda x, y, z, t: (F.lit(-omega) * y, F.lit(omega) * x, F.lit(0.0) * z)


def saddle(strength: float = 1.0) -> Field:
    return lambda x, y, z, t: (F.lit(strength) * x, F.lit(-strength) * y, F.lit(0.0) * z)


def moving_vortex(period: float = 5.0, orbit: float = 0.3, wobble: float = 0.5) -> Field:
    """A vortex whose centre circles the origin and whose strength swings with the same period."""

    def field(x, y, z, t):
        phase = F.lit(2.0 * math.pi / period) * t
        strength = F.lit(1.0) + F.lit(wobble) * F.sin(phase)
        dx, dy = x - F.lit(orbit) * F.cos(phase), y - F.lit(orbit) * F.sin(phase)
        r2 = dx * dx + dy * dy + F.lit(1e-6)
        return -strength * dy / r2, strength * dx / r2, F.lit(0.0) * z

    return field
