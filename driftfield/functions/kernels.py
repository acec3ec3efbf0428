"""Smoothing kernels as Columns of a distance r and a length h."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def _h(h) -> Column:
    return F.greatest(h if isinstance(h, Column) else F.lit(float(h)), F.lit(1e-12))


def gaussian_kernel(r2_over_h2: Column, dim: int) -> Column:
    """(2 pi)^(-d/2) exp(-r^2 / 2h^2): no 1/h^d factor, so it is a mean kernel, not a density."""
    return F.lit((2.0 * math.pi) ** (-dim / 2.0)) * F.exp(F.lit(-0.5) * r2_over_h2)


def cubic_spline(r: Column, h, dim: int) -> Column:
    """M4 cubic spline with support 2h; integrates to 1."""
    q, hh = r / _h(h), _h(h)
    norm = 10.0 / (7.0 * math.pi) if dim == 2 else 1.0 / math.pi
    near = F.lit(1.0) - F.lit(1.5) * q * q + F.lit(0.75) * q * q * q
    far = F.lit(0.25) * F.pow(F.lit(2.0) - q, F.lit(3.0))
    shape = F.when(q <= 1.0, near).when(q <= 2.0, far).otherwise(F.lit(0.0))
    return F.lit(norm) / F.pow(hh, F.lit(float(dim))) * shape


def wendland_c2(r: Column, h, dim: int, support: str = "2h", published: bool = False) -> Column:
    """Wendland C2 with support ``2h`` (kernel form) or ``h`` (estimator form).

    In three dimensions the published constant of the 2h form is eight times too large; the default
    constant integrates to 1 and ``published=True`` gives the published one.
    """
    hh = _h(h)
    if support == "2h":
        s = r / (F.lit(2.0) * hh)
        norm = 7.0 / (4.0 * math.pi) if dim == 2 else 21.0 / ((2.0 if published else 16.0) * math.pi)
    elif support == "h":
        s = r / hh
        norm = 7.0 / math.pi if dim == 2 else 21.0 / (2.0 * math.pi)
    else:
        raise ValueError("support must be '2h' or 'h'")
    rest = F.greatest(F.lit(1.0) - s, F.lit(0.0))
    return F.lit(norm) / F.pow(hh, F.lit(float(dim))) * F.pow(rest, F.lit(4.0)) * (F.lit(1.0) + F.lit(4.0) * s)


def sph_gaussian(r: Column, h, dim: int) -> Column:
    """pi^(-d/2) h^(-d) exp(-(r/h)^2)."""
    q = r / _h(h)
    return F.lit(math.pi ** (-dim / 2.0)) / F.pow(_h(h), F.lit(float(dim))) * F.exp(-q * q)


def sph_kernel(kind: str, r: Column, h, dim: int) -> Column:
    """Kernel of the particle density estimator by name."""
    if kind == "cubic_spline":
        return cubic_spline(r, h, dim)
    if kind == "wendland":
        return wendland_c2(r, h, dim, support="h")
    if kind == "gaussian":
        return sph_gaussian(r, h, dim)
    raise ValueError(f"unknown kernel {kind!r}")


def kernel_factor(kind: str, h: Column, dim: int) -> Column:
    """What ``kernel_shape`` lacks of the kernel: its constant, and 1/h^d except for the mean kernel."""
    if kind == "mean":
        return F.lit((2.0 * math.pi) ** (-dim / 2.0))
    norm = {
        "cubic_spline": 10.0 / (7.0 * math.pi) if dim == 2 else 1.0 / math.pi,
        "wendland": 7.0 / math.pi if dim == 2 else 21.0 / (2.0 * math.pi),
        "gaussian": math.pi ** (-dim / 2.0),
    }[kind]
    return F.lit(norm) / F.pow(_h(h), F.lit(float(dim)))


def kernel_shape(kind: str, q):
    """Kernel of a NumPy array of distances over h, without its factor; the array is used up."""
    import numpy as np

    if kind == "cubic_spline":  # (2 - q)^3 / 4 - (1 - q)^3, each while positive
        near = np.subtract(1.0, q)
        np.maximum(near, 0.0, out=near)
        cube = near * near
        cube *= near
        far = np.maximum(np.subtract(2.0, q, out=q), 0.0, out=q)
        np.multiply(far, far, out=near)
        near *= far
        near *= 0.25
        return np.subtract(near, cube, out=near)
    if kind == "wendland":
        rest = np.subtract(1.0, q)
        np.maximum(rest, 0.0, out=rest)
        rest *= rest
        rest *= rest
        q *= 4.0
        q += 1.0
        rest *= q
        return rest
    if kind == "gaussian":
        q *= q
        return np.exp(np.negative(q, out=q), out=q)
    raise ValueError(f"unknown kernel {kind!r}")


def kernel_of_square(kind: str, q2):
    """``kernel_shape`` of squares; the array is used up."""
    import numpy as np

    if kind == "gaussian":
        return np.exp(np.negative(q2, out=q2), out=q2)
    return kernel_shape(kind, np.sqrt(q2, out=q2))
