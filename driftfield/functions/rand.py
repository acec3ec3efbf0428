"""Random numbers as a function of (seed, row id, tag).

``F.rand`` depends on how rows are partitioned, so a retried task or another cluster size would give
other points. Here a value depends on its key alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

_TWO52 = 4503599627370496.0  # 13 hexadecimal digits of the hash: as many values as a double tells apart in [0, 1)


def _bits(seed, row_id: Column, tag: str) -> Column:
    key = F.concat_ws(":", F.lit(str(seed)), row_id.cast("string"), F.lit(tag))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double")


def keyed_uniform(seed, row_id: Column, tag: str) -> Column:
    """Uniform on [0, 1)."""
    return _bits(seed, row_id, tag) / F.lit(_TWO52)


def keyed_open_uniform(seed, row_id: Column, tag: str) -> Column:
    """Uniform on (0, 1): safe under a logarithm."""
    return (_bits(seed, row_id, tag) + F.lit(0.5)) / F.lit(_TWO52)


def keyed_range(seed, row_id: Column, tag: str, lo, hi) -> Column:
    """Uniform on [lo, hi)."""
    return F.lit(lo) + keyed_uniform(seed, row_id, tag) * (F.lit(hi) - F.lit(lo))


def keyed_integer(seed, row_id: Column, tag: str, lo: int, hi: int) -> Column:
    """Uniform integer on [lo, hi)."""
    return (F.lit(lo) + F.floor(keyed_uniform(seed, row_id, tag) * F.lit(float(hi - lo)))).cast("bigint")


def keyed_normal(seed, row_id: Column, tag: str) -> Column:
    """Standard normal (Box-Muller over two keyed uniforms)."""
    radius = F.sqrt(F.lit(-2.0) * F.ln(keyed_open_uniform(seed, row_id, tag + "r")))
    return radius * F.cos(F.lit(2.0 * math.pi) * keyed_uniform(seed, row_id, tag + "a"))
