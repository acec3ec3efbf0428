"""NumPy functions as Columns: for fields, densities, distances and rules that have no Column expression.

A function gets one float64 array per declared input, a whole Arrow batch at a time, and gives one array per output. Where an input is NULL
the outputs are NULL and the function sees NaN; NaN stays NaN. Prefer Column expressions where these exist: they need no Python worker.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from driftfield.model import AXES


def evaluate(fn: Callable, arrays: list[np.ndarray], outputs: int, name: str = "function") -> list[np.ndarray]:
    """The outputs of ``fn`` as float64 arrays of the inputs' length; a number stands for a constant array."""
    got = fn(*arrays)
    got = list(got) if isinstance(got, (tuple, list)) else [got]
    if len(got) != outputs:
        raise ValueError(f"{name} gave {len(got)} outputs, not {outputs}")
    n = len(arrays[0])
    out = [np.broadcast_to(np.asarray(g, dtype=np.float64), (n,) if np.ndim(g) == 0 else np.shape(g)) for g in got]
    if any(o.shape != (n,) for o in out):
        raise ValueError(f"{name} gave arrays of shapes {[o.shape for o in out]} for {n} rows")
    return out


def array_function(fn: Callable, inputs: int, outputs: tuple[str, ...] | None = None) -> Callable[..., Column]:
    """``fn(*arrays)`` as a function of ``inputs`` Columns: a double, or with ``outputs`` a struct of doubles with these names."""
    if inputs < 1:
        raise ValueError("an array function needs an input")
    names = outputs or ("value",)
    kind = DoubleType() if outputs is None else StructType([StructField(n, DoubleType()) for n in names])

    def run(*columns: pa.Array) -> pa.Array:
        lost = np.zeros(len(columns[0]), bool)
        for c in columns:
            if c.null_count:
                lost |= c.is_null().to_numpy(zero_copy_only=False)
        got = evaluate(fn, [c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns], len(names), getattr(fn, "__name__", "function"))
        arrays = [pa.array(g, pa.float64(), mask=lost) for g in got]
        return arrays[0] if outputs is None else pa.StructArray.from_arrays(arrays, names)

    # one Arrow batch in, one out; the number of arguments is fixed by the caller
    called = F.arrow_udf(_with_arguments(run, inputs), kind)
    return lambda *columns: called(*[(F.col(c) if isinstance(c, str) else c).cast("double") for c in columns])


def _with_arguments(run: Callable, n: int) -> Callable:
    """``run`` with type hints on its arguments, by which Spark tells the kind of function."""

    def batch(*columns: pa.Array) -> pa.Array:
        if len(columns) != n:
            raise ValueError(f"{n} columns expected, got {len(columns)}")
        return run(*columns)

    return batch


@dataclass(frozen=True)
class ArrayFunction:
    """A NumPy function of declared columns with one value: a pdf, a signed distance, a weight.

    ``column()`` gives it on a table that has these columns, ``at(x, y, z)`` on any three (for rules by distance), and ``with_pdf`` adds it to
    a table of points as ``pdf`` (for rejection sampling).
    """

    fn: Callable
    inputs: tuple[str, ...] = AXES

    def column(self) -> Column:
        return array_function(self.fn, len(self.inputs))(*self.inputs)

    def at(self, *columns: Column) -> Column:
        return array_function(self.fn, len(columns))(*columns)

    def with_pdf(self, points):
        """A negative or missing value counts as 0: no point is accepted there."""
        value = F.coalesce(F.nanvl(self.column(), F.lit(0.0)), F.lit(0.0))
        return points.withColumn("pdf", F.greatest(value, F.lit(0.0)))
