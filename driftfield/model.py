"""Table contracts and the small value objects that become literals in plans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

AXES = ("x", "y", "z")

# Required columns per table: name -> accepted Spark type names.
_INT = {"tinyint", "smallint", "int", "bigint"}
_NUM = _INT | {"float", "double"}
CONTRACTS: dict[str, dict[str, set[str]]] = {
    "points": {"id": _INT, "x": _NUM, "y": _NUM, "z": _NUM},
    "nodes": {"node_id": _INT, "x": _NUM, "y": _NUM, "z": _NUM},
    "times": {"t_idx": _INT, "t": _NUM},
    "samples": {"t_idx": _INT, "node_id": _INT, "u": _NUM, "v": _NUM, "w": _NUM},
    "grid": {"i": _INT, "j": _INT, "k": _INT, "u": _NUM, "v": _NUM, "w": _NUM},
    "elements": {"elem_id": _INT, "nodes": {"array<bigint>", "array<int>"}},
    "traj": {"particle_id": _INT, "t_idx": _INT, "t": _NUM, "x": _NUM, "y": _NUM, "z": _NUM},
}


class SchemaError(ValueError):
    """A DataFrame lacks a column of its table contract, or has it with another type."""


def check(df: DataFrame, contract: str) -> DataFrame:
    """Return ``df`` unchanged if it satisfies the named contract, else raise (no job is run)."""
    have = dict(df.dtypes)
    wrong = {
        name: have.get(name, "missing")
        for name, kinds in CONTRACTS[contract].items()
        if have.get(name) not in kinds
    }
    if wrong:
        raise SchemaError(f"{contract}: columns missing or of wrong type {wrong}; table has {have}")
    return df


@dataclass(frozen=True)
class Box:
    """Axis-aligned box. ``lo == hi`` on an axis is a flat axis; ``lo > hi`` is an error."""

    lo: tuple[float, float, float]
    hi: tuple[float, float, float]

    def __post_init__(self) -> None:
        if len(self.lo) != 3 or len(self.hi) != 3:
            raise ValueError("a box needs three low and three high coordinates")
        if any(a > b for a, b in zip(self.lo, self.hi)):
            raise ValueError(f"low corner {self.lo} exceeds high corner {self.hi}")

    @classmethod
    def of(cls, lo, hi) -> "Box":
        """Box from two corner sequences; two-dimensional corners get a flat z axis at 0."""
        pad = lambda c: tuple(float(v) for v in (list(c) + [0.0])[:3])
        return cls(pad(lo), pad(hi))

    @classmethod
    def around(cls, df: DataFrame) -> "Box | None":
        """Smallest box around x, y, z of a table: one aggregate row comes to the driver."""
        row = df.agg(*[f(a).cast("double").alias(f"{n}{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))]).first()
        if row["lox"] is None:
            return None
        return cls(tuple(row[f"lo{a}"] for a in AXES), tuple(row[f"hi{a}"] for a in AXES))

    @property
    def width(self) -> tuple[float, float, float]:
        return tuple(b - a for a, b in zip(self.lo, self.hi))

    def axes(self):
        """(axis name, low, high) triples."""
        return list(zip(AXES, self.lo, self.hi))


@dataclass(frozen=True)
class GridMeta:
    """Regular grid: node (i,j,k) lies at origin + (i,j,k) * spacing."""

    origin: tuple[float, float, float]
    spacing: tuple[float, float, float]
    shape: tuple[int, int, int]

    def __post_init__(self) -> None:
        if any(n < 1 for n in self.shape):
            raise ValueError("a grid needs at least one node per axis")
        if any(s <= 0 for s in self.spacing):
            raise ValueError("grid spacing must be positive")

    @property
    def box(self) -> Box:
        top = tuple(o + (n - 1) * s for o, n, s in zip(self.origin, self.shape, self.spacing))
        return Box(tuple(map(float, self.origin)), tuple(map(float, top)))
