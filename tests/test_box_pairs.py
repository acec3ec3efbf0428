"""Overlaps of boxes in crowded cells: lists per box, not a row for each possible pair."""

import random

import numpy as np
import pyarrow as pa
import pytest

from driftfield.model import Box
from driftfield.operators import cells

COLUMNS = "id bigint, lo_x double, lo_y double, lo_z double, hi_x double, hi_y double, hi_z double"
FRAME = cells.Frame.of(Box((0, 0, 0), (16, 16, 16)))


def boxes_of(seed: int, n: int, sizes) -> list[tuple]:
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        lo = [rnd.choice([rnd.uniform(-2, 10), float(rnd.randrange(10))]) for _ in range(3)]  # some on the edges of cells
        size = rnd.choice(sizes)
        rows.append((i, *lo, *[v + size for v in lo]))
    return rows + [(n, *rows[0][1:])]  # a copy


def overlaps(a, b):
    return sorted((p[0], q[0]) for p in a for q in b if all(p[1 + i] <= q[4 + i] and q[1 + i] <= p[4 + i] for i in range(3)))


@pytest.mark.parametrize(("rows", "crowded"), [(7, 1), (cells.GROUP, 1), (5, 40)])
def test_arrays_give_each_pair_once(spark, rows, crowded):
    a, b = boxes_of(1, 90, [0.0, 0.5, 1.0, 12.0]), boxes_of(2, 70, [0.0, 0.3, 2.0, 9.0])
    hole = (999, None, 0.0, 0.0, 1.0, 1.0, 1.0)
    left, right = spark.createDataFrame([*a, hole], COLUMNS), spark.createDataFrame([*b, hole], COLUMNS)
    got = cells.box_intersections(left, right, FRAME, rows=rows, crowded=crowded)
    assert sorted(map(tuple, got.collect())) == overlaps(a, b)


def test_ids_may_be_null_or_strings(spark):
    a = boxes_of(3, 20, [4.0])
    named = [(None if r[0] == 4 else f"n{r[0]}", *r[1:]) for r in a]
    df = spark.createDataFrame(named, COLUMNS.replace("id bigint", "id string"))
    got = cells.box_intersections(df, df, FRAME, crowded=1).collect()
    assert sorted(map(str, got)) == sorted(f"Row(a_id={named[p[0]][0]!r}, b_id={named[p[1]][0]!r})" for p in overlaps(a, a))


def test_large_boxes_meet_many_as_lists(spark, capsys):
    """300 x 300 boxes share a cell; what comes out of the cell join is a list per box and group, before it becomes pairs."""
    a = boxes_of(5, 300, [12.0])
    df = spark.createDataFrame(a, COLUMNS)
    pairs = cells.box_intersections(df, df, FRAME)
    pairs.explain()
    assert "FlatMapCoGroupsInArrow" in capsys.readouterr().out
    assert sorted(map(tuple, pairs.collect())) == overlaps(a, a)


def test_lists_of_a_group_follow_the_places_of_boxes():
    """Boxes that a box overlaps are listed in the same order of places for every box, whatever order they came in: a column store finds the runs again."""
    rng = np.random.default_rng(31)
    at = {"a": rng.uniform(0, 4, (150, 3)), "b": np.stack(np.meshgrid(*[np.arange(8) * 0.5] * 3), axis=-1).reshape(-1, 3)}

    def side(p, order):
        ends = {f"{p}_{e}_{x}": at[p][order, k] + (0.9 if e == "hi" else 0.0) for e in ("lo", "hi") for k, x in enumerate("xyz")}
        return pa.table({f"{p}_id": order, f"{p}_at": np.full(len(order), 7), **ends})

    listed = lambda order: {r["a_id"]: r["b_ids"] for r in cells._overlaps_of_group(side("a", np.arange(150)), side("b", order)).to_pylist()}
    one, other = listed(np.arange(512)), listed(rng.permutation(512))
    assert one == other
    hit = ((at["a"][:, None] <= at["b"] + 0.9) & (at["b"] <= at["a"][:, None] + 0.9)).all(2)
    assert {a: sorted(b) for a, b in one.items() if b} == {a: np.flatnonzero(h).tolist() for a, h in enumerate(hit) if h.any()}
