"""Spatial joins as equi-joins on cells.

A *frame* is a family of cubic grids, each level half the cell side of the one before. Anything with an
extent (a ball, an element box) is written into the few cells it touches at the level that fits its own
size; a point is written into its one cell at every level in use. Joining on (level, cell) then finds all
candidate pairs, each once, and an exact test decides. No pair of rows meets outside a shared cell.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from driftfield.model import AXES, Box
from driftfield.operators.ranks import join_per_key
from driftfield.session import cut_lineage

HOT_ROWS = 250_000
BLOCKS_BROADCAST = 200_000  # crowded keys up to this number are broadcast to tag rows, so that a hot key's rows are not gathered first
MAX_LEVEL = 48
GROUP = 4096  # rows a side of a group that returns its pairs: they fit a task's memory even if all rows meet
BOXES = 64  # boxes of one matrix of comparisons
PART_ROWS = 1_000_000  # rows of exploded balls that one task of a join sorts, at most
RANKED_ROWS = 125_000  # neighbours that one task ranks, about
CROWDED = 65_536  # possible pairs of a cell from which on arrays pay
MATRIX = 4096  # possible pairs of a cell from which on a matrix of distances pays
GROUP_PAIRS = 1 << 25  # possible pairs of one group, and of one task, of a radius join, about
TASK_PAIRS = 1 << 22  # possible pairs that are worth a task
SORTED = 1 << 23  # pairs that a task sorts by distance at once: 24 bytes each
BLOCK = 1 << 17  # distances of one matrix
SENT = 1 << 16  # pairs of one Arrow batch
CELL = ["level", "cx", "cy", "cz"]


@dataclass(frozen=True)
class Frame:
    """Grid family: at level l, cells have side ``side / 2**l`` and start at ``origin``."""

    origin: tuple[float, float, float]
    side: float

    @classmethod
    def of(cls, box: Box) -> "Frame":
        """A frame whose cube of level 0 holds the box, with room for rounding."""
        far = max(abs(c) for c in (*box.lo, *box.hi))
        return cls(box.lo, max(max(box.width), 1e-9) * (1 + 1e-9) + far * 1e-12)

    def index(self, c: Column, axis: int, level: Column) -> Column:
        return F.floor((c - F.lit(self.origin[axis])) * F.pow(F.lit(2.0), level) / F.lit(self.side)).cast("bigint")

    def level_with_side(self, size: Column) -> Column:
        """Finest level whose cell side is at least ``size``."""
        fit = F.floor(F.log2(F.lit(self.side) / F.greatest(size, F.lit(self.side * 2.0 ** -MAX_LEVEL))))
        return F.greatest(F.least(fit, F.lit(MAX_LEVEL)), F.lit(-MAX_LEVEL)).cast("int")


def locate(df: DataFrame, frame: Frame, levels: list[int]) -> DataFrame:
    """Each point once per level, with its cell."""
    tagged = df.selectExpr("*", f"explode(array({', '.join(str(int(v)) for v in levels)})) AS level")
    cell = "CAST(floor(({a} - {o!r}D) * pow(2D, level) / {side!r}D) AS bigint) AS c{a}"
    return tagged.selectExpr("*", *[cell.format(a=a, o=float(o), side=float(frame.side)) for a, o in zip(AXES, frame.origin)])


def cover(df: DataFrame, frame: Frame, lo: list[Column], hi: list[Column], level: Column, clip: bool = False) -> DataFrame:
    """Each box once per cell it touches at its level; with ``clip`` only cells of the frame's own cube."""
    out = df.withColumn("level", level)
    top = F.pow(F.lit(2.0), F.col("level")).cast("bigint") - 1
    for n, a in enumerate(AXES):
        first, last = frame.index(lo[n], n, F.col("level")), frame.index(hi[n], n, F.col("level"))
        if clip:
            first, last = F.greatest(first, F.lit(0)), F.least(last, top)
        span = F.sequence(first, last)
        out = out.withColumn(f"c{a}", F.explode(F.when(first <= last, span) if clip else span))
    return out


def used_levels(df: DataFrame) -> list[int]:
    """Distinct levels of a covered table: at most 2 * MAX_LEVEL + 1 integers."""
    return sorted(r["level"] for r in df.select("level").distinct().collect() if r["level"] is not None)


def parts_of(df: DataFrame, rows: int, most: int) -> int | None:
    """Partitions of at most about ``most`` rows; None for tables that as many as there are cores suffice for, which Spark splits itself.

    Spark merges small partitions until there are about as many as cores, of any number of rows up to a size in bytes as written, so what a task
    sorts would grow with the table.
    """
    parts = math.ceil(rows / most)
    if parts <= df.sparkSession.sparkContext.defaultParallelism:
        return None
    return max(parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # joins deal fewer out once more


def spread_join(left: DataFrame, right: DataFrame, on: list[str], hot: int | None = HOT_ROWS, parts: int | None = None) -> DataFrame:
    """Inner equi-join in which a key with more than ``hot`` rows on a side is cut into blocks.

    A key with l left and r right rows becomes ceil(l/hot) x ceil(r/hot) blocks: each side is dealt out
    by a hash of its row and repeated for the other side's blocks, so each pair still meets once.

    Sides may be exploded tables, whose estimated size knows nothing of the explosion: they are merged, never broadcast through the driver.
    ``parts`` fixes the number of partitions (see ``parts_of``).
    """

    def merged(one: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
        if parts is not None:
            one, other = (df.repartition(parts, *keys) for df in (one, other))
        return one.join(other.hint("merge"), keys)

    if hot is None:
        return merged(left, right, on)
    counts = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_l")).join(
        right.groupBy(*on).agg(F.count(F.lit(1)).alias("_r")).hint("merge"), on
    )
    blocks = cut_lineage(
        counts.filter((F.col("_l") > hot) | (F.col("_r") > hot)).select(
            *on, F.ceil(F.col("_l") / hot).alias("_lb"), F.ceil(F.col("_r") / hot).alias("_rb")
        )
    )
    crowded = blocks.count()
    if crowded == 0:
        return merged(left, right, on)
    if crowded <= BLOCKS_BROADCAST:
        blocks = F.broadcast(blocks)

    def dealt(df: DataFrame, own: str, other: str, own_slot: str, other_slot: str) -> DataFrame:
        simple = [c for c, t in df.dtypes if not t.startswith("map")]
        tagged = df.join(blocks, on, "left").withColumns(
            {own: F.coalesce(own, F.lit(1)), other: F.coalesce(other, F.lit(1))}
        )
        return (
            tagged.withColumn(own_slot, F.pmod(F.xxhash64(*simple), F.col(own)))
            .withColumn(other_slot, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1)))
            .drop(own, other)
        )

    spread_left = dealt(left, "_lb", "_rb", "_ls", "_rs")
    spread_right = dealt(right, "_rb", "_lb", "_rs", "_ls")
    return merged(spread_left, spread_right, [*on, "_ls", "_rs"]).drop("_ls", "_rs")


def cogroup_slots(left: DataFrame, right: DataFrame, slots: DataFrame, parts: int, ours, theirs, fn, schema: str) -> DataFrame:
    """What ``fn`` makes of Arrow tables of left rows (columns ``ours``) and right rows (``theirs``) of each cell in ``slots(level, cx, cy, cz, _lb, _rb)``.

    A side is dealt out to its own number of slots by a hash and repeated for the other side's, so each slot of one side meets each of the other.
    """
    keys = [*CELL, "_ls", "_rs"]

    def dealt(df: DataFrame, own: str, other: str, own_slot: str, other_slot: str, keep: tuple[str, ...]) -> DataFrame:
        tagged = df.join(slots, CELL).withColumn(own_slot, F.pmod(F.xxhash64(*keep), F.col(own)))
        tagged = tagged.withColumn(other_slot, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1)))
        return tagged.select(*keys, *keep).repartition(parts, *keys)

    dealt_left = dealt(left, "_lb", "_rb", "_ls", "_rs", ours)
    dealt_right = dealt(right, "_rb", "_lb", "_rs", "_ls", theirs)
    return dealt_left.groupBy(*keys).cogroup(dealt_right.groupBy(*keys)).applyInArrow(fn, schema)


def group_sizes(left: DataFrame, right: DataFrame) -> DataFrame:
    """(level, cx, cy, cz, _l, _r): rows of both sides in cells that both have, written."""
    count = lambda df, name: df.groupBy(*CELL).agg(F.count(F.lit(1)).alias(name))
    return cut_lineage(count(left, "_l").join(count(right, "_r").hint("merge"), CELL))


def group_plan(sizes: DataFrame, rows: int, cores: int) -> tuple[DataFrame, int, int]:
    """Slots of the cells for groups of at most about ``rows`` rows a side, the number of cells, and that of partitions for the groups."""
    cells, work = sizes.agg(F.count(F.lit(1)), F.sum(F.col("_l").cast("double") * F.col("_r"))).first()
    # groups small enough to give every core several
    rows = max(1, min(rows, max(1024, int(((work or 0.0) / (8 * cores)) ** 0.5))))
    slots = sizes.select(*CELL, F.ceil(F.col("_l") / rows).alias("_lb"), F.ceil(F.col("_r") / rows).alias("_rb"))
    groups = slots.agg(F.sum(F.col("_lb") * F.col("_rb"))).first()[0] or 0
    slots = F.broadcast(slots) if cells <= BLOCKS_BROADCAST else slots.hint("merge")
    return slots, cells, max(1, min(groups, max(16 * cores, groups // 64)))


def _padded(radius: Column) -> Column:
    return radius * F.lit(1.0 + 1e-9) + F.lit(1e-12)


_GAP = "sqrt((bx - x) * (bx - x) + (by - y) * (by - y) + (bz - z) * (bz - z))"


def _touched(frame: Frame) -> str:
    """Drop cells of a ball's bounding box that the ball itself does not reach (with room for rounding)."""
    side = f"({float(frame.side)!r}D / pow(2D, level))"
    parts = []
    for a, o in zip(AXES, frame.origin):
        low = f"({float(o)!r}D + c{a} * {side})"
        gap = f"greatest({low} - b{a}, b{a} - {low} - {side}, 0D)"
        parts.append(f"pow({gap}, 2)")
    return f"{' + '.join(parts)} <= pow(_radius * 1.000001D + 1e-9D * {side} + 1e-12D, 2)"


def _crowds(cells: DataFrame) -> dict[int, tuple[int, int]]:
    """Rows of the fullest cell and of all cells per level: at most 2 * MAX_LEVEL + 1 rows come to the driver."""
    counts = cells.filter("level IS NOT NULL").groupBy(*CELL).count()
    return {r["level"]: (r["m"], r["n"]) for r in counts.groupBy("level").agg(F.max("count").alias("m"), F.sum("count").alias("n")).collect()}


def _fullest(cells: DataFrame) -> dict[int, int]:
    return {level: m for level, (m, _) in _crowds(cells).items()}


def ball_pairs(
    balls: DataFrame,
    points: "DataFrame | SiteIndex",
    radius: Column,
    frame: Frame,
    hot: int | None = HOT_ROWS,
    max_level: int = MAX_LEVEL,
) -> DataFrame:
    """All (ball, point) pairs with the point inside the ball; adds the distance ``d``.

    ``balls`` has bx, by, bz and the columns of ``radius``; ``points`` has x, y, z, or is an index of such points. A ball touches at
    most 27 cells at its level, whatever its radius. ``max_level`` stops at a coarser level when finer
    cells would hold no fewer points.

    Balls are counted where their centres lie, one row each: a cell is touched by balls of 27 cells at most, so only where some cell holds
    a 27th of ``hot`` are the cells that balls touch counted one by one. Points of an index that are few are broadcast and need neither.
    """
    r = _padded(F.col("_radius"))
    indexed = isinstance(points, SiteIndex)
    level = F.least(frame.level_with_side(r), F.lit(max_level))
    if indexed:
        level = F.greatest(level, F.lit(0))
    sized = balls.withColumn("_radius", radius)
    centred = sized.select(level.alias("level"), *[F.col(f"b{a}") for a in AXES])
    centred = centred.withColumns({f"c{a}": frame.index(F.col(f"b{a}"), n, F.col("level")) for n, a in enumerate(AXES)})
    covered = cover(sized, frame, [F.col(f"b{a}") - r for a in AXES], [F.col(f"b{a}") + r for a in AXES], level, clip=indexed).filter(_touched(frame))
    if indexed and points.few:
        joined = covered.join(F.broadcast(points.located(range(points.depth + 1))), CELL)
    else:
        crowds = _crowds(centred)
        fullest = {v: m for v, (m, _) in crowds.items()}
        parts = parts_of(balls, 27 * sum(n for _, n in crowds.values()), PART_ROWS)
        located = points.located(sorted(fullest)) if indexed else locate(points, frame, sorted(fullest) or [0])
        if hot is not None and 27 * max(fullest.values(), default=0) <= hot:
            most = max((points.fullest[v] for v in fullest), default=0) if indexed and points.fullest else max(_fullest(located).values(), default=0)
            hot = hot if most > hot else None
        joined = spread_join(covered, located, CELL, hot, parts)
    return joined.withColumn("d", F.expr(_GAP)).filter(F.col("d") <= F.col("_radius")).drop("_radius", *CELL)


def _finite(df: DataFrame) -> DataFrame:
    cond = F.lit(True)
    for a in AXES:
        cond = cond & F.col(a).isNotNull() & ~F.isnan(a) & (F.abs(a) < F.lit(float("inf")))
    return df.filter(cond)


def _span_counts(balls: DataFrame, frame: Frame, lo: list[Column], hi: list[Column], level: int) -> DataFrame:
    """(level, cx, cy, cz, _l): balls by the cells of their bounding boxes. Balls of the same cells are counted before they are written into them."""
    ends = {f"{e}{a}": frame.index(c[n], n, F.lit(level)) for e, c in (("f", lo), ("t", hi)) for n, a in enumerate(AXES)}
    out = balls.select(*[c.alias(e) for e, c in ends.items()]).groupBy(*ends).agg(F.count(F.lit(1)).alias("_l")).withColumn("level", F.lit(level))
    for a in AXES:
        out = out.withColumn(f"c{a}", F.explode(F.sequence(f"f{a}", f"t{a}")))
    return out.groupBy(*CELL).agg(F.sum("_l").alias("_l"))


def _block_slots(sizes: DataFrame, pairs: int) -> DataFrame:
    """Slots of the cells (see ``cogroup_slots``), so that two slots have about ``pairs`` possible pairs: points in few slots, balls in the more."""
    side = max(1, math.isqrt(pairs))
    slots = sizes.withColumn("_rb", F.ceil(F.col("_r") / side))
    balls = F.greatest(F.lit(1.0), F.least(F.lit(float(pairs)) * F.col("_rb") / F.col("_r"), F.lit(16.0 * side)))
    return slots.select(*CELL, F.ceil(F.col("_l") / balls).alias("_lb"), "_rb")


class _Farthest:
    """Pairs of a task, held as numbers until ``SORTED`` are there, then handed on from the farthest to the nearest.

    Distances that repeat come one after the other, and the first to come are the most alike, so whoever stores the pairs by column
    stores a distance few times. In any other order a distance takes eight bytes a pair once there are more of them than a page has rows.
    """

    def __init__(self, size: int, names: list[str]):
        self.size, self.names = size, names
        self.q, self.p, self.d = np.empty(size, np.int32), np.empty(size, np.int32), np.empty(size)
        self._empty()

    def _empty(self) -> None:
        self.n, self.ids, self.rows = 0, ([], []), [0, 0]

    def add(self, q: np.ndarray, p: np.ndarray, d: np.ndarray, q_ids: pa.Array, p_ids: pa.Array):
        """Pairs of rows of ``q_ids`` and ``p_ids``; what must leave first is yielded."""
        if self.n + len(d) > self.size or max(self.rows) + max(len(q_ids), len(p_ids)) > self.size:
            yield from self.flush()
        for n, ids in enumerate((q_ids, p_ids)):
            if not self.ids[n] or self.ids[n][-1] is not ids:
                self.ids[n].append(ids)
                self.rows[n] += len(ids)
        at = slice(self.n, self.n + len(d))
        self.q[at], self.p[at], self.d[at] = q + (self.rows[0] - len(q_ids)), p + (self.rows[1] - len(p_ids)), d
        self.n += len(d)

    def flush(self):
        if self.n:
            q_ids, p_ids = (pa.concat_arrays(ids) for ids in self.ids)
            # distance and place as one whole number: 38 bits of the distance's share of the largest, below it the place, less than 2**24
            order = self.d[: self.n] / (self.d[: self.n].max() or 1.0)
            order *= -(2.0**38)
            order = (order + 2.0**38).astype(np.int64) << 24
            order |= np.arange(self.n, dtype=np.int32)
            order.sort()
            for start in range(0, self.n, SENT):
                o = order[start : start + SENT] & ((1 << 24) - 1)
                sent = [q_ids.take(pa.array(self.q[o])), p_ids.take(pa.array(self.p[o])), pa.array(self.d[o])]
                yield pa.RecordBatch.from_arrays(sent, names=self.names)
        self._empty()


def _pairs_of_groups(radius: float, keys: list[str], held: int, block: int):
    """For ``mapInArrow`` over rows sorted by ``keys``: pairs within ``radius`` of the two sides of each group, farthest first."""

    def near(rows: pa.Table, out: _Farthest):
        mine = rows.column("_ball").to_numpy()
        at = [rows.column(a).to_numpy() for a in AXES]
        q, p = [c[mine] for c in at], [c[~mine] for c in at]
        if not len(q[0]) or not len(p[0]):
            return
        q_ids, p_ids = (rows.column(c).filter(pa.array(side)).combine_chunks() for c, side in (("q_id", mine), ("p_id", ~mine)))
        for left in range(0, len(p[0]), block):
            right = [c[left : left + block] for c in p]
            width = len(right[0])
            high = max(1, block // width)
            for top in range(0, len(q[0]), high):
                gaps = [c[top : top + high, None] - r for c, r in zip(q, right)]
                gaps = [np.multiply(g, g, out=g) for g in gaps]
                square = np.add(np.add(gaps[0], gaps[1], out=gaps[0]), gaps[2], out=gaps[0]).ravel()
                hits = np.flatnonzero(square <= radius * radius * (1 + 1e-9) + 1e-300)
                d = np.sqrt(square[hits])
                inside = d <= radius
                if not inside.all():
                    hits, d = hits[inside], d[inside]
                if len(d):
                    yield from out.add(hits // width + top, hits % width + left, d, q_ids, p_ids)

    def run(batches):
        out = _Farthest(max(held, block), ["q_id", "p_id", "d"])
        parts, last = [], None
        with np.errstate(over="ignore"):
            for batch in batches:
                if not batch.num_rows:
                    continue
                key = np.stack([batch.column(k).to_numpy() for k in keys], axis=1)
                starts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
                for start, end in zip(starts, starts[1:]):
                    if parts and (key[start] != last).any():
                        yield from near(pa.Table.from_batches(parts), out)
                        parts = []
                    parts.append(batch.slice(start, end - start))
                    last = key[start]
            if parts:
                yield from near(pa.Table.from_batches(parts), out)
            yield from out.flush()

    return run


def radius_join(
    queries: DataFrame, points: DataFrame, radius: float, hot: int | None = HOT_ROWS, crowded: int = MATRIX, least: int = TASK_PAIRS
) -> DataFrame:
    """(q_id, p_id, d) for every pair within ``radius``. Rows with NULL, NaN or infinite coordinates match nothing.

    Where a cell has ``crowded`` possible pairs or more, its balls and points meet in matrices of distances, in groups that are dealt out;
    a task holds a bounded number of pairs and hands them on by distance (see ``_Farthest``). In other cells they are joined row by row, and
    so is everything where crowded cells have fewer than ``least`` possible pairs.
    """
    radius = float(radius)
    q = _finite(queries).select(F.col("id").alias("q_id"), *[F.col(a).cast("double").alias(f"b{a}") for a in AXES])
    p = _finite(points).select(F.col("id").alias("p_id"), *[F.col(a).cast("double").alias(a) for a in AXES])
    frame = Frame((0.0, 0.0, 0.0), radius * (1.0 + 2e-9) + 2e-12)
    size = _padded(F.lit(radius))
    level = q.sparkSession.range(1).select(frame.level_with_side(size)).first()[0]
    lo, hi = [F.col(f"b{a}") - size for a in AXES], [F.col(f"b{a}") + size for a in AXES]
    located = locate(p, frame, [level])
    sizes = cut_lineage(_span_counts(q, frame, lo, hi, level).join(located.groupBy(*CELL).agg(F.count(F.lit(1)).alias("_r")).hint("merge"), CELL))
    possible = F.col("_l").cast("double") * F.col("_r")
    busy = possible >= crowded
    n_cells, n_busy, work, others = sizes.agg(F.count(F.lit(1)), F.count_if(busy), F.sum(F.when(busy, possible)), F.sum(F.when(~busy, F.col("_l")))).first()
    if not n_busy or work < least:
        return ball_pairs(q, p, F.lit(radius), frame, hot).select("q_id", "p_id", "d")

    balls = cover(q.withColumn("_radius", F.lit(radius)), frame, lo, hi, F.lit(level)).filter(_touched(frame))
    cores = q.sparkSession.sparkContext.defaultParallelism
    # groups small enough to give every core several
    slots = _block_slots(sizes.filter(busy), max(1, min(GROUP_PAIRS, max(TASK_PAIRS, int(work / (8 * cores))))))
    slots = F.broadcast(slots) if n_busy <= BLOCKS_BROADCAST else slots.hint("merge")
    keys = [*CELL[1:], "_ls", "_rs"]
    kinds = {c: dict(df.dtypes)[c] for c, df in (("q_id", q), ("p_id", p))}

    def dealt(df: DataFrame, ball: bool) -> DataFrame:
        at = [f"b{a}" if ball else a for a in AXES]
        own, other, own_slot, other_slot = ("_lb", "_rb", "_ls", "_rs") if ball else ("_rb", "_lb", "_rs", "_ls")
        ids = [F.col(c) if c in df.columns else F.lit(None).cast(kinds[c]).alias(c) for c in kinds]
        tagged = df.join(slots, CELL).withColumn(own_slot, F.pmod(F.xxhash64("q_id" if ball else "p_id", *at), F.col(own)))
        tagged = tagged.withColumn(other_slot, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1)))
        return tagged.select(*keys, F.lit(ball).alias("_ball"), *ids, *[F.col(c).alias(a) for c, a in zip(at, AXES)])

    parts = max(1, math.ceil(work / GROUP_PAIRS), min(4 * cores, math.ceil(work / TASK_PAIRS)))
    groups = dealt(balls, True).unionByName(dealt(located, False)).repartition(parts, *keys).sortWithinPartitions(*keys)
    fn = _pairs_of_groups(radius, keys, SORTED, BLOCK)
    met = groups.mapInArrow(fn, f"q_id {kinds['q_id']}, p_id {kinds['p_id']}, d double")
    if n_busy == n_cells:
        return met
    rest = sizes.filter(~busy).select(*CELL)
    rest = F.broadcast(rest) if n_cells - n_busy <= BLOCKS_BROADCAST else rest.hint("merge")
    plain_hot = hot if hot is not None and hot < crowded else None  # a cell that is left to the join has fewer rows than ``crowded`` on a side
    sparse = spread_join(balls.join(rest, CELL, "left_semi"), located.join(rest, CELL, "left_semi"), CELL, plain_hot, parts_of(q, others, PART_ROWS))
    return met.unionByName(sparse.withColumn("d", F.expr(_GAP)).filter(F.col("d") <= F.col("_radius")).select("q_id", "p_id", "d"))


def sites(points: DataFrame, *more) -> DataFrame:
    """One row per distinct position (and extra key columns): copies of a point are merged before any join."""
    keys = [F.col(a) for a in AXES] + list(more)
    return _finite(points).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("mass").alias("mass"))


def neighbour_counts(queries: DataFrame, points: DataFrame, radius: float, hot: int | None = HOT_ROWS) -> DataFrame:
    """(id, n_near) for every query: pairs are counted, not emitted, and copies are merged on both sides."""
    q = _finite(queries).select(*[F.col(a).alias(f"b{a}") for a in AXES]).distinct()
    p = sites(points.withColumn("mass", F.lit(1.0)))
    frame = Frame((0.0, 0.0, 0.0), float(radius) * (1.0 + 2e-9) + 2e-12)
    pairs = ball_pairs(q, p, F.lit(float(radius)), frame, hot)
    near = pairs.groupBy("bx", "by", "bz").agg(F.sum("n").alias("n_near"))
    cond = [queries[a] == near[f"b{a}"] for a in AXES]
    return queries.join(near, cond, "left").select("id", F.coalesce("n_near", F.lit(0)).alias("n_near"))


# ---------------------------------------------------------------------------------------------------
# nearest neighbours


def _levels_needed(distinct_sites: DataFrame, frame: Frame, n: int, k: int) -> tuple[int, DataFrame]:
    """Depth at which no cell holds more than 32 k sites, and the counts of its cells. Each round is one small aggregate."""
    depth = max(1, math.ceil(math.log2(max(n / k, 2)) / 2))
    while True:
        counts = cut_lineage(locate(distinct_sites.select(*AXES), frame, [depth]).groupBy("cx", "cy", "cz").agg(F.count(F.lit(1)).alias("m")))
        fullest = counts.agg(F.max("m")).first()[0]
        if fullest <= 32 * k or depth >= MAX_LEVEL:
            return depth, counts
        depth = min(MAX_LEVEL, depth + max(2, math.ceil(math.log2(fullest / (32 * k)) / 2)))


def _lowest_ids(points: DataFrame, k: int) -> DataFrame:
    """(x, y, z, ids): distinct positions with their k lowest ids. The rank limit is applied before the shuffle, too."""
    named = points.select(F.col("id").alias("p_id"), *AXES)
    if k == 1:
        return named.groupBy(*AXES).agg(F.array(F.min("p_id")).alias("ids"))
    by_id = W.partitionBy(*AXES).orderBy("p_id")
    few = named.withColumn("_n", F.row_number().over(by_id)).filter(F.col("_n") <= k)
    return few.groupBy(*AXES).agg(F.sort_array(F.collect_list("p_id")).alias("ids"))


LIGHT = 64  # sites per wanted neighbour that an own cell may hold
SMALL_CELLS = 200_000  # tables of cells up to this size are broadcast


def _meet(rows: DataFrame, cells: DataFrame, n_cells: int, on: list[str], hot: int | None) -> DataFrame:
    """Rows with their cell's columns: no shuffle while the cells are few, else a join that splits crowded keys."""
    return rows.join(F.broadcast(cells), on) if n_cells <= SMALL_CELLS else spread_join(rows, cells, on, hot)


def _walk_down(orphans: DataFrame, usable: DataFrame, n_cells: int, frame: Frame, most: int, hot: int | None) -> list[DataFrame]:
    """Own cells for positions whose own cell is crowded although the child they lie in holds too few sites.

    Each goes on to the usable child nearest to it, level by level, until a cell is light or has no usable child.
    """
    settled = []
    children = usable.select(
        (F.col("level") - 1).alias("level"), *[F.shiftright(F.col(c), 1).alias(c) for c in CELL[1:]], F.struct(*CELL, "m").alias("child")
    )
    children = cut_lineage(children)
    side = F.lit(float(frame.side)) / F.pow(F.lit(2.0), F.col("child.level"))
    gap = F.lit(0.0)
    for n, a in enumerate(AXES):
        low = F.lit(float(frame.origin[n])) + F.col(f"child.c{a}") * side
        away = F.greatest(low - F.col(f"b{a}"), F.col(f"b{a}") - low - side, F.lit(0.0))
        gap = gap + away * away
    while not orphans.isEmpty():
        at = ["bx", "by", "bz"]
        met = _meet(orphans, children, n_cells, CELL, hot).groupBy(*at).agg(F.min_by("child", F.struct(gap, "child")).alias("child"))
        moved = cut_lineage(orphans.join(met, at, "left"))
        settled.append(moved.filter("child IS NULL").select(*at, *CELL))
        down = moved.filter("child IS NOT NULL").select(*at, "child.*")
        settled.append(down.filter(F.col("m") <= most).select(*at, *CELL))
        orphans = down.filter(F.col("m") > most).select(*at, *CELL)
    return settled


def _ancestors(cells: DataFrame, depth: int, *keep) -> DataFrame:
    """Cells of the finest level as cells of every level."""
    up = cells.withColumn("level", F.explode(F.lit(list(range(depth + 1)))))
    shift = F.lit(depth) - F.col("level")
    return up.select("level", *[F.floor(F.col(f"c{a}") / F.pow(F.lit(2.0), shift)).cast("bigint").alias(f"c{a}") for a in AXES], *keep)


@dataclass(frozen=True)
class SiteIndex:
    """Points prepared for nearest-neighbour searches, all tables written: distinct positions with their k lowest ids (``where``), counts of
    the cells of every level that hold as many sites as are wanted (``usable``), and, if stored, sites by the cells of every level."""

    k: int
    n: int
    need: int
    frame: Frame
    depth: int
    where: DataFrame
    usable: DataFrame
    n_usable: int
    stored: DataFrame | None = None
    fullest: dict | None = None

    @property
    def few(self) -> bool:
        """Whether the sites of all levels may be broadcast."""
        return self.stored is not None and self.n * (self.depth + 1) <= SMALL_CELLS

    def located(self, levels) -> DataFrame:
        levels = [int(v) for v in levels]
        if self.stored is None:
            return locate(self.where, self.frame, levels or [0])
        return self.stored.filter(F.col("level").isin(levels))


def site_index(points: DataFrame, k: int = 1, stored: bool = True, values: DataFrame | None = None) -> SiteIndex | None:
    """Index of ``points(id, x, y, z)`` for searches of k neighbours; None if there is no point. ``stored`` pays if it is searched often.

    With ``values(id, ...)`` a site also has the other columns of the lowest id at its position.
    """
    where = _lowest_ids(_finite(points), k)
    if values is not None:
        where = where.withColumn("id", F.col("ids")[0]).join(values, "id", "left").drop("id")
    where = cut_lineage(where)
    n = where.count()
    if n == 0:
        return None
    need = min(k, n)
    frame = Frame.of(Box.around(where.select(*AXES)))
    depth, finest = _levels_needed(where, frame, n, need)
    # counts of every level from the counts of the finest one
    usable = cut_lineage(_ancestors(finest, depth, "m").groupBy(*CELL).agg(F.sum("m").alias("m")).filter(F.col("m") >= need))
    index = SiteIndex(k, n, need, frame, depth, where, usable, usable.count())
    if not stored:
        return index
    located = cut_lineage(locate(where, frame, list(range(depth + 1))))
    return replace(index, stored=located, fullest=_fullest(located))


def _own_cells(asked: DataFrame, index: SiteIndex, hot: int | None) -> DataFrame:
    """(bx, by, bz, level, cx, cy, cz): a cell near each position that holds as many sites as wanted, but not many more.

    Positions outside the frame are taken where its cube is nearest to them.
    """
    frame, need, usable, n_usable = index.frame, index.need, index.usable, index.n_usable
    held = [F.least(F.greatest(F.col(a), F.lit(float(o))), F.lit(float(o) + frame.side)).alias(a) for a, o in zip(AXES, frame.origin)]
    # each position's finest cell; what its own cell is depends on that cell alone
    here = locate(asked.select(*[F.col(a).alias(f"b{a}") for a in AXES], *held), frame, [index.depth])
    names = {f"c{a}": f"f{a}" for a in AXES}
    last = F.lit(2**index.depth - 1)
    here = here.select("bx", "by", "bz", *[F.least(F.greatest(c, F.lit(0)), last).alias(f) for c, f in names.items()])
    f_cell = list(names.values())
    distinct = here.select(*f_cell).distinct()
    above = _ancestors(distinct.select(*f_cell, *[F.col(f).alias(c) for c, f in names.items()]), index.depth, *f_cell)
    level_of = _meet(above, usable, n_usable, CELL, hot).groupBy(*f_cell).agg(F.max_by(F.struct(*CELL, "m"), "level").alias("own"))
    level_of = cut_lineage(level_of)
    own = _meet(here, level_of, level_of.count(), f_cell, hot).select("bx", "by", "bz", "own.*")
    most = LIGHT * need
    own = cut_lineage(own)
    parts = [own.filter(F.col("m") <= most).select("bx", "by", "bz", *CELL)]
    parts += _walk_down(own.filter(F.col("m") > most).select("bx", "by", "bz", *CELL), usable, n_usable, frame, most, hot)
    return reduce(DataFrame.unionByName, parts)


def _bounds(asked: DataFrame, index: SiteIndex, hot: int | None) -> DataFrame:
    """(bx, by, bz, bound): the wanted smallest distance inside each position's own cell, whose sites are one row of few positions."""
    own = cut_lineage(_own_cells(asked, index, hot))
    used = cut_lineage(own.select(*CELL).distinct())
    n_used = used.count()
    sites_of = _meet(index.located(used_levels(used)).select(*CELL, *AXES), used, n_used, CELL, hot)
    sites_of = cut_lineage(sites_of.groupBy(*CELL).agg(F.collect_list(F.struct(*AXES)).alias("near")))
    met = own.join(F.broadcast(sites_of), CELL) if n_used * LIGHT * index.need <= SMALL_CELLS else join_per_key(own, sites_of, CELL)
    gap = lambda p: F.sqrt((F.col("bx") - p["x"]) * (F.col("bx") - p["x"]) + (F.col("by") - p["y"]) * (F.col("by") - p["y"]) + (F.col("bz") - p["z"]) * (F.col("bz") - p["z"]))
    distances = F.transform("near", gap)
    bound = F.array_min(distances) if index.need == 1 else F.element_at(F.array_sort(distances), index.need)
    return met.select("bx", "by", "bz", bound.alias("bound"))


def knn(queries: DataFrame, points: "DataFrame | SiteIndex", k: int, hot: int | None = HOT_ROWS) -> DataFrame:
    """(q_id, p_id, d, rank) of the k nearest points of every query, exact; ties go to the lowest id.

    1. Copies: points that share a position become one site that keeps its k lowest ids; queries that
       share a position are answered once.
    2. Bound: the k-th smallest distance inside a cell near the query bounds the true one. It is the finest cell around the query
       that holds k sites or more; if that is crowded (the query lies in an empty part of it), the nearest of its parts that is not.
       Sites are written only for cells that some query uses.
    3. Search: the ball of that bound is joined with the sites, and the k smallest (d, id) are kept.

    Sites, query positions and bounds are written to the shared folder, because each is read several times. ``points`` may be an index
    made for the same k, whose tables many searches share.
    """
    same = queries is points
    queries = _finite(queries)
    index = points if isinstance(points, SiteIndex) else site_index(points, k, stored=False)
    if index is None:
        none = queries.select(F.col("id").alias("q_id"), F.lit(0).cast("bigint").alias("p_id"), F.lit(0.0).alias("d"), F.lit(1).alias("rank"))
        return none.limit(0)
    if index.k != k:
        raise ValueError(f"the index is made for {index.k} neighbours, not {k}")
    place = ["bx", "by", "bz"]
    near, n_places = _in_balls(index.where if same else queries, index, hot, same)
    q = queries.select(F.col("id").alias("q_id"), *[F.col(a).alias(f"b{a}") for a in AXES])
    parts = parts_of(queries, index.need * n_places, RANKED_ROWS)
    if k == 1:
        ranked = _nearest_of(near, place).select(*place, "s.d", "s.p_id", F.lit(1).alias("rank"))
    else:
        by = place
        if parts is not None:
            near, by = near.withColumn("_h", _place_key()).repartition(parts, "_h"), ["_h", *place]
        best = near.withColumn("_n", F.rank().over(W.partitionBy(*by).orderBy("d"))).filter(F.col("_n") <= index.need)
        listed = best.select(*by, "d", F.explode("ids").alias("p_id"))
        ranked = listed.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy("d", "p_id"))).filter(F.col("rank") <= k)
    if parts is None:
        return q.join(ranked, place).select("q_id", "p_id", "d", "rank")
    return _answers(q, ranked, parts, hot).select("q_id", "p_id", "d", "rank")


def _place_key() -> Column:
    """Hash of a position. What is dealt out by it stays where it is; keys of doubles are dealt out once more, into partitions of Spark's own choice."""
    return F.xxhash64(*[F.col(f"b{a}") + F.lit(0.0) for a in AXES])  # -0.0 is 0.0


def _answers(q: DataFrame, ranked: DataFrame, parts: int, hot: int | None) -> DataFrame:
    """Queries with the neighbours of their position, in ``parts`` partitions; a position of more than ``hot`` queries is cut into blocks."""
    place = ["bx", "by", "bz"]
    q = q.withColumn("_h", _place_key())
    if "_h" not in ranked.columns:
        ranked = ranked.withColumn("_h", _place_key()).repartition(parts, "_h")
    ranked = ranked.withColumnsRenamed({c: f"_{c}" for c in place})
    copies = q.groupBy("_h").count().agg(F.max("count")).first()[0] or 0
    if hot is None or copies <= hot:
        met = q.repartition(parts, "_h").join(ranked.hint("merge"), ["_h"])
    else:
        met = spread_join(q, cut_lineage(ranked), ["_h"], hot, parts)
    same = [F.col(c) - F.col(f"_{c}") == 0.0 for c in place]
    return met.filter(reduce(lambda u, v: u & v, same))


def _in_balls(queries: DataFrame, index: SiteIndex, hot: int | None, distinct: bool = False) -> tuple[DataFrame, int]:
    """(bx, by, bz, d, site columns): for every position of queries the sites within its bound; and the number of positions."""
    asked = queries.select(*AXES) if distinct else cut_lineage(queries.select(*AXES).distinct())
    bounds = cut_lineage(_bounds(asked, index, hot))
    # the ball, on cells no finer than the depth at which cells are already nearly empty
    return ball_pairs(bounds, index if index.stored is not None else index.where, F.col("bound"), index.frame, hot, max_level=index.depth), bounds.count()


def _nearest_of(near: DataFrame, by: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """(by, s): the nearest site per key, lowest id on ties, as struct(d, p_id, near, carried columns)."""
    site = F.struct("d", F.col("ids")[0].alias("p_id"), F.struct(*AXES).alias("near"), *carry)
    return near.groupBy(*by).agg(F.min_by(site, F.struct("d", F.col("ids")[0])).alias("s"))


def nearest_sites(queries: DataFrame, index: SiteIndex, hot: int | None = HOT_ROWS) -> DataFrame:
    """(q_id, near): the position of the nearest site of every row of ``queries(id, x, y, z)``, searched from scratch."""
    queries = _finite(queries)
    place = ["bx", "by", "bz"]
    found = _nearest_of(_in_balls(queries, index, hot)[0], place).select(*place, "s.near")
    return queries.select(F.col("id").alias("q_id"), *[F.col(a).alias(f"b{a}") for a in AXES]).join(found, place).select("q_id", "near")


def nearest_again(queries: DataFrame, index: SiteIndex, carry: tuple[str, ...] = (), hot: int | None = HOT_ROWS) -> DataFrame:
    """(q_id, p_id, near, carried columns): the nearest site of every row of ``queries(id, x, y, z, near)``, lowest id on ties.

    ``near(x, y, z)`` is the position of any site, e.g. of the one found before the query moved a little: its distance bounds the true one,
    so the search needs no own cell. Rows without it have no row in the result.
    """
    q = _finite(queries).select(F.col("id").alias("q_id"), *[F.col(a).alias(f"b{a}") for a in AXES], F.col("near").alias("_from"))
    away = [F.col(f"_from.{a}") - F.col(f"b{a}") for a in AXES]
    gap = F.sqrt(reduce(lambda s, v: s + v, [v * v for v in away]))
    pairs = ball_pairs(q.filter("_from IS NOT NULL"), index, gap, index.frame, hot, max_level=index.depth)
    return _nearest_of(pairs, ["q_id"], carry).select("q_id", "s.p_id", "s.near", *[f"s.{c}" for c in carry])


def nearest(queries: DataFrame, points: DataFrame, hot: int | None = HOT_ROWS) -> DataFrame:
    """(q_id, p_id, d): the nearest point of every query, lowest id on ties."""
    return knn(queries, points, 1, hot).drop("rank")


# ---------------------------------------------------------------------------------------------------
# boxes


def cell_counts(points: DataFrame, origin, size: float) -> DataFrame:
    """Points per integer cell triple: a 3-D histogram, and the skew report of the joins above."""
    idx = {f"c{a}": F.floor((F.col(a) - F.lit(float(o))) / F.lit(float(size))).cast("bigint") for a, o in zip(AXES, origin)}
    return _finite(points).withColumns(idx).groupBy("cx", "cy", "cz").agg(F.count(F.lit(1)).alias("n"))


def _in_columns(at: np.ndarray, size: int = 1) -> np.ndarray:
    """The order of positions (one row per axis) by columns of cells, about ``size`` positions a cell."""
    cut = max(1, round((at.shape[1] / size) ** (1 / 3)))
    low, wide = at.min(1, keepdims=True), np.ptp(at, axis=1, keepdims=True)
    cell = np.minimum(np.floor((at - low) / np.where(wide > 0, wide, 1.0) * cut), cut - 1)
    return np.argsort((cell[0] * cut + cell[1]) * cut + cell[2], kind="stable")


def _overlaps_of_group(left, right):
    """(a_id, b_ids): overlapping boxes of one group, a list for each box of the left side.

    A pair counts if the low corner of the overlap lies in the cell, that is if on every axis one of the two boxes begins there. Ends are
    compared as ranks among those of the right side, small integers whose matrices fit a cache.
    """
    col = lambda t, c: t.column(c).to_numpy()
    ids, other_ids = (t.column(c).combine_chunks() for t, c in ((left, "a_id"), (right, "b_id")))
    plain = pa.types.is_integer(other_ids.type) and not other_ids.null_count
    values = other_ids.to_numpy() if plain else np.arange(len(other_ids))
    schema = pa.schema([("a_id", ids.type), ("b_ids", pa.list_(other_ids.type))])
    batches, owners, counts, found = [], [], [], []

    def flush() -> None:
        ends = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)
        listed = pa.array(np.concatenate(found))
        lists = pa.ListArray.from_arrays(pa.array(ends), listed if plain else other_ids.take(listed))
        batches.append(pa.RecordBatch.from_arrays([ids.take(pa.array(np.concatenate(owners))), lists], schema=schema))
        owners.clear(), counts.clear(), found.clear()

    n, m = len(ids), len(other_ids)
    if n and m:
        # boxes of the right side in columns of small cells: what a box overlaps are runs, much the same runs as those of the box before
        order = _in_columns(np.stack([col(right, f"b_lo_{x}") for x in AXES]))
        right, other_ids, values = right.take(pa.array(order)), other_ids.take(pa.array(order)), values if not plain else values[order]
        small = np.int16 if m < 32_000 else np.int32
        lo = np.stack([col(left, f"a_lo_{x}") for x in AXES])
        # a pair overlaps if first <= rank of the other's high end and rank of its low end < last, on every axis
        first, last = np.empty((3, n), small), np.empty((3, n), small)
        rank_hi, rank_lo = np.empty((3, m), small), np.empty((3, m), small)
        for k, x in enumerate(AXES):
            for rank, end, bound, mine, side in ((rank_hi, "hi", first, lo[k], "left"), (rank_lo, "lo", last, col(left, f"a_hi_{x}"), "right")):
                theirs = col(right, f"b_{end}_{x}")
                order = np.argsort(theirs, kind="stable")
                rank[k, order] = np.arange(m, dtype=small)
                bound[k] = np.searchsorted(theirs[order], mine, side)
        at, other_at = col(left, "a_at").astype(np.uint8), col(right, "b_at").astype(np.uint8)
        # boxes in the order of where they begin, so that those of a chunk lie near each other
        order = _in_columns(lo, BOXES)
        waiting = 0
        for start in range(0, n, BOXES):
            chunk = order[start : start + BOXES]
            begin, end = first[:, chunk], last[:, chunk]
            near = ((rank_hi >= begin.min(1)[:, None]) & (rank_lo < end.max(1)[:, None])).all(0).nonzero()[0]
            if not len(near):
                continue
            inside = (at[chunk][:, None] | other_at[near]) == 7
            test = np.empty_like(inside)
            for k in range(3):
                high, deep = rank_hi[k, near], rank_lo[k, near]
                if begin[k].max() > high.min():  # else it holds for all
                    inside &= np.less_equal(begin[k][:, None], high, out=test)
                if end[k].min() <= deep.max():
                    inside &= np.less(deep, end[k][:, None], out=test)
            n_hits = np.count_nonzero(inside, axis=1)
            hits = np.flatnonzero(inside)
            hits -= np.repeat(np.arange(len(chunk)) * len(near), n_hits)
            owners.append(chunk), counts.append(n_hits), found.append(values[near][hits])
            waiting += len(hits)
            if waiting >= 1 << 18:
                flush()
                waiting = 0
        if counts:
            flush()
    return pa.Table.from_batches(batches, schema)


def box_intersections(
    a: DataFrame, b: DataFrame, frame: Frame, hot: int | None = HOT_ROWS, rows: int = GROUP, crowded: int = CROWDED
) -> DataFrame:
    """(a_id, b_id) of all overlapping boxes (touching counts). Both sides have id, lo_x .. hi_z.

    A pair meets at the coarser of its two levels, in the one cell that holds the low corner of the overlap. A box is at home at its own
    level and a visitor at the coarser levels that the other side has boxes of. Homes meet homes and visitors; two visitors never meet.

    Where a cell has ``crowded`` possible pairs or more, its boxes meet as arrays in groups of at most ``rows`` a side, whose answer is one list
    per box; in other cells they are joined row by row.
    """

    def written(df: DataFrame, p: str) -> DataFrame:
        named = df.select(F.col("id").alias(f"{p}_id"), *[F.col(f"{e}_{x}").alias(f"{p}_{e}_{x}") for e in ("lo", "hi") for x in AXES])
        size = F.greatest(*[F.col(f"{p}_hi_{x}") - F.col(f"{p}_lo_{x}") for x in AXES])
        return named.withColumn(f"{p}_level", frame.level_with_side(size))

    def levels(df: DataFrame, p: str) -> list[int]:
        return sorted(r[0] for r in df.select(f"{p}_level").distinct().collect() if r[0] is not None) or [0]

    def home(df: DataFrame, p: str) -> DataFrame:
        lo, hi = ([F.col(f"{p}_{e}_{x}") for x in AXES] for e in ("lo", "hi"))
        return cover(df, frame, lo, hi, F.col(f"{p}_level"))

    def visiting(df: DataFrame, p: str, at: list[int]) -> DataFrame:
        away = df.withColumn("_lv", F.explode(F.lit(at))).filter(F.col("_lv") < F.col(f"{p}_level"))
        lo, hi = ([F.col(f"{p}_{e}_{x}") for x in AXES] for e in ("lo", "hi"))
        return cover(away, frame, lo, hi, F.col("_lv")).drop("_lv")

    def overlapping(met: DataFrame) -> DataFrame:
        keep = F.lit(True)
        for n, x in enumerate(AXES):
            low = F.greatest(f"a_lo_{x}", f"b_lo_{x}")
            keep = keep & (low <= F.least(f"a_hi_{x}", f"b_hi_{x}")) & (frame.index(low, n, F.col("level")) == F.col(f"c{x}"))
        return met.filter(keep).select("a_id", "b_id")

    def starts(df: DataFrame, p: str) -> DataFrame:
        """With ``p_at``: a bit per axis on which the box begins in the cell."""
        bits = [F.when(frame.index(F.col(f"{p}_lo_{x}"), n, F.col("level")) == F.col(f"c{x}"), 1 << n).otherwise(0) for n, x in enumerate(AXES)]
        return df.withColumn(f"{p}_at", reduce(lambda u, v: u + v, bits))

    def meet(left: DataFrame, right: DataFrame) -> list[DataFrame]:
        sizes = group_sizes(left, right)
        busy = F.col("_l").cast("double") * F.col("_r") >= crowded
        slots, n_cells, parts = group_plan(sizes.filter(busy), rows, left.sparkSession.sparkContext.defaultParallelism)
        plain_hot = hot if hot is not None and hot < crowded else None  # a cell that is left to the join has fewer rows than ``crowded`` on a side
        if n_cells == 0:
            return [overlapping(spread_join(left, right, CELL, plain_hot))]
        columns = {p: (f"{p}_id", f"{p}_at", *[f"{p}_{e}_{x}" for e in ("lo", "hi") for x in AXES]) for p in "ab"}
        kinds = [dict(df.dtypes)[f"{p}_id"] for p, df in (("a", left), ("b", right))]
        lists = cogroup_slots(
            starts(left, "a"), starts(right, "b"), slots, parts, columns["a"], columns["b"], _overlaps_of_group, f"a_id {kinds[0]}, b_ids array<{kinds[1]}>"
        )
        rest = sizes.filter(~busy).select(*CELL)
        rest = F.broadcast(rest) if sizes.count() <= BLOCKS_BROADCAST else rest.hint("merge")
        sparse = spread_join(left.join(rest, CELL, "left_semi"), right.join(rest, CELL, "left_semi"), CELL, plain_hot)
        return [lists.select("a_id", F.explode("b_ids").alias("b_id")), overlapping(sparse)]

    left, right = written(a, "a"), written(b, "b")
    met = meet(home(left, "a"), home(right, "b").unionByName(visiting(right, "b", levels(left, "a"))))
    met += meet(visiting(left, "a", levels(right, "b")), home(right, "b"))
    return reduce(DataFrame.unionByName, met)
