"""Approximate nearest neighbours: a forest of random-projection trees, searched through one priority queue.

Trees are fitted on a bounded sample (about ``SAMPLE`` distinct vectors by a hash of the id; a larger table wants a larger one): every inner node is a hyperplane between two
random points, cut at the sample's median, so trees are complete. Every vector is then routed to one leaf per tree. A query goes down all
trees through one queue ordered by the margin to the nearest hyperplane crossed, and takes leaves until they hold a share of all vectors;
candidates of a leaf are ranked by exact cosine. The share is calibrated on the sample: the least that finds ``recall`` of the true
neighbours there. On vectors without any structure it comes near one half, on clustered ones it is small.

Equal vectors are indexed once, with their lowest ids. Leaves and the queries that visit them meet in blocks of bounded size.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from driftfield.session import cut_lineage

SAMPLE = 16_384
#: The sample goes through the driver: at most so many numbers, i.e. fewer vectors where these are long.
SAMPLE_NUMBERS = 2_000_000
TREES = 12
LEAF = 32
RECALL = 0.97
LEAST_SEARCH = 1_000
#: Queries for calibration, taken from the sample.
PROBES = 48
BLOCK = 4_096
#: Neighbouring leaves of a tree that are ranked together.
TOGETHER = 8
_NEAR = 1e-9


@dataclass
class Forest:
    """Complete trees of one depth; node 2n + 1 is below, 2n + 2 above node n's hyperplane. Its size depends on the sample alone."""

    normals: np.ndarray  # (trees, nodes, dims)
    cuts: np.ndarray  # (trees, nodes)
    depth: int

    @property
    def nodes(self) -> int:
        return (1 << self.depth) - 1


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component near 1: squares neither overflow nor vanish, and no digit changes."""
    x = np.ascontiguousarray(x, np.float64)
    if not x.size:
        return x
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def grow(sample: np.ndarray, trees: int, leaf: int, seed: int = 1) -> Forest:
    """Fit the trees. Where all points of a node are equal, they go by a random plane."""
    x = _unit(sample)
    depth = max(0, int(np.ceil(np.log2(max(len(x), 1) / leaf))))
    nodes = (1 << depth) - 1
    normals, cuts = np.zeros((trees, nodes, x.shape[1])), np.zeros((trees, nodes))
    for t in range(trees):
        rng = np.random.default_rng([seed, t])
        held = {0: np.arange(len(x))}
        for n in range(nodes):
            at = held.pop(n)
            a, b = rng.choice(at, 2, replace=False) if len(at) > 1 else (0, 0)
            normal = x[a] - x[b]
            if not normal.any():
                normal = rng.normal(size=x.shape[1])
            normals[t, n] = normal / np.linalg.norm(normal)
            p = x[at] @ normals[t, n]
            order = np.argsort(p, kind="stable")
            half = len(at) // 2
            cuts[t, n] = (p[order[half - 1]] + p[order[half]]) / 2 if half else 0.0
            held[2 * n + 1], held[2 * n + 2] = at[order[:half]], at[order[half:]]
    return Forest(normals, cuts, depth)


def route(forest: Forest, x: np.ndarray) -> np.ndarray:
    """(vectors, trees) leaf of each vector in each tree."""
    x = _unit(x)
    out = np.zeros((len(x), len(forest.normals)), np.int64)
    for t in range(out.shape[1]):
        node = np.zeros(len(x), np.int64)
        for _ in range(forest.depth):
            above = np.einsum("ij,ij->i", x, forest.normals[t, node]) > forest.cuts[t, node]
            node = 2 * node + 1 + above
        out[:, t] = node - forest.nodes
    return out


def visits(forest: Forest, sizes: np.ndarray, x: np.ndarray, search_k: int) -> Iterator[list[tuple[int, int]]]:
    """For every query the (tree, leaf) pairs in the order of one queue over all trees, until the leaves hold ``search_k`` vectors."""
    trees, inner = len(forest.normals), forest.nodes
    margins = np.einsum("qd,tnd->qtn", _unit(x), forest.normals) - forest.cuts
    for margin in margins:
        queue = [(-np.inf, t, 0) for t in range(trees)]
        got, found = 0, []
        while queue and got < search_k:
            near, t, node = heapq.heappop(queue)
            if node >= inner:
                leaf = node - inner
                if sizes[t, leaf]:
                    found.append((t, leaf))
                    got += int(sizes[t, leaf])
                continue
            m = margin[t, node]
            heapq.heappush(queue, (max(near, -m), t, 2 * node + 2))
            heapq.heappush(queue, (max(near, m), t, 2 * node + 1))
        yield found


def calibrate(forest: Forest, sample: np.ndarray, k: int, recall: float) -> float:
    """Share of the vectors that leaves must hold, counting every tree's, to find ``recall`` of the k nearest in the sample."""
    x = _unit(sample)
    if len(x) < 2:
        return 1.0
    leaves = route(forest, x)
    trees = np.arange(leaves.shape[1])
    sizes = np.zeros((len(trees), 1 << forest.depth), np.int64)
    np.add.at(sizes, (np.broadcast_to(trees, leaves.shape), leaves), 1)
    probes = np.unique(np.linspace(0, len(x) - 1, PROBES).astype(int))
    near = x[probes] @ x.T
    near[np.arange(len(probes)), probes] = -2
    needed = []
    for row, found in zip(near, visits(forest, sizes, x[probes], len(trees) * len(x))):
        at = np.zeros(sizes.shape, np.int64)
        where = tuple(np.array(found).T)
        at[where] = np.cumsum(sizes[where])
        for v in np.argsort(-row)[: min(k, len(x) - 1)]:
            needed.append(at[trees, leaves[v]].min())
    return float(np.quantile(needed, recall) / len(x))


def cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``q`` with the same row of ``v`` in double precision; equal rows give equal results."""
    q, v = _scaled(q), _scaled(v)  # rows laid out alike are summed alike
    return (q * v).sum(1) / (np.sqrt((q * q).sum(1)) * np.sqrt((v * v).sum(1)))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _best(a: pa.Table, b: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of each query's k nearest rows in the leaves that it visits, ties to the smaller id."""
    q_ids, q, mask = a.column("q").to_numpy(), _matrix(a.column("qv")), a.column("leaves").to_numpy()
    ids, v, leaf = b.column("id").to_numpy(), _matrix(b.column("v")), b.column("leaf").to_numpy() % TOGETHER
    unit = _unit(v)
    out = []
    for lo in range(0, len(q), 256):
        rough = _unit(q[lo : lo + 256]) @ unit.T
        rough[(mask[lo : lo + 256, None] >> leaf & 1) == 0] = -2
        kth = np.partition(rough, -min(k, len(ids)), axis=1)[:, -min(k, len(ids))]
        for i, row in enumerate(rough):
            at = np.flatnonzero(row >= max(kth[i] - _NEAR, -1.5))  # all that can be among the k when computed exactly
            score = cosines(np.broadcast_to(q[lo + i], (len(at), q.shape[1])), v[at])
            order = np.lexsort((ids[at], -score))[:k]
            out.append((np.full(len(order), q_ids[lo + i]), ids[at[order]], score[order]))
    x, y, z = zip(*out)
    return np.concatenate(x), np.concatenate(y), np.concatenate(z)


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 5, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, recall: float = RECALL
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each query, itself left out; nearest first, ties to smaller ids.

    ``vectors`` and ``queries`` have (vec_id, embedding); queries must be rows of ``vectors``. Vectors that are null, zero, or hold null or
    non-finite components take no part, as query or candidate; nor do rows without an id. Vectors of different lengths have no cosine: each
    length is searched on its own. With fewer than k others, all that are found are returned. Rows that repeat an id and vector count once.
    """
    spark = vectors.sparkSession
    e = F.col("embedding")
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    fine = F.col("vec_id").isNotNull() & e.isNotNull() & F.forall(e, number) & F.exists(e, lambda x: x != 0)
    kind = vectors.schema["embedding"].dataType.elementType.simpleString()
    typed = F.transform(e, lambda x: x.cast(kind if kind in ("float", "double") else "double"))
    pick = lambda df: df.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), F.xxhash64(typed).alias("h1"), F.xxhash64(F.lit(7), typed).alias("h2"), typed.alias("v"))
    # one row per distinct vector with its k + 1 lowest ids; the rank's limit is applied before the shuffle too
    order = F.row_number().over(W.partitionBy("h1", "h2").orderBy("vec_id"))
    lowest = pick(vectors).groupBy("h1", "h2", "vec_id").agg(F.first("v").alias("v")).withColumn("_n", order).where(F.col("_n") <= k + 1)
    classes = cut_lineage(lowest.groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.sort_array(F.collect_list("vec_id")).alias("ids"), F.min_by("v", "vec_id").alias("v")))
    n, dims, least = classes.agg(F.count(F.lit(1)), F.max(F.size("v")), F.min(F.size("v"))).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if n == 0:
        return empty
    if least < dims:
        lengths = sorted(r[0] for r in classes.select(F.size("v")).distinct().collect())  # one number per length
        of = lambda df, d: df.where(F.size("embedding") == d)
        return reduce(DataFrame.union, [nearest(of(vectors, d), of(queries, d), k, trees, leaf, sample, recall) for d in lengths])
    share = F.pmod(F.xxhash64(F.lit("forest"), "id"), F.lit(1 << 30)) / float(1 << 30)
    sample = min(sample, SAMPLE_NUMBERS // dims)
    taken = classes.where(share < sample / n).select("id", "v").orderBy("id").collect()  # about ``sample`` rows at most
    taken = taken or classes.select("id", "v").orderBy("id").limit(1).collect()
    points = np.array([r["v"] for r in taken])
    forest = grow(points, trees, leaf)
    search_k = max(LEAST_SEARCH, int(np.ceil(calibrate(forest, points, k, recall) * n)))
    held = spark.sparkContext.broadcast(forest)
    value = dict(classes.dtypes)["v"]

    def to_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                leaves = route(held.value, _matrix(part.column("v")))
                rows = pa.array(np.repeat(np.arange(len(leaves)), trees))
                flat = leaves.ravel().astype(np.int32)
                columns = [pa.array(np.tile(np.arange(trees, dtype=np.int32), len(leaves))), pa.array(flat // TOGETHER), pa.array(flat), part.column("id").take(rows), part.column("v").take(rows)]
                yield pa.RecordBatch.from_arrays(columns, ["tree", "cell", "leaf", "id", "v"])

    routed = classes.select("id", "v").mapInArrow(to_leaves, f"tree int, cell int, leaf int, id long, v {value}")
    sizes = np.zeros((trees, 1 << forest.depth), np.int64)
    for r in routed.groupBy("tree", "leaf").count().collect():  # trees * leaves rows, a number that the sample bounds
        sizes[r["tree"], r["leaf"]] = r["count"]
    held_sizes = spark.sparkContext.broadcast(sizes)

    asked = cut_lineage(pick(queries).select("vec_id", "h1", "h2").distinct().join(classes.select("h1", "h2", "id"), ["h1", "h2"]))
    asked_classes = classes.select("id", "v").join(asked.select("id").distinct(), "id", "left_semi")

    def to_visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                rows, cells = [], []
                for i, found in enumerate(visits(held.value, held_sizes.value, _matrix(part.column("v")), search_k)):
                    masks: dict[tuple[int, int], int] = {}
                    for t, f in found:
                        masks[t, f // TOGETHER] = masks.get((t, f // TOGETHER), 0) | 1 << f % TOGETHER
                    rows += [i] * len(masks)
                    cells += [(t, c, m) for (t, c), m in masks.items()]
                columns = np.array(cells, np.int32).reshape(-1, 3)
                take = pa.array(rows, pa.int64())
                arrays = [*[pa.array(columns[:, i].copy()) for i in range(3)], part.column("id").take(take), part.column("v").take(take)]
                yield pa.RecordBatch.from_arrays(arrays, ["tree", "cell", "leaves", "q", "qv"])

    # the queue costs more than reading queries does: spread them over all cores
    spread = asked_classes.repartition(spark.sparkContext.defaultParallelism, "id")
    visited = cut_lineage(spread.mapInArrow(to_visits, f"tree int, cell int, leaves int, q long, qv {value}"))
    # a cell's vectors and its queries are dealt to blocks; every block of the one meets every block of the other
    cells = np.add.reduceat(sizes, np.arange(0, sizes.shape[1], TOGETHER), axis=1)
    listed = spark.createDataFrame([(t, c, -(-int(m) // BLOCK)) for t, row in enumerate(cells) for c, m in enumerate(row) if m], "tree int, cell int, nv int")
    asks = visited.groupBy("tree", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("nq"))
    parts = F.broadcast(listed.join(asks, ["tree", "cell"]))  # at most trees * leaves rows
    deal = lambda df, id_, own, other: (
        df.join(parts, ["tree", "cell"])
        .withColumn(f"b{own}", F.pmod(F.xxhash64(id_), F.col(f"n{own}")).cast("int"))
        .withColumn(f"b{other}", F.explode(F.sequence(F.lit(0), F.col(f"n{other}") - 1)))
        .drop("nv", "nq")
    )
    by = ["tree", "cell", "bv", "bq"]

    def rank(a: pa.Table, b: pa.Table) -> pa.Table:
        found = _best(a, b, k + 1) if a.num_rows and b.num_rows else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table(dict(zip(("q", "id", "score"), found)))

    left, right = deal(visited, "q", "q", "v"), deal(routed, "id", "v", "q")
    ranked = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(rank, "q long, id long, score double")
    top = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "id"))
    best = ranked.groupBy("q", "id").agg(F.max("score").alias("score")).withColumn("_n", top).where(F.col("_n") <= k + 1).drop("_n")
    # back to rows: each class stands for its lowest ids, each asked class for its queries
    rows = best.join(classes.select("id", "ids"), "id").select("q", "score", F.explode("ids").alias("vec_id"))
    rows = rows.withColumn("_n", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("_n") <= k + 1)
    answers = asked.select(F.col("vec_id").alias("query_id"), F.col("id").alias("q")).join(rows.drop("_n"), "q").where("vec_id <> query_id")
    final = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", final).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
