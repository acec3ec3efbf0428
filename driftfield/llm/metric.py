"""Exact joins of documents by the Jaccard distance of their shingle sets, a metric: pivots, Voronoi regions, triangle-inequality windows.

With r = 1 - threshold, two documents are linked if their distance is at most r. Pivots are points of the same space, of two kinds:

1. *Single shingles* come first. Two texts that share nothing are at distance 1 from each other and from every document but their own
   kind, so windows around document pivots would hold everything; a set of one shingle is near to just the documents that hold it. All
   shingles are pivots, ordered by how many documents hold them (what is nearest when distances tie): a document's region is its rarest
   shingle's. A linked document lacks at most m = n - ceil(threshold * n) of its n shingles, so its nearest pivot is among the first m + 1
   of them: that is the window, and a document is copied to so many regions, no more. A shingle that one document alone holds needs no
   region; a document whose window holds only such is linked with nothing, and a cheap pass over a part of the shingle space finds most of
   these documents before any set is sent.
2. *Documents.* Regions with the same smallest member become one cell, with that member as its pivot. Within a cell the distances to
   some pivots are computed; each document goes to the region of its nearest pivot and, by the triangle inequality, to every one that is at
   most 2 r farther; regions are joined in the same way again. Documents within r of a pivot are linked to it, and regions whose members
   are all in one component need no further look. Cells too large for a task are split by Spark, dealt to chunks that get the pivots'
   sets; smaller ones recurse inside one task. Where windows cannot separate a cell (its documents are all as near to each other), the
   documents outside its largest component are compared with all of it in blocks.

Every link is confirmed on whole sets; one link for each two parts that it joins leaves a task, so rows follow documents, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from driftfield.llm import blocks as B
from driftfield.llm.neardup import components
from driftfield.operators.ranks import join_per_key
from driftfield.session import cut_lineage

#: The part of the shingle space that the first pass looks at, of 256.
FIRST_PASS = 77
#: Shingles and documents of a block, and bytes of shingles that a bucket is made for.
BLOCK_SHINGLES, BLOCK_DOCS = 1 << 20, 60_000
BUCKET_BYTES = 32 << 20
#: Cells of more documents or shingles are split by Spark into chunks and blocks of these sizes.
CELL, CELL_SHINGLES = 1024, 4_000_000
CHUNK, BLOCK = 1024, 256
PIVOTS = 8
#: A cell of no more documents is compared directly; so is one of whose documents a region keeps a larger share.
SMALL, TOO_LARGE = 32, 0.7
IDS_BROADCAST = 1_000_000
_SEVERAL = np.uint16(65535)


def _block_number() -> Iterator[int]:
    number = TaskContext.get().partitionId() << 33
    while True:
        yield number
        number += 1


def _shingle_blocks(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(ids, row, hash) of whole texts, up to about BLOCK_SHINGLES shingles at a time."""
    for batch in batches:
        ids = batch.column("doc_id").cast(pa.int64())
        rows, hashes, first, n, held = [], [], 0, 0, 0
        for b in B.blocks(batch.column("text")):
            r, h = B.shingles(b, k)
            rows.append(r + n)
            hashes.append(h)
            n, held = n + len(b), held + len(h)
            if held >= BLOCK_SHINGLES or n >= BLOCK_DOCS - B.BLOCK_ROWS:
                yield ids.slice(first, n), np.concatenate(rows), np.concatenate(hashes)
                rows, hashes, first, n, held = [], [], first + n, 0, 0
        if n:
            yield ids.slice(first, n), np.concatenate(rows), np.concatenate(hashes)


def _buckets(docs: DataFrame) -> int:
    """How many buckets keep one at about BUCKET_BYTES: a word of six bytes gives a shingle, a third of which are sent with ten bytes each."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return int(max(64, size // (2 * BUCKET_BYTES)))


def _packed(buckets: np.ndarray, block: int, *columns: np.ndarray) -> Iterator[tuple[int, int, list[bytes]]]:
    """Columns cut by bucket, as bytes."""
    order = np.argsort(buckets, kind="stable")
    cuts = np.flatnonzero(np.diff(buckets[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(buckets[part[0]]), block, [c[part].tobytes() for c in columns]


def _joined(column: pa.ChunkedArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Values of all rows one after another, and how many each row has."""
    parts = [np.frombuffer(x, dtype) for x in column.to_pylist()]
    return np.concatenate([np.zeros(0, dtype), *parts]), np.array([len(p) for p in parts], np.int64)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, alone) of every row: size and 128-bit digest of its set, and how many of the first pass's shingles no other
    row holds. ``docs`` must give its rows in the same order if it is read again after a loss, as tables do."""
    n_buckets = _buckets(docs)
    lists = ["doc_id", "n_shingles", "d1", "d2"]
    schema = "bucket int, block bigint, " + ", ".join(f"{c} array<bigint>" for c in lists) + ", hashes binary, rows binary"
    names = ["bucket", "block", *lists, "hashes", "rows"]
    types = [pa.int32(), pa.int64(), *[pa.list_(pa.int64())] * 4, pa.binary(), pa.binary()]
    arrow = pa.schema(list(zip(names, types)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _block_number()
        for ids, rows, hashes in _shingle_blocks(batches, k):
            block, n = next(number), len(ids)
            counts = np.bincount(rows, minlength=n)
            total = np.zeros((2, len(hashes) + 1), np.uint64)
            np.cumsum(hashes, out=total[0, 1:])
            np.cumsum(B.mix64(hashes ^ np.uint64(0x5851F42D4C957F2D)), out=total[1, 1:])
            ends = np.cumsum(counts)
            d1, d2 = ((t[ends] - t[ends - counts]).view(np.int64) for t in total)
            yield pa.RecordBatch.from_pydict(dict(zip(names, [[block % n_buckets], [block], [ids], [pa.array(counts)], [pa.array(d1)], [pa.array(d2)], [None], [None]])), arrow)
            part = (hashes >> np.uint64(56)) < FIRST_PASS
            own, rows = hashes[part], rows[part]
            order = np.argsort(own, kind="stable")
            own, rows = own[order], rows[order].astype(np.uint16)
            first = np.ones(len(own), bool)
            first[1:] = own[1:] != own[:-1]
            again = np.zeros(len(own), bool)
            again[:-1] = ~first[1:]
            rows[again] = _SEVERAL
            own, rows = own[first], rows[first]
            out = [(b, at, None, None, None, None, *c) for b, at, c in _packed((own % np.uint64(n_buckets)).astype(np.int64), block, own, rows)]
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out)))), arrow)

    def unique(table: pa.Table) -> pa.Table:
        """Rows of shingles that occur once in all, by block; what blocks say about their documents goes on as it is."""
        heads = table.filter(table["hashes"].is_null())
        sent = table.filter(table["hashes"].is_valid())
        hashes, counts = _joined(sent["hashes"], np.uint64)
        rows, _ = _joined(sent["rows"], np.uint16)
        source = np.repeat(np.arange(len(counts)), counts)
        order = np.argsort(hashes, kind="stable")
        same = np.zeros(len(hashes) + 1, bool)
        same[1:-1] = hashes[order][1:] == hashes[order][:-1]
        single = order[~same[1:] & ~same[:-1]]
        single = np.sort(single[rows[single] != _SEVERAL])
        found = np.split(rows[single], np.searchsorted(source[single], np.arange(1, len(counts)))) if len(counts) else []
        found = pa.array([f.tobytes() for f in found], pa.binary())
        return pa.concat_tables([heads, sent.set_column(names.index("rows"), table.schema.field("rows"), found)])

    def count(table: pa.Table) -> pa.Table:
        head = table.filter(table["doc_id"].is_valid()).slice(0, 1)
        columns = {c: head[c].combine_chunks().flatten() for c in lists}
        rows, _ = _joined(table.filter(table["rows"].is_valid())["rows"], np.uint16)
        return pa.table({**columns, "alone": pa.array(np.bincount(rows, minlength=len(columns["doc_id"])).astype(np.int64))})

    sent = docs.select("doc_id", "text").mapInArrow(send, schema)
    back = sent.groupBy("bucket").applyInArrow(unique, schema)
    return back.groupBy("block").applyInArrow(count, "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, alone bigint")


def _sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(block, doc_id, n, hashes) of the documents named, hashes in order."""
    picked = F.broadcast(ids) if ids.count() <= IDS_BROADCAST else ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _block_number()
        for ids, rows, hashes in _shingle_blocks(batches, k):
            order = np.lexsort((hashes, rows))
            counts = np.bincount(rows, minlength=len(ids))
            offsets = pa.py_buffer(np.concatenate([[0], np.cumsum(counts) * 8]).astype(np.int32))
            sets = pa.Array.from_buffers(pa.binary(), len(ids), [None, offsets, pa.py_buffer(hashes[order])])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), next(number))), ids, pa.array(counts.astype(np.int64)), sets], ["block", "doc_id", "n", "hashes"])

    named = docs.select("doc_id", "text").where("text is not null").join(picked, "doc_id", "left_semi")
    return named.mapInArrow(run, "block bigint, doc_id bigint, n bigint, hashes binary").where("n > 0")


def _windows(sets: DataFrame, n_buckets: int, threshold: tuple[int, int]) -> DataFrame:
    """(pivot, doc_id): the single-shingle pivots, held by two documents or more, within each document's window."""
    times, of = threshold

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            at = 0
            for end in np.append(np.flatnonzero(np.diff(blocks)) + 1, len(blocks)):
                kinds, counts = np.unique(_joined(batch.column("hashes").slice(at, end - at), np.uint64)[0], return_counts=True)
                out = [(b, n, *c) for b, n, c in _packed((kinds % np.uint64(n_buckets)).astype(np.int64), int(blocks[at]), kinds, counts.astype(np.uint32))]
                at = end
                if out:
                    yield pa.RecordBatch.from_pydict(dict(zip(["bucket", "block", "hashes", "counts"], map(list, zip(*out)))), pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())]))

    def add(table: pa.Table) -> pa.Table:
        hashes, sizes = _joined(table["hashes"], np.uint64)
        counts, _ = _joined(table["counts"], np.uint32)
        source = np.repeat(np.arange(len(sizes)), sizes)
        kinds, code = np.unique(hashes, return_inverse=True)
        total = np.minimum(np.bincount(code, weights=counts), 2**32 - 1).astype(np.uint32)[code]
        shared = np.flatnonzero(total > 1)
        cuts = np.searchsorted(source[shared], np.arange(1, len(sizes)))
        cut = lambda x: pa.array([p.tobytes() for p in np.split(x[shared], cuts)], pa.binary())
        return pa.table({"block": table["block"], "hashes": cut(hashes), "counts": cut(total)})

    def window(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        hashes, sizes = _joined(left["hashes"], np.uint64)
        kinds, _ = _joined(right["hashes"], np.uint64)
        holders, _ = _joined(right["counts"], np.uint32)
        order = np.argsort(kinds)
        kinds, holders = kinds[order], holders[order]
        row = np.repeat(np.arange(len(sizes)), sizes)
        at = np.minimum(np.searchsorted(kinds, hashes), max(len(kinds) - 1, 0))
        shared = kinds[at] == hashes if len(kinds) else np.zeros(len(hashes), bool)
        row, hashes, count = row[shared], hashes[shared], holders[at[shared]] if len(kinds) else holders
        # shingles of one holder come first in the order
        single = sizes - np.bincount(row, minlength=len(sizes))
        order = np.lexsort((hashes, count, row))
        row, hashes = row[order], hashes[order]
        place = np.arange(len(row)) - np.searchsorted(row, np.arange(len(sizes)))[row]
        wide = sizes - -(-of * sizes // times) + 1 - single
        near = place < wide[row]
        ids = left["doc_id"].to_numpy()
        return pa.table({"pivot": hashes[near].view(np.int64), "doc_id": ids[row[near]]})

    counts = sets.select("block", "hashes").mapInArrow(send, "bucket int, block bigint, hashes binary, counts binary")
    back = counts.groupBy("bucket").applyInArrow(add, "block bigint, hashes binary, counts binary")
    left = sets.select(F.col("block").alias("of_block"), "doc_id", "hashes")
    return left.groupBy("of_block").cogroup(back.groupBy("block")).applyInArrow(window, "pivot bigint, doc_id bigint")


class _Cell:
    """Documents of a cell with their sets, and which of them are known to be in one component."""

    def __init__(self, ids: np.ndarray, hashes: np.ndarray, sizes: np.ndarray, parts: np.ndarray, threshold: tuple[int, int]):
        self.ids, self.sizes = ids, sizes
        self.times, self.of = threshold
        self.reach = 1 - self.of / self.times + 1e-9
        self.code = np.unique(hashes, return_inverse=True)[1] if len(hashes) else np.zeros(0, np.int64)
        self.ends = np.cumsum(sizes)
        self.part = np.unique(parts, return_inverse=True)[1]
        self.links: list[tuple[int, int]] = []
        self.held = np.zeros(int(self.code.max()) + 1 if len(self.code) else 1, bool)

    def rows(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among members, shingle) of the sets of members."""
        sizes = self.sizes[members]
        ends = np.cumsum(sizes)
        place = np.arange(int(ends[-1])) - np.repeat(ends - sizes, sizes) + np.repeat(self.ends[members] - sizes, sizes)
        return np.repeat(np.arange(len(members)), sizes), self.code[place]

    def overlaps(self, x: int, rows: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
        own = self.code[self.ends[x] - self.sizes[x] : self.ends[x]]
        self.held[own] = True
        both = np.bincount(rows[0][self.held[rows[1]]], minlength=n)
        self.held[own] = False
        return both

    def link(self, x: int, members: np.ndarray, both: np.ndarray) -> None:
        """Links of x with members, where parts are joined by them."""
        linked = members[self.times * both >= self.of * (self.sizes[x] + self.sizes[members] - both)]
        others = linked[self.part[linked] != self.part[x]]
        if len(others):
            parts, first = np.unique(self.part[others], return_index=True)
            self.links += [(int(self.ids[x]), int(self.ids[y])) for y in others[first]]
            self.part[np.isin(self.part, parts)] = self.part[x]

    def direct(self, members: np.ndarray) -> None:
        """Documents outside the largest component against all."""
        names, counts = np.unique(self.part[members], return_counts=True)
        rows = self.rows(members)
        for x in members[self.part[members] != names[np.argmax(counts)]]:
            self.link(x, members, self.overlaps(x, rows, len(members)))

    def join(self, members: np.ndarray) -> None:
        if len(members) < 2 or (self.part[members] == self.part[members[0]]).all():
            return
        if len(members) <= SMALL:
            return self.direct(members)
        rows = self.rows(members)
        distances, farthest = [], 0
        nearest = np.full(len(members), np.inf)
        while len(distances) < PIVOTS and nearest[farthest] > 0:
            x = members[farthest]
            both = self.overlaps(x, rows, len(members))
            self.link(x, members, both)
            distances.append(1 - both / (self.sizes[x] + self.sizes[members] - both))
            nearest = np.minimum(nearest, distances[-1])
            farthest = int(np.argmax(nearest))
        regions = [members[d <= nearest + 2 * self.reach] for d in distances]
        if max(map(len, regions)) > TOO_LARGE * len(members):
            return self.direct(members)
        for region in regions:
            self.join(region)


def _cell_of(table: pa.Table, parts: np.ndarray, threshold: tuple[int, int]) -> _Cell:
    hashes, sizes = _joined(table["hashes"], np.uint64)
    return _Cell(table["doc_id"].to_numpy(), hashes, sizes, parts, threshold)


def _as_pairs(links: list[tuple[int, int]]) -> pa.Table:
    pairs = np.array(links, np.int64).reshape(-1, 2)
    return pa.table({"a": pairs.max(1), "b": pairs.min(1)})


def _with_parts(cells: DataFrame, links: DataFrame) -> DataFrame:
    """``cells(cell, doc_id, ...)`` with ``part``, the component by the links so far."""
    found = components(links).select(F.col("node").alias("doc_id"), "component")
    return cells.join(found, "doc_id", "left").withColumn("part", F.coalesce("component", "doc_id")).drop("component")


def _in_tasks(cells: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Links of cells that fit a task each, from ``cells(cell, doc_id, part)``."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table["doc_id"].to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        cell = _cell_of(table, table["part"].to_numpy(), threshold)
        cell.join(np.arange(len(table)))
        return _as_pairs(cell.links)

    return cells.select("cell", "doc_id", "part").join(sets.select("doc_id", "hashes"), "doc_id").groupBy("cell").applyInArrow(run, "a bigint, b bigint")


def _in_blocks(cells: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Links of cells that windows cannot separate: documents outside a cell's largest part against all its documents."""
    sizes = cells.groupBy("cell", "part").agg(F.count(F.lit(1)).alias("n"))
    whole = sizes.groupBy("cell").agg(F.sum("n").alias("members"), F.max(F.struct("n", "part")).alias("main")).where("members > main.n")
    plan = whole.select("cell", F.col("main.part").alias("main"), F.ceil((F.col("members") - F.col("main.n")) / BLOCK).cast("int").alias("ns"), F.ceil(F.col("members") / CHUNK).cast("int").alias("na"))
    each = cut_lineage(join_per_key(cells.select("cell", "doc_id", "part"), plan, "cell"))
    place = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    stragglers = each.where("part <> main").withColumns({"i": place("ns"), "straggler": F.lit(True)}).withColumn("j", spread("na"))
    others = each.withColumns({"j": place("na"), "straggler": F.lit(False)}).withColumn("i", spread("ns"))
    columns = ["cell", "i", "j", "straggler", "doc_id", "part"]

    def run(table: pa.Table) -> pa.Table:
        cell = _cell_of(table, table["part"].to_numpy(), threshold)
        role = table["straggler"].to_numpy()
        members = np.flatnonzero(~role)
        if not len(members):
            return _as_pairs([])
        rows = cell.rows(members)
        for x in np.flatnonzero(role):
            cell.link(x, members, cell.overlaps(x, rows, len(members)))
        return _as_pairs(cell.links)

    placed = stragglers.select(*columns).union(others.select(*columns)).join(sets.select("doc_id", "hashes"), "doc_id")
    return placed.groupBy("cell", "i", "j").applyInArrow(run, "a bigint, b bigint")


def _split(cells: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(cell, pivot, doc_id, linked): for every document of a cell the pivots whose regions it belongs to or visits, and links to pivots."""
    cells = cells.select("cell", "doc_id", "members")
    picks = cells.groupBy("cell", "members").agg(F.array_distinct(F.array(*[F.min_by("doc_id", F.xxhash64("doc_id", F.lit(j))) for j in range(PIVOTS)])).alias("p"))
    chunks = F.ceil(F.col("members") / CHUNK).cast("int")
    pivots = picks.select(F.col("cell").alias("of_cell"), chunks.alias("chunks"), F.explode("p").alias("doc_id")).join(sets.select("doc_id", "hashes"), "doc_id")
    pivots = pivots.select("of_cell", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("of_chunk"), F.col("doc_id").alias("pivot_id"), F.col("hashes").alias("pivot_hashes"))
    dealt = cells.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), chunks).cast("int")).drop("members").join(sets.select("doc_id", "hashes"), "doc_id")

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        right = pa.table({"doc_id": right["pivot_id"], "hashes": right["pivot_hashes"]})
        both_sides = pa.concat_tables([left.select(["doc_id", "hashes"]), right])
        n, p = len(left), len(right)
        cell = _cell_of(both_sides, np.arange(n + p), threshold)
        if not n:
            return pa.table({c: [] for c in ("cell", "pivot", "doc_id", "linked")}, schema)
        rows = cell.rows(np.arange(n))
        both = np.stack([cell.overlaps(n + j, rows, n) for j in range(p)])
        union = cell.sizes[:n] + cell.sizes[n:, None] - both
        linked = cell.times * both >= cell.of * union
        distance = 1 - both / union
        pivot, row = np.nonzero(distance <= distance.min(axis=0) + 2 * cell.reach)
        ids = cell.ids
        return pa.table({"cell": pa.array(np.full(len(row), key[0].as_py())), "pivot": ids[n + pivot], "doc_id": ids[row], "linked": linked[pivot, row]}, schema)

    schema = pa.schema([("cell", pa.int64()), ("pivot", pa.int64()), ("doc_id", pa.int64()), ("linked", pa.bool_())])
    return dealt.groupBy("cell", "chunk").cogroup(pivots.groupBy("of_cell", "of_chunk")).applyInArrow(run, "cell bigint, pivot bigint, doc_id bigint, linked boolean")


def _sized(cells: DataFrame, sets: DataFrame) -> DataFrame:
    """``cells`` with the number of documents and shingles of each, written."""
    sizes = sets.select("doc_id", "n").distinct()
    of_cell = cells.join(sizes, "doc_id").groupBy("cell").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles"))
    return cut_lineage(join_per_key(cells, of_cell.where("members > 1"), "cell"))


def links_of_cells(cells: DataFrame, sets: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """(a, b): links that connect all documents of ``cells(cell, doc_id)`` that are linked within a cell, directly or through others."""
    fits = f"members <= {CELL} and shingles <= {CELL_SHINGLES}"
    sized = _sized(cells, sets).withColumn("part", F.col("doc_id"))
    links = cut_lineage(_in_tasks(sized.where(fits), sets, threshold))
    large = sized.where(f"not ({fits})")
    while not large.isEmpty():
        visits = cut_lineage(_split(large, sets, threshold))
        links = cut_lineage(links.union(visits.where("linked and pivot <> doc_id").select(F.greatest("pivot", "doc_id").alias("a"), F.least("pivot", "doc_id").alias("b")).distinct()))
        regions = visits.select(F.col("cell").alias("parent"), F.xxhash64("cell", "pivot").alias("cell"), "doc_id")
        sizes = regions.groupBy("parent", "cell").agg(F.count(F.lit(1)).alias("n")).groupBy("parent").agg(F.max("n").alias("most"))
        parents = large.select(F.col("cell").alias("parent"), "members").distinct().join(sizes, "parent")
        dense = cut_lineage(parents.where(F.col("most") > TOO_LARGE * F.col("members")).select(F.col("parent").alias("cell")))
        whole = _with_parts(large.select("cell", "doc_id").join(F.broadcast(dense) if dense.count() <= IDS_BROADCAST else dense, "cell", "left_semi"), links)
        links = cut_lineage(links.union(_in_blocks(cut_lineage(whole), sets, threshold)))
        apart = regions.join(dense.withColumnRenamed("cell", "parent"), "parent", "left_anti").select("cell", "doc_id")
        if apart.isEmpty():
            break
        parted = cut_lineage(_with_parts(_sized(apart, sets), links))
        mixed = parted.groupBy("cell").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x < y").select("cell")
        sized = cut_lineage(parted.join(mixed, "cell", "left_semi"))
        links = cut_lineage(links.union(_in_tasks(sized.where(fits), sets, threshold)))
        large = sized.where(f"not ({fits})")
    return links


def similar_documents(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (100, 80)) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs(doc_id, text)``.

    Documents are linked if ``100 * |intersection| >= 80 * |union|`` of their sets of distinct ``k``-word shingles (A-Z lower-cased; a text with
    fewer words has one shingle), and ``component_id`` is the smallest id that links reach. No link is missed, whatever the groups. Null, empty
    and wordless texts have no shingle and are linked with nothing. Rows that repeat an id count as one document with all links of its texts. A
    row with a null ``doc_id`` stays, unlinked, with a null component. An empty table gives no row; other columns are not read.
    """
    times, of = threshold
    signed = cut_lineage(signatures(docs, k))
    named = signed.where("n_shingles > 0 and doc_id is not null")
    digest = F.struct("d1", "d2")
    twice = cut_lineage(named.groupBy("doc_id").agg(F.min(digest).alias("x"), F.max(digest).alias("y")).where("x <> y").select("doc_id"))
    close = named.where(f"{times} * (n_shingles - alone) >= {of} * n_shingles")
    several = not twice.isEmpty()
    if several:
        close = close.union(named.join(twice, "doc_id", "left_semi").select(*close.columns))
    classes = cut_lineage(close.groupBy("d1", "d2").agg(F.min("doc_id").alias("first")))
    sets = cut_lineage(_sets(docs, classes.select(F.col("first").alias("doc_id")).distinct(), k))
    near = cut_lineage(_windows(sets, _buckets(docs), threshold))
    firsts = near.groupBy("pivot").agg(F.min("doc_id").alias("cell"), F.max("doc_id").alias("last")).where("cell < last").drop("last")
    cells = cut_lineage(join_per_key(near, firsts, "pivot").select("cell", "doc_id").distinct())
    links = links_of_cells(cells, sets, threshold)
    if several:
        texts = named.join(twice, "doc_id", "left_semi").join(classes, ["d1", "d2"])
        links = cut_lineage(links.union(texts.select(F.greatest("doc_id", "first").alias("a"), F.least("doc_id", "first").alias("b"))))
    found = components(links).withColumnRenamed("node", "first")
    of_class = classes.join(found, "first", "left").select("d1", "d2", F.coalesce("component", "first").alias("component"))
    linkable = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    rows = signed.select("doc_id", "n_shingles", F.when(linkable, F.col("d1")).alias("d1"), "d2")
    joined = join_per_key(rows.where("d1 is not null"), cut_lineage(of_class), ["d1", "d2"], "left").select("doc_id", "n_shingles", "component")
    joined = joined.union(rows.where("d1 is null").select("doc_id", "n_shingles", F.lit(None).cast("bigint")))
    return joined.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
