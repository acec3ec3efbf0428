"""Near-duplicate groups by MinHash bands and odd sketches, every link confirmed on full shingle sets.

1. One pass over the texts: size and 128-bit digest of each shingle set, MinHash band keys, an odd sketch. Equal sets become one class.
2. Classes that share a band key are candidates. Keys with the same smallest member become one cell, so a group that shares fifty keys is
   looked at once. A cell's members are compared with its smallest member, so a group of n gives n - 1 pairs; odd sketches (parities of
   MinHash samples; the population count of their XOR estimates the similarity) drop pairs far from the threshold. What is left joins
   classes into families. Then the members of a cell outside its largest family are compared by sketch with all its members, in blocks,
   and families with a near pair are joined: every pair that may be a link now lies in one family.
3. The pairs found are confirmed on the full sets. Where a family still falls apart, members outside its largest part are compared with
   all its members in blocks that hold the texts, and only links between parts leave a block. So no link is lost, and the rows written
   follow the number of documents, not of pairs.

Fifty bands of six rows miss a pair of similarity 0.8 with probability below 3e-7; the sketch margin is over five standard errors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from driftfield.llm import blocks as B
from driftfield.operators.ranks import join_per_key
from driftfield.session import cut_lineage

BANDS, ROWS = 50, 6
SAMPLES, BITS = 1024, 2048
MARGIN = 0.08
BLOCK = 1024
TEXT_BLOCK = 256
#: Narrow rows that a task of a small table is given.
ROWS_PER_TASK = 100_000
#: Up to so many ids are broadcast to pick texts by; beyond, texts and ids are shuffled.
IDS_BROADCAST = 1_000_000
_SKETCH = BITS // 8 + SAMPLES // 8

_XOR = B.mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)).astype(np.uint32)
_MULTIPLY = (B.mix64(np.arange(1001, BANDS * ROWS + 1001, dtype=np.uint64)).astype(np.uint32)) | np.uint32(1)


def _band_keys(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(texts, BANDS) keys: the smallest hash under each of BANDS * ROWS functions, ROWS of them per key."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    keys = np.zeros((len(starts), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(starts), band + 1, np.uint64)
        for row in range(ROWS):
            f = band * ROWS + row
            least = np.minimum.reduceat((short ^ _XOR[f]) * _MULTIPLY[f], starts)
            key = B.mix64(key + least.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        keys[:, band] = key
    return keys


def _odd_sketches(rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """(n, _SKETCH) bytes: parities of one MinHash sample per bin, and which bins have one."""
    bins = hashes & np.uint64(SAMPLES - 1)
    order = np.sort(rows.astype(np.uint64) << np.uint64(54) | bins << np.uint64(44) | hashes >> np.uint64(20))
    first = np.ones(len(order), bool)
    first[1:] = order[1:] >> np.uint64(44) != order[:-1] >> np.uint64(44)
    sample = order[first]
    row = (sample >> np.uint64(54)).astype(np.int64)
    bin_no = (sample >> np.uint64(44)).astype(np.int64) & (SAMPLES - 1)
    bit = (B.mix64(sample & np.uint64((1 << 54) - 1)) & np.uint64(BITS - 1)).astype(np.int64)
    odd = (np.bincount(row * BITS + bit, minlength=n * BITS) & 1).astype(bool).reshape(n, BITS)
    filled = np.zeros((n, SAMPLES), bool)
    filled[row, bin_no] = True
    return np.concatenate([np.packbits(odd, axis=1), np.packbits(filled, axis=1)], axis=1)


def _signature(block: B.Block, k: int) -> dict[str, np.ndarray]:
    n = len(block)
    rows, hashes = B.shingles(block, k)
    counts = np.bincount(rows, minlength=n)
    full = np.flatnonzero(counts)
    starts = (np.cumsum(counts) - counts)[full]
    digests = np.zeros((n, 2), np.uint64)
    bands, sketches = np.zeros((n, BANDS), np.uint64), np.zeros((n, _SKETCH), np.uint8)
    if len(full):
        digests[full, 0] = np.add.reduceat(hashes, starts)
        digests[full, 1] = np.add.reduceat(B.mix64(hashes ^ np.uint64(0x5851F42D4C957F2D)), starts)
        bands[full] = _band_keys(hashes, starts)
        sketches = _odd_sketches(rows, hashes, n)
    return {"n_shingles": counts.astype(np.int64), "d1": digests[:, 0].view(np.int64), "d2": digests[:, 1].view(np.int64), "bands": bands, "sketch": sketches}


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, bands, sketch) of every row; an empty set has zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in B.blocks(batch.column("text")):
                s = _signature(b, k)
                n = len(b)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(s["bands"].view(np.int64).ravel()))
                sketch = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * _SKETCH), pa.py_buffer(np.ascontiguousarray(s["sketch"]))])
                columns = [batch.column("doc_id").cast(pa.int64()).slice(b.first, n), *[pa.array(s[c]) for c in ("n_shingles", "d1", "d2")], bands, sketch]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "d1", "d2", "bands", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, bands array<bigint>, sketch binary")


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of sketches (uint64 words on the last axis): matching samples over bins that either fills."""
    split = BITS // 64
    odd = np.bitwise_count(a[..., :split] ^ b[..., :split]).sum(-1, dtype=np.float64)
    filled_a, filled_b = (np.bitwise_count(x[..., split:]).sum(-1, dtype=np.float64) for x in (a, b))
    either = np.bitwise_count(a[..., split:] | b[..., split:]).sum(-1, dtype=np.float64)
    differ = -BITS / 2 * np.log(np.maximum(1 - 2 * odd / BITS, 1e-9))
    return (filled_a + filled_b - differ) / 2 / np.maximum(either, 1)


def _words_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), _SKETCH // 8)


def _likely(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose sketches come near the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = similarity(_words_of(batch.column("sa")), _words_of(batch.column("sb"))) >= least
            yield batch.select(["a", "b"]).filter(pa.array(near))

    side = lambda id_, s: sketches.select(F.col("doc_id").alias(id_), F.col("sketch").alias(s))
    return pairs.join(side("a", "sa"), "a").join(side("b", "sb"), "b").mapInArrow(run, "a bigint, b bigint")


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, threshold: tuple[int, int]) -> DataFrame:
    """(a, b, linked): ``share * |intersection| >= percent * |union|`` on the full shingle sets."""
    times, of = threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            at = 0
            sizes = np.array(batch.column("ta").to_pandas().str.len()) + np.array(batch.column("tb").to_pandas().str.len())
            piece = np.cumsum(sizes) // B.BLOCK_BYTES
            for end in np.append(np.flatnonzero(np.diff(piece)) + 1, len(piece)):
                sets = []
                for c in ("ta", "tb"):
                    part = batch.column(c).slice(at, end - at)
                    got = [(b.first, *B.shingles(b, k)) for b in B.blocks(part)]
                    rows = np.concatenate([r + first for first, r, _ in got])
                    sets.append((rows, B.by_row(rows, np.concatenate([h for _, _, h in got]))))
                (rows_a, a), (rows_b, b) = sets
                n = int(end - at)
                both = np.bincount(rows_a[np.isin(a, b)], minlength=n)
                either = np.bincount(rows_a, minlength=n) + np.bincount(rows_b, minlength=n) - both
                linked.append(times * both >= of * either)
                at = end
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(np.concatenate([np.zeros(0, bool), *linked]))], ["a", "b", "linked"])

    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint, linked boolean")


def _tasks(rows: int) -> int:
    """How many tasks a table of so many narrow rows is worth: a shuffle of few rows need not make as many files as one of many."""
    return max(4, -(-rows // ROWS_PER_TASK))


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node that these links reach), without a node's link to itself."""
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = code[: len(a)], code[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], least)
        np.minimum.at(new, label[right], least)
        while not np.array_equal(new[new], new):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[own], nodes[label[own]]


def _contracted(links: DataFrame) -> DataFrame:
    """The links of each Arrow batch as stars around the smallest node that they reach in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = _forest(batch.column("a").to_numpy(), batch.column("b").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return links.select("a", "b").mapInArrow(run, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that links reach, for every node of ``links(a, b)``.

    Links are first contracted where they lie. Then every round gives each node's larger neighbours its smallest neighbour (large star), and
    does so for the smaller ones (small star); it ends when all links are a node and its component. Rounds grow with the logarithm of the
    longest chain, tasks with the number of links.
    """
    check = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    links = links.where("a <> b")
    n = _tasks(links.count())
    edges = cut_lineage(_contracted(links.coalesce(n)).distinct().coalesce(n))
    state = check(edges)
    while state[0]:
        n = _tasks(2 * state[0])
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).coalesce(n)
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(n)
        large = cut_lineage(large)
        least = large.groupBy("a").agg(F.min("b").alias("m")).coalesce(n)
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b")))
        edges = cut_lineage(small.coalesce(n).distinct().coalesce(n))
        before, state = state, check(edges)
        if before == state:
            break
    nodes = edges.select(F.col("b").alias("node")).distinct().coalesce(n)
    return cut_lineage(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(nodes.select("node", F.col("node").alias("component"))))


def _near_elsewhere(cells: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) near enough that join the components of ``cells(cell, doc_id, component)``, wherever two of a cell have such a pair.

    Members outside a cell's largest component are compared with all its members: both are dealt to blocks by hash, and a task compares
    two blocks and names one pair for each two components that it joins.
    """
    sizes = cells.groupBy("cell", "component").agg(F.count(F.lit(1)).alias("n"))
    whole = sizes.groupBy("cell").agg(F.sum("n").alias("members"), F.max(F.struct("n", "component")).alias("main")).where("members > main.n")
    plan = whole.select("cell", F.col("main.component").alias("main"), F.ceil((F.col("members") - F.col("main.n")) / BLOCK).cast("int").alias("ns"), F.ceil(F.col("members") / BLOCK).cast("int").alias("na"))
    each = cut_lineage(join_per_key(cells, cut_lineage(plan), "cell"))
    columns = ["cell", "i", "j", "straggler", "doc_id", "component"]
    placed = _in_blocks(each.withColumn("straggler", F.col("component") != F.col("main")), columns).join(sketches, "doc_id")

    def run(table: pa.Table) -> pa.Table:
        ids, part = (table.column(c).to_numpy() for c in ("doc_id", "component"))
        part = np.unique(part, return_inverse=True)[1]
        words = _words_of(table.column("sketch").combine_chunks())
        role = table.column("straggler").to_numpy()
        right = np.flatnonzero(~role)
        found = []
        for x in np.flatnonzero(role):
            near = right[part[right] != part[x]]
            near = near[similarity(words[x], words[near]) >= least]
            parts, first = np.unique(part[near], return_index=True)
            if len(parts):
                found += [(ids[x], ids[y]) for y in near[first]]
                part[np.isin(part, parts)] = part[x]
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": pairs.max(1), "b": pairs.min(1)})

    return placed.groupBy("cell", "i", "j").applyInArrow(run, "a bigint, b bigint")


def _in_blocks(each: DataFrame, columns: list[str]) -> DataFrame:
    """``each(..., doc_id, straggler, ns, na)`` in cells (i, j): one of ``ns`` blocks of stragglers beside one of ``na`` blocks of all rows."""
    place = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    stragglers = each.where("straggler").withColumn("i", place("ns")).withColumn("j", spread("na"))
    others = each.withColumns({"j": place("na"), "straggler": F.lit(False)}).withColumn("i", spread("ns"))
    return stragglers.select(*columns).union(others.select(*columns))


def _families(likely: DataFrame, cells: DataFrame, sketches: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(pairs, families): components of near pairs such that no near pair of one cell lies across two of them.

    Each member outside its cell's main component meets all others, and every two components with a near pair are joined, so once is enough.
    """
    families = components(likely)
    n = _tasks(cells.count())
    held = cells.join(families.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("cell", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    more = cut_lineage(_near_elsewhere(cut_lineage(held.coalesce(n)), sketches, least).coalesce(n))
    if more.isEmpty():
        return likely, families
    return cut_lineage(likely.union(more).coalesce(n)), components(families.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))


def _sets_and_sketches(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles as (row, hash), and sketches."""
    rows, hashes, sketches = [], [], []
    for block in B.blocks(texts):
        r, h = B.shingles(block, k)
        rows.append(r + block.first)
        hashes.append(h)
        sketches.append(_odd_sketches(r, h, len(block)))
    return np.concatenate(rows), np.concatenate(hashes), np.ascontiguousarray(np.concatenate(sketches)).view(np.uint64)


def _links_between(table: pa.Table, k: int, threshold: tuple[int, int], least: float) -> list[tuple[int, int]]:
    """Links of stragglers with members of other parts; one for each two parts that they join here."""
    times, of = threshold
    ids, parts = (table.column(c).to_numpy() for c in ("doc_id", "part"))
    role = table.column("straggler").to_numpy(zero_copy_only=False)
    left, right = np.flatnonzero(role), np.flatnonzero(~role)
    rows, hashes, sketches = _sets_and_sketches(table.column("text").combine_chunks(), k)
    sizes = np.bincount(rows, minlength=len(ids))
    kinds, code = np.unique(hashes, return_inverse=True)
    bounds = np.searchsorted(rows, np.arange(len(ids) + 1))
    on_right = np.zeros(len(ids), bool)
    on_right[right] = True
    right_rows, right_code = rows[on_right[rows]], code[on_right[rows]]
    root = {int(p): int(p) for p in parts}

    def find(p: int) -> int:
        while root[p] != p:
            root[p] = root[root[p]]
            p = root[p]
        return p

    links = []
    present = np.zeros(len(kinds), bool)
    for x in left:
        near = right[(similarity(sketches[x], sketches[right]) >= least) & (parts[right] != parts[x])]
        if not len(near):
            continue
        own = code[bounds[x] : bounds[x + 1]]
        present[own] = True
        both = np.bincount(right_rows, weights=present[right_code], minlength=len(ids))[near].astype(np.int64)
        present[own] = False
        for y in near[times * both >= of * (sizes[x] + sizes[near] - both)]:
            p, q = find(int(parts[x])), find(int(parts[y]))
            if p != q:
                root[max(p, q)] = min(p, q)
                links.append((int(ids[x]), int(ids[y])))
    return links


def _rest_of_families(families: DataFrame, found: DataFrame, tested: DataFrame, texts: DataFrame, k: int, threshold: tuple[int, int], least: float) -> DataFrame:
    """Links (a, b) between parts of one family, beyond the pairs tested."""
    held = families.select(F.col("node").alias("doc_id"), F.col("component").alias("family")).join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    held = cut_lineage(held.select("family", "doc_id", F.coalesce("component", "doc_id").alias("part")))
    done = tested.join(families.select(F.col("node").alias("a"), F.col("component").alias("family")), "a").groupBy("family").agg(F.count(F.lit(1)).alias("pairs"))
    sizes = held.groupBy("family", "part").agg(F.count(F.lit(1)).alias("n"))
    whole = sizes.groupBy("family").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("members"), F.max(F.struct("n", "part"))["part"].alias("main"), F.max("n").alias("most"))
    split = whole.join(done, "family").where("parts > 1 and pairs < members * (members - 1) / 2")
    blocks = split.select("family", "main", F.ceil((F.col("members") - F.col("most")) / TEXT_BLOCK).cast("int").alias("ns"), F.ceil(F.col("members") / TEXT_BLOCK).cast("int").alias("na"))
    each = cut_lineage(join_per_key(held, cut_lineage(blocks), "family"))
    columns = ["family", "i", "j", "straggler", "doc_id", "part"]
    placed = _in_blocks(each.withColumn("straggler", F.col("part") != F.col("main")), columns).join(texts, "doc_id")

    def run(table: pa.Table) -> pa.Table:
        pairs = np.array(_links_between(table, k, threshold, least), np.int64).reshape(-1, 2)
        return pa.table({"a": pairs.max(1), "b": pairs.min(1)})

    return placed.groupBy("family", "i", "j").applyInArrow(run, "a bigint, b bigint")


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents named, written once."""
    ids = cut_lineage(ids.distinct())
    picked = F.broadcast(ids) if ids.count() <= IDS_BROADCAST else ids
    return cut_lineage(docs.select("doc_id", "text").where("text is not null").join(picked, "doc_id", "left_semi"))


def near_duplicates(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (100, 80)) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs(doc_id, text)``.

    Documents are linked if ``100 * |intersection| >= 80 * |union|`` of their sets of distinct ``k``-word shingles (A-Z lower-cased; a
    text with fewer words has one shingle). ``component_id`` is the smallest id reachable, ``kept`` marks the document that has it. Null,
    empty and wordless texts have no shingle and are linked with nothing. Rows that repeat an id count as one document with all links of
    its texts. Rows with a null ``doc_id`` stay: unlinked, with a null component, ``kept`` true.
    """
    least = threshold[1] / threshold[0] - MARGIN
    signed = cut_lineage(signatures(docs, k))
    linkable = signed.where("n_shingles > 0 and doc_id is not null")
    smallest = linkable.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "bands", "sketch")).alias("m"))
    classes = cut_lineage(smallest.select("d1", "d2", F.col("m.doc_id").alias("first"), "m.bands", "m.sketch"))
    keys = classes.select(F.col("first").alias("doc_id"), F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("doc_id").alias("cell"), F.max("doc_id").alias("last")).where("cell < last").drop("last")
    cells = cut_lineage(join_per_key(keys, cut_lineage(shared), "key").select("cell", "doc_id").distinct())
    sketches = classes.select(F.col("first").alias("doc_id"), "sketch")
    pairs = cells.where("doc_id > cell").select(F.col("doc_id").alias("a"), F.col("cell").alias("b"))
    likely = cut_lineage(_likely(pairs, sketches, least))
    near, families = _families(likely, cells, sketches, least)
    texts = _texts_of(docs, families.select(F.col("node").alias("doc_id")))
    tested = cut_lineage(_confirmed(near, texts, k, threshold))
    found = components(tested.where("linked"))
    rest = cut_lineage(_rest_of_families(families, found, tested, texts, k, threshold, least))
    if not rest.isEmpty():
        found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(rest))
    of_class = classes.join(found.withColumnRenamed("node", "first"), "first", "left").select("d1", "d2", F.coalesce("component", "first").alias("component"))
    rows = signed.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("d1")).alias("d1"), "d2")
    joined = join_per_key(rows.where("d1 is not null"), cut_lineage(of_class), ["d1", "d2"], "left").select("doc_id", "n_shingles", "component")
    joined = joined.union(rows.where("d1 is null").select("doc_id", "n_shingles", F.lit(None).cast("bigint")))
    component = F.coalesce("component", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, k: int = 5, threshold: tuple[int, int] = (100, 80)) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each group, columns unchanged; rows that repeat id and text go."""
    kept = near_duplicates(docs, k, threshold).where("kept").select("doc_id").distinct()
    unnamed = docs.where("doc_id is null")
    return docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*[f"`{c}`" for c in docs.columns]).union(unnamed)
