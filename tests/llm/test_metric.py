import random

import numpy as np
import pytest

from driftfield.llm import metric as M
from tests.llm.test_neardup import brute


def compare(docs, k):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in M.similar_documents(docs, k).collect()}
    assert got == {i: v[:2] for i, v in brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], k).items()}
    return got


@pytest.mark.parametrize("k", [2, 5])
def test_documents(small_docs, k):
    compare(small_docs, k)


def drifting(seed, families=12, copies=25):
    """Families whose members drift apart, around the threshold, so that most links do not touch the smallest member."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for family in range(families):
        texts = [rng.choices(vocabulary, k=rng.choice([12, 40, 150]))]
        for _ in range(copies):
            words = list(rng.choice(texts))
            for _ in range(max(1, len(words) * rng.choice([2, 4, 5, 6]) // 100)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(words)
        rows += [" ".join(t) for t in texts]
    rng.shuffle(rows)
    return list(enumerate(rows))


def around_a_passage(seed, n=150):
    """One passage that most texts consist of, with own words before it: all are about as far from each other as the threshold."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    return [(i, " ".join([f"x{rng.randrange(10**6)}" for _ in range(rng.randint(3, 12))] + passage)) for i in range(n)]


def make(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)


@pytest.mark.parametrize("rows", [drifting(4), around_a_passage(1)], ids=["drifting", "passage"])
def test_hard_groups(spark, rows):
    compare(make(spark, rows), 2)


@pytest.mark.parametrize("rows", [drifting(5), around_a_passage(2)], ids=["drifting", "passage"])
@pytest.mark.parametrize("too_large", [0.7, 1.0])
def test_cells_split_by_spark(spark, monkeypatch, rows, too_large):
    """The same with cells, chunks and blocks so small that every group takes several, by regions and by blocks."""
    for name, value in {"CELL": 8, "CHUNK": 7, "BLOCK": 3, "SMALL": 4, "PIVOTS": 3, "IDS_BROADCAST": 1, "TOO_LARGE": too_large}.items():
        monkeypatch.setattr(M, name, value)
    if too_large == 1.0:  # regions may stay as large as their cell, so only cells that shrink may be split
        monkeypatch.setattr(M, "TOO_LARGE", 0.95)
    compare(make(spark, rows), 2)


def test_regions_within_a_task(monkeypatch):
    """Joins in one task against all pairs, with so small cells that they recurse."""
    monkeypatch.setattr(M, "SMALL", 3)
    rng = np.random.default_rng(3)
    for _ in range(30):
        centres = [set(rng.integers(0, 400, 40).tolist()) for _ in range(6)]
        sets = []
        for _ in range(60):
            s = set(centres[rng.integers(6)])
            for x in rng.choice(sorted(s), rng.integers(0, 8), replace=False):
                s.discard(int(x))
            sets.append(sorted(s | set(rng.integers(0, 400, rng.integers(0, 6)).tolist())))
        sizes = np.array([len(s) for s in sets])
        cell = M._Cell(np.arange(60), np.concatenate(sets).astype(np.uint64), sizes, np.arange(60), (100, 80))
        cell.join(np.arange(60))
        root = list(range(60))
        for i in range(60):
            for j in range(i):
                both = len(set(sets[i]) & set(sets[j]))
                if 100 * both >= 80 * (sizes[i] + sizes[j] - both):
                    root = [root[i] if r == root[j] else r for r in root]
        same = lambda parts: [[a == b for b in parts] for a in parts]
        assert same(cell.part.tolist()) == same(root)
        assert len(cell.links) == 60 - len(set(root))


def test_one_large_group(spark):
    """2,000 near copies of one text with six stragglers, in chunks of 1,024."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(2000):
        words = list(base)
        words[rng.randrange(60)] = f"y{rng.randrange(10**6)}"
        if i % 350 == 0:
            for j in range(rng.choice([5, 8, 30])):
                words[(i + 5 * j) % 60] = f"z{i}-{j}"
        rows.append((i, " ".join(words)))
    compare(make(spark, rows), 2)


def test_rows_that_repeat_an_id(spark):
    """An id with two texts joins the groups of both, also where one of them is like no other."""
    text = lambda c, n=30: " ".join(f"{c}{i}" for i in range(n))
    rows = [(1, text("a")), (2, text("b")), (3, text("a") + " x"), (3, text("b") + " y"), (4, text("c")), (4, text("a")), (5, text("d")), (6, None), (None, text("a")), (None, None)]
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in M.similar_documents(make(spark, rows), 2).collect())
    assert got == [(-1, -1), (-1, -1), (1, 1), (2, 1), (3, 1), (3, 1), (4, 1), (4, 1), (5, 5), (6, 6)]


def test_edges(edge_docs, no_docs):
    assert len(M.similar_documents(edge_docs, 2).collect()) == edge_docs.count()
    compare(edge_docs, 2)
    assert M.similar_documents(no_docs).collect() == []
