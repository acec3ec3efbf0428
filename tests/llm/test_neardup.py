import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from driftfield.llm import blocks as B, neardup as N


def shingle_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def brute(rows, k):
    sets = {i: shingle_set(t, k) for i, t in rows}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sorted(sets):
        common = Counter(j for x in sets[i] for j in holders[x] if j < i)
        for j, n in common.items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def compare(docs, k):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in N.near_duplicates(docs, k).collect()}
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], k)


@pytest.mark.parametrize("k", [2, 5])
def test_documents(small_docs, k):
    compare(small_docs, k)


def test_copies_of_copies(spark):
    """Families whose members drift apart, around the threshold, so that most links do not touch the smallest member."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for family in range(12):
        base = rng.choices(vocabulary, k=rng.choice([12, 40, 150]))
        texts = [base]
        for _ in range(25):
            words = list(rng.choice(texts))
            for _ in range(max(1, len(words) * rng.choice([2, 4, 5, 6]) // 100)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(words)
        rows += [" ".join(t) for t in texts]
    rng.shuffle(rows)
    compare(spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string"), 2)


def test_blocks_of_families(spark, monkeypatch):
    """The same with blocks so small that every family and key takes several."""
    monkeypatch.setattr(N, "BLOCK", 4)
    monkeypatch.setattr(N, "TEXT_BLOCK", 3)
    monkeypatch.setattr(N, "IDS_BROADCAST", 1)
    test_copies_of_copies(spark)


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(0)
    for size in (30, 300, 5000):
        for share in (0.6, 0.8, 0.9, 1.0):
            common = int(size * share)
            words = [f"w{x}" for x in rng.integers(0, 1 << 40, 2 * size)]
            texts = [" ".join(words[:size]), " ".join(words[size - common : 2 * size - common])]
            (block,) = B.blocks(pa.array(texts))
            rows, hashes = B.shingles(block, 1)
            sketch = N._odd_sketches(rows, hashes, 2).view(np.uint64)
            a, b = (set(t.split()) for t in texts)
            assert abs(N.similarity(sketch[0], sketch[1]) - len(a & b) / len(a | b)) < N.MARGIN


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (200, 300), (300, 400), (400, 200)]
    got = {r["node"]: r["component"] for r in N.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200, 300: 200, 400: 200}
    assert N.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_edges(spark, edge_docs, no_docs):
    rows = N.near_duplicates(edge_docs, 2).collect()
    assert len(rows) == edge_docs.count()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows}
    assert got == brute([(r["doc_id"], r["text"]) for r in edge_docs.select("doc_id", "text").collect()], 2)
    assert N.near_duplicates(no_docs).collect() == []
    left = N.without_near_duplicates(edge_docs, 2)
    assert left.columns == edge_docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(i for i, v in got.items() if v[2])
    nameless = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (1, "a b c")], "doc_id bigint, text string")
    assert all(r["kept"] for r in N.near_duplicates(nameless).collect()) and N.without_near_duplicates(nameless).count() == 3
