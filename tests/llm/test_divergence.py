import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from driftfield.llm import blocks as B, divergence as D
from tests.llm.conftest import rows_of


def terms_of(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute(rows, least, top):
    counts, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source, terms = lang or "", source or "", terms_of(text)
        groups[lang].add(source)
        counts[lang, source].update(terms)
        df[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= least]
        v = len(kept)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[k] for k in kept) + 2 * v) for t in kept}  # noqa: E731, B023
        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            more = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(more)[:top])):
                out += [(lang, s, part, item, -value, rank) for rank, (value, _, item) in enumerate(items, 1)]
    return sorted(out, key=repr)


def got(docs, least=D.LEAST_DOCUMENTS, top=D.TOP):
    return rows_of(D.audit(docs, least, top).select("lang", "source", "part", "item", "value", "rank"))


def plain(docs):
    return [tuple(r) for r in docs.select("lang", "source", "text").collect()]


@pytest.mark.parametrize("least", [1, 2])
def test_edges(edge_docs, no_docs, least):
    assert got(edge_docs, least, 3) == brute(plain(edge_docs), least, 3)
    assert got(no_docs) == []


def test_tiles_shards_and_pieces(spark, monkeypatch):
    """Many sources in tiles of three, terms in shards of five, and texts cut into pieces, with one source that owns a third of all rows."""
    rng = random.Random(2)
    vocabulary = ["the", "Of", "émile", "ßtrasse", "日本", *(f"w{chr(97 + i)}{chr(97 + i // 3)}" for i in range(40))]
    rows = []
    for i in range(400):
        source = "hot" if i % 3 == 0 else rng.choice(["a", "b", "Ä", "c", None, "x" * 30, "z-1", "q", "r"])
        text = rng.choice([" ", "\n", "-", "7"]).join(rng.choices(vocabulary, k=rng.choice([0, 3, 80])))
        rows.append((rng.choice(["en", "de", None]), source, text))
    rows += [("xx", "lone", None), ("xx", "other", "9 9"), ("yy", "only", "a b")]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    want = brute(rows, 4, 5)
    assert got(docs, 4, 5) == want
    monkeypatch.setattr(D, "SHARD", 5)
    monkeypatch.setattr(D, "TILE", 3)
    assert got(docs, 4, 5) == want


@pytest.mark.parametrize("size", [16, 100])
def test_pieces_count_as_the_whole_text(monkeypatch, size):
    text = "one Two, trois  " + "x" * 300 + " one2two3 " + "é" * 50 + " one -- deux " * 30
    (block,) = B.blocks(pa.array([text]))
    whole = D._block_counts(block)
    monkeypatch.setattr(D, "COUNT_BYTES", size)
    cut = D._block_counts(block)
    pairs = lambda t: sorted(zip(t["term"].to_pylist(), t["n"].to_pylist()))
    assert pairs(cut) == pairs(whole) == sorted(Counter(terms_of(text)).items())


def test_shares_do_not_overflow():
    import numpy as np

    n, v = 4 * 10**15, 10**6
    count = np.array([0, 1, n // 3, n])
    assert D._share(count, np.full(4, n), v).tolist() == [1 + 10**9 * (int(c) + 2) // (n + 2 * v) for c in count]
