import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from driftfield.llm import spelling as S
from tests.llm.conftest import rows_of


def brute_counts(rows, rate, least, often):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % rate == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least and n >= often}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute(counts):
    near = defaultdict(list)
    words = sorted(counts)
    for i, a in enumerate(words):
        for b in words[i + 1 :]:
            if one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def compare(docs, **options):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    counts = brute_counts(rows, options.get("typo_rate", S.TYPO_RATE), options.get("least_length", S.LEAST_LENGTH), options.get("least_count", S.LEAST_COUNT))
    got = rows_of(S.variants(docs, **options).select("word", "form", "root", "n", "n_near", "form_n"))
    assert got == brute(counts)
    return got


def test_edges(edge_docs, no_docs):
    compare(edge_docs, least_length=1, least_count=1)
    compare(edge_docs)
    assert S.variants(no_docs).collect() == []


def typo_texts(seed, letters, n):
    rng = random.Random(seed)
    words = ["".join(rng.choices(letters, k=rng.randint(5, 9))) for _ in range(n)]
    rows = []
    for i in range(60):
        text = []
        for w in rng.choices(words, weights=[1 / (1 + j) for j in range(n)], k=120):
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                at, c = rng.randrange(len(w)), rng.choice(letters)
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + c + w[at + 1 :], w[:at] + c + w[at:]])
            text.append(rng.choice([str.upper, str, str])(w))
        rows.append((i if i else None, rng.choice([" ", "-", "1", "× ", "\n"]).join(text)))
    return rows


@pytest.mark.parametrize("options", [{}, {"symbols": 2}, {"symbols": 2, "crowded": 3}, {"symbols": 97}])
def test_typos_in_any_alphabet(spark, options):
    """The same pairs however letters are reduced, also where most words share few reduced words and are refined."""
    docs = spark.createDataFrame(typo_texts(1, "abcdeéÿÀ", 60), "doc_id bigint, text string").repartition(3)
    got = compare(docs, typo_rate=5, least_length=4, least_count=1, **options)
    assert sum(r[4] for r in got) > 500 and any(r[1] for r in got)


def test_chains_of_forms(spark):
    """a -> b -> c -> d -> e, each ten times as frequent as the one before."""
    words = ["stonewalk" + "sabc"[:i] for i in range(5)]
    text = " ".join(w for i, w in enumerate(words) for _ in range(10**i))
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    got = {r[0]: r[2] for r in compare(docs, typo_rate=10**9, least_count=1)}
    assert set(got.values()) == {words[-1]}


def test_very_long_words(spark):
    """Words of 3,000 letters and a neighbourhood computed in many pieces."""
    rng = random.Random(5)
    word = "".join(rng.choices("abcdefghé", k=3000))
    texts = [word, word, word[:1500] + word[1501:], word[:1500] + word[1501:], "z" + word, "z" + word, word[:-1] + "q", word[:-1] + "q"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert [r[4] for r in compare(docs, typo_rate=10**9)].count(0) == 0


def test_crc_of_two_parts():
    rng = np.random.default_rng(0)
    prefixes = [f"{i}:".encode() for i in rng.integers(0, 10**12, 65)]
    words = [rng.integers(97, 123, i, np.uint8).tobytes() for i in range(65)]
    got = S._crc_after(np.array([zlib.crc32(p) for p in prefixes], np.uint32), np.array([zlib.crc32(w) for w in words], np.uint32), np.arange(65))
    assert got.tolist() == [zlib.crc32(p + w) for p, w in zip(prefixes, words)]
