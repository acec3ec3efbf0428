import math

import numpy as np

from driftfield.llm import forest as A


def exact(rows, k=5, every=50):
    fine = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in fine:
        if q % every == 0:
            scored = [(-float(A.cosines(fine[q][None], v[None])[0]), i) for i, v in fine.items() if i != q]
            out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall_on_given_vectors(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = exact([(r["vec_id"], r["embedding"]) for r in vectors.collect()])
    got = found(A.nearest(vectors, vectors.where("vec_id % 50 = 0")))
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in want)
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values()) and hits >= 0.9 * 5 * len(want)
    scores = {(q, i): s for q, v in want.items() for i, s in v}
    assert all(scores.get((q, i), s) == s for q, v in got.items() for i, s in v)


def test_ties_copies_and_vectors_that_take_no_part(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(120)]
    rows += [(200 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(60)] + [(300 + i, [2.0, 4.0, 6.0, 8.0]) for i in range(3)]
    rows += [(400, None), (450, [0.0] * 4), (500, [1.0, None, 0.0, 0.0]), (550, [float("nan"), 1.0, 0.0, 0.0]), (600, [float("inf"), 1.0, 0.0, 0.0]), (None, [1.0] * 4), rows[0], rows[7]]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "vec_id bigint, embedding array<double>, score string, rank int")
    got = found(A.nearest(df, df.where("vec_id % 50 = 0")))
    want = exact(rows)
    assert set(got) == set(want)
    assert [i for i, _ in got[200]] == [201, 202, 203, 204, 205] and [i for i, _ in got[250]] == [200, 201, 202, 203, 204]
    assert sum(got[q] == want[q] for q in want) >= len(want) - 1


def test_small_tables(spark):
    schema = "vec_id bigint, embedding array<float>"
    for rows in ([], [(0, [1.0, 0.0])], [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (3, [0.0, 1.0])], [(0, None)]):
        df = spark.createDataFrame(rows, schema)
        got = found(A.nearest(df, df.where("vec_id % 50 = 0")))
        want = exact(rows)
        assert {q: v for q, v in want.items() if v} == got


def test_blocks_give_the_same(spark, monkeypatch):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    a = found(A.nearest(vectors, vectors.where("vec_id % 50 = 0")))
    monkeypatch.setattr(A, "BLOCK", 3)
    assert found(A.nearest(vectors, vectors.where("vec_id % 50 = 0"))) == a


def test_queue_takes_leaves_by_margin():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 8))
    forest = A.grow(x, 3, 20)
    leaves = A.route(forest, x)
    sizes = np.stack([np.bincount(leaves[:, t], minlength=1 << forest.depth) for t in range(3)])
    assert (sizes.sum(1) == 400).all() and sizes.min() >= 10
    for own, order in zip(leaves[:5], A.visits(forest, sizes, x[:5], 10**9)):
        assert {(t, int(leaf)) for t, leaf in enumerate(own)} == set(order[:3]) and len(order) == sizes.size


def test_very_large_and_very_small_vectors(spark):
    """Components whose squares overflow or vanish; the same cosines as those of the vectors in ordinary size."""
    base = [[1.0, 2.0, 3.0], [1.0, 2.0, 3.5], [-1.0, 0.5, 0.25], [3.0, -1.0, 0.0]]
    sizes = [2.0**660, 2.0**-660, 1.0, 2.0**-1000]
    rows = [(50 * i + j, [c * size for c in v]) for i, v in enumerate(base) for j, size in enumerate(sizes)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = found(A.nearest(df, df.where("vec_id % 50 = 0")))
    plain = exact([(i, base[i // 50]) for i, _ in rows])
    assert got == plain and all(math.isfinite(s) for v in got.values() for _, s in v)


def test_each_length_on_its_own(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=2 + i % 3)]) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = found(A.nearest(df, df.where("vec_id % 10 = 0")))
    assert len(got) == 9
    for q, answers in got.items():
        mates = [(i, v) for i, v in rows if i % 3 == q % 3]
        assert answers == exact(mates, every=1)[q]
