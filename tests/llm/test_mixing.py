import re

from hypothesis import given, settings, strategies as st

from driftfield.llm import mixing as M


def fill(sizes, weights, share, cap):
    """Targets by giving the excess of capped sources to the others, again and again."""
    budget, target, open_ = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        level = budget / sum(weights[i] for i in open_)
        over = {i for i in open_ if level * weights[i] >= cap * sizes[i]}
        for i in over or open_:
            target[i] = cap * sizes[i] if over else level * weights[i]
        budget -= sum(cap * sizes[i] for i in over)
        open_ = open_ - over if over else set()
    return target


@given(st.lists(st.integers(0, 1000), min_size=1, max_size=9))
@settings(max_examples=8, deadline=None)
def test_targets_equal_repeated_sharing(spark, sizes):
    sized = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, size long")
    got = [r["target"] for r in M.source_targets(sized).orderBy("slot").collect()]
    want = fill(sizes, [(5.0, 2.0, 1.0)[i % 3] for i in range(len(sizes))], 1.5, 2)
    assert all(abs(a - b) < 1e-6 * max(1, b) for a, b in zip(got, want))


def test_mix_of_documents(spark, small_docs):
    rows = M.mix(small_docs).collect()
    by = {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by.setdefault(r["source"], []).append(r)
    longest = max(r["size"] for r in rows)
    for part in by.values():
        assert sum(r["size"] for r in part) == part[0]["source_size"]
        assert abs(sum(r["taken"] for r in part) - part[0]["target"]) <= longest
    assert 0 <= 1.5 * sum(r["size"] for r in rows) - sum(r["taken"] for r in rows) <= longest
    assert rows == M.mix(small_docs.repartition(7)).collect() or sorted(rows) == sorted(M.mix(small_docs.repartition(7)).collect())


def test_edges(edge_docs, no_docs):
    got = M.mix(edge_docs).collect()
    assert len(got) == edge_docs.count()
    words = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in edge_docs.collect()}
    assert all(r["size"] == words[r["doc_id"]] for r in got)
    assert M.mix(no_docs).collect() == []
    assert M.mixed_documents(no_docs).collect() == []
    mixed = M.mixed_documents(edge_docs)
    assert mixed.columns == edge_docs.columns
    assert {tuple(r) for r in mixed.collect()} <= {tuple(r) for r in edge_docs.collect()}


def test_one_source_holds_all(spark):
    docs = spark.createDataFrame([(i, "a b c " * (i % 7), "only") for i in range(500)], "doc_id bigint, text string, source string")
    rows = M.mix(docs).collect()
    assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= 18


def test_documents_come_as_often_as_the_mix_has_them(spark, small_docs):
    copies = {r["doc_id"]: r["copies"] for r in M.mix(small_docs).collect()}
    got = {r["doc_id"]: r["count"] for r in M.mixed_documents(small_docs).groupBy("doc_id").count().collect()}
    assert got == {d: n for d, n in copies.items() if n}
