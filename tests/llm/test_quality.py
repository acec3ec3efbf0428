import re
from collections import Counter

from hypothesis import given, settings, strategies as st
import pyarrow as pa

from driftfield.llm import blocks as B, quality as Q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(grams)
    covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(covered)


@given(st.lists(st.text(alphabet="ab \n\té#|\r\x0b日", max_size=80), min_size=1, max_size=12))
@settings(max_examples=150, deadline=None)
def test_measures(texts):
    got = []
    for block in B.blocks(pa.array(texts), max_bytes=40, max_rows=5):
        m = Q._measure(block)
        got += list(zip(*(m[c].tolist() for c in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"))))
    assert got == [brute(t) for t in texts]


def test_edges(edge_docs, no_docs):
    got = Q.apply_policy(Q.ledger(edge_docs))
    texts = {r["doc_id"]: r["text"] for r in edge_docs.collect()}
    rows = got.collect()
    assert len(rows) == edge_docs.count()
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_lines"], r["n_dup_lines"], r["n_repeat_words"]) == brute(texts[r["doc_id"]])
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
        if not texts[r["doc_id"]]:
            assert r["failed"] == Q.mask(["few_words"])
    assert Q.ledger(no_docs).collect() == []
    assert all(r["n_failed"] == 0 for r in Q.ablations(Q.ledger(no_docs)).collect())


def test_policies_and_ablations(small_docs):
    entries = Q.ledger(small_docs)
    failed = [r["failed"] for r in entries.collect()]
    for version in Q.POLICIES:
        wanted = Q.mask({*Q.BASE, *Q.POLICIES[version]})
        assert Q.apply_policy(entries, version).where("kept").count() == sum(f & wanted == 0 for f in failed)
        for r in Q.ablations(entries, version).collect():
            bit = Q.mask([r["rule"]])
            assert r["n_failed"] == sum(f & bit != 0 for f in failed)
            assert r["n_alone"] == sum(f & wanted == bit for f in failed)
            assert r["n_kept_without"] == r["n_kept"] + r["n_alone"] == sum(f & wanted & ~bit == 0 for f in failed)


def test_clean_documents_stay_and_junk_goes(spark, small_docs, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    rows = Q.apply_policy(Q.ledger(small_docs)).join(labels, "doc_id").where("n_words >= 20").groupBy("quality").agg({"kept": "count"}).collect()
    kept = Q.apply_policy(Q.ledger(small_docs)).join(labels, "doc_id").where("n_words >= 20 and kept").groupBy("quality").count().collect()
    all_, kept = {r[0]: r[1] for r in rows}, {r[0]: r[1] for r in kept}
    assert kept[1] >= 0.97 * all_[1] and kept.get(0, 0) <= 0.2 * all_[0]
