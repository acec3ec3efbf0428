import itertools
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftfield.llm import blocks as B, secrets as S


@pytest.fixture(scope="module")
def field(spark, small_docs):
    return S.fit(small_docs)


def base(text):
    found = []
    for kind, (pattern, group, least) in enumerate(
        [(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), (r"AKIA[A-Z0-9]+", 0, 20), (r"[0-9a-f]+", 0, 24)]
    ):
        found += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found))


def test_base_spans(spark, field):
    texts = [
        None, "", 'é token = "abcdef123456" x', "token = abc", "Password:hunter2x secret=token=abcdef", "AKIA" + "A" * 16, "AKIA" + "A" * 15, "akia" + "A" * 16,
        "日本 " + "0af" * 8, "0af" * 7, "API_KEY: 'zzzzzz' apikey==zzzzzz", "ſecret = abcdefg", "token=" + "f" * 40, 'token = "' + "ab12" * 10 + '"', "x" * 5000 + " token=abcdefgh",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for f in (None, field):
        for r in S.scan(docs, f).collect():
            want = base(texts[r["doc_id"]] or "")
            assert r["base_spans"] == want
            assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))
            assert r["n_assign"] + r["n_access"] + r["n_hex"] == len(list(filter(None, want.split(","))))


def test_base_spans_of_documents(small_docs, field):
    got = {r["doc_id"]: r["base_spans"] for r in S.scan(small_docs, field).collect()}
    assert got == {r["doc_id"]: base(r["text"] or "") for r in small_docs.collect()}


def test_field_finds_shapes_and_leaves_prose(spark, small_docs):
    field = S.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    secrets = ["ghp_16C7e42F292c6912E7710c838347Ae178B4a", "eyJhbGciOiJIUzI1NiIsInR5cCI6IkpXVCJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0", "sk-proj-a8F3kd92Ls0Zq71Xn5Bv"]
    for s in secrets:
        text = f"é we use {s}, here"
        ((_, found, added),) = S._spans_of(field, pa.array([text]))
        assert not found and [text[a:b] for a, _, b in added] == [s]
    rows = S.scan(small_docs, field).collect()
    assert sum(r["n_added"] for r in rows) <= 0.01 * len(rows)


def test_viterbi_is_exact():
    rng = np.random.default_rng(5)
    for _ in range(20):
        step, first = S._forbid(rng.normal(size=(3, 3)), rng.normal(size=3))
        f = S.Field(np.zeros((len(S.NAMES), 3)), step, first)
        lengths = rng.integers(1, 6, 4)
        scores = rng.normal(size=(lengths.sum(), 3)) * 2
        starts = np.cumsum(lengths) - lengths
        tags = S.viterbi(f, scores, starts)
        for s, n in zip(starts, lengths):
            value = lambda t: first[t[0]] + sum(scores[s + i, t[i]] for i in range(n)) + sum(step[t[i], t[i + 1]] for i in range(n - 1))
            best = max(itertools.product(range(3), repeat=int(n)), key=value)
            assert value(tuple(tags[s : s + n])) == pytest.approx(value(best))


def test_lines_left_out_are_outside_throughout(small_docs):
    """With random weights, decoding every line gives the same spans as decoding those that the bound lets through."""
    texts = [r["text"] for r in small_docs.limit(40).collect()]
    rng = np.random.default_rng(2)
    for _ in range(4):
        w = rng.normal(0, 0.7, (len(S.NAMES), 3))
        w[0] = (2, -1, 0)
        step = rng.normal(size=(3, 3))
        step[[S.BEGIN, S.INSIDE], S.INSIDE] += 3
        f = S.Field(w, *S._forbid(step, rng.normal(size=3)))
        for block in B.blocks(pa.array(texts)):
            starts, ends, rows, shape, keyword, doc = S._words(block)
            same = S._lines(block, starts, rows)
            tags = S.viterbi(f, S._features(shape, keyword, doc[rows], same) @ w, np.flatnonzero(~same))
            want = []
            for i in np.flatnonzero(tags == S.BEGIN):
                j = i
                while j + 1 < len(tags) and tags[j + 1] == S.INSIDE and same[j + 1]:
                    j += 1
                want.append((rows[i], starts[i], ends[j]))
            assert S._tag(f, block) == want and (tags == S.INSIDE).any()


def test_redact_and_edges(spark, edge_docs, no_docs, field):
    assert S.fit(no_docs) is None
    assert S.scan(no_docs, field).collect() == [] and S.redact(no_docs, None).collect() == []
    same = S.redact(edge_docs, field)
    assert same.columns == edge_docs.columns and sorted(same.collect(), key=repr) == sorted(edge_docs.collect(), key=repr)
    assert S.scan(edge_docs, field).count() == edge_docs.count()
    docs = spark.createDataFrame([(1, 'é token = "' + "0f" * 20 + '" end', 0), (2, None, None)], "doc_id bigint, text string, n_chars int")
    got = {r["doc_id"]: r for r in S.redact(docs, field).collect()}
    assert got[1]["text"] == 'é [SECRET]" end' and got[1]["n_chars"] == len(got[1]["text"]) and got[2]["text"] is None


def test_field_is_fitted_on_rare_matches(spark):
    """Of 40,000 texts with a keyword 40 have a base match; all 40 are learnt from."""
    prose = F.concat(F.lit("The secret of the old garden was a token of the river, and number "), F.col("id").cast("string"), F.lit(" of the walk went on.\nNobody knew the password there."))
    value = F.concat(F.lit("They wrote token = "), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 40), F.lit(" on the wall of the house."))
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 1000 == 7, value).otherwise(prose).alias("text"))
    assert docs.where(F.col("text").rlike(S._HINT)).count() == 40_000 and docs.where(F.col("text").rlike(S._MATCH)).count() == 40
    field = S.fit(docs)
    secret = "16c7e42f292c-6912e7710c83-8347ae178b4a"
    ((_, found, added),) = S._spans_of(field, pa.array([f"They wrote {secret} on the wall of the house."]))
    assert not found and len(added) == 1
    assert not list(S._spans_of(field, pa.array(["The secret of the old garden was a token of the river."])))


@pytest.mark.parametrize("text", ["token = abcdef", "token = abcde", "API_KEY: 'zzzzzz'", "the secret token", "AKIA" + "A" * 15, "AKIA" + "A" * 16, "0af" * 8, "0af" * 7, "Password:hunter2x"])
def test_spark_pattern_agrees_with_base_spans(spark, text):
    docs = spark.createDataFrame([(text,)], "text string")
    assert docs.select(F.col("text").rlike(S._MATCH)).first()[0] == bool(S.base_spans(text))
