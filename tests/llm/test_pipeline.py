"""The pipeline beside a version of its own with plain Python where stages can be written plainly."""

import hashlib
from collections import Counter

from sentencepiece import SentencePieceProcessor

import corpus_pipeline as C
from driftfield.llm import language, mixing, secrets
from driftfield.llm.queries import piece_model

from .test_neardup import brute


def test_against_brute_force(spark, small, small_docs):
    got = C.run(spark, small).collect()
    model = language.fit(small_docs)
    fine = {r["doc_id"] for r in language.predict(small_docs, model).where("not rejected").collect()}
    docs = {r["doc_id"]: r for r in small_docs.collect() if r["doc_id"] in fine}
    kept = {i for i, (_, _, k) in brute([(i, r["text"]) for i, r in docs.items()], 5).items() if k}
    rows = [docs[i] for i in sorted(kept)]
    unique = spark.createDataFrame(rows, small_docs.schema)
    found = {r["doc_id"]: r["spans"] for r in secrets.scan(unique, secrets.fit(unique)).collect()}
    texts = {}
    for r in rows:
        text, spans = r["text"], sorted((int(s.split(":")[1]), int(s.split(":")[2])) for s in found[r["doc_id"]].split(",") if s)
        out, at = "", 0
        for a, b in spans:
            out += text[at:a] + "[SECRET]" if a >= at else ""
            at = max(at, b)
        texts[r["doc_id"]] = out + text[at:]
    clean = spark.createDataFrame([(i, t, docs[i]["source"]) for i, t in texts.items()], "doc_id bigint, text string, source string")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(clean).collect()}
    library = SentencePieceProcessor(model_proto=piece_model())
    want = Counter()
    for i, n in copies.items():
        ids = library.encode(texts[i], add_bos=True, add_eos=True)
        want[i, len(ids), tuple(ids), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += n
    assert Counter((r["doc_id"], r["n_tokens"], tuple(r["ids"]), r["decoded_sha256"]) for r in got) == +want


def test_stages_keep_columns_and_survive_edges(spark, edge_docs, no_docs, small):
    for docs in (edge_docs, no_docs):
        for name, stage in C.STAGES[:-1]:
            out = stage(spark, docs, small)
            assert out.columns == docs.columns
            assert {tuple(r) for r in out.collect()} <= {tuple(r) for r in docs.collect()}
        assert C.STAGES[-1][1](spark, docs, small).count() == docs.count()
