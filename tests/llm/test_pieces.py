import hashlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from sentencepiece import SentencePieceProcessor

from driftfield.llm import pieces as P
from driftfield.llm.queries import piece_model


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_proto=piece_model())


@pytest.fixture(scope="module")
def model():
    return P.load_model(piece_model())


def check(model, library, texts):
    ids, at = P.encode_block(model, texts)
    shown, shown_at = P.decode_block(model, ids, at)
    for i, t in enumerate(texts):
        want = library.encode(t, add_bos=True, add_eos=True)
        assert ids[at[i] : at[i + 1]].tolist() == want
        assert bytes(shown[shown_at[i] : shown_at[i + 1]]).decode() == library.decode(want)


@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abcdeth  ▁\n\t<0x>éß字🤷ab12"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=8))
@settings(max_examples=300, deadline=None)
def test_equals_library(model, library, texts):
    check(model, library, texts)


def test_special_texts(model, library):
    check(model, library, ["", " ", "▁", "<s></s><unk>", "<0x0A>", "\0", " " * 99, "a" * 5000, "ab" * 4000, "日本" * 3000, "\n" * 3000, "the " * 9000])


def test_long_words_merge_in_the_same_order(model, library, monkeypatch):
    monkeypatch.setattr(P, "LONG_WORD", 3)
    check(model, library, ["the international commission aaaaaaa", "", "indivisibility 字字 ééé", "ththeheth" * 30])


def test_pieces_in_random_order(model, library):
    rng = np.random.default_rng(1)
    names = [library.id_to_piece(i) for i in range(259, 32000)]
    check(model, library, ["".join(rng.choice(names, 12)) for _ in range(300)])


def test_documents_and_edges(edge_docs, no_docs, small_docs, library):
    for docs in (edge_docs, small_docs):
        got = P.token_digests(P.tokenize(docs, piece_model(), packed=True)).collect()
        texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
        assert len(got) == docs.count()
        for r in got:
            ids = library.encode(texts[r["doc_id"]], add_bos=True, add_eos=True)
            assert r["n_tokens"] == len(ids)
            assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert P.tokenize(no_docs, piece_model()).collect() == []
    lists = {r["doc_id"]: r["ids"] for r in P.tokenize(edge_docs, piece_model()).collect()}
    assert all(v == library.encode(t or "", add_bos=True, add_eos=True) for v, t in ((lists[r["doc_id"]], r["text"]) for r in edge_docs.collect()))
