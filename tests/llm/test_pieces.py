"""Merge rounds against the library."""

import hashlib
import random

import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from landcube.llm import piece_rounds

MODEL = P.path("piece_bpe_32k.model")
TEXTS = ["", None, " ", "  two  blanks  ", "▁a ▁▁", "Hello, world! it's 2024\n\tx", "日本語 🙂 é\x00\x1c\x85", "<s> </s> <unk> <0x41>", "a" * 5000, " " * 5000, "word " * 3000, "x", "x"]
DOCS = "doc_id long, text string, n_tokens int, ids string"


def docs(spark):
    return spark.createDataFrame([(i if i else None, t, 1, "z") for i, t in enumerate(TEXTS)], DOCS)


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aeinthrosl  ▁gréß日語\n1.,'!-=🙂"), max_size=300))
def test_rounds_equal_library(text):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    p = piece_rounds.pieces(MODEL)
    ids = p.encode([text])[0].tolist()
    assert ids == lib.encode(text) and p.decode(ids) == lib.decode(ids)


def test_batches_equal_library(lib):
    """Many words at once, with runs whose merges have equal scores and text without blanks."""
    r = random.Random(3)
    parts = ["the", "in", "er", "a", "e", "t", " ", "  ", " " * 17, "-" * 9, "xxx", "\n", "é", "日", "0x", "==="]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 80))) for _ in range(3000)]
    texts += ["".join(r.choice("abcdefghijklmnopqrstuvwxyz+/0123456789") for _ in range(20_000)), "".join(r.choice("etaoinsr") for _ in range(20_000))]
    p = piece_rounds.Pieces(MODEL)
    assert [x.tolist() for x in p.encode(texts)] == lib.encode(texts)
    p.known.clear()
    assert [p.encode([t])[0].tolist() for t in texts[:200]] == lib.encode(texts[:200])


def test_places_one_by_one():
    """The slow way alone gives what the rounds give."""
    p, r = piece_rounds.pieces(MODEL), random.Random(5)
    for _ in range(300):
        word = "▁" + "".join(r.choice("thein") for _ in range(r.randint(1, 20)))
        sym = [p.char_ids[p.chars.tolist().index(ord(c))] for c in word]
        slow = [int(x) for x in p.one_by_one([int(s) for s in sym], 1 << 60) if x is not None]
        assert slow == p.encode([word[1:]])[0].tolist()


def test_decoding_any_ids(lib):
    r, p = random.Random(7), piece_rounds.pieces(MODEL)
    for _ in range(3000):
        ids = [r.randrange(32_000) if r.random() < 0.5 else r.randrange(262) for _ in range(r.randint(0, 12))]
        assert p.decode(ids) == lib.decode(ids)


def test_round_trip(spark, lib):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in enumerate(TEXTS):
        ids = lib.encode(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids))))
    rows = piece_rounds.round_trip(docs(spark), MODEL).collect()
    assert sorted((r.doc_id or 0, *r[1:]) for r in rows) == want
    assert piece_rounds.round_trip(docs(spark).limit(0), MODEL).count() == 0


def test_encode_then_decode(spark, lib):
    enc = piece_rounds.encode_documents(docs(spark), MODEL)
    assert {(r.doc_id or 0): list(r.ids) for r in enc.collect()} == {i: lib.encode(t or "") for i, t in enumerate(TEXTS)}
    back = {(r.doc_id or 0): r.text for r in piece_rounds.decode_documents(enc, MODEL).collect()}
    assert back == {i: (t or "").replace("▁", " ") for i, t in enumerate(TEXTS)}
    none = spark.createDataFrame([(1, None)], "doc_id int, ids array<int>")
    assert piece_rounds.decode_documents(none, MODEL).first().text == ""


def test_other_models_are_refused(tmp_path):
    """A file whose trainer names another kind of model."""
    path = tmp_path / "other.model"
    path.write_bytes(bytes([0x12, 2, 0x18, 1, 0x1A, 0]))
    with pytest.raises(ValueError):
        piece_rounds.Pieces(str(path))
