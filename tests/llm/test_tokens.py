"""Token operators against the libraries themselves."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from landcube.llm import bpe_tree, packing, token_counts
from landcube.llm.pretokens import read_ranks
from tokenizers import Tokenizer

RANKS, BYTES, WORDS = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
TEXTS = ["", None, "Hello, world! it's 2024", "a" * 3000, "äöü ñ 日本語 🙂 \n\t x", "<|endoftext|> in <|endoftext|>text", "word " * 3000, "\x1c\x85\xa0 ​", "x", "x", "Σας ΑΣ İstanbul"]
DOCS = "doc_id long, text string, n_tokens int, ids string"


def docs(spark):
    return spark.createDataFrame([(i if i else None, t, 1, "z") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 1, "z")], DOCS)


@pytest.fixture(scope="module")
def tik():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("aeinth gr éß日\n 1.,'!-"), max_size=400))
def test_tree_equals_library(text):
    tik = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})
    c = bpe_tree.codec(RANKS)
    ids = c.encode(text, P.PATTERN)
    assert ids == tik.encode_ordinary(text) and c.decode(ids) == text.encode()


def test_long_windows_equal_short_ones():
    c, rng = bpe_tree.codec(RANKS), np.random.default_rng(0)
    for n in (1, 2, 50, 300):
        data = bytes(rng.choice(list(b"abcdeinth "), n).astype(np.uint8))
        assert c._long_window(data) == c._window(data[:128]) + [] if n <= 128 else c._long_window(data) == c.encode_run(data)


def test_round_trip(spark, tik):
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_tree.round_trip(docs(spark), RANKS, P.PATTERN).collect()}
    want = set()
    for i, t in enumerate(TEXTS):
        ids = tik.encode_ordinary(t or "")
        want.add((i if i else None, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == want


def test_encode_then_decode(spark):
    enc = bpe_tree.encode_documents(docs(spark), RANKS, P.PATTERN)
    assert sorted(bytes(r.data) for r in bpe_tree.decode_documents(enc, RANKS).collect()) == sorted((t or "").encode() for t in [*TEXTS, TEXTS[3]])


def test_counts(spark):
    lib = Tokenizer.from_file(BYTES)
    want = sorted((i or -1, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in [*enumerate(TEXTS), (3, TEXTS[3])])
    rows = token_counts.count_tokens(docs(spark), BYTES, P.PATTERN).collect()
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in rows)


def test_empty_table(spark):
    none = docs(spark).limit(0)
    assert bpe_tree.round_trip(none, RANKS, P.PATTERN).count() == 0 and token_counts.count_tokens(none, BYTES, P.PATTERN).count() == 0
    assert packing.pack(none, WORDS).count() == 0


def _bfd(sizes, capacity):
    bins = []
    for s in sorted(sizes, reverse=True):
        fit = [(r, i) for i, r in enumerate(bins) if r >= s]
        if fit:
            bins[min(fit)[1]] -= s
        else:
            bins.append(capacity - s)
    return sorted(bins)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plan_is_best_fit_decreasing(sizes):
    counts = {s: sizes.count(s) for s in set(sizes)}
    runs, bins = packing.plan(counts, 40)
    fill = {}
    for s, n in counts.items():
        own = runs[runs[:, 0] == s]
        for x in range(n):
            q = own[np.searchsorted(own[:, 1], x, "right") - 1]
            fill.setdefault(q[3] + (x - q[1]) // q[2], []).append((q[4] + (x - q[1]) % q[2] * s, s))
    left = []
    for got in fill.values():
        at = 0
        for o, s in sorted(got):
            assert o == at
            at += s
        left.append(40 - at)
    assert sorted(left) == _bfd(sizes, 40) and bins == len(left)


def test_pack(spark):
    lib = Tokenizer.from_file(WORDS)
    df = docs(spark)
    rows = packing.pack(df, WORDS, capacity=64).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for got in by.values():
        at = 0
        for o, n in sorted(got):
            assert o == at
            at += n
        assert at <= 64
    for i, t in enumerate(TEXTS):
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        mine = {(r.piece, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == (i if i else None)}
        assert mine == {(k, a, len(ids[a : a + 64]), zlib.crc32(ids[a : a + 64].tobytes())) for k, a in enumerate(range(0, len(ids), 64))}
    assert len(by) == len(_bfd([r.length for r in rows], 64))


def test_sequences(spark):
    lib = Tokenizer.from_file(WORDS)
    df = spark.createDataFrame([(1, "one two three"), (2, "four"), (3, "five " * 30)], "doc_id long, text string")
    packed = packing.pack(df, WORDS, 16)
    whole = sum(len(r.ids) for r in packing.sequences(df, packed, WORDS, 16).collect())
    assert whole == sum(len(lib.encode(t, add_special_tokens=False).ids) + 1 for t in ("one two three", "four", "five " * 30))
