"""Fill-in-the-middle against regular expressions."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from landcube.llm import fill_middle as M

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = ["", None, " ", "\n\n", "one", " one two  three\t\n", "with <P> inside", "a <S>", "<M>", "é 日本 🙂 \x1c\x85\xa0 x", "word " * 50_000, "x" * 100_000, "a b c d e f", "a b c d e f"]
DOCS = "doc_id long, text string, n int, form string"


def plain_way(text, doc_id):
    """By the list of tokens."""
    u = TOKEN.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(u), "plain", None, None, text
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < 80 else f"<P>{p}<S>{s}<M>{m}"
    return len(u), "spm" if h4 % 100 < 80 else "psm", len(p), len(m), out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab é日🙂 \t\n\x0b\x0c\r\x1c\x85\xa0<PSM>"), max_size=200), st.integers(-5, 10**6))
def test_equals_plain_way(text, doc_id):
    got = M.cut(text, doc_id)
    assert got == plain_way(text, doc_id) and M.restore(got[4], got[1]) == text


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 1 << 700))
def test_select(bits):
    places = [i for i in range(bits.bit_length()) if bits >> i & 1]
    assert [M.select(bits, k + 1) for k in range(len(places))] == places


def test_markers_at_the_edges():
    """Parts that end or begin like markers are told apart."""
    for p, m, s in [("a<", " <", " <P"), ("<S", " <M", " <"), ("", "", " <"), ("x<P", "", ""), ("", " >", "")]:
        for form, out in (("psm", f"<P>{p}<S>{s}<M>{m}"), ("spm", f"<S>{s}<P>{p}<M>{m}")):
            assert M.restore(out, form) == p + m + s


def test_table(spark):
    ids = [None, *range(1, len(TEXTS))]
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in zip(ids, TEXTS)] + [(12, TEXTS[12], 1, "z")], DOCS)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {i: plain_way(t or "", i) for i, t in zip(ids, TEXTS)}
    rows = M.digests(docs).collect()
    assert len(rows) == len(TEXTS) + 1 and {r.form for r in rows} == {"plain", "spm", "psm"}
    text = dict(zip(ids, TEXTS))
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == want[r.doc_id][:4]
        assert r.output_sha256 == sha(want[r.doc_id][4]) and r.restored_sha256 == sha(text[r.doc_id] or "")
    assert {r.doc_id: r.output for r in M.transform(docs).collect()} == {i: w[4] for i, w in want.items()}
    assert M.digests(docs.limit(0)).count() == 0
