"""Spelling variants against plain edit distances."""

import random
import re
import zlib
from collections import Counter

import pytest
from landcube.llm import variants as V

DOCS = "doc_id long, text string, word string, n int, form string"


def near(a, b):
    """One inserted, deleted or replaced code point."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_way(n):
    out = {}
    by = {}
    for w in n:
        by.setdefault(len(w), []).append(w)
    for w in n:
        some = [x for k in (-1, 0, 1) for x in by.get(len(w) + k, []) if near(w, x)]
        best = min(some, key=lambda x: (-n[x], x), default=None)
        out[w] = (best if best and n[best] >= 10 * n[w] else None, len(some))
    rows = set()
    for w, (form, some) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, n[w], some, n[form] if form else None))
    return rows


def counted(texts):
    n = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(str.maketrans(V.UPPER, V.LOWER))
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= 7:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= 2}


def rows(df):
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("full", [3, 20, 1000])
def test_near_pairs_against_brute_force(spark, full):
    """Families that share a beginning, an end or both, so that keys are split again."""
    r = random.Random(full)
    word = lambda k, letters="abé": "".join(r.choice(letters) for _ in range(k))
    words = {word(r.randint(7, 9), "ab") for _ in range(300)} | {"prefix" + word(r.randint(3, 5)) for _ in range(150)} | {word(4) + "ending" for _ in range(60)} | {"start" + word(3) + "finish" for _ in range(40)}
    words |= {"a" * k for k in range(7, 14)} | {"ab" * k for k in range(4, 8)} | {"long" * 60 + word(2) for _ in range(9)}
    n = {w: r.choice([2, 3, 30, 300, 300, 4000]) for w in words}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    p = V.Params(full=full)
    pairs = V.near_pairs(df, p).collect()
    got = {(r.a, r.b) for r in pairs}
    assert len(got) == len(pairs)
    assert got == {(a, b) for a in n for b in n if (len(a), a) < (len(b), b) and near(a, b)}
    assert all(n[r.a] == r.a_n and n[r.b] == r.b_n for r in pairs)
    assert rows(V.grouped(df, p)) == plain_way(n)


def test_short_words(spark):
    """Parts of one code point or none."""
    n = {w: 5 for w in ["a", "b", "ab", "ba", "bb", "abc", "abb", "aab"]}
    p = V.Params(shortest=1, full=2)
    assert rows(V.grouped(spark.createDataFrame(list(n.items()), "word string, n long"), p)) == plain_way(n)


def test_documents_against_brute_force(spark):
    r = random.Random(1)
    vocabulary = ["colouring", "coloring", "analyse", "analyze", "ÉCLAIRÉE", "éclairée", "ÿÀ×÷öøþß", "underneath", "short", "STRASSEN", "strassen"]
    texts = [(i, " ".join(r.choice(vocabulary) for _ in range(60))) for i in range(120)]
    texts += [(200, None), (201, ""), (None, "colouring analyse 日本語analyse"), (3, texts[3][1]), (202, "x" * 70_000 + " underneath,underneath" * 3000)]
    docs = spark.createDataFrame([(i, t, "w", 1, "f") for i, t in texts], DOCS)
    n = counted(texts)
    assert {tuple(x) for x in V.counted(docs).collect()} == set(n.items())
    got = rows(V.spelling_variants(docs))
    assert got == plain_way(n) and any(x[1] for x in got)


def test_chains_and_empty_tables(spark):
    """Roots follow several forms; of equal counts the smallest form."""
    n = {"aaaaaaa": 2, "aaaaaab": 20, "aaaaabb": 200, "aaaabbb": 2000, "aaabbbb": 20_000, "aabbbbb": 200_000, "zaaaaaa": 20, "qqqqqqqq": 9}
    got = rows(V.grouped(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert got == plain_way(n) and {x[2] for x in got if x[0] == "aaaaaaa"} == {"aabbbbb"}
    none = spark.createDataFrame([], DOCS)
    assert V.spelling_variants(none).count() == 0
    assert V.spelling_variants(spark.createDataFrame([(1, "alone once here", "", 1, "")], DOCS)).count() == 0
