"""Near-duplicate operators against brute force."""

import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from landcube.llm import lattice, line_dedup, norm_topk, simhash
from landcube.llm.common import connected_components
from pyspark.sql import functions as F


def partition(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_connected_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)]
    got = {r.node: r.component for r in connected_components(spark, spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == partition(pairs, {x for p in pairs for x in p})
    assert connected_components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


# --- fingerprints ---------------------------------------------------------------


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", ["", None, " \t\n", "a", "A b", "a b c", "one two three four Two ONE", "x\x1cy\x85z é É", "w " * 500])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_search_finds_all(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = base[rng.integers(0, 300, 300)]
    for _ in range(4):
        near = near ^ np.where(rng.random(300) < 0.6, np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64), np.uint64(0))
    fp = np.unique(np.r_[base, near])
    pairs = [(int(a), int(b)) for a, b in np.argwhere(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3, 1))]
    ids = fp.view(np.int64).tolist()
    at = {f: i for i, f in enumerate(ids)}
    df = spark.createDataFrame([(f,) for f in ids], "fp long")
    got = [(at[r.a], at[r.b]) for r in simhash.links(df, len(fp), simhash.Params(shard_rows=40, sample=256)).collect()]
    assert partition(got, range(len(fp))) == partition(pairs, range(len(fp)))


def test_near_duplicate_documents(spark):
    long_ = " ".join(f"word{i}" for i in range(4000))
    rows = [(5, "a b c d", "x"), (3, "A B C D", "x"), (7, None, "x"), (8, "", "x"), (9, "other words here", "x"), (1, long_, "x"), (2, long_ + " tail", "x"), (None, "a b c d", "x"), (5, "a b c d", "x")]
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")).collect()
    comp = {(r.doc_id, r.component_id) for r in out}
    assert {(5, 3), (3, 3), (7, 7), (8, 7), (9, 9), (1, 1), (2, 1), (None, 3)} == comp and len(out) == 9
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_documents_that_share_an_id(spark):
    """Fingerprints tell documents apart, not ids; one row of each group stays."""
    rows = [(1, "the first text of all"), (1, "something wholly other than that"), (None, "the first text of all"), (None, "no other row says this"), (4, "something wholly other than that"), (4, "something wholly other than that")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.component_id or 0, r.kept) for r in simhash.near_duplicates(docs).collect()))
    assert got == sorted([(1, 1, True), (1, 1, True), (0, 1, False), (0, 0, False), (4, 1, False), (4, 1, False)])
    left = sorted((r.doc_id or 0, r.text) for r in simhash.keep_one(docs).collect())
    assert left == sorted([(1, rows[0][1]), (1, rows[1][1]), (0, rows[3][1])])


# --- lines ----------------------------------------------------------------------


def test_lines(spark):
    a = "the quick brown fox jumps over the lazy dog while many others look on and wonder about it all day long today"
    b = a.replace("wonder", "wonders")
    rows = [(1, f"{a}\n\nunique one", 0), (2, f"  {a.upper()}\n{b}", 0), (3, None, 0), (4, "", 0), (5, "unique one", 0), (6, "日本語の長い文章がここにあります。" * 4 + "\nshort", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id int")
    got = {(r.doc_id, r.line_no): (r.first_doc_id, r.first_line_no, r.kept) for r in line_dedup.duplicate_lines(docs).collect()}
    assert got == {(1, 0): (1, 0, True), (1, 2): (1, 2, True), (2, 0): (1, 0, False), (2, 1): (1, 0, False), (5, 0): (1, 2, False), (6, 0): (6, 0, True), (6, 1): (6, 1, True)}
    left = {r.doc_id: r.text for r in line_dedup.drop_duplicate_lines(docs).collect()}
    assert set(left) == {1, 3, 4, 6} and left[1] == f"{a}\n\nunique one" and left[3] is None and left[4] == ""
    assert line_dedup.duplicate_lines(docs.limit(0)).count() == 0


def shingle_set(text):
    return {text[i : i + 8] for i in range(max(1, len(text) - 7))}


def line_classes(text):
    sets = [shingle_set(t) for t in text]
    pairs = [(i, j) for i in range(len(text)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    return pairs, partition(pairs, range(len(text)))


@pytest.mark.parametrize("length", [6, 12, 40, 90])
def test_line_links_against_brute_force(spark, length):
    """Lines of some words, each with five that differ in a word or some letters."""
    rng = np.random.default_rng(length)
    words = ["".join(rng.choice(list("abcdefghinos"), 6)) for _ in range(400)]
    text = []
    for _ in range(40):
        base = " ".join(rng.choice(words, length))
        text.append(base)
        for k in range(5):
            cut = int(rng.integers(len(base) // 2, len(base)))
            text.append(base[:cut] + base[cut + k :])
    text = list(dict.fromkeys(text))
    pairs, want = line_classes(text)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "doc_id long, text string")
    got = {r.doc_id: r.first_doc_id for r in line_dedup.duplicate_lines(docs).collect()}
    assert len(pairs) >= 50 and sum(got[i] == want[i] for i in want) >= 0.99 * len(want)


@pytest.mark.parametrize("p", [line_dedup.Params(), line_dedup.Params(salt_rows=64, full=4)])
def test_one_family_of_many_variants(spark, p):
    """A sentence of sixty words of which each line replaces two: one component."""
    rng = np.random.default_rng(21)
    words = ["".join(rng.choice(list("abcdefghinos"), 5)) for _ in range(300)]
    base, text = list(rng.choice(words, 60)), []
    for i in range(400):
        v = list(base)
        for k in rng.integers(0, 60, 2):
            v[int(k)] = f"other{i}"
        text.append(" ".join(v))
    pairs, want = line_classes(text)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "doc_id long, text string")
    got = {r.doc_id: r.first_doc_id for r in line_dedup.duplicate_lines(docs, p).collect()}
    assert len(pairs) > 5_000 and got == want


def test_rows_that_share_an_id(spark):
    """No text is lost that stands nowhere else, whatever its row's id."""
    a, b, c = "the first of the long lines", "a line of quite another kind", "unique"
    rows = [(1, a), (None, b), (None, a), (5, c), (5, a), (7, "seven and more"), (7, "seven and more"), (8, "the same id"), (8, "but other words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted(((r.doc_id or 0, r.text) for r in line_dedup.drop_duplicate_lines(docs).collect()))
    assert left == sorted([(1, a), (0, b), (5, c), (7, "seven and more"), (8, "the same id"), (8, "but other words")])
    kept = [(r.doc_id, r.first_doc_id) for r in line_dedup.duplicate_lines(docs).where("kept").collect()]
    assert sorted(kept, key=str) == sorted([(1, 1), (None, None), (5, 5), (7, 7), (7, 7), (8, 8), (8, 8)], key=str)


def test_very_long_and_very_common_lines(spark):
    rng = np.random.default_rng(3)
    long_ = " ".join("".join(rng.choice(list("abcdefghinos"), 7)) for _ in range(9000))
    rows = [(i, "a line that all documents have\n" + (long_ + "x" * (i % 2) if i < 4 else f"own {'abcdefgh'[i % 8] * 9} {i}")) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.line_no): (r.first_doc_id, r.first_line_no) for r in line_dedup.duplicate_lines(docs).collect()}
    assert len(got) == 6000 and all(got[i, 0] == (0, 0) for i in range(3000)) and all(got[i, 1] == (0, 1) for i in range(4))


def test_lines_that_differ_past_their_start(spark):
    """Different ids, links and lines without blanks stay; near ones still meet."""
    text = ["order 100000001234", "order 100000005678", "今天天气很好我们去公园", "今天天气很好我们去学校", "https://aaa.org", "https://bbb.org", "short", "shore", "x" * 9, "y" + "x" * 8]
    long_ = "日本語の長い文章がここにあります学校へ行く道で友達に会い図書館で本を読んだ"
    docs = spark.createDataFrame([*enumerate(text), (90, long_), (91, long_ + "。")], "doc_id long, text string")
    got = {r.doc_id: r.first_doc_id for r in line_dedup.duplicate_lines(docs).collect()}
    assert got == {i: i for i in range(len(text))} | {90: 90, 91: 90}
    plain = {t: shingle_set(t) for t in [*text, long_, "a\u0085b\u2028", "🙂" * 5 + "abcdefg"]}
    norm = spark.createDataFrame([(t,) for t in plain], "norm string")
    assert all(set(r.s) == {r2 for r2 in r.w} and len(r.s) == len(plain[r.norm]) for r in norm.select("norm", line_dedup.shingles().alias("s"), F.transform(
        F.udf(lambda t: [x.encode("utf-32-be") for x in plain[t]], "array<binary>")("norm"), lambda x: F.xxhash64(x)).alias("w")).collect())


LENGTHS = [*range(9, 121), 200, 300, 500, 1000]
LATIN, CJK = "abcdefghijklmnopqrstuvwxyz", "".join(map(chr, range(0x4E00, 0x4E40)))


def near_pair(rng, n, share, letters, how):
    """Two lines of about n shingles with a Jaccard similarity of ``share`` or a little
    more: changed or longer at the end, or changed at random places among the letters n and s."""
    a = list(rng.choice(list(letters), n + 7))
    other = "0123456789" if letters == LATIN else "あいうえお"
    if how == "end":
        cut = max(c for c in range(n) if n - c >= share * (n + c))  # changed characters at the end change as many shingles
        return "".join(a), "".join(a[: n + 7 - cut]) + "".join(rng.choice(list(other), cut))
    if how == "longer":
        return "".join(a), "".join(a) + "".join(rng.choice(list(other), int(n / share + 1e-9) - n))
    b, sets = list(a), shingle_set("".join(a))
    for k in rng.permutation(n + 7):
        if a[k] in "ns":
            c = b[k]
            b[k] = str(rng.choice(list(other)))
            now = shingle_set("".join(b))
            if len(sets & now) < share * len(sets | now):
                b[k] = c
                break
    return "".join(a), "".join(b)


@pytest.mark.parametrize("letters,how", [(LATIN, "end"), (LATIN, "longer"), (LATIN, "ns"), (CJK, "end"), (CJK, "longer")])
def test_bands_meet_at_every_length(spark, letters, how):
    """Of pairs at a similarity of 0.8 all but one in a hundred share a bucket, at
    0.9 all but one in a thousand, whatever the length; over all lengths fewer miss."""
    rng = np.random.default_rng(len(how) + len(letters))
    each, pairs = 300, []
    for n in LENGTHS:
        count = (30 if n > 120 else 60) if how == "ns" else each if n <= 120 else 100
        pairs += [(n, share, *near_pair(rng, n, share, letters, how)) for share in (0.8, 0.9) for _ in range(count)]
    rows = [(2 * i + k, p[2 + k]) for i, p in enumerate(pairs) for k in (0, 1)]
    schema = pa.schema([("id", pa.int64()), ("norm", pa.string())])
    signed = line_dedup.signatures(spark.createDataFrame(pa.Table.from_arrays([pa.array(c) for c in zip(*rows)], schema=schema)))
    keys = {r.id: set(r["keys"]) for r in signed.collect()}
    missed, seen = {}, {}
    for i, (n, share, _, _) in enumerate(pairs):
        for k in ((share, n // 12 if n <= 120 else n), share):
            seen[k] = seen.get(k, 0) + 1
            missed[k] = missed.get(k, 0) + (not keys[2 * i] & keys[2 * i + 1])
    assert missed[0.8] <= 0.005 * seen[0.8] and missed[0.9] <= 0.0005 * seen[0.9]
    for (share, n), m in ((k, m) for k, m in missed.items() if isinstance(k, tuple)):
        assert m <= (0.01 if share == 0.8 else 0.001) * seen[share, n] + 1, (share, n, m)


def test_columns_of_any_name(spark):
    """Working columns do not meet the caller's."""
    names = ["doc_id", "text", "row_", "check_", "_row", "_check", "_digest", "_gone", "_kept", "gone", "kept", "digest", "id"]
    rows = [(1, "the first of the long lines", *"abcdefghijk"), (2, "the first of the long lines\nand more of it", *"abcdefghijk"), (2, None, *"lmnopqrstuv")]
    docs = spark.createDataFrame(rows, ", ".join(f"{c} {'long' if c == 'doc_id' else 'string'}" for c in names))
    assert sorted(map(str, line_dedup.drop_duplicate_lines(docs).collect())) == sorted(map(str, [
        spark.createDataFrame([r], docs.schema).first() for r in (rows[0], (2, "and more of it", *"abcdefghijk"), rows[2])]))
    kept = simhash.keep_one(docs.where("text is not null"))
    assert kept.columns == names and kept.count() == 2


def test_all_pairs_of_a_large_bucket(spark):
    """Lines of one template are no copies; those that share most of their own part are."""
    rng = np.random.default_rng(13)
    draw = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789"), n))
    template, text = draw(107), []
    for _ in range(200):
        own = draw(20)
        text += [template + own, template + own[:7] + draw(13)]
    order = rng.permutation(len(text))
    text = [text[i] for i in order]
    sets = [{t[i : i + 8] for i in range(len(t) - 7)} for t in text]
    pairs = [(i, j) for i in range(len(text)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    want = partition(pairs, range(len(text)))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "doc_id long, text string")
    got = {r.doc_id: r.first_doc_id for r in line_dedup.duplicate_lines(docs).collect()}
    assert len(pairs) >= 200 and len(set(want.values())) >= 100 and got == want


@pytest.mark.parametrize("n", [1, 9, 60, 400])
def test_maps_refuse_no_near_pair(spark, n):
    """Bit maps let every pair at the threshold pass, repeats included, and refuse most others
    that have no repeats."""
    rng = np.random.default_rng(n)
    pairs = [near_pair(rng, n, share, letters, how) for share in (0.3, 0.5, 0.8, 0.81, 0.9) for letters, how in ((LATIN, "end"), (LATIN, "longer"), (CJK, "end")) for _ in range(8)]
    pairs += [(x * 3, y * 3 + "z") for x, y in pairs]
    texts = spark.createDataFrame([(2 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)], "id long, norm string")
    got = {r.a // 2 for r in line_dedup.possible(spark.createDataFrame([(2 * i, 2 * i + 1) for i in range(len(pairs))], "a long, b long"), line_dedup.sketches(texts)).collect()}
    sets = [(shingle_set(x), shingle_set(y)) for x, y in pairs]
    share = [len(x & y) / len(x | y) for x, y in sets]
    assert {i for i, s in enumerate(share) if s >= 0.8} <= got
    far = [i for i, s in enumerate(share) if s < 0.6 and i < len(pairs) // 2]  # repeats make the bound wide
    assert len(got & set(far)) <= 0.1 * len(far)
    near = {r.a // 2 for r in line_dedup.links(spark.createDataFrame([(2 * i, 2 * i + 1) for i in got], "a long, b long"), texts).collect()}
    assert near == {i for i, s in enumerate(share) if s >= 0.8 - 1e-9}


def test_templates_do_not_meet(spark, monkeypatch):
    """Lines of many templates, with more own shingles than a near pair may have, are
    not tried against each other in the join of large buckets."""
    rng = np.random.default_rng(31)
    draw = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789"), n))
    text = [t + draw(40) for t in (draw(140) for _ in range(100)) for _ in range(8)]
    tried, put = [], line_dedup.Written.write

    def write(self, df, name="t"):
        out = put(self, df, name)
        tried.extend([out.count()] if name == "tried" else [])
        return out

    monkeypatch.setattr(line_dedup.Written, "write", write)
    docs = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")
    assert line_dedup.duplicate_lines(docs, line_dedup.Params(full=4)).where("kept").count() == len(text) and sum(tried) == 0


def test_a_spread_family_is_not_tried_by_all_pairs(spark, monkeypatch):
    """Lines of one sentence that replace one to six of its words, some by words that a
    second line has too: the same links as brute force, from few pairs."""
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghinos"), 5)) for _ in range(300)]
    base, text = list(rng.choice(words, 60)), []
    for i in range(300):
        v = list(base)
        for k in rng.choice(60, 1 + i % 6, replace=False):
            v[int(k)] = f"x{i:04d}"
        text.append(" ".join(v))
        if i % 10 == 5:  # a near copy of a line that is far from the others
            text.append(text[-1].replace(base[-1], "other"))
    text = list(dict.fromkeys(text))
    tried, put = [], line_dedup.Written.write

    def write(self, df, name="t"):
        out = put(self, df, name)
        tried.extend([out.count()] if name == "tried" else [])
        return out

    monkeypatch.setattr(line_dedup.Written, "write", write)
    pairs, want = line_classes(text)
    docs = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")
    got = {r.doc_id: r.first_doc_id for r in line_dedup.duplicate_lines(docs, line_dedup.Params(full=4)).collect()}
    assert got == want and len(pairs) > 3_000 and 100 < len(set(want.values())) < 250
    assert sum(tried) <= 2 * len(text)


def test_families_of_one_chain_meet_at_little(spark, monkeypatch):
    """Two sentences with many variants, and lines that hold a passage of both, so that
    their buckets form a chain: the links of brute force, from few pairs and rows."""
    rng = np.random.default_rng(23)
    words = ["".join(rng.choice(list("abcdefghinos"), 5)) for _ in range(400)]
    bases, text = [list(rng.choice(words, 120)) for _ in range(2)], []
    for i in range(400):
        v = list(bases[i % 2])
        for k in rng.choice(120, 2 + i // 2 % 8, replace=False):
            v[int(k)] = str(rng.choice(words))
        text.append(" ".join(v))
    for _ in range(16):
        a, b = rng.integers(0, 40, 2)
        text += [" ".join([*bases[0][a : a + 80], f"number{i}", *bases[1][b : b + 80]]) for i in range(6)]
    wrote, put = {"tried": 0, "open": 0}, line_dedup.Written.write

    def write(self, df, name="t"):
        out = put(self, df, name)
        if name in wrote:
            wrote[name] += out.count()
        return out

    monkeypatch.setattr(line_dedup.Written, "write", write)
    pairs, want = line_classes(text)
    docs = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")
    got = {r.doc_id: r.first_doc_id for r in line_dedup.duplicate_lines(docs, line_dedup.Params(full=4)).collect()}
    assert sum(got[i] == want[i] for i in want) >= 0.98 * len(want) and len(pairs) > 5_000
    assert wrote["tried"] <= 4 * len(text) and wrote["open"] <= 160 * len(text), wrote


# --- vectors --------------------------------------------------------------------


def test_e8_decoding():
    x = np.random.default_rng(5).standard_normal((500, 8)) * 3
    z = lattice.decode(x)
    nearest = np.min([((x - z - r) ** 2).sum(axis=1) for r in lattice.roots()], axis=0)
    assert (((x - z) ** 2).sum(axis=1) <= nearest + 1e-9).all() and len(lattice.roots()) == 240


VECTORS = "vec_id long, embedding array<float>, label int, n_links int"


def vectors(seed=6, n=300, dim=16):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 3, dim))
    x = np.r_[base, base + rng.standard_normal(base.shape) * 0.2, base[: n // 6], rng.standard_normal((n // 6, dim))].astype(np.float32)
    rows = [(i, [float(v) for v in e], i % 2 if i < n // 3 else (i - n // 3) % 2, 0) for i, e in enumerate(x)]
    odd = [(1001, None, 0, 0), (1002, [0.0] * dim, 0, 0), (1003, [float("nan")] * dim, 0, 0), (1004, rows[0][1], None, 0), (1005, [1.0, None], 0, 0), (1006, [], 0, 0), (1007, rows[0][1][:5], 0, 0), (None, rows[0][1], 0, 0)]
    return rows, odd


def test_lattice_links(spark):
    rows, odd = vectors()
    u = np.array([r[1] for r in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    lab = np.array([r[2] for r in rows])
    s = (u @ u.T >= 0.93) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(s, False)
    comp = partition([(int(a), int(b)) for a, b in np.argwhere(s)], range(len(rows)))
    got = {r.vec_id: r for r in lattice.near_duplicates(spark.createDataFrame(rows + odd, VECTORS)).collect()}
    found = sum(got[i].n_links for i in range(len(rows)))
    assert found <= s.sum() and found >= 0.98 * s.sum() and s.sum() > 100
    assert sum(got[i].component_id == comp[i] for i in comp) >= 0.98 * len(comp)
    for r in odd[:-1]:
        assert got[r[0]].n_links == 0 and got[r[0]].component_id == r[0] and got[r[0]].kept
    assert got[None].n_links == 0 and got[None].component_id is None
    assert lattice.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


@pytest.mark.parametrize("pairs", [
    [(i, i + 1) for i in range(199)], [(i + 1, i) for i in reversed(range(199))], [(0, i) for i in range(1, 200)], [(199, i) for i in range(199)],
    [tuple(map(int, p)) for p in np.random.default_rng(8).integers(0, 200, (120, 2))], []])
def test_classes_of_blocks_of_links(pairs):
    up, a, b = np.arange(200), *np.array(pairs, np.int64).reshape(-1, 2).T
    for lo in range(0, len(pairs), 50):
        lattice.unite(up, a[lo : lo + 50], b[lo : lo + 50])
    assert dict(enumerate(up.tolist())) == partition(pairs, range(200))


@pytest.mark.parametrize("split", [4_000, 7])
def test_lattice_nodes_are_vectors(spark, split):
    """Rows that share an id are vectors each; a dense cell split on both sides counts the same."""
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (4, [1.0, 0.02]), (3, [0.0, 2.0])]
    df = spark.createDataFrame([(i, e, 0, 0) for i, e in rows], VECTORS)
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in lattice.near_duplicates(df).collect())
    assert got == [(1, 1, 1), (1, 2, 1), (2, 2, 1), (3, 1, 1), (4, 2, 1)]
    rng = np.random.default_rng(8)
    x = np.r_[np.ones((60, 8)) + rng.standard_normal((60, 8)) * 0.05, rng.standard_normal((40, 8))].astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = (u @ u.T >= 0.93).sum(axis=1) - 1
    df = spark.createDataFrame([(i, [float(v) for v in e], 0, 0) for i, e in enumerate(x)], VECTORS)
    got = {r.vec_id: r.n_links for r in lattice.near_duplicates(df, lattice.Params(split_rows=split, chunk_rows=3 * split)).collect()}
    assert [got[i] for i in range(60)] == want[:60].tolist()


@pytest.mark.parametrize("bucket", [40, 10_000])
def test_top_k(spark, bucket):
    rows, odd = vectors(7)
    rows = [(i, [v * (1 + i % 9) for v in e], a, b) for i, e, a, b in rows]
    x = {i: np.floor(np.array(e, np.float32).astype(float) * 256).astype(int) for i, e, *_ in rows} | {1002: np.zeros(16, int), 1004: np.floor(np.array(odd[3][1], np.float32).astype(float) * 256).astype(int)}
    p = norm_topk.Params(bucket_rows=bucket, block_rows=3)
    got = {}
    for r in norm_topk.top_k(spark.createDataFrame(rows + odd, VECTORS), p).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in [i for i in x if i % 50 == 0]:
        want = sorted(((int(-(x[q] @ v)), i) for i, v in x.items() if i != q))[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
    assert norm_topk.top_k(spark.createDataFrame([], VECTORS), p).count() == 0


@pytest.mark.parametrize("sign", [-1, 1])
def test_top_k_with_a_dominant_coordinate(spark, sign):
    rng = np.random.default_rng(11)
    e = rng.standard_normal((400, 4)) * 0.5
    e[:, 1] += sign * rng.choice([0.3, 1, 3], 400)
    e *= rng.uniform(0.5, 1.5, (400, 1))
    e = e.astype(np.float32)
    x = np.floor(e.astype(float) * 256).astype(int)
    rows = [(i, [float(v) for v in r], 0, 0) for i, r in enumerate(e)]
    p = norm_topk.Params(bucket_rows=20, block_rows=3, query_every=4)
    got = {}
    for r in norm_topk.top_k(spark.createDataFrame(rows, VECTORS), p).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in range(0, 400, 4):
        want = sorted((int(-(x[q] @ v)), i) for i, v in enumerate(x) if i != q)[:5]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]


@pytest.mark.parametrize("share", [-0.9, -0.6, 0.6, 0.9])
def test_pruning_keeps_every_hit(share):
    """Scores of a bucket that reach theta survive, wherever the query's length lies."""
    rng = np.random.default_rng(12)
    x = rng.integers(-1000, 1000, (3000, 3))
    x[:500, 0] = -rng.integers(2000, 9000, 500)
    xn = np.linalg.norm(x, axis=1)
    x, xn = x[np.argsort(-xn)], np.sort(xn)[::-1]
    rest = np.sqrt(1 - share * share) / np.sqrt(2)
    q = np.floor(np.array([[share, rest, rest]]) * 5000).astype(int)
    qn = np.linalg.norm(q, axis=1)
    score = x @ q[0]
    for t in (0.05, 0.3, 0.5, 0.8, 0.95):
        th = t * qn[0] * xn[0]
        want = sorted(score[score >= th].tolist(), reverse=True)
        got = norm_topk._best(q, qn, np.array([-1]), x, xn, np.arange(len(x)), np.array([th]), norm_topk.Params(k=5000))[2]
        assert got == want
