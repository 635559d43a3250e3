"""Licenses, toxicity, archives and the pipeline."""

import hashlib
import re

import numpy as np
from landcube.llm import license_scan, toxicity, warc
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, labels string, score string"


def test_licenses(spark):
    texts = ["", None, "Licensed under CC BY-NC 4.0.", "x CC  by\ncc-BY; all RIGHTS reserved.", "Released under the MIT License.", "released under the license", "acc by cc byte", "é GENERAL public  license É", "all rights\nreserved " * 3000,
             "😀 😀 😀 all rights reserved and more", "𠀀𠀁 cc𠀀 cc by 𠀂all rights reserved𠀂 😀😀 general public license 𐐀", "😀" * 70_000 + " CC BY " + "é😀 " * 70_000 + "cc by", "cc😀by cc by😀"]
    rows = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], DOCS)).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at, labels = [], set()
        for p, label in license_scan.PHRASES.items():
            q = p.split()
            here = [k for k in range(len(w)) if w[k : k + len(q)] == q]
            at += here
            labels |= {label} if here else set()
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))), t
        assert set(r.labels.split(",")) >= set(r.base_labels.split(",")) - {""} and 0 <= r.score <= 1
    assert rows[4].labels == "mit" and rows[4].score == 1.0 and rows[2].labels == "cc-by,cc-by-nc" and rows[6].labels == ""
    assert license_scan.scan(spark.createDataFrame([], DOCS)).count() == 0


def test_wrapped_templates(spark):
    """A notice is found wherever its lines break, and words far apart are none."""
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the conditions are met"
    texts = [bsd, bsd.replace("\n", "\r\n# \r\n# ")]
    want = [("bsd", 1.0)] * 2
    for width in (1, 2, 5, 9):
        for label, t in license_scan.TEMPLATES:
            w = t.split()
            at = [f"word{i}" for i in range(width - 1)] + w + ["tail"] * 30
            texts.append("\n".join(" ".join(at[i : i + width]) for i in range(0, len(at), width)))
            want.append((label, 1.0))
    gap = "\n".join(["filler words stand here"] * 9)
    texts += [f"Redistribution and use in source and binary forms, with or without\n{gap}\nmodification, are permitted", f"Released under\n{gap}\nthe MIT License"]
    rows = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], DOCS)).collect()}
    for i, (label, score) in enumerate(want):
        assert label in rows[i].labels.split(",") and rows[i].score == score, texts[i]
    assert [(rows[i].labels, rows[i].score) for i in range(len(want), len(texts))] == [("", 0.0)] * 2


def test_templates_against_brute_force(spark):
    """Labels and score of every block, by plain sets."""
    rng = np.random.default_rng(5)
    apart = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    texts = []
    for i in range(240):
        w = []
        for _ in range(int(rng.integers(1, 4))):
            t = license_scan.TEMPLATES[int(rng.integers(len(license_scan.TEMPLATES)))][1].split()
            t = [x for x in t if rng.random() > 0.15 * (i % 3)]  # some words are missing
            for _ in range(int(rng.integers(0, 3))):
                t.insert(int(rng.integers(len(t) + 1)), "between")
            w += t + ["filler"] * int(rng.integers(0, 12))
        texts.append("".join(x + rng.choice([" ", " ", " ", "\n", ",\n\n"]) for x in w))
    rows = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], DOCS)).collect()}
    met = 0
    for i, text in enumerate(texts):
        lines = [x for x in map(apart, text.split("\n")) if x]
        best, labels = 0.0, set(rows[i].base_labels.split(",")) - {""}
        for label, t in license_scan.TEMPLATES:
            t, n = set(apart(t)), len(apart(t))
            for k, own in enumerate(lines):
                after = [x for line in lines[k + 1 :] for x in line][: n - 1]
                share = len(t & (set(own) | set(after))) / len(t)
                if share >= 0.8 - 1e-9:
                    best, labels = max(best, share), labels | {label}
        met += best > 0
        assert (rows[i].labels, rows[i].score) == (",".join(sorted(labels)), 1.0 if rows[i].n_base else best), text
    assert 50 < met < 240


def test_logit_by_all_pairs():
    """The factored sum is that of a double loop over pairs of terms."""
    rng = np.random.default_rng(4)
    m = 12
    model = toxicity.Model(0.3, np.arange(m, dtype=np.uint32), rng.normal(size=m), rng.normal(size=(m, 5)))
    for n in (0, 1, 2, 7, m):
        at = sorted(int(i) for i in rng.permutation(m)[:n])
        pairs = sum(float(model.factors[i] @ model.factors[j]) for i in at for j in at if i < j)
        want = 0.3 + sum(float(model.weights[i]) for i in at) + (pairs / n if n else 0.0)
        assert abs(model.logit(at) - want) < 1e-12


def test_pairs_of_terms(spark):
    """An insult and the mention of a group are toxic together, each alone is not;
    nor does it hang on either word alone if it is just one of two that is."""
    rng = np.random.default_rng(9)
    vocab = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(200)]
    for toxic in (lambda a, b: a and b, lambda a, b: a != b):
        rows, labels = [], []
        for i in range(1500):
            a, b = (rng.random(2) < 0.5).tolist()
            rows.append((i, " ".join([*rng.choice(vocab, 20), *["zzinsult"] * a, *["qqgroup"] * b])))
            labels.append((i, int(toxic(a, b))))
        docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
        out = toxicity.score(docs, toxicity.fit(docs, lab)).where(toxicity.held_out(F.col("doc_id"))).collect()
        assert len(out) > 200 and sum(r.predicted == labels[r.doc_id][1] for r in out) >= 0.95 * len(out)


def test_training_rows_are_bounded(spark):
    docs = spark.createDataFrame([(i % 20, f"text number {i}") for i in range(400)], "doc_id long, text string")
    lab = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int")
    assert toxicity.training_rows(docs, lab, toxicity.Params(train_rows=3)).count() == 3
    a, b = (toxicity.fit(docs.repartition(n), lab, toxicity.Params(min_llr=0.5)) for n in (1, 7))
    assert a.terms.tolist() == b.terms.tolist() and a.weights.tolist() == b.weights.tolist()


def test_toxicity(spark):
    rng = np.random.default_rng(8)
    vocab = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(300)]
    rows, labels = [], []
    for i in range(900):
        bad = i % 5 == 0
        w = list(rng.choice(vocab, 30)) + (["insultword"] if bad else [])
        rows.append((i, " ".join(w), "x", "y"))
        labels.append((i, int(bad), 1))
    docs = spark.createDataFrame(rows + [(2000, None, "", ""), (2001, "", "", ""), (None, "insultword", "", ""), (5, rows[5][1], "", "")], DOCS)
    lab = spark.createDataFrame(labels + [(None, 1, 0), (7, None, 0), (3000, 1, 0)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(docs, lab)
    out = toxicity.score(docs, model).withColumn("h", toxicity.held_out(F.col("doc_id"))).collect()
    held = [r for r in out if r.h and r.doc_id is not None and r.doc_id < 900]
    assert len(out) == 904 and len(held) > 100 and sum(r.predicted == (r.doc_id % 5 == 0) for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert {r.predicted for r in out if r.doc_id in (2000, 2001)} == {0}
    none = toxicity.fit(docs, lab.where("toxic = 0"))
    assert toxicity.score(docs, none).where("predicted = 1").count() == 0
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), lab.limit(0))).count() == 0


def test_archive(spark, tmp_path):
    big, small = "x" * 150, "tiny"
    rows = [(4, "http://a", big, 1), (2, "http://b", big, 1), (9, "c\r\nInjected: 1", small, 1), (8, None, small, 1), (1, "http://d", None, 1), (3, "http://é", "é" * 60, 1), (4, "http://a", big, 1), (None, "http://n", big, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    path = str(tmp_path / "w")
    warc.write_archive(pages, path)
    got = sorted(((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archive(spark, path).collect()), key=str)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = [(4, 150, sha(big), "revisit", 2), (2, 150, sha(big), "response", None), (9, 4, sha(small), "response", None), (8, 4, sha(small), "response", None), (1, 0, sha(""), "response", None), (3, 120, sha("é" * 60), "response", None), (4, 150, sha(big), "revisit", 2), (-1, 150, sha(big), "revisit", 2)]
    assert got == sorted(want, key=str)
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    rec = {r.page_id: r for r in warc.reconstruct(spark, path).collect()}
    assert bytes(rec[2].record).endswith(b"\r\n\r\n" + big.encode() + b"\r\n\r\n") and bytes(rec[4].payload) == big.encode() and bytes(rec[4].record).endswith(b"\r\n\r\n\r\n\r\n")
    assert bytes(rec[2].record).startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and b"Injected" not in [x.split(b":")[0] for x in bytes(rec[9].record).split(b"\r\n")]
    warc.write_archive(pages.limit(0), str(tmp_path / "e"))
    assert warc.read_archive(spark, str(tmp_path / "e")).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    word = lambda *n: "".join(chr(97 + int(d)) for k in n for d in f"{k:04d}")
    base = [" ".join(word(i, j) for j in range(60)) for i in range(30)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(base)] + [(100, base[3], "en", "s", 1), (101, base[4] + "\nown line of this one", "en", "s", 1), (102, None, "en", "s", 0)]
    rows += [(200 + i, "insultword " + " ".join(word(i + 500, j + 500) for j in range(50)), "en", "s", 1) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i >= 200)) for i, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in out}
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), str(tmp_path)).columns == docs.columns, name
    twice = spark.createDataFrame([(1, "the first text of them all"), (1, "something wholly other than that"), (None, "no id here"), (None, "nor is there one with this text")], "doc_id long, text string")
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        assert {r.text for r in stage(spark, twice, str(tmp_path)).collect()} == {r.text for r in twice.collect()}, name
    assert ids == {*range(30), 101, 102} and len(corpus_pipeline.STAGES) == 4


def test_license_words_are_split(spark):
    """Words of whole texts come from one split, not from a match for each."""
    texts = ["", " ", "a", " a", "a ", "..A-b\n\nc9..", "\x00x\x7f", "é\u00a0ñ 日本 🙂🙂-x", "[^_^]`z{", "a\n" * 3000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in df.select("doc_id", license_scan.words(F.col("text")).alias("w")).collect()}
    want = {i: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t) for i, t in enumerate(texts)}
    assert {i: r.w for i, r in got.items()} == want
    assert {r.doc_id: r.n_words for r in license_scan.phrase_places(df).collect()} == {i: len(w) for i, w in want.items()}
    assert "regexp_extract_all" not in str(license_scan.words(F.col("text")))
