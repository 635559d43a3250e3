"""Spelling variants: words that are one edit apart, by an even-partition pigeonhole join.

Of two words that differ by one inserted, deleted or replaced code point, one of
the two halves of the shorter word stands unchanged in the other: the first half
in place, the second at the end, one position on if the other word is longer. So a
word is indexed by its two halves, and probes with the substrings at those places
for words of its own length and, one position on, for words one shorter.

Rows that meet know where the edit is: in the part that is not shared. If a key
holds more than ``full`` rows (words with a common beginning, say), its rows are
keyed again by the two halves of that part, and so on until few meet or the part
is a single code point. No pair is given up, and no key's rows are paired with each other
while they are many. Every pair is found once: at the part that holds the first
code point in which the two words differ.

Pairs are verified by the edit distance of the parts that are not shared. A word's
form is its near word of largest count, if that is ``ratio`` times its own; roots
follow forms by doubling steps, and counts grow along them, so there are few.

Null texts hold no words; a null id is written as nothing in front of the colon;
repeated rows count again, and further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Params:
    shortest: int = 7  #: code points
    least: int = 2  #: occurrences
    every: int = 31  #: a code point goes where this divides an occurrence's hash
    ratio: int = 10  #: how much more often a form occurs
    full: int = 128  #: rows of a key that meet without further keys


def occurrences(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(word) for every occurrence, with the code points deleted that the hashes name."""
    # shorter runs can be no word: only those that are long enough leave the text
    runs = F.regexp_extract_all("text", F.lit(f"([A-Za-z\\u00C0-\\u00FF]{{{p.shortest},}}+)"), F.lit(1))
    run = F.translate("run", UPPER, LOWER)
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run"))
    rows = docs.select("doc_id", F.explode(runs).alias("run")).select("doc_id", run.alias("run")).select("run", h.alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    word = F.when(F.pmod("h", F.lit(p.every)) != 0, F.col("run")).when(
        F.length("run") > p.shortest, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run"))))
    return rows.select(word.alias("word")).where("word is not null")


def counted(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(word, n) of the words that occur often enough."""
    return occurrences(docs, p).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= p.least)


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows(word, n, l, longer, a, b)`` with their ``key``: what stands outside
    the part [a, b) of words of length l, of a word that is ``longer`` outside the
    part that is one longer."""
    tail = F.col("b") + F.col("longer")
    return rows.withColumn("key", F.xxhash64("l", "a", "b", F.substring("word", F.lit(1), F.col("a")), F.substring("word", tail + 1, F.lit(1 << 20))))


def _halved(rows: DataFrame) -> DataFrame:
    """Each row twice: its part [a, b) in two halves."""
    mid = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    part = F.explode(F.array(F.struct(F.col("a").alias("a"), mid.alias("b")), F.struct(mid.alias("a"), F.col("b").alias("b")))).alias("part")
    return rows.select("word", "n", "l", "longer", part).select("word", "n", "l", "longer", "part.a", "part.b")


def near_pairs(words: DataFrame, p: Params = Params(), store: Written | None = None) -> DataFrame:
    """(a, a_n, b, b_n): the pairs of ``words(word, n)`` that are one edit apart, once
    each; b is the longer one, or the later of two of one length. Words are distinct."""
    store = store or Written(words.sparkSession)
    # as a word to be found, and as one that looks for words of its length or one shorter
    roles = F.explode(F.array(F.lit(0), F.lit(1))).alias("longer")
    rows = words.select("word", "n", F.length("word").alias("size"), roles).where("size > longer")
    rows = rows.select("word", "n", (F.col("size") - F.col("longer")).alias("l"), "longer", F.lit(0).alias("a"), (F.col("size") - F.col("longer")).alias("b"))
    found, open_ = [], rows
    while True:
        keyed = _keyed(_halved(open_))
        many = keyed.where("b > a + 1").groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > p.full).select("key")
        many = store.write(many, "many")
        last = many.isEmpty()
        if not last:
            keyed = store.write(keyed.join(many.withColumn("deep", F.lit(True)), "key", "left"), "keyed")
            open_ = keyed.where("deep").drop("deep", "key")
            keyed = keyed.where("deep is null").drop("deep")
        found.append(_met(keyed))
        if last:
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _met(keyed: DataFrame) -> DataFrame:
    x = keyed.where("longer = 0").select("key", F.col("word").alias("x"), F.col("n").alias("x_n"), "l", "a", "b")
    y = keyed.select("key", F.col("word").alias("y"), F.col("n").alias("y_n"), F.col("l").alias("y_l"), F.col("a").alias("y_a"), F.col("b").alias("y_b"), "longer")
    same = (F.col("l") == F.col("y_l")) & (F.col("a") == F.col("y_a")) & (F.col("b") == F.col("y_b"))
    once = (F.col("longer") == 1) | (F.col("x") < F.col("y"))
    # the first difference is in this part; if there is none, y goes on where x ends
    here = (F.col("b") == F.col("l")) | (F.substring("x", F.lit(1), F.col("b")) != F.substring("y", F.lit(1), F.col("b")))
    near = F.levenshtein(F.substring("x", F.col("a") + 1, F.col("b") - F.col("a")), F.substring("y", F.col("a") + 1, F.col("b") - F.col("a") + F.col("longer")), 1) == 1
    outside = (F.substring("x", F.lit(1), F.col("a")) == F.substring("y", F.lit(1), F.col("a"))) & (
        F.substring("x", F.col("b") + 1, F.lit(1 << 20)) == F.substring("y", F.col("b") + F.col("longer") + 1, F.lit(1 << 20)))
    met = x.join(y, "key").where(same & once & here & near & outside)
    return met.select(F.col("x").alias("a"), F.col("x_n").alias("a_n"), F.col("y").alias("b"), F.col("y_n").alias("b_n"))


def grouped(words: DataFrame, p: Params = Params(), store: Written | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of ``words(word, n)``."""
    store = store or Written(words.sparkSession)
    pairs = near_pairs(words, p, store)
    both = F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))).alias("x")
    # of equal counts the smallest word: bytes of UTF-8 compare as code points do
    best = pairs.select(both).select("x.*").groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    known = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "best.near", (-F.col("best.less")).alias("near_n"))
    often = F.col("near_n") >= p.ratio * F.col("n")
    known = store.write(known.select("word", "n", "n_near", F.when(often, F.col("near")).alias("form"), F.when(often, F.col("near_n")).alias("form_n")), "forms")
    # steps double: each word knows the word 1, 2, 4, ... forms on
    steps = known.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = store.write(steps.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        steps = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            break
    return known.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``docs(doc_id, text)``."""
    store = Written(docs.sparkSession)
    return grouped(store.write(counted(docs, p), "words"), p, store)
