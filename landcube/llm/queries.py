"""The registered queries of this subpackage: each applies one operator, with
production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_tree, fill_middle, lattice, license_scan, line_dedup, norm_topk, packing, piece_rounds, simhash, token_counts, toxicity, variants, warc
from .common import Written, table


def op1_lattice_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_norm_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm_topk.top_k(table(spark, sf_dir, "embeddings"))


def op3_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe_tree.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op6_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.duplicate_lines(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the archive to the shared folder, then answers from what it reads there."""
    path = f"{Written(spark).base}/archive"
    pages = table(spark, sf_dir, "pages")
    warc.write_archive(pages, path)
    return warc.read_archive(spark, path, dict(pages.dtypes)["page_id"]).drop("url")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


def op12_piece_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_rounds.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lattice_near_dedup": op1_lattice_near_dedup,
    "op2_norm_topk": op2_norm_topk,
    "op3_bpe_tree": op3_bpe_tree,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_license_scan": op5_license_scan,
    "op6_simhash_vptree": op6_simhash_vptree,
    "op7_token_counts": op7_token_counts,
    "op8_toxicity": op8_toxicity,
    "op9_line_dedup": op9_line_dedup,
    "op10_warc": op10_warc,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_piece_rounds": op12_piece_rounds,
    "op13_fill_middle": op13_fill_middle,
}

#: DuckDB twins of the queries that SQL can express on whole tables.
ORACLES: dict[str, str] = {
    "op2_norm_topk": """
        with v as (select vec_id, [floor(256 * x::double)::bigint for x in embedding] x from embeddings
                   where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        s as (select q.vec_id query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::bigint score
              from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(c.x) = len(q.x)),
        r as (select *, row_number() over (partition by query_id order by score desc, vec_id) "rank" from s)
        select query_id, "rank"::int "rank", vec_id, score from r where "rank" <= 5""",
    "op10_warc": """
        with p as (select page_id, coalesce(html, '') html from pages),
        d as (select page_id, strlen(html)::bigint n, sha256(html) digest from p),
        k as (select *, case when n >= 100 then min(page_id) over (partition by digest) end keeper from d)
        select page_id, n payload_bytes, digest payload_digest,
               case when keeper is null or keeper = page_id then 'response' else 'revisit' end record_type,
               case when keeper <> page_id then keeper end refers_to
        from k""",
    "op11_spelling_variants": """
        with recursive t as (select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) crc),
        runs as (select coalesce(doc_id::varchar, '') id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') run from documents),
        bytes as (select run, flatten(list_transform(string_split(id || ':' || run, ''), lambda c: case when unicode(c) < 128 then [unicode(c)::bigint] else [192 + unicode(c) // 64, 128 + unicode(c) % 64]::bigint[] end)) b
                  from runs where length(run) >= 7),
        hashed as (select run, xor(list_reduce([4294967295::bigint] || b, lambda c, x: xor(c // 256, crc[xor(c % 256, x) + 1])), 4294967295) h from bytes, t),
        v as (select case when h % 31 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end word from hashed),
        w as (select word, count(*) n from v where length(word) >= 7 group by word having count(*) >= 2),
        part as (select word, n, i::int i, substr(word, 1, i::int) || chr(0) || substr(word, i::int + 2) k, substr(word, 1, i::int) || substr(word, i::int + 2) d from (select word, n, unnest(range(length(word))) i from w)),
        shorter as (select distinct p.word, p.n, q.word near, q.n near_n from part p join w q on q.word = p.d),
        near as (select p.word, q.word near, q.n near_n from part p join part q on p.i = q.i and p.k = q.k and p.word <> q.word
                 union all select word, near, near_n from shorter union all select near, word, n from shorter),
        best as (select word, count(*) n_near, min({'less': -near_n, 'near': near}) x from near group by word),
        f as (select w.word, w.n, coalesce(b.n_near, 0) n_near, case when -b.x.less >= 10 * w.n then b.x.near end form, case when -b.x.less >= 10 * w.n then -b.x.less end form_n
              from w left join best b on w.word = b.word),
        walk as (select word, word as reached, 0 as steps from f union all select a.word, f.form, a.steps + 1 from walk a join f on a.reached = f.word where f.form is not null),
        r as (select word, max_by(reached, steps) root from walk group by word)
        select f.word, f.form, r.root, f.n, f.n_near, f.form_n from f join r on f.word = r.word""",
    "op13_fill_middle": """
        with d as (select doc_id, coalesce(text, '') t, sha256('42:' || coalesce(doc_id::varchar, '')) h from documents),
        k as (select doc_id, t, regexp_extract_all(t, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') u,
                     list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::bigint) x from d),
        c as (select *, len(u)::bigint n, least(x[1] % (len(u) + 1), x[2] % (len(u) + 1)) a, greatest(x[1] % (len(u) + 1), x[2] % (len(u) + 1)) b,
                     case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or x[3] % 100 >= 50 then 'plain' when x[4] % 100 < 80 then 'spm' else 'psm' end form from k),
        p as (select doc_id, t, n, form, array_to_string(u[1:a], '') p, array_to_string(u[a + 1:b], '') m, array_to_string(u[b + 1:], '') s from c)
        select doc_id, n, form, case when form <> 'plain' then length(p)::bigint end prefix_chars, case when form <> 'plain' then length(m)::bigint end middle_chars,
               sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) output_sha256,
               sha256(case form when 'plain' then t else p || m || s end) restored_sha256 from p""",
}
