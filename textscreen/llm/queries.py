"""Registered queries of this subpackage, with the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import materialise
from . import bpe, counts, extract, infill, licences, lines, packing, pitman_yor, quality, simhash, sketches, vectors, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(build):
        QUERIES[build.__name__] = build
        if sql:
            SQL[build.__name__] = sql
        return build

    return add


def read(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet").select(*columns)


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TRIM = r"regexp_replace({}, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"


@query()
def op1_pitman_yor(spark, sf):
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return pitman_yor.score(read(spark, sf, "documents", "doc_id", "text"), held_out)


@query(
    rf"""
    WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
    m AS (
      SELECT doc_id, len(ws)::BIGINT AS n_words,
        coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls, ws FROM w),
    win AS (SELECT doc_id, p, list_aggregate(ws[p:p+4], 'string_agg', ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS p FROM m)),
    rep AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
    cov AS (SELECT doc_id, count(DISTINCT q)::BIGINT AS n_repeat_words FROM (SELECT doc_id, unnest(range(p, p + 5)) AS q FROM rep) GROUP BY doc_id),
    r AS (
      SELECT m.doc_id, n_words, word_chars, n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
        len(list_filter(ws, lambda x: NOT regexp_matches(x, '[a-z]') AND len(regexp_extract_all(x, '[A-Z]')) > 1)) AS n_upper,
        len(list_filter(ws, lambda x: NOT regexp_matches(x, '[A-Za-z\x{{C0}}-\x{{10FFFF}}]'))) AS n_plain,
        len(list_distinct(ws)) AS n_distinct,
        len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_adjacent
      FROM m LEFT JOIN cov USING (doc_id)),
    b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
      ((n_words < 10)::INT | (100 * n_repeat_words > 20 * n_words)::INT * 2 | (10 * n_symbols > n_words)::INT * 4
      | (10 * n_upper > 3 * n_words)::INT * 8 | (2 * n_plain > n_words)::INT * 16 | (10 * n_distinct < n_words)::INT * 32
      | (10 * n_adjacent > 2 * n_words)::INT * 64 | (2 * n_dup_lines > n_lines)::INT * 128
      | (word_chars < 2 * n_words OR word_chars > 15 * n_words)::INT * 256)::BIGINT AS fail_bits FROM r)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, fail_bits, fail_bits = 0 AS kept FROM b
    """
)
def op2_quality_rules(spark, sf):
    judged = quality.ledger(read(spark, sf, "documents", "doc_id", "text")).select("doc_id", "ledger.*")
    base, bits = quality.passes(F.col("fail_bits"), "base-1"), F.col("fail_bits")
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~base).alias("base_failed"), "fail_bits",
        (base & quality.passes(bits, "strict-1")).alias("kept"),
    )


@query(
    f"""
    WITH l AS ({SQL["op2_quality_rules"]}), r AS (SELECT unnest({[name for name, _ in quality.RULES]}) AS rule, unnest({[1 << i for i in range(len(quality.RULES))]}) AS bit)
    SELECT rule, count(*) FILTER (fail_bits & bit <> 0)::BIGINT AS n_failed, count(*) FILTER (fail_bits = bit)::BIGINT AS n_failed_alone,
      count(*) FILTER (fail_bits & ~bit = 0)::BIGINT AS n_kept_without, count(*) FILTER (fail_bits = 0)::BIGINT AS n_kept FROM l, r GROUP BY rule
    """
)
def quality_ablation(spark, sf):
    """What each rule of the strict policy costs, from a stored ledger."""
    stored = materialise(quality.ledger(read(spark, sf, "documents", "doc_id", "text")).select("doc_id", "ledger.*"), "ledger")
    return quality.ablation(stored, "strict-1")


@query()
def op4_best_fit_packing(spark, sf):
    return packing.pack(read(spark, sf, "documents", "doc_id", "text"))


@query()
def op5_simhash_pivots(spark, sf):
    found = simhash.near_duplicates(read(spark, sf, "documents", "doc_id", "text"), shingle=3, max_bits=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


@query(
    f"""
    WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
        generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
    k AS (SELECT *, {_LOWER.format(_TRIM.format("line"))} AS key FROM l),
    f AS (SELECT *, CASE WHEN length(key) >= 10 THEN min(doc_id) OVER (PARTITION BY key) < doc_id ELSE false END AS gone FROM k)
    SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
      sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM f GROUP BY doc_id
    """
)
def op7_line_dedup(spark, sf):
    kept = lines.dedup(read(spark, sf, "documents", "doc_id", "text"))
    return kept.select("doc_id", "_lines.n_lines", "_lines.n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query()
def op3_line_block_text(spark, sf):
    return extract.extract(read(spark, sf, "pages", "page_id", "url", "html")).select("page_id", "url", "main.text", "main.n_chars")


@query()
def op8_cross_polytope(spark, sf):
    return vectors.near_duplicates(read(spark, sf, "embeddings", "vec_id", "embedding", "label"), cosine=0.93)


#: The vocabulary file; a cluster without it at this path gets it by ``SparkContext.addFile`` and its bare name.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


@query()
def op9_recursive_bpe(spark, sf):
    docs = read(spark, sf, "documents", "doc_id", "text")
    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return bpe.encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, emit=bpe.digests, fields=fields)


@query()
def op10_edit_aware_counts(spark, sf):
    docs = read(spark, sf, "documents", "doc_id", "text")
    tokenizer = public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN
    stored = materialise(counts.build(docs, *tokenizer), "trees")
    return counts.apply_edits(stored, *tokenizer, counts.redactions, keep=False).select("doc_id", "counts.*")


@query()
def op6_licence_scan(spark, sf):
    return licences.scan(read(spark, sf, "documents", "doc_id", "text"))


@query()
def op11_cholesky_whitening(spark, sf):
    return whitening.whiten(read(spark, sf, "embeddings", "vec_id", "embedding"))


@query()
def op12_bottom_k(spark, sf):
    made = sketches.fingerprints(read(spark, sf, "documents", "doc_id", "text"))
    own, changed, following = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return made.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        sketches.to_hex(own).alias("fingerprint"), sketches.to_hex(changed).alias("edited_fingerprint"),
        sketches.resemblance(own, changed).alias("near_edited"), sketches.resemblance(own, following).alias("near_next"),
        sketches.containment(own, changed).alias("kept_in_edited"), sketches.distinct_count(own).alias("distinct_shingles"),
    )


@query(
    """
    WITH t AS (SELECT doc_id, coalesce(text, '') AS s, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || doc_id::VARCHAR) AS d FROM documents),
    h AS (SELECT doc_id, s, n, ('0x' || substr(d, 1, 8))::BIGINT % (n + 1) AS h1, ('0x' || substr(d, 9, 8))::BIGINT % (n + 1) AS h2,
        ('0x' || substr(d, 17, 8))::BIGINT % 100 AS h3, ('0x' || substr(d, 25, 8))::BIGINT % 100 AS h4 FROM t),
    c AS (SELECT doc_id, s, n, least(h1, h2) AS a, greatest(h1, h2) AS b,
        CASE WHEN n = 0 OR contains(s, '<P>') OR contains(s, '<S>') OR contains(s, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
    p AS (SELECT *, substring(s, 1, a) AS pre, substring(s, a + 1, b - a) AS mid, substring(s, b + 1) AS suf FROM c)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN s WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
        sha256(s) AS restored_sha256 FROM p
    """
)
def op13_counted_infill(spark, sf):
    made = infill.transform(read(spark, sf, "documents", "doc_id", "text")).select("doc_id", "infill.*")
    return made.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(infill.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
