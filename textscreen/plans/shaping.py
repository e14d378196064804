"""Projections, filters, unions, joins, splits and whole staging recipes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as score_functions, text
from ..functions.hashing import uniform
from ..operators import evaluate, joins, ordered, rewrite, sequences, split, staging
from ..session import materialise
from .fixtures import counted_vocab, flags, functions, pair_preds, pairs, preds, raw_text, scores, split_functions, table, texts, tokens, truth, u
from .registered import query
from .sources import CLEAN_SQL

_FLAGS_SQL = "(quality = 0 OR toxic = 1)::int"
_HASH_RANK = "row_number() OVER (PARTITION BY target ORDER BY md5(concat('42-', idx)), idx) - 1"
_PARTS = f"""SELECT idx, func, target, CASE WHEN 10 * r < 8 * n THEN 'train' WHEN 10 * r < 9 * n THEN 'test' ELSE 'valid' END AS split
    FROM (SELECT *, {_HASH_RANK} AS r, count(*) OVER (PARTITION BY target) AS n FROM functions)"""


@query("SELECT doc_id, lang AS lang_code, source AS source_name, n_chars FROM documents")
def normalize_columns(spark, sf):
    documents = table(spark, sf, "documents")
    named = documents.select(
        F.col("doc_id").alias("Doc ID"),
        F.col("lang").alias("Lang Code"),
        F.col("source").alias("Source Name"),
        F.col("n_chars").alias("N Chars"),
    )
    return rewrite.normalize_columns(named)


@query("SELECT doc_id, text, n_chars FROM documents")
def drop_columns(spark, sf):
    return rewrite.drop_columns(table(spark, sf, "documents"), ["lang", "source"])


@query("SELECT idx, func, target FROM functions", "functions")
def canonical_select(spark, sf):
    labelled = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return rewrite.canonical(labelled, "text", "toxic", "doc_id")


@query("SELECT doc_id, text, 0 AS label, true AS label_missing FROM documents")
def default_missing(spark, sf):
    return rewrite.with_default(table(spark, sf, "documents"), "label").select("doc_id", "text", "label", "label_missing")


@query("SELECT conv_id, turn, func_before AS func, 1 AS target FROM pairs", "pairs")
def const_columns(spark, sf):
    copied = pairs(spark, sf).withColumns({"func": F.col("func_before"), "target": F.lit(1)})
    return copied.select("conv_id", "turn", "func", "target")


@query(
    """SELECT conv_id, turn, 'before' AS variant, func_before AS func, vul AS target FROM pairs UNION ALL
    SELECT conv_id, turn, 'after', func_after, 0 FROM pairs""",
    "pairs",
)
def unpivot_pairs(spark, sf):
    return rewrite.unpivot_pairs(pairs(spark, sf), "vul").drop("vul")


@query("SELECT doc_id, text AS func FROM documents")
def decode_utf8(spark, sf):
    encoded = table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("bytes"))
    return rewrite.decode_utf8(encoded, "bytes").drop("bytes")


@query(f"SELECT doc_id, {_FLAGS_SQL} AS target FROM labels")
def any_flag(spark, sf):
    return rewrite.any_flag(flags(spark, sf), "CWE").select("doc_id", "target")


@query("SELECT idx, CASE target WHEN 0 THEN 'safe' ELSE 'vulnerable' END AS label FROM functions", "functions")
def label_names(spark, sf):
    label = score_functions.mapped_label(F.col("target"), ["safe", "vulnerable"])
    return functions(spark, sf).select("idx", label.alias("label"))


@query("SELECT idx, 'defect_detection: ' || func AS func FROM functions", "functions")
def prefix_text(spark, sf):
    return functions(spark, sf).select("idx", text.task_prefix(F.col("func")).alias("func"))


@query(f"SELECT doc_id, {CLEAN_SQL} AS func, 'ok' AS status FROM documents")
def rewrite_text(spark, sf):
    raw = texts(spark, sf).select("doc_id", raw_text().alias("func"))
    return rewrite.rewrite_text(raw)


@query("SELECT idx, func, target FROM functions WHERE target = 1", "functions")
def filter_class(spark, sf):
    return functions(spark, sf).filter(F.col("target") == 1).select("idx", "func", "target")


@query("SELECT doc_id, quality FROM documents JOIN labels USING (doc_id)")
def filter_not_null(spark, sf):
    attached = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return attached.filter(F.col("quality").isNotNull()).select("doc_id", "quality")


@query("SELECT model, idx, (y_pred > 0.5 AND idx % 11 <> 0)::int AS predicted FROM preds", "preds")
def threshold(spark, sf):
    """Every eleventh score is not a number and so not above."""
    given = F.when(F.col("idx") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("y_pred"))
    return preds(spark, sf).select("model", "idx", score_functions.above(given).alias("predicted"))


@query("SELECT idx, (s1 > s0)::int AS predicted FROM scores", "scores")
def argmax_class(spark, sf):
    return scores(spark, sf).select("idx", score_functions.argmax(F.col("scores")).alias("predicted"))


_ALL_PREDS = f"SELECT doc_id AS idx, round({u(chr(39) + 'm0' + chr(39), 'doc_id')}, 4) AS y_pred FROM documents"


def _all_preds(spark, sf, salt="m0"):
    """Scores of every text, labelled or not."""
    documents = table(spark, sf, "documents").select(F.col("doc_id").alias("idx"))
    return documents.withColumn("y_pred", F.round(uniform(salt, "idx"), 4))


@query(f"SELECT p.idx, y_pred, target FROM ({_ALL_PREDS}) p LEFT JOIN truth t ON p.idx = t.idx", "truth")
def join_truth(spark, sf):
    return joins.join_truth(_all_preds(spark, sf), truth(spark, sf))


@query(
    f"SELECT t.idx, target, y_pred FROM truth t LEFT JOIN (SELECT * FROM ({_ALL_PREDS}) WHERE y_pred > 0.25) p ON p.idx = t.idx",
    "truth",
)
def attach_preds(spark, sf):
    return joins.attach_predictions(truth(spark, sf), _all_preds(spark, sf).filter("y_pred > 0.25"))


@query(
    f"""SELECT coalesce(b.idx, a.idx) AS idx, b.y_pred AS before, a.y_pred AS after
    FROM (SELECT * FROM ({_ALL_PREDS}) WHERE y_pred > 0.25) b
    FULL JOIN (SELECT * FROM ({_ALL_PREDS}) WHERE y_pred < 0.75) a ON a.idx = b.idx"""
)
def align_preds(spark, sf):
    scored = _all_preds(spark, sf)
    return joins.align_predictions(scored.filter("y_pred > 0.25"), scored.filter("y_pred < 0.75"))


@query(
    """SELECT doc_id, n_chars / (max(n_chars) OVER () + 1.0) AS relative,
    (n_chars - min(n_chars) OVER ())::double / (max(n_chars) OVER () - min(n_chars) OVER ()) AS placed FROM documents"""
)
def scalar_broadcast(spark, sf):
    n, low, high = F.col("n_chars"), F.col("_low"), F.col("_high")
    scaled = joins.with_scalars(table(spark, sf, "documents"), F.min(n).alias("_low"), F.max(n).alias("_high"))
    return scaled.select("doc_id", (n / (high + 1.0)).alias("relative"), ((n - low) / (high - low)).alias("placed"))


@query(
    """SELECT idx, count(*) AS n, round(sum(vec[1]::double), 4) AS first, round(max(vec[64]::double), 6) AS last
    FROM token_rows JOIN vocab USING (token) GROUP BY idx""",
    "tokens",
    "token_rows",
    "vocab",
)
def embed_lookup(spark, sf):
    known = materialise(counted_vocab(spark, sf), "vocab")
    embedded = sequences.embed_tokens(tokens(spark, sf), known.drop("n"), counts=known.select("token", "n"))
    return embedded.groupBy("idx").agg(
        F.count("token").alias("n"),
        F.round(F.sum(F.col("vec")[0].cast("double")), 4).alias("first"),
        F.round(F.max(F.col("vec")[63].cast("double")), 6).alias("last"),
    )


@query("SELECT idx, target, row_number() OVER (ORDER BY target, idx) - 1 AS position FROM truth", "truth")
def assign_idx(spark, sf):
    return ordered.assign_idx(truth(spark, sf), "target", "idx", name="position")


@query(
    """SELECT idx, (row_number() OVER (ORDER BY idx) - 1) // 32 AS in_order,
    (row_number() OVER (ORDER BY md5(concat('7-', idx)), idx) - 1) // 32 AS shuffled FROM truth""",
    "truth",
)
def batches(spark, sf):
    in_order = ordered.batches(truth(spark, sf).select("idx"), 32).withColumnRenamed("batch_id", "in_order")
    return ordered.batches(in_order, 32, seed=7).withColumnRenamed("batch_id", "shuffled")


@query("SELECT idx, row_number() OVER (ORDER BY md5(concat('42-', idx)), idx) - 1 AS rank FROM functions", "functions")
def seeded_shuffle(spark, sf):
    return ordered.shuffle_rank(functions(spark, sf).select("idx"), 42)


@query(
    f"""SELECT 'texts' AS dataset, model, idx, target, y_pred FROM preds UNION ALL
    SELECT 'vectors', 'm0', vec_id, (label = 0)::int, round({u(chr(39) + 'v' + chr(39), 'vec_id')}, 4) FROM embeddings""",
    "preds",
)
def union_datasets(spark, sf):
    columns = ["dataset", "model", "idx", "target", "y_pred"]
    texts = preds(spark, sf).withColumn("dataset", F.lit("texts")).select(*columns)
    vectors = table(spark, sf, "embeddings").select(
        F.lit("vectors").alias("dataset"),
        F.lit("m0").alias("model"),
        F.col("vec_id").alias("idx"),
        (F.col("label") == 0).cast("int").alias("target"),
        F.round(uniform("v", "vec_id"), 4).alias("y_pred"),
    )
    return texts.unionByName(vectors)


@query("SELECT model, dataset, kind, idx, variant, y_pred, target FROM united", "functions", "pair_preds", "united")
def union_truth(spark, sf):
    return evaluate.union_truth(pair_preds(spark, sf))


@query(f"SELECT idx, target, split FROM ({_PARTS})", "functions")
def stratified_split(spark, sf):
    return split.stratified_split(functions(spark, sf).select("idx", "target"))


@query(
    """SELECT split, row_number() OVER (PARTITION BY split ORDER BY idx) - 1 AS idx, func, target, label_missing FROM (
    SELECT idx, func, target, false AS label_missing, split FROM split_functions WHERE split <> 'test' UNION ALL
    SELECT idx, func, 0, true, split FROM split_functions WHERE split = 'test')""",
    "functions",
    "split_functions",
)
def stage_labelled(spark, sf):
    rows = split_functions(spark, sf).select("idx", F.col("func").alias("code"), F.col("target").alias("label"), "split")
    rows = rows.withColumnRenamed("idx", "position")
    labelled = staging.stage_labelled(rows.filter("split <> 'test'"), "position", by=["split"])
    unlabelled = staging.stage_labelled(rows.filter("split = 'test'").drop("label"), "position", by=["split"])
    return labelled.unionByName(unlabelled)


@query(
    f"SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx, text AS func, {_FLAGS_SQL} AS target FROM documents JOIN labels USING (doc_id)"
)
def stage_flags(spark, sf):
    return staging.stage_flags(flags(spark, sf), "doc_id")


@query(
    """SELECT kind, idx, cve_id, variant, func, target FROM (
    SELECT *, CASE WHEN vul = 1 THEN 'vuln' ELSE 'safe' END AS kind,
        row_number() OVER (PARTITION BY vul ORDER BY conv_id, turn) - 1 AS idx FROM (
        SELECT *, CASE WHEN turn % 3 <> 0 THEN 'CVE-' || conv_id END AS cve_id FROM pairs) WHERE cve_id IS NOT NULL),
    LATERAL (SELECT 'before' AS variant, func_before AS func, vul AS target UNION ALL SELECT 'after', func_after, 0)""",
    "pairs",
)
def stage_pairs(spark, sf):
    raw = pairs(spark, sf).select(
        "conv_id",
        "turn",
        F.col("vul"),
        F.when(F.col("turn") % 3 != 0, F.concat(F.lit("CVE-"), F.col("conv_id").cast("string"))).alias("CVE ID"),
        "func_before",
        "func_after",
    )
    staged = staging.stage_pairs(raw, "conv_id", "turn", dropped=["vul"])
    return staging.pair_variants(staged).drop("conv_id", "turn")


@query(
    f"""SELECT source_idx, func, target, split,
    row_number() OVER (PARTITION BY split ORDER BY md5(concat('42-', source_idx)), source_idx) - 1 AS idx
    FROM (SELECT idx AS source_idx, func, target, split FROM ({_PARTS}))""",
    "functions",
)
def stage_stratified(spark, sf):
    return staging.stage_stratified(functions(spark, sf), row_id="idx")


@query(
    """SELECT source_idx, raw_id, func, target, split,
    row_number() OVER (PARTITION BY split ORDER BY md5(concat('42-', source_idx)), source_idx) - 1 AS idx FROM (
    SELECT *, CASE WHEN 10 * r < 8 * n THEN 'train' WHEN 10 * r < 9 * n THEN 'test' ELSE 'valid' END AS split FROM (
    SELECT *, row_number() OVER (PARTITION BY target ORDER BY md5(concat('42-', source_idx)), source_idx) - 1 AS r,
        count(*) OVER (PARTITION BY target) AS n FROM (
    SELECT row_number() OVER (ORDER BY length(func), idx) - 1 AS source_idx, nullif(idx % 7, 0) AS raw_id, func, target FROM functions)))""",
    "functions",
)
def stage_stratified_repeats(spark, sf):
    """Rows whose own ids are null or repeated, numbered by length and position instead."""
    rows = functions(spark, sf).withColumns({"raw_id": F.nullif(F.col("idx") % 7, F.lit(0)), "n": F.length("func")})
    return staging.stage_stratified(rows.withColumnRenamed("idx", "position"), key="n", tie="position", keep=["raw_id"])
