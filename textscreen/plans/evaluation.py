"""Metrics, reports and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import workflows
from ..functions import scores as score_functions, text
from ..operators import checks, evaluate, joins, precision, runs as run_operators
from ..session import shared_dir
from ..sources import writers
from .fixtures import TOKEN_SQL, functions, pair_preds, preds, runs, scores, split_functions, table, texts, truth
from .registered import query

_BOARD = ("preds", "conf", "conf_with_baselines", "board")
_METRICS = """(tn + tp)::double / (tn + fp + fn + tp) AS accuracy,
    CASE WHEN tp + fp = 0 THEN 0 ELSE tp::double / (tp + fp) END AS "precision",
    CASE WHEN tp + fn = 0 THEN 0 ELSE tp::double / (tp + fn) END AS recall,
    CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp::double / (2 * tp + fp + fn) END AS f1"""
_LOSS_ROWS = """SELECT idx, target, greatest(s0, s1) + ln(exp(s0 - greatest(s0, s1)) + exp(s1 - greatest(s0, s1)))
    - CASE target WHEN 1 THEN s1 ELSE s0 END AS ce,
    (SELECT count(*) FROM scores)::double / count(*) OVER (PARTITION BY target) AS cw FROM scores"""


@query("SELECT target, count(*) AS n FROM functions GROUP BY target", "functions")
def class_counts(spark, sf):
    return evaluate.class_counts(functions(spark, sf))


@query("SELECT target, count(*) AS n, (SELECT count(*) FROM functions)::double / count(*) AS weight FROM functions GROUP BY target", "functions")
def class_weights(spark, sf):
    return evaluate.class_weights(functions(spark, sf))


@query("SELECT idx, target, count(*) OVER ()::double / count(*) OVER (PARTITION BY target) AS class_weight FROM truth", "truth")
def class_weight_join(spark, sf):
    return evaluate.with_class_weight(truth(spark, sf))


@query(
    """SELECT doc_id AS idx, class, count(*) OVER ()::double / count(*) OVER (PARTITION BY class) AS class_weight
    FROM (SELECT doc_id, toxic + 2 * quality AS class FROM labels)""",
)
def class_weight_many(spark, sf):
    """Four classes."""
    rows = table(spark, sf, "labels").select(F.col("doc_id").alias("idx"), (F.col("toxic") + 2 * F.col("quality")).alias("class"))
    return evaluate.with_class_weight(rows, "class")


@query("SELECT split, count(*) AS n, sum(target)::bigint AS positives FROM split_functions GROUP BY split", "functions", "split_functions")
def split_counts(spark, sf):
    return evaluate.split_counts(split_functions(spark, sf))


def _stats_sql(column: str, source: str) -> str:
    return (
        f"SELECT '{column}' AS name, round(avg({column}), 8) AS mean, round(stddev_samp({column}), 8) AS std, "
        f"round(median({column}), 8) AS median FROM {source}"
    )


@query(
    " UNION ALL ".join(_stats_sql(c, "(SELECT *, before - after AS diff FROM pair_preds)") for c in ("before", "after", "diff")),
    "functions",
    "pair_preds",
)
def delta_stats(spark, sf):
    scored = pair_preds(spark, sf).withColumn("diff", F.col("before") - F.col("after"))
    stats = evaluate.column_stats(scored, ["before", "after", "diff"])
    return stats.select("name", *[F.round(c, 8).alias(c) for c in ("mean", "std", "median")])


@query("SELECT model, tn, fp, fn, tp FROM conf", "preds", "conf")
def confusion(spark, sf):
    return evaluate.confusion(preds(spark, sf), ["model"], predicted=score_functions.above(F.col("y_pred")))


@query(f"SELECT model, {_METRICS} FROM conf", "preds", "conf")
def point_metrics(spark, sf):
    return evaluate.point_metrics(preds(spark, sf), ["model"])


@query(
    """SELECT model, round(sum(tp / total * ctp / cn), 8) AS average_precision FROM (
    SELECT model, tp::double AS tp, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn, sum(tp) OVER (PARTITION BY model) AS total FROM (
    SELECT model, y_pred, sum(target)::double AS tp, count(*)::double AS n FROM preds GROUP BY ALL)
    WINDOW w AS (PARTITION BY model ORDER BY y_pred DESC)) GROUP BY model""",
    "preds",
)
def average_precision(spark, sf):
    rated = evaluate.average_precision(preds(spark, sf), ["model"])
    return rated.withColumn("average_precision", F.round("average_precision", 8))


_CELLS = 200


@query(
    f""", steps AS (SELECT model, tp, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn FROM (
        SELECT model, y_pred, sum(target)::double AS tp, count(*)::double AS n FROM preds GROUP BY ALL) WINDOW w AS (PARTITION BY model ORDER BY y_pred DESC)),
    exact AS (SELECT model, sum(tp * ctp / cn) / sum(tp) AS ap FROM steps GROUP BY model),
    cells AS (SELECT model, cell, p, n - p AS n, coalesce(sum(p) OVER w, 0) AS tp, coalesce(sum(n) OVER w, 0) AS seen FROM (
        SELECT model, least({_CELLS - 1}, floor(y_pred * {_CELLS})) AS cell, sum(target)::double AS p, count(*)::double AS n FROM preds GROUP BY ALL)
        WINDOW w AS (PARTITION BY model ORDER BY cell DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    bounds AS (SELECT model, sum(p * (tp + p) / (seen + p + n)) FILTER (p > 0) / sum(p) AS value, sum(p * (tp + p) / (seen + p)) FILTER (p > 0) / sum(p) AS high,
        sum(CASE WHEN seen + n = 0 THEN p ELSE greatest(0, p - (seen + n - tp) * ln((seen + n + p + 0.5) / (seen + n + 0.5))) END) FILTER (p > 0) / sum(p) AS low FROM cells GROUP BY model)
    SELECT model, round(value, 8) AS average_precision, round(low, 8) AS low, round(high, 8) AS high, round(ap, 8) AS exact, true AS inside FROM bounds JOIN exact USING (model)""",
    "preds",
)
def average_precision_bounds(spark, sf):
    """The bounds from two merged sketches, and the exact value inside them."""
    rated, even = preds(spark, sf), F.col("idx") % 2 == 0
    merged = precision.merge(*[precision.sketch(rated.filter(half), ["model"], cells=_CELLS) for half in (even, ~even)], by=["model"])
    bounds = precision.average_precision_bounds(merged, ["model"])
    exact = evaluate.average_precision(rated, ["model"]).withColumnRenamed("average_precision", "exact")
    both = bounds.join(exact, "model").withColumn("inside", F.col("exact").between(F.col("low") - 1e-12, F.col("high") + 1e-12))
    return both.select("model", *[F.round(c, 8).alias(c) for c in ("average_precision", "low", "high", "exact")], "inside")


@query(
    """SELECT count(*) FILTER ((s1 > s0)::int = target)::double / count(*) AS accuracy,
    2 * count(*) FILTER (s1 > s0 AND target = 1)::double / (count(*) FILTER (s1 > s0) + count(*) FILTER (target = 1)) AS f1 FROM scores""",
    "scores",
)
def score_metrics(spark, sf):
    return evaluate.score_metrics(scores(spark, sf))


@query(
    f"""SELECT -1::bigint AS batch_id, round(avg(cw * ce * 0.8), 8) AS loss FROM ({_LOSS_ROWS}) UNION ALL
    SELECT idx // 128, round(avg(cw * ce * 0.8), 8) FROM ({_LOSS_ROWS}) GROUP BY 1""",
    "scores",
)
def weighted_loss(spark, sf):
    rows = evaluate.with_class_weight(scores(spark, sf)).withColumn("weight", F.lit(0.8))
    whole = evaluate.weighted_loss(rows).select(F.lit(-1).cast("long").alias("batch_id"), F.round("loss", 8).alias("loss"))
    batched = evaluate.weighted_loss(rows.withColumn("batch_id", F.expr("idx div 128")), ["batch_id"])
    return whole.unionByName(batched.withColumn("loss", F.round("loss", 8)))


_POOLED = """count(*) FILTER (target = 0 AND y_pred <= 0.5) AS tn, count(*) FILTER (target = 0 AND y_pred > 0.5) AS fp,
    count(*) FILTER (target = 1 AND y_pred <= 0.5) AS fn, count(*) FILTER (target = 1 AND y_pred > 0.5) AS tp FROM united"""


@query(
    f"""SELECT model, dataset, {_METRICS} FROM (SELECT model, dataset, {_POOLED} GROUP BY ALL
    UNION ALL SELECT model, 'all', {_POOLED} GROUP BY model)""",
    "functions",
    "pair_preds",
    "united",
)
def micro_metrics(spark, sf):
    united = evaluate.union_truth(pair_preds(spark, sf))
    counts = evaluate.confusion(united, ["model", "dataset"], predicted=score_functions.above(F.col("y_pred")))
    # Each line of counts stands for its data set and for the pool.
    lines = counts.withColumn("dataset", F.explode(F.array("dataset", F.lit("all"))))
    summed = lines.groupBy("model", "dataset").agg(*[F.sum(c).alias(c) for c in ("tn", "fp", "fn", "tp")])
    return summed.select("model", "dataset", *[c.alias(n) for n, c in evaluate.ratios().items()])


@query(
    f"""SELECT doc_id, round(avg(len(regexp_extract_all(part, {TOKEN_SQL}))), 8) AS tokens FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS part FROM documents) WHERE part <> '' GROUP BY doc_id"""
)
def nested_mean(spark, sf):
    parts = F.filter(F.split("text", "\n"), lambda p: p != "")
    mean = text.mean_of_parts(parts, text.token_count)
    return texts(spark, sf).select("doc_id", F.round(mean, 8).alias("tokens"))


@query("SELECT run, epoch, greatest(0, max(val_ap) OVER (PARTITION BY run ORDER BY epoch)) AS best FROM runs", "runs")
def running_best(spark, sf):
    return run_operators.running_best(runs(spark, sf), "val_ap", ["run"]).select("run", "epoch", "best")


@query(
    """SELECT run, epoch, val_ap, r <= 2 AS best, epoch = last_epoch AS last FROM (
    SELECT *, row_number() OVER (PARTITION BY run ORDER BY val_ap DESC, epoch) AS r, max(epoch) OVER (PARTITION BY run) AS last_epoch
    FROM runs) WHERE r <= 2 OR epoch = last_epoch""",
    "runs",
)
def top_checkpoints(spark, sf):
    return run_operators.top_checkpoints(runs(spark, sf))


@query('SELECT model, f1, "precision", recall FROM board WHERE model LIKE \'m%\' ORDER BY f1 DESC, model', *_BOARD)
def leaderboard_sort(spark, sf):
    rated = evaluate.point_metrics(preds(spark, sf), ["model"])
    return rated.select("model", "f1", "precision", "recall").orderBy(F.desc("f1"), "model")


@query(
    f"SELECT model, tn, fp, fn, tp, {_METRICS} FROM conf_with_baselines WHERE model NOT LIKE 'm%'",
    "preds",
    "conf",
    "conf_with_baselines",
)
def baselines(spark, sf):
    counts = evaluate.confusion(preds(spark, sf), ["model"], predicted=score_functions.above(F.col("y_pred")))
    return evaluate.baselines(counts).select("*", *[c.alias(n) for n, c in evaluate.ratios().items()])


@query('SELECT model, f1, "precision", recall FROM board ORDER BY f1 DESC, model', *_BOARD)
def leaderboard(spark, sf):
    labelled = joins.join_truth(preds(spark, sf).drop("target"), truth(spark, sf))
    return evaluate.leaderboard(labelled)


@query('SELECT model, f1, "precision", recall FROM board', *_BOARD)
def row_leaderboard(spark, sf):
    """The leaderboard from files of predictions, one per model and data set, and the truth apart."""
    rows = preds(spark, sf).withColumn("file", F.concat(F.lit("set"), F.col("idx") % 3)).select("model", "file", "idx", "y_pred")
    root = writers.write_csv(rows, shared_dir(spark, "rows"), ["model", "file"])
    return workflows.row_leaderboard(spark, root, truth(spark, sf))


@query(
    """SELECT model, CASE WHEN "precision" > 0 THEN round_even((1 / "precision" - 1) * 100, 0) ELSE 'inf'::double END AS fp_per_100,
    round_even(100 - recall * 100, 0) AS fn_per_100 FROM board""",
    *_BOARD,
)
def error_cost(spark, sf):
    return evaluate.error_cost(evaluate.leaderboard(preds(spark, sf)))


@query(
    """SELECT model, dataset, name AS "check", expected, actual, expected = actual AS ok FROM (
    SELECT model, dataset, count(*) FILTER (kind = 'vuln') AS v, count(*) FILTER (kind = 'safe') AS s FROM pair_preds GROUP BY ALL)
    JOIN (SELECT model, dataset, count(*) AS n, count(target) AS t, count(*) FILTER (target = 0) AS z, count(*) FILTER (target = 1) AS o
        FROM united GROUP BY ALL) USING (model, dataset),
    LATERAL (VALUES ('predictions', s + 2 * v, n), ('truths', n, t), ('safe', s + v, z), ('vulnerable', v, o)) c(name, expected, actual)""",
    "functions",
    "pair_preds",
    "united",
)
def cardinality_checks(spark, sf):
    pairs = pair_preds(spark, sf)
    return checks.cardinality_checks(pairs, evaluate.union_truth(pairs), ["model", "dataset"])


@query(
    """SELECT 'y_pred' AS "check", 0::bigint AS expected, count(*) FILTER (y_pred IS NULL) AS actual, count(*) FILTER (y_pred IS NULL) = 0 AS ok
    FROM documents LEFT JOIN preds ON doc_id = idx AND model = 'm1' UNION ALL
    SELECT 'target', 0, count(*) FILTER (target IS NULL), count(*) FILTER (target IS NULL) = 0
    FROM documents LEFT JOIN preds ON doc_id = idx AND model = 'm1'""",
    "preds",
)
def nan_guard(spark, sf):
    documents = table(spark, sf, "documents").select(F.col("doc_id").alias("idx"))
    attached = joins.attach_predictions(documents, preds(spark, sf).filter("model = 'm1'"))
    return checks.nan_guard(attached, ["y_pred", "target"])


@query(
    """SELECT model, idx, max(y_pred) FILTER (variant = 'before') AS before, max(y_pred) FILTER (variant = 'after') AS after,
    max(y_pred) FILTER (variant = 'before') - max(y_pred) FILTER (variant = 'after') AS diff FROM united WHERE kind = 'vuln' GROUP BY ALL""",
    "functions",
    "pair_preds",
    "united",
)
def before_after_delta(spark, sf):
    scored = evaluate.union_truth(pair_preds(spark, sf)).filter("kind = 'vuln'")
    return evaluate.before_after(scored, ["model", "idx"])


@query("SELECT idx, round(exp(s1) / (exp(s0) + exp(s1)), 9) AS y_pred FROM scores", "scores")
def softmax_p1(spark, sf):
    return scores(spark, sf).select("idx", F.round(score_functions.softmax_at(F.col("scores"), 1), 9).alias("y_pred"))


_PAIR_BOARD = f"SELECT model, {_POOLED} GROUP BY model"


@query(
    f"""SELECT model, {_METRICS.split("AS accuracy,")[1]} FROM (WITH c AS MATERIALIZED ({_PAIR_BOARD}) SELECT * FROM c UNION ALL
    SELECT 'safe baseline', tn + fp, 0, fn + tp, 0 FROM c WHERE model = 'm2' UNION ALL
    SELECT 'vuln baseline', 0, tn + fp, 0, fn + tp FROM c WHERE model = 'm2')""",
    "functions",
    "pair_preds",
    "united",
)
def pair_leaderboard(spark, sf):
    rows = pair_preds(spark, sf).withColumn("file", F.concat_ws("-", "dataset", "kind"))
    root = writers.write_csv(rows.select("model", "file", "before", "after"), shared_dir(spark, "pairs"), ["model", "file"])
    return workflows.pair_leaderboard(workflows.pair_predictions(spark, root))


@query(
    f"""SELECT model, tn, fp, fn, tp, {_METRICS}, average_precision FROM conf JOIN (
    SELECT model, round(sum(tp / total * ctp / cn), 8) AS average_precision FROM (
    SELECT model, tp::double AS tp, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn, sum(tp) OVER (PARTITION BY model) AS total FROM (
    SELECT model, y_pred, sum(target)::double AS tp, count(*)::double AS n FROM preds GROUP BY ALL)
    WINDOW w AS (PARTITION BY model ORDER BY y_pred DESC)) GROUP BY model) USING (model)""",
    "preds",
    "conf",
)
def row_report(spark, sf):
    report = workflows.row_report(preds(spark, sf), ["model"])
    return report.withColumn("average_precision", F.round("average_precision", 8))
