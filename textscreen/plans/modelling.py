"""Training, selecting and applying classifiers on the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import workflows
from ..functions.hashing import uniform
from ..operators import evaluate, models, training
from ..operators.curriculum import rank_for_epochs
from ..session import materialise, shared_dir
from ..sources import writers
from .fixtures import TOKEN_SQL, pairs, table, texts, u, vocab
from .registered import query

_VECTORS = 64


def _examples(spark, sf):
    """Four groups with their own share of positives, as one-hot features, and a weight from the id.

    Without a penalty the fit has a closed form: a group's probability is its
    weighted share of positives.
    """
    group = (F.col("vec_id") % 4).cast("int")
    rows = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("idx"),
        F.transform(F.array(*[F.lit(g) for g in range(4)]), lambda g: (g == group).cast("double")).alias("vector"),
        (uniform("label", "vec_id") < 0.2 + 0.15 * group).cast("int").alias("target"),
        (0.5 + uniform("weight", "vec_id") / 2).alias("weight"),
        (uniform("part", "vec_id") < 0.8).alias("training"),
    )
    return models.with_features(rows, "vector")


_FIT = {"fitIntercept": False, "maxIter": 200, "tol": 1e-12}
_EXAMPLES_SQL = f"""SELECT vec_id AS idx, (vec_id % 4)::int AS g, ({u("'label'", 'vec_id')} < 0.2 + 0.15 * (vec_id % 4))::int AS target,
    0.5 + {u("'weight'", 'vec_id')} / 2 AS weight, {u("'part'", 'vec_id')} < 0.8 AS training FROM embeddings"""


def _shares_sql(where: str) -> str:
    """The closed form: class weight times sample weight, positives over all, per group."""
    return f"""SELECT g, sum(w * target) / sum(w) AS p FROM (
        SELECT g, target, weight * count(*) OVER ()::double / count(*) OVER (PARTITION BY target) AS w
        FROM ({_EXAMPLES_SQL}) WHERE {where}) GROUP BY g"""


@query(f"SELECT g AS feature, round(ln(p / (1 - p)), 4) AS coefficient FROM ({_shares_sql('true')}) UNION ALL SELECT -1, 0.0")
def train_weighted(spark, sf):
    model = models.train_weighted(_examples(spark, sf), weight="weight", **_FIT)
    return spark.createDataFrame(
        [(i, round(float(c), 4)) for i, c in enumerate(model.coefficients)] + [(-1, float(model.intercept))], "feature int, coefficient double"
    )


@query(f"SELECT idx, round(p, 5) AS y_pred FROM ({_EXAMPLES_SQL}) JOIN ({_shares_sql('training')}) USING (g)")
def batch_score(spark, sf):
    rows = _examples(spark, sf)
    model = models.train_weighted(rows.filter("training"), weight="weight", **_FIT)
    return models.score(rows, model).withColumn("y_pred", F.round("y_pred", 5))


@query(
    f"""WITH shares AS ({_shares_sql("training")}),
    valid AS (SELECT idx, target, p FROM ({_EXAMPLES_SQL}) JOIN shares USING (g) WHERE NOT training),
    steps AS (SELECT tp, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn FROM (
        SELECT p, sum(target)::double AS tp, count(*)::double AS n FROM valid GROUP BY p) WINDOW w AS (ORDER BY p DESC))
    SELECT idx, round(p, 5) AS y_pred, (SELECT round(sum(tp * ctp / cn) / sum(tp), 8) FROM steps) AS val_ap,
        (SELECT round(avg(target), 8) FROM valid) AS flat_ap FROM valid"""
)
def select_model(spark, sf):
    """A penalty so large that all scores are equal against none; the equal scores rate as the share of positives."""
    rows = materialise(_examples(spark, sf).select("idx", "vector", "target", "weight", "training"), "examples")
    rows = models.with_features(rows, "vector")
    train, valid = rows.filter("training"), rows.filter("NOT training")
    flat = {**_FIT, "regParam": 1e4, "elasticNetParam": 1.0}
    model, rates = models.select_model(train, valid, [flat, _FIT], weight="weight")
    rated = {f"{name}_ap": F.lit(round(rate, 8)) for name, (_, rate) in zip(("flat", "val"), rates)}
    return models.score(valid, model).withColumn("y_pred", F.round("y_pred", 5)).withColumns(rated)


_RUN_SQL = """WITH rows AS (SELECT idx, g, target, CASE WHEN part < 0.6 THEN 'train' WHEN part < 0.8 THEN 'valid' ELSE 'test' END AS split FROM (
        SELECT vec_id AS idx, (vec_id % 4)::int AS g, (LABEL < 0.2 + 0.15 * (vec_id % 4))::int AS target, PART AS part FROM embeddings)),
    weights AS (SELECT target, (SELECT count(*) FROM rows WHERE split = 'train')::double / count(*) AS cw FROM rows WHERE split = 'train' GROUP BY target),
    shares AS (SELECT g, sum(cw * target) / sum(cw) AS p FROM rows JOIN weights USING (target) WHERE split = 'train' GROUP BY g),
    scored AS (SELECT split, target, cw, p FROM rows JOIN shares USING (g) JOIN weights USING (target)),
    steps AS (SELECT split, tp, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn FROM (
        SELECT split, p, sum(target)::double AS tp, count(*)::double AS n FROM scored GROUP BY ALL) WINDOW w AS (PARTITION BY split ORDER BY p DESC)),
    found AS (
        SELECT split, 'acc' AS metric, avg(((p > 0.5)::int = target)::int) AS value FROM scored GROUP BY split UNION ALL
        SELECT split, 'f1', 2 * count(*) FILTER (p > 0.5 AND target = 1)::double
            / (count(*) FILTER (p > 0.5) + count(*) FILTER (target = 1)) FROM scored GROUP BY split UNION ALL
        SELECT split, 'loss', avg(-cw * ln(CASE target WHEN 1 THEN p ELSE 1 - p END)) FROM scored GROUP BY split UNION ALL
        SELECT split, 'ap', sum(tp * ctp / cn) / sum(tp) FROM steps GROUP BY split)
    SELECT epoch, split, metric, round(value, 5) AS value FROM (
        SELECT unnest([0, 1])::bigint AS epoch, * FROM (SELECT split, metric, value FROM found UNION ALL SELECT split, 'max_' || metric, value FROM found) WHERE split <> 'test'
        UNION ALL SELECT 0, split, metric, value FROM found WHERE split = 'test')"""


@query(_RUN_SQL.replace("LABEL", u("'label'", "vec_id")).replace("PART ", u("'part'", "vec_id") + " "))
def train_run(spark, sf):
    """A whole run on texts of one word each, whose vectors are one-hot: every metric has a closed form."""
    group = (F.col("vec_id") % 4).cast("int")
    rows = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("idx"),
        F.concat(F.lit("g"), group).alias("func"),
        (uniform("label", "vec_id") < 0.2 + 0.15 * group).cast("int").alias("target"),
        uniform("part", "vec_id").alias("part"),
    )
    hot = F.transform(F.array(*[F.lit(g) for g in range(4)]), lambda g: (g == group).cast("float"))
    vocab = table(spark, sf, "embeddings").select(F.concat(F.lit("g"), group).alias("token"), hot.alias("vec")).distinct()
    parts = {"train": "part < 0.6", "valid": "part >= 0.6 AND part < 0.8", "test": "part >= 0.8"}
    splits = {name: rows.filter(where).drop("part") for name, where in parts.items()}
    done = workflows.train_and_test(splits, materialise(vocab, "vocab"), "m_run", shared_dir(spark, "run"), epochs=2, length=1, features=4, **_FIT)
    metrics = writers.read_metrics(spark, done["metrics"])
    return metrics.select(F.col("epoch").cast("long").alias("epoch"), "split", "metric", F.round("value", 5).alias("value"))


_STEPS = [(0, 0), (0, 1), (1, 0), (1, 1), (1, 2), (1, 3)]  # (epoch, batch), as four batches fill the table
_ADAM = training.Optimizer("adamw", lr=0.05, betas=(0.9, 0.99), eps=1e-8, decay=0.01)


def _steps_sql() -> str:
    """Every step written out on long tables: softmax, mean gradient, moments, weights."""
    parts = [
        f"""r AS MATERIALIZED (SELECT idx, target, weight * n::double / count(*) OVER (PARTITION BY target) AS scale, n,
            row_number() OVER (ORDER BY weight, idx) - 1 AS pos FROM (SELECT idx, target, weight, count(*) OVER () AS n FROM ({_EXAMPLES_SQL})))""",
        "x AS MATERIALIZED (SELECT vec_id AS idx, f, CASE WHEN f < 8 THEN embedding[f + 1]::double ELSE 1 END AS v FROM embeddings, range(9) t(f))",
        "s0 AS (SELECT c, f, 0.0::double AS w, 0.0::double AS m, 0.0::double AS v FROM range(2) a(c), range(9) b(f))",
    ]
    for i, (epoch, batch) in enumerate(_STEPS):
        t, (b1, b2) = i + 1, _ADAM.betas
        parts += [
            f"""b{i} AS MATERIALIZED (SELECT idx, target, scale, count(*) OVER () AS size FROM (SELECT *, (row_number() OVER (ORDER BY md5('42-{epoch}-' || idx), idx) - 1) // ((n + 3) // 4) AS batch
                FROM r WHERE pos < floor(n * {(epoch + 1) * 0.5})) WHERE batch = {batch})""",
            f"z{i} AS (SELECT idx, c, exp(sum(w * x.v)) AS e FROM b{i} JOIN x USING (idx) JOIN s{i} USING (f) GROUP BY idx, c)",
            f"q{i} AS (SELECT idx, c, e / sum(e) OVER (PARTITION BY idx) AS p FROM z{i})",
            f"g{i} AS (SELECT c, f, sum(scale * (p - (target = c)::int) * v / size) AS g FROM b{i} JOIN q{i} USING (idx) JOIN x USING (idx) GROUP BY c, f)",
            f"""s{t} AS MATERIALIZED (SELECT c, f, w * (1 - {_ADAM.lr} * {_ADAM.decay}) - {_ADAM.lr} * (m / (1 - pow({b1}, {t}))) / (sqrt(v / (1 - pow({b2}, {t}))) + {_ADAM.eps}) AS w, m, v
                FROM (SELECT c, f, w, {b1} * m + (1 - {b1}) * g AS m, {b2} * v + (1 - {b2}) * g * g AS v FROM s{i} JOIN g{i} USING (c, f)))""",
        ]
    ends = [max(i for i, (e, _) in enumerate(_STEPS) if e == epoch) + 1 for epoch in (0, 1)]
    states = " UNION ALL ".join(f"SELECT {e} AS epoch, {end}::bigint AS step, * FROM s{end}" for e, end in enumerate(ends))
    return f"WITH {', '.join(parts)} SELECT epoch, step, c::int AS class, f::int AS feature, round(w, 7) AS w FROM ({states})"


@query(_steps_sql())
def train_epochs(spark, sf):
    """Two epochs in mini-batches, the first on the half with the smallest weights; the second goes on from its weights."""
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("idx"), F.slice(F.col("embedding").cast("array<double>"), 1, 8).alias("x"))
    rows = _examples(spark, sf).select("idx", "target", "weight").join(vectors, "idx")
    rows = evaluate.with_class_weight(rows).withColumn("scale", F.col("class_weight") * F.col("weight"))
    ranked = materialise(rank_for_epochs(rows), "ranked")
    size = (ranked.count() + 3) // 4
    config = {"schedule": "linear", "linear_steps": 1, "linear_split": 0.5}
    states = training.train(ranked, training.initial_state(spark, 8), config, 2, _ADAM, size, vector="x", weight="scale")
    lines = [state.select(F.lit(e).alias("epoch"), "step", "classes", "width", F.posexplode("w").alias("at", "w")) for e, state in enumerate(states)]
    return lines[0].unionByName(lines[1]).select(
        "epoch", "step", F.expr("at div width").cast("int").alias("class"), (F.col("at") % F.col("width")).cast("int").alias("feature"), F.round("w", 7).alias("w")
    )


_TOKENS, _WIDTH = 64, 8


def _scores_sql(rows: str) -> str:
    """Scores of ``rows (id, func)``: the largest value of each feature over 64 places, empty ones as zeros, through fixed weights."""
    weight = lambda c: f"((({c} * {_WIDTH + 1} + f) * 37 % 101) / 50.0 - 1)::double"
    return f"""WITH t AS (SELECT id, regexp_extract_all(func, {TOKEN_SQL}) AS ts FROM ({rows})),
        e AS (SELECT id, len(ts) AS n, unnest(ts[1:{_TOKENS}]) AS token FROM t),
        v AS (SELECT id, f, greatest(max(coalesce(vec[f + 1]::double, 0)), CASE WHEN any_value(n) < {_TOKENS} THEN 0 END) AS x
            FROM e LEFT JOIN vocab USING (token), range({_WIDTH}) b(f) GROUP BY id, f),
        z AS (SELECT id, sum(x * ({weight(1)} - {weight(0)})) AS z FROM v GROUP BY id),
        b AS (SELECT {weight(1)} - {weight(0)} AS bias FROM (SELECT {_WIDTH} AS f))
        SELECT t.id, 1 / (1 + exp(-(coalesce(z, 0) + bias))) AS y_pred FROM t LEFT JOIN z ON t.id = z.id, b"""


def _fixed_state(spark):
    weights = F.transform(F.sequence(F.lit(0), F.lit(2 * (_WIDTH + 1) - 1)), lambda i: (i * 37 % 101) / 50.0 - 1)
    return materialise(training.initial_state(spark, _WIDTH).withColumn("w", weights.cast("array<double>")), "state")


@query(f"SELECT id AS idx, round(y_pred, 8) AS y_pred FROM ({_scores_sql('SELECT doc_id AS id, text AS func FROM documents')})", "tokens", "vocab")
def score_rows(spark, sf):
    """Texts to scores: tokens, vectors, pooling, a trained state."""
    rows = texts(spark, sf).select(F.col("doc_id").alias("idx"), F.col("text").alias("func"))
    scored = workflows.score_rows(rows, materialise(vocab(spark, sf), "vocab"), _fixed_state(spark), _TOKENS, _WIDTH)
    return scored.select("idx", F.round("y_pred", 8).alias("y_pred"))


@query(
    f"""SELECT idx, round(before, 8) AS before, round(after, 8) AS after, round(before - after, 8) AS diff FROM (
        SELECT id.idx AS idx, max(y_pred) FILTER (id.variant = 'before') AS before, max(y_pred) FILTER (id.variant = 'after') AS after FROM ({_scores_sql(
        "SELECT {'idx': conv_id * 1000 + turn, 'variant': 'before'} AS id, func_before AS func FROM pairs UNION ALL SELECT {'idx': conv_id * 1000 + turn, 'variant': 'after'}, func_after FROM pairs")}) GROUP BY id.idx)""",
    "tokens",
    "vocab",
    "pairs",
)
def score_pairs(spark, sf):
    """Both sides of every change pair scored in one pass."""
    rows = pairs(spark, sf).select((F.col("conv_id") * 1000 + F.col("turn")).alias("idx"), "func_before", "func_after")
    scored = workflows.score_pairs(rows, materialise(vocab(spark, sf), "vocab"), _fixed_state(spark), _TOKENS, _WIDTH)
    return scored.select("idx", *[F.round(c, 8).alias(c) for c in ("before", "after", "diff")])


@query(
    f"""SELECT vec_id AS idx, round(1 / (1 + exp(-list_sum(list_transform(range({_VECTORS}),
    lambda i: embedding[i + 1]::double * (((i * 37) % 101) / 50.0 - 1)::double)))), 8) AS y_pred FROM embeddings"""
)
def score_in_batches(spark, sf):
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").alias("vector"))

    def load():
        import numpy as np

        weights = (np.arange(_VECTORS) * 37 % 101) / 50.0 - 1

        def predict(frame):
            return 1 / (1 + np.exp(-np.stack(frame["vector"]).astype("float64") @ weights))

        return predict

    return models.score_in_batches(vectors, load, ["vector"]).withColumn("y_pred", F.round("y_pred", 8))
