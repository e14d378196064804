"""Inputs of the operators, derived from the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import sequence, text
from ..functions.hashing import uniform
from ..sources.readers import spread, stored_bytes

MODELS = ["m0", "m1", "m2"]
STEPS = FEATURES = 8


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_sizes: dict[str, int] = {}


def spread_table(spark: SparkSession, sf: str, name: str, key: str) -> DataFrame:
    """A table spread over all cores for work on its texts; its size is looked up once."""
    path = f"{sf}/{name}.parquet"
    if path not in _sizes:
        _sizes[path] = stored_bytes(spark, path)
    return spread(table(spark, sf, name), key, _sizes[path])


def texts(spark: SparkSession, sf: str) -> DataFrame:
    return spread_table(spark, sf, "documents", "doc_id")


def functions(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled texts as ``(idx, func, target, dataset, project)``."""
    labelled = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return labelled.select(
        F.col("doc_id").alias("idx"),
        F.col("text").alias("func"),
        F.col("toxic").alias("target"),
        F.col("lang").alias("dataset"),
        F.col("source").alias("project"),
    )


def split_functions(spark: SparkSession, sf: str) -> DataFrame:
    digit = F.col("idx") % 10
    split = F.when(digit < 8, F.lit("train")).when(digit == 8, F.lit("valid")).otherwise(F.lit("test"))
    return functions(spark, sf).withColumn("split", split)


def truth(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").select(F.col("doc_id").alias("idx"), F.col("toxic").alias("target"))


def _models() -> Column:
    return F.explode(F.array(*[F.lit(m) for m in MODELS])).alias("model")


def preds(spark: SparkSession, sf: str) -> DataFrame:
    """Three models' scores of every labelled text, with its truth."""
    rows = truth(spark, sf).select("idx", "target", _models())
    return rows.withColumn("y_pred", F.round(0.6 * uniform(F.col("model"), "idx") + 0.4 * F.col("target"), 4))


def pair_preds(spark: SparkSession, sf: str) -> DataFrame:
    """Before and after scores of three models: positives are vulnerable pairs."""
    rows = functions(spark, sf).select("idx", "dataset", "target", _models())
    before = F.round(0.6 * uniform(F.concat("model", F.lit("b")), "idx") + 0.4 * F.col("target"), 4)
    after = F.round(0.7 * uniform(F.concat("model", F.lit("a")), "idx"), 4)
    kind = F.when(F.col("target") == 1, F.lit("vuln")).otherwise(F.lit("safe"))
    return rows.select("model", "dataset", kind.alias("kind"), "idx", before.alias("before"), after.alias("after"))


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """A user turn and the assistant's next turn as text before and after."""
    turns = table(spark, sf, "conversations")
    asked = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("func_before"))
    # Turns are numbered without gaps, so the next one is a join on the full key
    # and a very long conversation spreads over all tasks.
    answered = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("func_after"))
    paired = asked.join(answered, ["conv_id", "turn"])
    return paired.select("conv_id", "turn", (F.col("conv_id") % 2).cast("int").alias("vul"), "func_before", "func_after")


def flags(spark: SparkSession, sf: str) -> DataFrame:
    """Texts as bytes with weakness flags, some of them null."""
    labelled = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return labelled.select(
        F.col("doc_id"),
        F.encode("text", "UTF-8").alias("functionSource"),
        (F.col("quality") == 0).alias("CWE_a"),
        (F.col("toxic") == 1).alias("CWE_b"),
        F.when(F.col("quality") == 0, F.lit(False)).alias("CWE_c"),
    )


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Two class scores per labelled text."""
    logits = F.array(
        F.round(4 * uniform("s0", "idx") - 2, 6), F.round(4 * uniform("s1", "idx") - 2 + F.col("target"), 6)
    )
    return truth(spark, sf).withColumn("scores", logits)


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf).select(F.col("doc_id").alias("idx"), text.tokenize(F.col("text")).alias("tokens"))


def counted_vocab(spark: SparkSession, sf: str) -> DataFrame:
    """Every token of the texts with how often it is found and a vector picked by its hash."""
    vectors = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    size = vectors.agg(F.count(F.lit(1)).alias("_size"))
    distinct = tokens(spark, sf).select(F.explode_outer("tokens").alias("token")).filter(F.col("token").isNotNull()).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    picked = F.conv(F.substring(F.md5("token"), 1, 8), 16, 10).cast("long") % F.col("_size")
    return distinct.crossJoin(F.broadcast(size)).select("token", "n", picked.alias("vec_id")).join(vectors, "vec_id").drop("vec_id")


def vocab(spark: SparkSession, sf: str) -> DataFrame:
    return counted_vocab(spark, sf).drop("n")


def sequences(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors cut into 8 positions of 8 features."""
    flat = F.col("embedding").cast("array<double>")
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), sequence.reshape(flat, FEATURES).alias("x"))


def sources(spark: SparkSession, sf: str) -> DataFrame:
    """Source files made of the documents: one function per line, with the line in a comment and in a string."""

    def function(line: Column, i: Column) -> Column:
        return F.concat(
            F.lit("static int f"), i.cast("string"), F.lit("(const char *s, int n)"), F.when(i % 4 == 1, " const").otherwise(""),
            F.lit(" {\n  // "), line, F.lit(" }\n  if (n > "), F.length(line).cast("string"),
            F.lit(' && s) { put("'), F.translate(line, '"\\', "''"), F.lit('}"); }\n'),
            F.when(i % 3 == 0, "  while (n) { n--; }\n").otherwise(""), F.when(i % 2 == 0, "  return n ? '{' : 0;\n").otherwise(""), F.lit("}\n"),
        )

    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    body = F.concat(F.lit("namespace a { class B {\n/* { if */\n"), F.array_join(F.transform(lines, function), ""), F.lit("}; }\nint g(int x);\n"))
    return texts(spark, sf).select(F.col("doc_id").alias("idx"), body.alias("func"))


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """A metric per run and epoch."""
    events = table(spark, sf, "events")
    return events.groupBy(F.col("event_type").alias("run"), F.expr("event_id div 1000").alias("epoch")).agg(
        F.round(F.avg("value"), 6).alias("val_ap")
    )


def raw_text() -> Column:
    """Text given tabs, blanks at line ends, CRLF and runs of empty lines."""
    return F.replace(F.col("text"), F.lit(". "), F.lit(".  \r\n\r\n\r\n\r\n\t"))


def u(salt: str, row_id: str) -> str:
    """The repeatable uniform number in SQL."""
    return (
        f"(('0x' || substr(md5(concat({salt}, '-', cast({row_id} AS varchar))), 1, 8))::bigint::double / 4294967296.0)"
    )


TOKEN_SQL = r"'[A-Za-z0-9_]+|[^ \t\r\nA-Za-z0-9_]'"
_MODELS_SQL = "(VALUES ('m0'), ('m1'), ('m2')) m(model)"

CTES = {
    "functions": """SELECT d.doc_id AS idx, d.text AS func, l.toxic AS target, d.lang AS dataset, d.source AS project
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "split_functions": """SELECT *, CASE WHEN idx % 10 < 8 THEN 'train' WHEN idx % 10 = 8 THEN 'valid' ELSE 'test' END AS split
        FROM functions""",
    "truth": "SELECT doc_id AS idx, toxic AS target FROM labels",
    "preds": f"""SELECT doc_id AS idx, toxic AS target, model, round(0.6 * {u('model', 'doc_id')} + 0.4 * toxic, 4) AS y_pred
        FROM labels, {_MODELS_SQL}""",
    "pair_preds": f"""SELECT model, dataset, CASE WHEN target = 1 THEN 'vuln' ELSE 'safe' END AS kind, idx,
        round(0.6 * {u("model || 'b'", 'idx')} + 0.4 * target, 4) AS before, round(0.7 * {u("model || 'a'", 'idx')}, 4) AS after
        FROM functions, {_MODELS_SQL}""",
    "united": """SELECT model, dataset, kind, idx, 'before' AS variant, before AS y_pred, CASE WHEN kind = 'vuln' THEN 1 ELSE 0 END AS target
        FROM pair_preds UNION ALL SELECT model, dataset, kind, idx, 'after', after, 0 FROM pair_preds WHERE kind = 'vuln'""",
    "pairs": """SELECT conv_id, turn, (conv_id % 2)::int AS vul, text AS func_before, next_text AS func_after FROM (
        SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations
        WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'""",
    "scores": f"""SELECT doc_id AS idx, toxic AS target, round(4 * {u("'s0'", 'doc_id')} - 2, 6) AS s0,
        round(4 * {u("'s1'", 'doc_id')} - 2 + toxic, 6) AS s1 FROM labels""",
    "tokens": f"SELECT doc_id AS idx, regexp_extract_all(text, {TOKEN_SQL}) AS tokens FROM documents",
    "vocab": """SELECT token, embedding AS vec FROM (SELECT DISTINCT unnest(tokens) AS token FROM tokens)
        JOIN embeddings ON vec_id = ('0x' || substr(md5(token), 1, 8))::bigint % (SELECT count(*) FROM embeddings)""",
    "token_rows": "SELECT idx, unnest(range(len(tokens))) AS t, unnest(tokens) AS token FROM tokens",
    "seq": """SELECT vec_id AS id, (i // 8)::int AS t, (i % 8)::int AS f, embedding[i + 1]::double AS v
        FROM embeddings, range(64) r(i)""",
    "sources": r"""SELECT doc_id AS idx, 'namespace a { class B {' || chr(10) || '/* { if */' || chr(10) || (SELECT string_agg(
            'static int f' || i || '(const char *s, int n)' || CASE WHEN i % 4 = 1 THEN ' const' ELSE '' END || ' {' || chr(10) || '  // ' || line || ' }' || chr(10)
            || '  if (n > ' || length(line) || ' && s) { put("' || translate(line, '"\', repeat(chr(39), 2)) || '}"); }' || chr(10)
            || CASE WHEN i % 3 = 0 THEN '  while (n) { n--; }' || chr(10) ELSE '' END
            || CASE WHEN i % 2 = 0 THEN '  return n ? ''{'' : 0;' || chr(10) ELSE '' END || '}' || chr(10), '' ORDER BY i)
            FROM (SELECT unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i))
        || '}; }' || chr(10) || 'int g(int x);' || chr(10) AS func FROM documents""",
    "lexemes": r"""SELECT idx, unnest(ts) AS t, generate_subscripts(ts, 1) AS pos FROM (SELECT idx, list_filter(regexp_extract_all(func,
        '(?s)/\*.*?(?:\*/|\z)|//[^\n]*|"(?:[^"\\\n]|\\.)*"?|''(?:[^''\\\n]|\\.)*''?|[A-Za-z0-9_]+|&&|[|][|]|[^ \t\r\n\f\x0B]'),
        lambda t: NOT (starts_with(t, '/*') OR starts_with(t, '//'))) AS ts FROM sources)""",
    "nested": """SELECT *, sum(CASE t WHEN '{' THEN 1 WHEN '}' THEN -1 ELSE 0 END) OVER w AS depth, sum(CASE t WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER w AS paren,
        lag(t) OVER w AS prior FROM lexemes WINDOW w AS (PARTITION BY idx ORDER BY pos)""",
    "blocks": """SELECT idx, t, pos, prior, min(CASE WHEN t = '}' THEN pos END) OVER (PARTITION BY idx, depth + (t = '{')::int * -1 ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS till,
        max(CASE WHEN t = '(' AND paren = 1 THEN pos - 1 END) OVER (PARTITION BY idx ORDER BY pos) AS name FROM nested""",
    "found": """SELECT idx, pos, till, name FROM (SELECT *, max(till) OVER (PARTITION BY idx ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS covered
        FROM blocks WHERE t = '{' AND prior IN (')', 'const') AND till IS NOT NULL) WHERE covered IS NULL OR covered < pos""",
    "measured": """SELECT f.idx, f.pos, any_value(f.till - f.name + 1) AS size,
        1 + count(*) FILTER (l.t IN ('if', 'for', 'while', 'case', 'catch', '&&', '||', '?')) AS cc
        FROM found f JOIN lexemes l ON l.idx = f.idx AND l.pos BETWEEN f.pos AND f.till GROUP BY f.idx, f.pos""",
    "runs": """SELECT event_type AS run, event_id // 1000 AS epoch, round(avg(value), 6) AS val_ap FROM events GROUP BY ALL""",
    "conf": """SELECT model, count(*) FILTER (target = 0 AND y_pred <= 0.5) AS tn, count(*) FILTER (target = 0 AND y_pred > 0.5) AS fp,
        count(*) FILTER (target = 1 AND y_pred <= 0.5) AS fn, count(*) FILTER (target = 1 AND y_pred > 0.5) AS tp FROM preds GROUP BY model""",
    "conf_with_baselines": """SELECT * FROM conf UNION ALL
        SELECT 'safe baseline', tn + fp, 0, fn + tp, 0 FROM conf WHERE model = 'm2' UNION ALL
        SELECT 'vuln baseline', 0, tn + fp, 0, fn + tp FROM conf WHERE model = 'm2'""",
    "board": """SELECT model, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0::double * tp / (2 * tp + fp + fn) END AS f1,
        CASE WHEN tp + fp = 0 THEN 0 ELSE tp::double / (tp + fp) END AS "precision",
        CASE WHEN tp + fn = 0 THEN 0 ELSE tp::double / (tp + fn) END AS recall FROM conf_with_baselines""",
}
