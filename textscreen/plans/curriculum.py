"""Difficulty, weights and subsets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import code, scores as score_functions, text
from ..functions.hashing import uniform
from ..operators import curriculum
from ..session import materialise, shared_dir
from .fixtures import TOKEN_SQL, functions, sources, split_functions, spread_table, table, texts, truth, u
from .registered import query


def complexity_sql(column: str) -> str:
    code = rf"regexp_replace({column}, '(?s)/\*.*?\*/|//[^\n]*', ' ', 'g')"
    decisions = r"'\b(if|for|while|case|catch)\b|&&|[|][|]|[?]'"
    return f"CASE WHEN contains({column}, '{{') THEN (1 + len(regexp_extract_all({code}, {decisions})))::int END"


def token_count_sql(column: str) -> str:
    return f"len(regexp_extract_all({column}, {TOKEN_SQL}))::int"


_SOURCES_SQL = "SELECT 'text' AS kind, doc_id AS idx, text AS func FROM documents UNION ALL SELECT 'page', page_id, html FROM pages"


def _sources(spark, sf) -> DataFrame:
    """Every text and every raw page, which has braces in its style block."""
    written = texts(spark, sf).select(F.lit("text").alias("kind"), F.col("doc_id").alias("idx"), F.col("text").alias("func"))
    pages = spread_table(spark, sf, "pages", "page_id").select(F.lit("page").alias("kind"), F.col("page_id").alias("idx"), F.col("html").alias("func"))
    return written.unionByName(pages)


def _imputed_sql(value: str, low: str, high: str, seed: str = "42") -> str:
    return f"coalesce({value}::double, (trunc({low}) + floor({u(chr(39) + seed + chr(39), 'idx')} * (trunc({high}) - trunc({low}))))::double)"


@query("SELECT doc_id, length(text)::int AS difficulty FROM documents")
def len_difficulty(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.char_length(F.col("text")).alias("difficulty"))


@query(f"SELECT doc_id, {token_count_sql('text')} AS difficulty FROM documents")
def token_difficulty(spark, sf):
    return texts(spark, sf).select("doc_id", text.token_count(F.col("text")).alias("difficulty"))


@query(f"SELECT kind, idx, {complexity_sql('func')} AS difficulty FROM ({_SOURCES_SQL})")
def complexity_difficulty(spark, sf):
    return _sources(spark, sf).select("kind", "idx", text.complexity(F.col("func")).alias("difficulty"))


@query(
    """SELECT idx, count(pos)::int AS functions, round(avg(cc), 9) AS complexity, round(avg(size), 9) AS lexemes
    FROM documents LEFT JOIN measured ON idx = doc_id GROUP BY idx""",
    *("sources", "lexemes", "nested", "blocks", "found", "measured"),
)
def function_measures(spark, sf):
    """Mean complexity and length of every file's functions; braces in comments, strings and literals count for nothing."""
    totals = sources(spark, sf).select("idx", code.function_totals(F.col("func")).alias("all"))
    means = [F.round(F.try_divide(F.col(f"all.{c}").cast("double"), F.col("all.n")), 9).alias(c) for c in ("complexity", "lexemes")]
    return totals.select("idx", F.col("all.n").alias("functions"), *means)


@query("SELECT doc_id, 1.0::double AS weight FROM documents")
def unit_weight(spark, sf):
    documents = table(spark, sf, "documents").withColumn("split", F.lit("train"))
    return curriculum.curriculum_weights(documents, "none", func="text", row_id="doc_id").select("doc_id", "weight")


@query("SELECT doc_id, 1 - n_chars::double / (max(n_chars) OVER () + 1) AS weight FROM documents")
def difficulty_weight(spark, sf):
    measured = table(spark, sf, "documents").select("doc_id", text.char_length(F.col("text")).alias("difficulty"))
    return curriculum.difficulty_weight(measured, "difficulty").drop("difficulty")


@query("SELECT idx, 1 - (1 - (1 - length(func)::double / (max(length(func)) OVER () + 1))) * 1.5 AS weight FROM functions", "functions")
def sample_weight(spark, sf):
    measured = functions(spark, sf).select("idx", text.char_length(F.col("func")).alias("difficulty"))
    weighted = curriculum.difficulty_weight(measured, "difficulty")
    return weighted.select("idx", score_functions.sample_weight(F.col("weight"), 1.5).alias("weight"))


@query(f"SELECT idx, {u(chr(39) + '42' + chr(39), 'idx')} AS weight FROM truth", "truth")
def random_weight(spark, sf):
    return truth(spark, sf).select("idx", uniform(42, "idx").alias("weight"))


@query(
    f"""SELECT kind, idx, {_imputed_sql('d', 'min(d) OVER ()', 'max(d) OVER ()')} AS difficulty
    FROM (SELECT kind, idx, {complexity_sql('func')} AS d FROM ({_SOURCES_SQL}))"""
)
def impute_range(spark, sf):
    measured = _sources(spark, sf).select("kind", "idx", text.complexity(F.col("func")).alias("difficulty"))
    return curriculum.impute_range(measured, "difficulty")


_LENGTH_WEIGHTS = "SELECT idx, 1 - length(func)::double / (max(length(func)) OVER () + 1) AS weight FROM functions"


_EPOCHS_SQL = f"""SELECT epoch, idx, weight FROM (SELECT *, row_number() OVER (ORDER BY weight, idx) - 1 AS r, count(*) OVER () AS n
    FROM ({_LENGTH_WEIGHTS})), (VALUES (0), (3), (9)) e(epoch)
    WHERE r < least(n, floor(n * ((epoch // 2 + 1) * 0.3::double)))"""
_LINEAR = {"schedule": "linear", "linear_steps": 2, "linear_split": 0.3}


def _length_weights(spark, sf):
    measured = functions(spark, sf).select("idx", text.char_length(F.col("func")).alias("difficulty"))
    return curriculum.difficulty_weight(measured, "difficulty").select("idx", "weight")


@query(_EPOCHS_SQL, "functions")
def curriculum_linear(spark, sf):
    weighted = materialise(_length_weights(spark, sf), "weights")
    cuts = curriculum.weight_cuts(weighted)
    epochs = [
        curriculum.scheduled_subset(weighted, _LINEAR, e, cuts=cuts).withColumn("epoch", F.lit(e)) for e in (0, 3, 9)
    ]
    return reduce(DataFrame.unionByName, epochs)


@query(_EPOCHS_SQL, "functions")
def curriculum_epochs(spark, sf):
    ranked = materialise(curriculum.rank_for_epochs(_length_weights(spark, sf)), "ranked")
    epochs = [curriculum.epoch_rows(ranked, _LINEAR, e).withColumn("epoch", F.lit(e)) for e in (0, 3, 9)]
    return reduce(DataFrame.unionByName, epochs).select("epoch", "idx", "weight")


@query(_EPOCHS_SQL, "functions")
def curriculum_stored(spark, sf):
    """The same epochs from files clustered by rank, each reading only its own."""
    ranked = curriculum.rank_for_epochs(_length_weights(spark, sf))
    path = curriculum.store_ranked(ranked, shared_dir(spark, "clustered"), rows_per_part=100)
    epochs = [curriculum.stored_epoch(spark, path, _LINEAR, e).withColumn("epoch", F.lit(e)) for e in (0, 3, 9)]
    return reduce(DataFrame.unionByName, epochs).select("epoch", "idx", "weight")


def _by_name_sql() -> str:
    branches = []
    measures = {
        "length": "length(func)",
        "tokens": token_count_sql("func"),
        "cyclomatic": complexity_sql("func"),
    }
    for kind, measure in measures.items():
        inner = f"SELECT idx, split, {measure} AS d FROM split_functions"
        low, high = "(SELECT min(d) FROM m WHERE split = 'train')", "(SELECT max(d) FROM m WHERE split = 'train')"
        filled = _imputed_sql("d", low, high)
        branches.append(
            f"""SELECT '{kind}' AS kind, idx, CASE WHEN split = 'train' THEN 1 - {filled} / ({high} + 1) ELSE 1 END AS weight
            FROM (WITH m AS MATERIALIZED ({inner}) SELECT idx, split, d, {low} AS low, {high} AS high FROM m)""".replace(
                filled, _imputed_sql("d", "low", "high")
            ).replace(f"/ ({high} + 1)", "/ (high + 1)")
        )
    random = f"CASE WHEN split = 'train' THEN {u(chr(39) + '42' + chr(39), 'idx')} ELSE 1 END"
    branches.append(f"SELECT 'random', idx, {random} FROM split_functions")
    branches.append("SELECT 'none', idx, 1 FROM split_functions")
    return "SELECT kind, idx, round(weight, 9) AS weight FROM (" + " UNION ALL ".join(branches) + ")"


@query(_by_name_sql(), "functions", "split_functions")
def difficulty_by_name(spark, sf):
    rows = split_functions(spark, sf).select("idx", "func", "split")
    kinds = ("length", "tokens", "cyclomatic", "random", "none")
    weighted = curriculum.curriculum_columns(rows, {kind: kind for kind in kinds})
    lines = F.array(*[F.struct(F.lit(kind).alias("kind"), "idx", F.round(kind, 9).alias("weight")) for kind in kinds])
    return weighted.select(F.inline(lines))
