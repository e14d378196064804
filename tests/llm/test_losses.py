"""Rows and columns that used to get lost."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textscreen.llm import lines

A, B = "first words of one text that is here twice over", "quite another text that has no copy anywhere at all"


def test_line_dedup_keeps_columns_of_any_name(spark):
    rows = [(1, "shared line of text\nown", 7, "p", 1.5, "x"), (2, "shared line of text\nmine", 8, "q", 2.5, "y"), (2, "shared line of text\nmine", 8, "q", 2.5, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id int, _of string, _at double, `a.b` string")
    got = lines.dedup(df)
    assert got.columns == [*df.columns, "_lines"]
    assert sorted(tuple(r)[:-1] for r in got.collect()) == [rows[0], (2, "mine", 8, "q", 2.5, "y"), (2, "mine", 8, "q", 2.5, "y")]
    for name in ("id", "of", "at", "row", "batch", "pos", "first"):
        assert lines.dedup(df.withColumn(name, F.lit(name))).select(name).distinct().collect()[0][0] == name
    with pytest.raises(TypeError, match="must be a whole number"):
        lines.dedup(df.withColumn("doc_id", F.col("_of")))


def test_near_dedup_stage_judges_each_row_of_a_repeated_id(spark):
    rows = [(1, A), (5, A), (5, B), (None, A), (7, None), (8, ""), (9, " \n")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.simhash_dedup(spark, df, "")
    assert got.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted([(1, A), (5, B), (None, A), (7, None)], key=repr)
    assert corpus_pipeline.simhash_dedup(spark, df.limit(0), "").count() == 0


def test_stages_keep_columns_of_any_name(spark):
    names = ["_ledger", "_lines", "_gone", "_gone_digest", "bits", "component_id", "digest", "row", "id", "of", "at", "part", "n"]
    rows = [(i, f"{A} number {i} of many more words\nshared line of text", "en", "s", 1, *range(len(names))) for i in range(3)]
    df = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "lang string", "source string", "n_chars long", *[f"`{n}` int" for n in names]]))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, "")
        assert out.columns == df.columns
        assert {tuple(r)[5:] for r in out.collect()} == {tuple(range(len(names)))}, name
    assert corpus_pipeline.STAGES[-1][1](spark, df, "").count() == 3


def test_stages_on_odd_rows(spark):
    rows = [(1, A * 3), (1, A * 3), (2, None), (3, ""), (4, "word " * 50_000), (None, B), (5, f"{B}\n{A}")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, "")
        assert name == "best-fit packing" or out.columns == df.columns
        assert stage(spark, df.limit(0), "").count() == 0
        assert out.count() >= (1 if name == "quality rules" else 3)
