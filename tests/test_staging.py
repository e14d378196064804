"""Column rewrites, joins and whole staging recipes."""

import pytest
from pyspark.sql import functions as F

from textscreen.functions.registry import Registry
from textscreen.operators import joins, rewrite, staging


def test_normalize_columns(spark):
    df = spark.createDataFrame([(1, 2)], ["CVE ID", "Func Before"])
    assert rewrite.normalize_columns(df).columns == ["cve_id", "func_before"]


def test_dropping_a_missing_column_is_an_error(spark):
    df = spark.createDataFrame([(1, 2)], ["a", "b"])
    assert rewrite.drop_columns(df, ["a"]).columns == ["b"]
    with pytest.raises(ValueError, match="c"):
        rewrite.drop_columns(df, ["a", "c"])


def test_missing_label(spark):
    df = spark.createDataFrame([("x", 1)], ["code", "label"])
    assert tuple(rewrite.with_default(df, "label").first()) == ("x", 1, False)
    assert tuple(rewrite.with_default(df.drop("label"), "label").first()) == ("x", 0, True)


def test_null_flag_counts_as_false(spark):
    rows = [(True, None), (None, None), (False, False), (None, True)]
    df = spark.createDataFrame(rows, "`CWE-119` boolean, CWE_other boolean")
    assert [r["target"] for r in rewrite.any_flag(df, "CWE").collect()] == [1, 0, 0, 1]


def test_broken_utf8_is_an_error(spark):
    df = spark.createDataFrame([(bytearray("é".encode()),)], "raw binary")
    assert rewrite.decode_utf8(df, "raw").first()["func"] == "é"
    broken = spark.createDataFrame([(bytearray(b"\xff\xfe"),)], "raw binary")
    with pytest.raises(Exception, match="MALFORMED"):
        rewrite.decode_utf8(broken, "raw").collect()


def test_rewrite_marks_rows_without_text(spark):
    df = spark.createDataFrame([("a \n",), (None,)], "func string")
    assert [tuple(r) for r in rewrite.rewrite_text(df).collect()] == [("a\n", "ok"), (None, "failed")]
    with pytest.raises(ValueError, match="unknown rewrite"):
        rewrite.rewrite_text(df, how="nope")


def test_registry():
    registry = Registry("thing")
    assert registry.get("identity")("x") == "x"
    registry.register("twice", lambda x: x * 2)
    assert registry.get("twice")("x") == "xx"
    with pytest.raises(ValueError, match="unknown thing: 'other'"):
        registry.get("other")


def test_stage_pairs(spark):
    columns = ["CVE ID", "vul", "func_before", "func_after", "Seq", *staging.PAIR_DROPPED]
    columns = [c for i, c in enumerate(columns) if c not in columns[:i]]
    rows = [("CVE-1", "1", "b1", "a1", 3), ("CVE-2", "0", "b2", "a2", 1), (None, "1", "b3", "a3", 2), ("CVE-4", "1", "b4", "a4", 0)]
    df = spark.createDataFrame([(*r, *["x"] * (len(columns) - 5)) for r in rows], columns)
    staged = staging.stage_pairs(df, "seq")
    assert set(staged.columns) == {"cve_id", "func_before", "func_after", "seq", "kind", "idx"}
    got = {(r["kind"], r["idx"], r["variant"], r["func"], r["target"]) for r in staging.pair_variants(staged).collect()}
    assert got == {
        ("vuln", 0, "before", "b4", 1), ("vuln", 0, "after", "a4", 0),
        ("vuln", 1, "before", "b1", 1), ("vuln", 1, "after", "a1", 0),
        ("safe", 0, "before", "b2", 0), ("safe", 0, "after", "a2", 0),
    }


def test_stage_flags(spark):
    df = spark.createDataFrame([(5, bytearray(b"x"), True), (2, bytearray(b"y"), False)], "n long, functionSource binary, CWE_1 boolean")
    assert {tuple(r) for r in staging.stage_flags(df, "n").collect()} == {(0, "y", 0), (1, "x", 1)}


def test_stage_stratified_numbers_each_part(spark):
    df = spark.range(50).select(F.col("id").alias("idx"), F.lit("f").alias("func"), (F.col("id") % 2).alias("target"))
    got = staging.stage_stratified(df).collect()
    for part, size in (("train", 40), ("test", 6), ("valid", 4)):
        assert sorted(r["idx"] for r in got if r["split"] == part) == list(range(size))
    assert sorted(r["source_idx"] for r in got) == list(range(50))


@pytest.mark.parametrize("limit", [1 << 30, 0])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_is_the_same_broadcast_or_salted(spark, limit, how):
    rows = [(i, "hot" if i % 3 else f"k{i % 700}") for i in range(2000)] + [(-1, None), (-2, "absent")]
    left = spark.createDataFrame(rows, "id long, k string")
    table = spark.createDataFrame([("hot", 1), *((f"k{i}", i) for i in range(0, 700, 3))], "k string, v long")
    want = sorted(left.join(table, "k", how).collect(), key=str)
    looked_up = joins.lookup(left, table, "k", how, limit)
    assert sorted(looked_up.collect(), key=str) == want
    assert looked_up.columns == ["k", "id", "v"]


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_broadcasts_the_rows_of_frequent_keys(spark, how):
    rows = [(i, f"k{i % 5}" if i % 10 else f"k{i % 900}") for i in range(9000)] + [(-i, None) for i in range(50)] + [(-100 - i, "absent") for i in range(900)]
    left = spark.createDataFrame(rows, "id long, k string")
    table = spark.createDataFrame([(f"k{i}", [float(i)] * 20) for i in range(0, 900)] + [("k7", None)], "k string, v array<double>")
    want = sorted(left.join(table, "k", how).collect(), key=str)
    got = joins.lookup(left, table, "k", how, 20_000)
    assert got.columns == ["k", "id", "v"] and sorted(got.collect(), key=str) == want
    # The rows of frequent keys are joined where they are, in a branch of their own without salts.
    plan = got._jdf.queryExecution().optimizedPlan()
    assert plan.nodeName() == "Union" and "_salt" not in plan.children().head().toString()


def test_broadcast_needs_a_measured_size(spark):
    df = spark.range(1000).select("id", F.lit("x" * 100).alias("s"), F.array(F.lit(1.0)).alias("a"))
    assert joins.fits_broadcast(df, 200_000) and not joins.fits_broadcast(df, 100_000)
    assert joins.fits_broadcast(df.limit(0), 0)


def test_align_keeps_the_union_of_keys(spark):
    before = spark.createDataFrame([(1, 0.1), (2, 0.2)], "idx long, y_pred double")
    after = spark.createDataFrame([(2, 0.3), (3, 0.4)], "idx long, y_pred double")
    assert {tuple(r) for r in joins.align_predictions(before, after).collect()} == {(1, 0.1, None), (2, 0.2, 0.3), (3, None, 0.4)}


@pytest.mark.parametrize("how", [{}, {"row_id": "idx"}, {"key": "n"}, {"key": "n", "tie": "n"}])
def test_stage_stratified_keeps_every_row_once(spark, how):
    rows = [(f"f{i}", i % 3, None if i % 4 == 0 else i % 5, i // 6) for i in range(60)]
    raw = spark.createDataFrame(rows, "func string, target int, idx long, n long")
    got = staging.stage_stratified(raw, **how).collect()
    assert sorted((r["func"], r["target"]) for r in got) == sorted((r[0], r[1]) for r in rows)
    for part, size in (("train", 48), ("test", 6), ("valid", 6)):
        assert sorted(r["idx"] for r in got if r["split"] == part) == list(range(size))


def test_stage_stratified_needs_only_text_and_class(spark):
    raw = spark.createDataFrame([(f"f{i}", i % 2, "p") for i in range(20)], "func string, target int, project string")
    got = staging.stage_stratified(raw, keep=["project"])
    assert set(got.columns) == {"source_idx", "func", "target", "project", "split", "idx"} and got.count() == 20


def test_broadcast_measure_sees_nested_values(spark):
    wide = F.array_repeat(F.lit(1.0), 500)
    df = spark.range(10).select(F.array(wide).alias("nested"), F.struct(wide.alias("x")).alias("s"), F.create_map(F.lit("k"), wide).alias("m"))
    assert not joins.fits_broadcast(df, 10 * 3 * 4000)
    assert joins.fits_broadcast(df, 10 * 3 * 4000 + 10 * 300)


def test_lookup_with_many_hot_keys(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "400")
    left = spark.range(6000).select("id", F.when(F.col("id") < 2000, 0).otherwise(F.col("id") % 250).alias("k"))
    table = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    try:
        got = joins.lookup(left, table, "k", limit=0).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert sorted(r["id"] for r in got) == list(range(6000)) and all(r["v"] == 2 * r["k"] for r in got)
