"""The lexer fold on hand-made source."""

import pytest
from pyspark.sql import functions as F

from textscreen.functions import code
from textscreen.operators.curriculum import curriculum_weights

# Source, and (complexity, lexemes) of each of its functions.
SOURCES = [
    ("int f() { return 0; }", [(1, 8)]),
    ("int f(int a) { if (a && b) { return 1; } while (a) a--; }\nvoid g(void) { }", [(4, 26), (1, 6)]),
    ("/* int f() { if } */ // int g() {\nint h() { /* } */ char *s = \"if } \\\" {\"; char c = '}'; // }\n }", [(1, 16)]),
    ("namespace a { class B { B(int x) : y(x) { f(x); } int z() const { return y ? 1 : 2; } }; }", [(1, 17), (2, 13)]),
    ("struct S { int a; }; int t[] = { 1, 2 }; int f(int); x = g(1); { }", []),
    ("if (a) { b(); } for (;;) { c } int f() { switch (x) { case 1: case 2: break; } }", [(3, 19)]),
    ("int f() { if (a) { ", []),
    ("} } int f() { { { } } }", [(1, 9)]),
    ("int a(int x) { for (;;) if (y || z) catch (e) { } }", [(5, 24)]),
    ("prose without code (or nearly so); nothing else", []),
    ("int f(void) { return ifx + whiley + s.forz; }", [(1, 15)]),
    ("/* never closed int f() { }", []),
    ("", []),
]


def test_functions(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(SOURCES)] + [(99, None)], "i int, s string")
    rows = {r["i"]: r for r in df.select("i", code.function_totals(F.col("s")).alias("f"), code.mean_complexity(F.col("s")).alias("c"), code.mean_lexemes(F.col("s")).alias("l")).collect()}
    assert rows[99]["f"] is None and rows[99]["c"] is None
    for i, (source, want) in enumerate(SOURCES):
        got = rows[i]
        assert tuple(got["f"]) == (len(want), sum(c for c, _ in want), sum(n for _, n in want)), source
        if want:
            assert got["c"] == pytest.approx(sum(c for c, _ in want) / len(want)) and got["l"] == pytest.approx(sum(n for _, n in want) / len(want))
        else:
            assert got["c"] is None and got["l"] is None


def test_very_long_source(spark):
    one = 'int f(int a) { // }\n if (a) { g("}{"); } }\n'
    row = spark.range(1).select(code.function_totals(F.repeat(F.lit(one), 20_000)).alias("f")).first()["f"]
    assert tuple(row) == (20_000, 40_000, 20_000 * 18)
    assert spark.range(1).select(code.function_totals(F.concat(F.lit('int f() { "'), F.repeat(F.lit("x\\\\"), 300_000), F.lit('"; }'))).alias("f")).first()["f"]["n"] == 1


def test_difficulty_by_function(spark):
    df = spark.createDataFrame([(0, SOURCES[1][0]), (1, SOURCES[0][0]), (2, "no code")], "idx long, func string").withColumn("split", F.lit("train"))
    weights = {r["idx"]: r["weight"] for r in curriculum_weights(df, "cyclomatic_per_function").collect()}
    assert weights[0] == pytest.approx(1 - 2.5 / 3.5) and weights[1] == pytest.approx(1 - 1 / 3.5)
    assert weights[2] == pytest.approx(1 - 1 / 3.5)  # drawn from 1 to 2, the latter left out
