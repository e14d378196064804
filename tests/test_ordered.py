"""Global ranks, running values and bottom-k against plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from textscreen.operators import ordered


def skewed(n=3000, seed=1):
    """A third of the rows share one key and some have none."""
    rng = random.Random(seed)
    rows = []
    for i in rng.sample(range(10 * n), n):
        draw = rng.random()
        key = 7.0 if draw < 0.34 else None if draw < 0.4 else round(rng.gauss(0, 10), 2)
        rows.append((i, key))
    return rows


def by_key(row):
    return (row[1] is not None, row[1] if row[1] is not None else 0, row[0])


@pytest.mark.parametrize("parts", [4, 16, 64])
def test_assign_idx_matches_sort(spark, parts):
    rows = skewed()
    df = spark.createDataFrame(rows, "id long, key double").repartition(7)
    got = {r["id"]: r["pos"] for r in ordered.assign_idx(df, "key", "id", name="pos", parts=parts).collect()}
    assert got == {row[0]: i for i, row in enumerate(sorted(rows, key=by_key))}


def test_no_bucket_holds_the_frequent_key(spark):
    rows = skewed(8000)
    df = spark.createDataFrame(rows, "id long, key double")
    counts = ordered.with_value_bucket(df, "key", "id", 32).groupBy(ordered.BUCKET).count().collect()
    assert max(r["count"] for r in counts) < 8000 * 3 / 32


def test_whole_numbers_beyond_double_precision(spark):
    base = 2**60
    rows = [(base + i // 3, i) for i in range(300)] + [(base + 50, 1000 + i) for i in range(200)]
    df = spark.createDataFrame(rows, "key long, tie long").repartition(5)
    got = ordered.assign_idx(df, "key", "tie", name="pos", parts=8).collect()
    assert [(r["key"], r["tie"]) for r in sorted(got, key=lambda r: r["pos"])] == sorted(rows)


def test_infinite_and_nan_keys_come_last(spark):
    values = [float("nan"), float("inf"), float("-inf"), 0.0, 1.0, -1.0]
    df = spark.createDataFrame(list(enumerate(values)), "id long, key double")
    got = ordered.assign_idx(df, "key", "id", name="pos", parts=4).orderBy("pos").collect()
    assert [r["id"] for r in got] == [2, 5, 3, 4, 1, 0]


@pytest.mark.parametrize("rows", [[], [(3, 1.0)], [(1, None), (2, None)]])
def test_tiny_tables(spark, rows):
    df = spark.createDataFrame(rows, "id long, key double")
    assert sorted(r["pos"] for r in ordered.assign_idx(df, "key", "id", name="pos").collect()) == list(range(len(rows)))


def test_keys_must_be_numbers(spark):
    for kind in ("string", "decimal(10,2)"):
        with pytest.raises(TypeError, match="cannot order by k"):
            ordered.assign_idx(spark.range(3).select(F.col("id").cast(kind).alias("k")), "k")


def test_assign_idx_restarts_per_group(spark):
    rows = [(i, i % 3) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, part long")
    got = ordered.assign_idx(df, "id", by=["part"], name="pos", parts=5).collect()
    assert all(r["pos"] == r["id"] // 3 for r in got)


def test_shuffle_rank_is_the_order_of_the_hash(spark):
    df = spark.range(2000).withColumnRenamed("id", "idx")
    want = sorted(range(2000), key=lambda i: hashlib.md5(f"5-{i}".encode()).hexdigest())
    got = {r["idx"]: r["rank"] for r in ordered.shuffle_rank(df.repartition(9), 5).collect()}
    assert got == {i: n for n, i in enumerate(want)}


def test_same_ranks_for_any_number_of_partitions(spark):
    df = spark.createDataFrame(skewed(500), "id long, key double")
    results = []
    for partitions in ("1", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        results.append({r["id"]: r["pos"] for r in ordered.assign_idx(df, "key", "id", name="pos").collect()})
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1]


@pytest.mark.parametrize("count", [0, 1, 700, 1300, 2999, 3000, 5000])
def test_smallest_is_the_head_of_the_sort(spark, count):
    rows = skewed()
    df = spark.createDataFrame(rows, "id long, key double")
    taken = ordered.smallest(df, "key", "id", F.least(F.col("n_rows"), F.lit(count)), parts=16)
    assert taken.columns == ["id", "key"]
    assert {r["id"] for r in taken.collect()} == {r[0] for r in sorted(rows, key=by_key)[:count]}


def test_running_maximum_and_totals(spark):
    rng = random.Random(3)
    rows = [(g, i, rng.random()) for g in "ab" for i in range(400)]
    df = spark.createDataFrame(rows, "g string, i long, v double").repartition(6)
    got = ordered.running(
        ordered.with_value_bucket(df, "i", parts=16), ["i"], {"top": ("max", F.col("v")), "sum": ("sum", F.col("v"))}, ["g"], totals=True
    ).collect()
    for r in got:
        seen = [v for g, i, v in rows if g == r["g"] and i <= r["i"]]
        assert r["top"] == max(seen)
        assert r["sum"] == pytest.approx(sum(seen))
        assert r["sum_total"] == pytest.approx(sum(v for g, _, v in rows if g == r["g"]))


def test_batches_have_the_size_asked_for(spark):
    df = spark.range(100).withColumnRenamed("id", "idx")
    for seed in (None, 3):
        sizes = ordered.batches(df, 32, seed=seed).groupBy("batch_id").count().orderBy("batch_id").collect()
        assert [r["count"] for r in sizes] == [32, 32, 32, 4]


def test_file_order(spark, tmp_path):
    from textscreen.session import materialise

    for name, start in (("b_dev", 100), ("a_train", 0)):
        (tmp_path / f"{name}.csv").write_text("n\n" + "\n".join(str(start + i) for i in range(50)) + "\n")
    rows = ordered.file_order(spark.read.schema("n long").option("header", True).csv(str(tmp_path)))
    got = ordered.assign_idx_by_file(materialise(rows, "ordered")).orderBy("idx").collect()
    assert [r["n"] for r in got] == [*range(50), *range(100, 150)]
    assert [r["idx"] for r in got] == list(range(100))


def test_frequent_values_are_cut_no_finer_than_needed(spark):
    df = spark.range(60_000).select("id", (F.pmod(F.xxhash64("id"), F.lit(12))).alias("key"))
    sizes = [r["count"] for r in ordered.with_value_bucket(df, "key", "id", parts=64).groupBy("_bucket").count().collect()]
    assert len(sizes) <= 2 * 64 + 12 and max(sizes) <= 3 * 60_000 / 64
