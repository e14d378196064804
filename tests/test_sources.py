"""Files written and read back, catalogues and versions."""

from multiprocessing.pool import ThreadPool

import pytest
from pyspark.sql import functions as F

from textscreen.operators import rewrite, staging
from textscreen.operators.ordered import file_order
from textscreen.session import materialise, shared_dir
from textscreen.sources import readers, writers
from textscreen.sources.catalog import Catalog, load_dataset

TEXTS = ['int a = "x, y";\n\n', "  blanks kept  ", "comma, \"quote\" and\nline", "back\\slash", "é\t"]


def rows(spark):
    return spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(TEXTS)], readers.CANONICAL)


def contents(df):
    return sorted((r["idx"], r["func"], r["target"]) for r in df.collect())


def test_csv_round_trip(spark, tmp_path):
    path = writers.write_csv(rows(spark), str(tmp_path / "csv"))
    assert contents(readers.read_csv(spark, path, readers.CANONICAL)) == contents(rows(spark))


def test_jsonl_round_trip_and_unknown_keys(spark, tmp_path):
    path = writers.write_jsonl(rows(spark).withColumn("extra", F.lit("x")), str(tmp_path / "json"))
    assert contents(readers.read_jsonl(spark, path)) == contents(rows(spark))


def test_split_from_path(spark):
    paths = ["file:/in/set_v1_train.csv", "/in/RAW_validate.bin", "/out/split=test/part-00000-ab.c000.json", "/x/dev.jsonl"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in df.select(readers.split_from_path(F.col("p"))).collect()] == ["train", "validate", "test", "dev"]


def test_path_dims_of_plain_files(spark, tmp_path):
    for model, name in (("m", "seta-safe"), ("m", "setb-vuln"), ("other model+1", "all")):
        (tmp_path / model).mkdir(exist_ok=True)
        (tmp_path / model / f"{name}.csv").write_text("before,after\n0.5,0.25\n")
    tree = readers.with_path_dims(readers.read_tree(spark, str(tmp_path), readers.PAIR_PREDICTIONS))
    got = {(r["model"], r["dataset"], r["kind"], r["before"]) for r in tree.collect()}
    assert got == {("m", "seta", "safe", 0.5), ("m", "setb", "vuln", 0.5), ("other model+1", "all", None, 0.5)}


def test_run_names_with_underscores(spark):
    df = spark.createDataFrame([("bert_seta_on_big_safe_after.txt",), ("my_model_setb_on_x.txt",)], "name string")
    got = [(r["model"], r["trained_on"], r["tested_on"]) for r in readers.with_run_dims(df).collect()]
    assert got == [("bert", "seta", "big_safe_after"), ("my_model", "setb", "x")]


def test_prediction_lines(spark, tmp_path):
    df = spark.createDataFrame([(3, 0.123456), (11, 1.0)], readers.PREDICTIONS)
    path = writers.write_prediction_lines(df, str(tmp_path / "lines"))
    assert sorted(r["value"] for r in spark.read.text(path).collect()) == ["11\t1.0000", "3\t0.1235"]
    assert {tuple(r)[:2] for r in readers.read_prediction_lines(spark, path).collect()} == {(3, 0.1235), (11, 1.0)}


def test_folder_of_runs(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5)], readers.PREDICTIONS)
    for name in ("m_seta_on_big_safe_after", "n_k_setb_on_x"):
        writers.write_prediction_lines(df, str(tmp_path / f"{name}.txt"))
    lines = readers.with_run_dims(readers.read_prediction_lines(spark, str(tmp_path)), "path")
    got = {(r["model"], r["trained_on"], r["tested_on"], r["y_pred"]) for r in lines.collect()}
    assert got == {("m", "seta", "big_safe_after", 0.5), ("n_k", "setb", "x", 0.5)}


def test_publish_reads_what_it_replaces(spark, tmp_path):
    root = str(tmp_path / "data")
    writers.publish(rows(spark), root)
    for _ in range(2):
        current = readers.read_jsonl(spark, writers.current_path(spark, root))
        writers.publish(current.withColumn("target", F.col("target") + 1), root)
    assert "/v=3/" in writers.current_path(spark, root) and len(writers.versions(spark, root)) == 3
    got = readers.read_jsonl(spark, writers.current_path(spark, root))
    assert sorted(r["target"] for r in got.collect()) == [2, 2, 2, 3, 3]


def test_unfinished_version_is_not_current(spark, tmp_path):
    root = str(tmp_path / "data")
    with pytest.raises(FileNotFoundError):
        writers.current_path(spark, root)
    writers.publish(rows(spark), root)
    # A version whose files are there, even all of them, but not its manifest.
    rows(spark).write.json(str(tmp_path / "data" / "v=2" / "torn"))
    assert "/v=1/" in writers.current_path(spark, root)
    writers.publish(rows(spark), root)
    assert "/v=2/" in writers.current_path(spark, root) and "torn" not in writers.current_path(spark, root)


def test_two_writers_at_once_give_two_versions(spark, tmp_path):
    root = str(tmp_path / "data")
    with ThreadPool(4) as pool:
        paths = pool.map(lambda i: writers.publish(spark.createDataFrame([(i, str(i), 0)] * (i + 1), readers.CANONICAL), root), range(4))
    found = writers.versions(spark, root)
    assert len(set(paths)) == 4 and sorted(m["path"] for m in found) == sorted(paths)
    for i, path in enumerate(paths):
        assert [r["func"] for r in readers.read_jsonl(spark, path).collect()] == [str(i)] * (i + 1)
    assert writers.current_path(spark, root) == found[-1]["path"]


def test_a_repeated_run_reads_back_once(spark, tmp_path):
    path, hour = str(tmp_path / "metrics"), 3_600_000_000
    line = lambda epoch, value: spark.createDataFrame([("r", epoch, "val", "ap", value), (None, epoch, None, "ap", value)], writers.METRICS)
    for epoch in range(2):
        writers.append_metrics(line(epoch, 0.1), path, "failed", at=hour)
    for epoch in range(3):
        writers.append_metrics(line(epoch, 0.2), path, "again", at=hour + 1 + epoch)
    read = lambda: sorted((r["run"] or "", r["epoch"], r["value"]) for r in writers.read_metrics(spark, path).collect())
    want = [(run, epoch, 0.2) for run in ("", "r") for epoch in range(3)]
    assert read() == want and not writers.versions(spark, f"{path}/folded")
    # Days later the log is folded; what is written late, or comes after, still counts.
    writers.append_metrics(line(2, 0.5), path, "late", at=hour * 60)
    folded = writers.versions(spark, f"{path}/folded")
    assert [spark.read.parquet(m["path"]).count() for m in folded] == [6]
    assert read() == [(run, epoch, 0.5 if epoch == 2 else 0.2) for run in ("", "r") for epoch in range(3)]
    plan = writers.read_metrics(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(slot" in plan
    writers.append_metrics(line(0, 0.9), path, "late", at=hour * 120)
    assert len(writers.versions(spark, f"{path}/folded")) == 2
    assert read() == [(run, epoch, (0.9, 0.2, 0.5)[epoch]) for run in ("", "r") for epoch in range(3)]


def test_metrics_are_appended(spark, tmp_path):
    path = str(tmp_path / "metrics")
    for epoch in range(3):
        df = spark.createDataFrame([("r", epoch, "val", "ap", epoch / 10)], writers.METRICS)
        writers.append_metrics(df, path)
    assert writers.read_metrics(spark, path).count() == 3
    logged = writers.log_parameters(spark, "r", {"lr": 5e-4, "batch_size": 128}, str(tmp_path / "parameters"))
    assert {(r["name"], r["value"]) for r in spark.read.parquet(logged).collect()} == {("lr", "0.0005"), ("batch_size", "128")}


def test_catalog(spark, tmp_path):
    paths = {}
    for split, ids in (("train", [0, 1]), ("valid", [2])):
        paths[split] = writers.write_jsonl(rows(spark).filter(F.col("idx").isin(ids)), str(tmp_path / split))
    described = f"train: {paths['train']}\nvalid: {paths['valid']}\ntest: {paths['valid']}\nlabels: [ safe, vulnerable ]\n"
    catalog = Catalog(load_dataset("texts", described))
    assert catalog.get("texts").labels == ["safe", "vulnerable"]
    assert load_dataset("t", "train: ./a/b.jsonl  # all\ntest: 'c'\nlabels: [ no, yes ]\n") == load_dataset("t", '{"train": "./a/b.jsonl", "test": "c", "labels": ["no", "yes"]}')
    with pytest.raises(ValueError, match="cannot read"):
        load_dataset("t", "train ./a")
    stages = {s: sorted((r["idx"], r["split"]) for r in catalog.load(spark, "texts", s).collect()) for s in ("fit", "test", None)}
    assert stages["fit"] == [(0, "train"), (1, "train"), (2, "valid")]
    assert stages["test"] == [(2, "test")]
    assert stages[None] == sorted(stages["fit"] + stages["test"])
    with pytest.raises(ValueError, match="unknown data set"):
        catalog.load_split(spark, "others", "train")
    with pytest.raises(ValueError, match="unknown stage"):
        catalog.load(spark, "texts", "predict")


def test_staging_from_csv_files(spark, tmp_path):
    """Files of one data set, the last without labels, to numbered JSON lines."""
    (tmp_path / "x_train.csv").write_text('id,label,code\n9,1,"a,\nb"\n8,0,c\n')
    (tmp_path / "x_test.csv").write_text("id,code\n7,d\n")
    staged = {}
    for split in ("train", "test"):
        raw = file_order(readers.read_csv(spark, str(tmp_path / f"x_{split}.csv")))
        done = staging.stage_labelled(materialise(raw, "raw"))
        path = writers.write_jsonl(done.select("idx", "func", "target"), str(tmp_path / "out" / split))
        staged[split] = contents(readers.read_jsonl(spark, path))
    assert staged == {"train": [(0, "a,\nb", 1), (1, "c", 0)], "test": [(0, "d", 0)]}


class Session:
    """Just the settings of a session."""

    def __init__(self, base, master):
        settings = {"spark.checkpoint.dir": base}
        self.conf = self
        self.sparkContext = self
        self.master = master
        self.get = lambda name, default=None: settings.get(name, default)
        self.getConf = lambda: self


def test_staging_pairs_from_a_csv_file(spark, tmp_path):
    head = [c.replace("_", " ") for c in staging.PAIR_DROPPED if c not in ("unnamed:_0", "vul")]
    lines = [",".join(["Unnamed: 0", "CVE ID", "vul", "func before", "func after", *head])]
    for i, (cve, vul) in enumerate((("CVE-1", 1), ("", 1), ("CVE-2", 0), ("CVE-3", 1))):
        lines.append(",".join([str(i), cve, str(vul), f'"before {i},\n"', f"after {i}", *["x"] * len(head)]))
    (tmp_path / "pairs.csv").write_text("\n".join(lines) + "\n")
    raw = materialise(file_order(readers.read_csv(spark, str(tmp_path / "pairs.csv"))), "pairs")
    pairs = staging.stage_pairs(raw)
    assert sorted(pairs.columns) == ["cve_id", "func_after", "func_before", "idx", "kind"]
    got = {(r["kind"], r["idx"], r["cve_id"], r["func_before"]) for r in pairs.collect()}
    assert got == {("vuln", 0, "CVE-1", "before 0,\n"), ("vuln", 1, "CVE-3", "before 3,\n"), ("safe", 0, "CVE-2", "before 2,\n")}


def test_shared_folder_follows_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark, "x") != shared_dir(spark, "x")
    assert not named or shared_dir(spark, "x").startswith(named)
    assert shared_dir(Session("hdfs:/c/", "yarn"), "x").startswith("hdfs:/c/textscreen/x-")
    assert shared_dir(Session(None, "local[2]"), "x").startswith("/")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session(None, "yarn"), "x")


def test_rewriting_keeps_other_columns(spark):
    assert rewrite.rewrite_text(rows(spark)).columns == ["idx", "func", "target", "status"]


TRICKY = [
    'plain', 'two\nlines', '"quoted"', 'comma, "x"\n\n\nfour lines "', '', None, ' blanks ', 'cr\r\nlf', '""', '"\n"', 'é 日本\n語', '\n', "'", '\\', 'back\\"slash',
    'a very long value ' * 300 + '\n"end"\n' * 40,
]


@pytest.mark.parametrize("size", [64, 1000, 1 << 27])
def test_split_csv_equals_whole_file(spark, size):
    rows = [(i, TRICKY[i * 7 % len(TRICKY)], i % 3) for i in range(400)]
    path = writers.write_csv(spark.createDataFrame(rows, readers.CANONICAL).coalesce(1), shared_dir(spark, "one_file"))
    whole = sorted(map(repr, readers.read_csv(spark, path, readers.CANONICAL).collect()))
    untyped = sorted(map(repr, readers.read_csv(spark, path).collect()))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        if size < 1 << 20:
            assert spark.read.text(path).rdd.getNumPartitions() > 4
        assert sorted(map(repr, readers.read_csv_split(spark, path, readers.CANONICAL).collect())) == whole
        assert sorted(map(repr, readers.read_csv_split(spark, path).collect())) == untyped
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_split_csv_shuffles_only_the_edges_of_its_ranges(spark):
    rows = spark.createDataFrame([(i, f'line {i}\n"second", ' + "x" * 200, i % 3) for i in range(5000)], readers.CANONICAL)
    path = writers.write_csv(rows.coalesce(1), shared_dir(spark, "edges"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 17)
    try:
        got = readers.read_csv_split(spark, path, readers.CANONICAL)
        # Rows that reach the one shuffle by a map-side sink: all lines of a range but those between its first and last start stay.
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan and "SortMergeJoin" not in plan
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_split_csv_with_crlf_names_and_several_files(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_bytes(f'CVE ID,Func `x\r\n{name}1,"x\r\ny ""q"""\r\n\r\n{name}2,\r\n{name}3,z'.encode())
    (tmp_path / "c.csv").write_bytes(b"CVE ID,Func `x\n")
    got = readers.read_csv_split(spark, str(tmp_path))
    assert got.columns == ["CVE ID", "Func `x"]
    want = [(f"{n}{i}", t) for n in "ab" for i, t in ((1, 'x\r\ny "q"'), (2, None), (3, "z"))]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_small_scans_are_spread_and_large_ones_left_alone(spark, monkeypatch):
    path = writers.write_jsonl(rows(spark).coalesce(1), shared_dir(spark, "one"))
    size = readers.stored_bytes(spark, path)
    assert 100 < size < 10_000 and readers.stored_bytes(spark, shared_dir(spark, "x").rsplit("/", 1)[0]) > 0
    scan = readers.read_jsonl(spark, path)
    assert readers.spread(scan, "idx", size).rdd.getNumPartitions() == 8
    monkeypatch.setattr(readers, "SPREAD_BYTES", 10)
    assert readers.spread(scan, "idx", size).rdd.getNumPartitions() == scan.rdd.getNumPartitions()
    assert contents(readers.spread(scan, "idx", 1)) == contents(rows(spark))
