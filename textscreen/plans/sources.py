"""Scans and sinks: every one writes derived rows and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import uniform
from ..session import shared_dir
from ..sources import readers, writers
from ..sources.catalog import Catalog, Dataset
from ..operators.rewrite import rewrite_text
from .fixtures import functions, pair_preds, preds, raw_text, runs, split_functions, table, texts, truth, u
from .registered import query

_CLEAN = r"""regexp_replace(regexp_replace(replace(regexp_replace({}, '\r\n?', chr(10), 'g'), chr(9), '    '),
    ' +(\n|\z)', '\1', 'g'), '\n\n\n+', chr(10) || chr(10), 'g')"""
RAW_SQL = r"replace(text, '. ', '.  ' || repeat(chr(13) || chr(10), 4) || chr(9))"
CLEAN_SQL = _CLEAN.format(RAW_SQL)


@query("SELECT idx, func, target FROM functions", "functions")
def scan_csv(spark, sf):
    rows = functions(spark, sf).select("idx", "func", "target")
    path = writers.write_csv(rows, shared_dir(spark, "csv"))
    return readers.read_csv(spark, path, readers.CANONICAL)


@query("""SELECT doc_id AS idx, replace(text, '. ', '."' || chr(10) || ', "') AS func, (doc_id % 2)::int AS target FROM documents""")
def scan_csv_split(spark, sf):
    """Texts with quotes, commas and line ends, every file read by as many tasks as it has byte ranges."""
    written = F.replace("text", F.lit(". "), F.lit('."\n, "')).alias("func")
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("idx"), written, (F.col("doc_id") % 2).cast("int").alias("target"))
    return readers.read_csv_split(spark, writers.write_csv(rows, shared_dir(spark, "csv_split")), readers.CANONICAL)


@query("SELECT idx, func, target FROM functions", "functions")
def scan_jsonl(spark, sf):
    rows = functions(spark, sf).select("idx", "func", "target")
    path = writers.write_jsonl(rows, shared_dir(spark, "jsonl"))
    return readers.read_jsonl(spark, path)


@query("SELECT model, dataset, kind, before, after FROM pair_preds", "functions", "pair_preds")
def scan_path_dims(spark, sf):
    rows = pair_preds(spark, sf).withColumn("file", F.concat_ws("-", "dataset", "kind"))
    path = writers.write_csv(rows.select("model", "file", "before", "after"), shared_dir(spark, "tree"), ["model", "file"])
    return readers.with_path_dims(readers.read_tree(spark, path, readers.PAIR_PREDICTIONS)).drop("path")


@query(
    "SELECT model, project AS trained_on, 'big_' || kind || '_after' AS tested_on, count(*) AS n "
    "FROM pair_preds JOIN (SELECT idx, project FROM functions) USING (idx) GROUP BY ALL",
    "functions",
    "pair_preds",
)
def run_name_dims(spark, sf):
    projects = functions(spark, sf).select("idx", "project")
    name = F.concat("model", F.lit("_"), "project", F.lit("_on_big_"), "kind", F.lit("_after.txt"))
    rows = pair_preds(spark, sf).join(projects, "idx").select(name.alias("name"))
    return readers.with_run_dims(rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"))).drop("name")


@query("SELECT idx, func, target, 'texts' AS dataset, split FROM split_functions", "functions", "split_functions")
def catalog_splits(spark, sf):
    root = shared_dir(spark, "catalog")
    writers.write_jsonl(split_functions(spark, sf).select("idx", "func", "target", "split"), root, ["split"])
    texts = Dataset("texts", {s: f"{root}/split={s}" for s in ("train", "valid", "test")})
    catalog = Catalog(texts)
    return catalog.load(spark, "texts", "fit").unionByName(catalog.load(spark, "texts", "test"))


@query("SELECT idx, func, target, split FROM split_functions", "functions", "split_functions")
def sink_jsonl_split(spark, sf):
    rows = split_functions(spark, sf).select("idx", "func", "target", "split")
    path = writers.write_jsonl(rows, shared_dir(spark, "splits"), ["split"])
    tree = readers.read_tree(spark, path, readers.CANONICAL, "json")
    return tree.withColumn("split", readers.split_from_path(F.col("path"))).drop("path")


@query("SELECT idx, y_pred FROM preds WHERE model = 'm0'", "preds")
def sink_csv_preds(spark, sf):
    rows = preds(spark, sf).filter("model = 'm0'").select("idx", "y_pred")
    path = writers.write_csv(rows, shared_dir(spark, "preds"))
    return readers.read_csv(spark, path, readers.PREDICTIONS, multi_line=False)


@query(
    f"SELECT printf('%d', doc_id) || chr(9) || printf('%.4f', 0.6 * {u(chr(39) + 'p' + chr(39), 'doc_id')} + 0.4 * toxic) AS value FROM labels"
)
def sink_pred_lines(spark, sf):
    rows = truth(spark, sf).withColumn("y_pred", 0.6 * uniform("p", "idx") + 0.4 * F.col("target"))
    path = writers.write_prediction_lines(rows, shared_dir(spark, "lines"))
    return spark.read.text(path)


@query(f"SELECT doc_id AS idx, {CLEAN_SQL} AS func, 0 AS target FROM documents")
def publish_rewrite(spark, sf):
    root = shared_dir(spark, "published")
    raw = texts(spark, sf).select(F.col("doc_id").alias("idx"), raw_text().alias("func"), F.lit(0).alias("target"))
    writers.publish(raw, root)
    current = readers.read_jsonl(spark, writers.current_path(spark, root))
    writers.publish(rewrite_text(current).drop("status"), root)
    return readers.read_jsonl(spark, writers.current_path(spark, root))


@query(
    """SELECT run, epoch, 'train' AS split, 'acc' AS metric, val_ap / 2 AS value FROM runs UNION ALL
    SELECT run, epoch, 'valid', 'ap', val_ap FROM runs""",
    "runs",
)
def append_metrics(spark, sf):
    path = shared_dir(spark, "run_metrics")
    for split, metric, value in (("train", "acc", F.col("val_ap") / 2), ("valid", "ap", F.col("val_ap"))):
        rows = runs(spark, sf).select(
            "run", "epoch", F.lit(split).alias("split"), F.lit(metric).alias("metric"), value.alias("value")
        )
        writers.append_metrics(rows, path)
    return writers.read_metrics(spark, path)


