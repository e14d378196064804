"""Sinks. Each write is one distributed job; nothing passes through the driver."""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scores import prediction_line

METRICS = "run string, epoch long, split string, metric string, value double"
SLOT_MICROS = 600_000_000  # ten minutes
FOLD_SLOTS = 144
_KEY = ["run", "epoch", "split", "metric"]
_LOG = f"{METRICS}, token string, at long, slot long"
_MANIFEST = "version long, token string, path string, mark long"


def write_jsonl(df: DataFrame, path: str, by: list[str] | None = None) -> str:
    """JSON lines, one folder per value of ``by`` (a split or a variant)."""
    writer = df.write
    (writer.partitionBy(*by) if by else writer).json(path)
    return path


def write_csv(df: DataFrame, path: str, by: list[str] | None = None) -> str:
    """CSV with a header; blanks at the ends of text are kept."""
    writer = df.write.option("header", True).option("escape", '"')
    writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    (writer.partitionBy(*by) if by else writer).csv(path)
    return path


def write_prediction_lines(df: DataFrame, path: str, row_id: str = "idx", score: str = "y_pred") -> str:
    df.select(prediction_line(F.col(row_id), F.col(score)).alias("value")).write.text(path)
    return path


def append_metrics(df: DataFrame, path: str, token: str | None = None, at: int | None = None) -> str:
    """Add rows to the metrics log at ``path``; of several rows of a key the newest counts.

    A key is a run, epoch, split and metric. ``token`` names the attempt that writes,
    such as a restarted run, and ``at`` its time in microseconds, by default now: what
    a failed attempt left is superseded as the run is repeated. When the log has gone
    on for ``FOLD_SLOTS`` slots since it was last folded, this folds it.
    """
    spark, at = df.sparkSession, time.time_ns() // 1000 if at is None else at
    marks = {"token": F.lit(token or uuid.uuid4().hex), "at": F.lit(at).cast("long")}
    # A folder of its own: writers of one folder would clear away each other's unfinished files.
    df.select(*_KEY, "value").withColumns(marks).write.parquet(f"{path}/log/slot={at // SLOT_MICROS}/part={uuid.uuid4().hex}")
    done = versions(spark, f"{path}/folded")
    oldest = done[-1]["mark"] if done else _log_rows(spark, path).agg(F.min("slot")).first()[0]
    if at // SLOT_MICROS - oldest > FOLD_SLOTS:
        fold_metrics(spark, path, at)
    return path


def _newest(rows: DataFrame) -> DataFrame:
    """One row per key; keys with a null part count, too."""
    last = F.max_by(F.struct("value", "token", "at"), F.struct("at", "token")).alias("_last")
    return rows.groupBy(*_KEY).agg(last).select(*_KEY, "_last.value", "_last.token", "_last.at")


def _log_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_LOG).parquet(f"{path}/log").drop("part")


def _metrics_log(spark: SparkSession, path: str) -> DataFrame:
    """What the last fold holds, and the rows of all slots after it."""
    log, folded = _log_rows(spark, path), versions(spark, f"{path}/folded")
    if not folded:
        return log.drop("slot")
    base = spark.read.schema(_LOG.replace(", slot long", "")).parquet(folded[-1]["path"])
    return base.unionByName(log.filter(F.col("slot") > folded[-1]["mark"]).drop("slot"))


def fold_metrics(spark: SparkSession, path: str, at: int) -> None:
    """Publish the newest row of every key up to the slot before the last one.

    Reads then skip the folders of these slots. The last two slots stay out, so an
    append that is still being written is never passed over.
    """
    mark = at // SLOT_MICROS - 2
    publish(_newest(_metrics_log(spark, path).filter(F.expr(f"at div {SLOT_MICROS}") <= mark)), f"{path}/folded", "parquet", mark)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of every key of the log."""
    return _newest(_metrics_log(spark, path)).drop("token", "at")


def log_parameters(spark: SparkSession, run: str, parameters: dict, path: str) -> str:
    """Append a run's settings, one row each."""
    rows = [(run, str(k), str(v)) for k, v in parameters.items()]
    spark.createDataFrame(rows, "run string, name string, value string").write.mode("append").parquet(path)
    return path


def versions(spark: SparkSession, root: str) -> list:
    """Finished versions below ``root``, oldest first: ``(version, token, path, mark)`` of every manifest."""
    try:
        found = spark.read.schema(_MANIFEST).option("recursiveFileLookup", True).json(f"{root}/manifests").collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted(found, key=lambda m: (m["version"], m["token"]))


def current_path(spark: SparkSession, root: str) -> str:
    found = versions(spark, root)
    if not found:
        raise FileNotFoundError(f"no finished version below {root}")
    return found[-1]["path"]


def publish(df: DataFrame, root: str, form: str = "json", mark: int | None = None) -> str:
    """Write ``df`` as the next version of the data set at ``root``; gives its path.

    A version's files go to a folder that no other writer has. Its manifest, one file
    that appears whole or not at all, is added only once they are complete, so a
    version that was torn off is never read, and ``df`` may read the current one.
    Writers at the same time give two versions of the same number, of which the one
    with the greater token counts as later; neither's files are touched by the other.
    ``mark`` is kept in the manifest.
    """
    spark, token = df.sparkSession, uuid.uuid4().hex
    found = versions(spark, root)
    version = (found[-1]["version"] if found else 0) + 1
    path = f"{root}/v={version}/{token}"
    df.write.format(form).save(path)
    manifest = spark.createDataFrame([(version, token, path, mark)], _MANIFEST)
    manifest.coalesce(1).write.json(f"{root}/manifests/{version}-{token}")
    return path
