"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_local_base: str | None = None


def build_session(app: str = "textscreen", cpus: int | str = "*", shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder that ``spark.checkpoint.dir`` names.

    Only a local master may fall back to the machine's temporary folder: on a
    cluster that folder is not the same on every node.
    """
    global _local_base
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        if _local_base is None:
            _local_base = tempfile.mkdtemp(prefix="textscreen-")
        base = _local_base
    return f"{base.rstrip('/')}/textscreen/{name}-{uuid.uuid4().hex}"


def materialise(df, name: str):
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage and fixes values that later steps scan more than once; the
    written table outlives lost executors.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
