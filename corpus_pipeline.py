"""From raw documents to packed training sequences: quality rules, line dedup, SimHash near-dedup, best-fit packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from textscreen.llm import lines, packing, quality, simhash
from textscreen.llm.blocks import free
from textscreen.session import materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the strict policy, unchanged, repeated rows too; null and empty texts never pass."""
    return quality.accepted(docs, "strict-1")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with only the lines that no smaller document holds; ``n_chars`` follows the text.

    No document goes, even if all its lines do. Null texts become empty ones, and rows
    repeating an id count as one document.
    """
    # A column of the name that the operator adds steps aside.
    aside = free(docs, "_lines")
    kept = lines.dedup(docs.withColumnRenamed("_lines", aside)).drop("_lines").withColumnRenamed(aside, "_lines")
    counted = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return counted.select(*[F.col(f"`{c}`") for c in docs.columns])


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id.

    Documents without an id stay. Of rows that repeat an id each is judged by its own
    text. Null and empty texts are near-duplicates of each other; no rows give no rows.
    """
    found = simhash.near_duplicates(docs, shingle=3, max_bits=2, digest=True)
    key, digest = free(docs, "_gone"), free(docs, "_gone_digest")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(key), F.col("digest").alias(digest)).distinct()
    same = (docs["doc_id"] == F.col(key)) & (F.xxhash64(docs["text"]) == F.col(digest))
    return docs.join(gone, same, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where the words of each document go: pieces, bins and their lengths; a text without words has one row without a bin."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("simhash near-dedup", simhash_dedup),
    ("best-fit packing", best_fit_packing),
]

#: Fingerprints and best-fit bins are beyond SQL; the tests hold ``run`` against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written to the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
