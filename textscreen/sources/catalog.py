"""Named data sets: which files hold which split, and what the labels are called."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from .readers import CANONICAL, read_jsonl

# Splits that each stage of a run reads.
STAGES = {"fit": ("train", "valid"), "test": ("test",), None: ("train", "valid", "test")}


@dataclass(frozen=True)
class Dataset:
    name: str
    paths: dict[str, str]
    labels: list[str] = field(default_factory=lambda: ["safe", "vulnerable"])


def load_dataset(name: str, text: str) -> Dataset:
    """A data set from its description: JSON, or lines ``split: path`` and ``labels: [ first, second ]``."""
    if text.lstrip().startswith("{"):
        settings = json.loads(text)
    else:
        lines = [line.split("#")[0].strip() for line in text.splitlines()]
        parts = [line.partition(":") for line in lines if line]
        if not all(colon for _, colon, _ in parts):
            raise ValueError(f"cannot read the description of {name!r}")
        settings = {key.strip(): value.strip().strip("'\"") for key, _, value in parts}
        if "labels" in settings:
            settings["labels"] = [label.strip().strip("'\"") for label in settings["labels"].strip("[]").split(",")]
    labels = settings.pop("labels", ["safe", "vulnerable"])
    return Dataset(name, settings, labels)


class Catalog:
    def __init__(self, *datasets: Dataset) -> None:
        self._datasets = {d.name: d for d in datasets}

    def get(self, name: str) -> Dataset:
        if name not in self._datasets:
            raise ValueError(f"unknown data set: {name!r}")
        return self._datasets[name]

    def load_split(self, spark: SparkSession, name: str, split: str) -> DataFrame:
        path = self.get(name).paths[split]
        rows = read_jsonl(spark, path, CANONICAL)
        return rows.withColumns({"dataset": F.lit(name), "split": F.lit(split)})

    def load(self, spark: SparkSession, name: str, stage: str | None = None) -> DataFrame:
        """All splits of a stage; two splits may name the same file."""
        if stage not in STAGES:
            raise ValueError(f"unknown stage: {stage!r}")
        return reduce(DataFrame.unionByName, [self.load_split(spark, name, s) for s in STAGES[stage]])
