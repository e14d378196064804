"""The licence classifier: families, near misses, calibration, odd rows."""

import pytest
from pyspark.sql import functions as F

from textscreen.llm import licences

SF = "/root/testdata/sf0.01"
KNOWN = {
    "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC", "All rights reserved.": "Proprietary",
    "Licensed under CC BY 4.0.": "CC-BY", "Licensed under CC BY-SA 4.0.": "CC-BY-SA",
    "Redistribution and use in source and binary forms, with or without modification, are permitted": "BSD",
}
MISSES = [
    "All rights reserved tables at the restaurant were taken.", "Released under the terms of the ISC licence.", "He renewed his licence to drive.",
    "You can use it under the terms of the GNU Lesser General Public License v2.1.", "Licensed under the European Union Public Licence.",
    "The permission to enter was granted free of charge by the mayor.", "The Apache people lived in the south.", "",
]


@pytest.fixture(scope="module")
def planted(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    top = docs.agg(F.max("doc_id")).first()[0]
    lines = [*KNOWN, *MISSES]
    more = [(top + 1 + i, f"Some prose before.\n{line}\nSome prose after.") for i, line in enumerate(lines)] + [(None, "x\nReleased under the MIT License."), (top + 1, None)]
    extra = [(top + 99, "word " * 40_000 + "\nReleased under the MIT License.\n" + "\n".join(["word"] * 5_000))]
    both = docs.unionByName(spark.createDataFrame(more + extra, docs.schema)).withColumns({"family": F.lit("x"), "words": F.lit(1), "key": F.lit(2)})
    return top, both, licences.scan(both).collect()


def test_known_families_are_confirmed(planted):
    top, _, found = planted
    for i, (line, family) in enumerate(KNOWN.items()):
        own = [r for r in found if r["doc_id"] == top + 1 + i]
        assert [(r["paragraph"], r["family"], r["confirmed"]) for r in own] == [(1, family, True)], line
    assert [(r["paragraph"], r["family"]) for r in found if r["doc_id"] == top + 99] == [(1, "MIT")]
    assert [r["family"] for r in found if r["doc_id"] is None] == ["MIT"]


def test_near_misses_are_not_confirmed(planted):
    top, _, found = planted
    first = top + 1 + len(KNOWN)
    wrong = [r for r in found if r["doc_id"] is not None and first <= r["doc_id"] < first + len(MISSES)]
    assert not [r for r in wrong if r["confirmed"]]
    assert len(wrong) <= 2


def test_every_planted_line_of_the_tables_is_found(spark, planted):
    _, both, found = planted
    lines = both.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("paragraph", "line"))
    want = {(r["doc_id"], r["paragraph"], KNOWN[r["line"]]) for r in lines.filter(F.col("line").isin(list(KNOWN))).collect()}
    got = {(r["doc_id"], r["paragraph"], r["family"]) for r in found if r["confirmed"]}
    assert want <= got and len(got) <= 1.02 * len(want)


def test_probabilities_are_calibrated(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fitted = licences.Classifier(docs)
    assert 0.25 < fitted.temperature < 8
    rows = fitted.reliability().collect()
    total = sum(r["n"] for r in rows)
    assert total > 100
    # The mean distance between how sure the model was and how often it was right.
    assert sum(r["n"] * abs(r["probability"] - r["right"]) for r in rows) / total < 0.1
    held = fitted.model.transform(fitted.held_out.where("origin = 'held out'"))
    assert held.where("prediction = 0").count() >= 0.6 * held.count()
    assert fitted.anchors and not {"the", "of", "and", "to"} & set(fitted.anchors)


def test_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id string, text string")
    assert licences.scan(none).count() == 0
    few = spark.createDataFrame([("a", "Released under the MIT License."), ("a", "Released under the MIT License."), ("b", None)], "doc_id string, text string")
    assert [(r["doc_id"], r["family"]) for r in licences.scan(few).collect()] == [("a", "MIT")] * 2
