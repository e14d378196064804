"""Licence families of paragraphs: a sparse word n-gram logistic regression, confirmed against templates.

Only DataFrame operations and Spark ML run here. The classifier is fitted on
snippets of ``TEMPLATES`` and, as the class ``unknown``, on notices of other licences,
on sentences that only sound like notices, and on a bounded sample of the corpus's own
paragraphs: those that no template covers by three tenths, whatever words they hold. A
quarter of all snippets and of the sample, and some licences that the fit never sees,
calibrate the probabilities by one temperature; ``Classifier.reliability`` tells how
well. N-grams of nothing but common words have no weight. A paragraph gets a family if
the calibrated probability of that family beats every other class and reaches
``least``; the finding is confirmed if the paragraph's n-grams cover most of one of the
family's templates, and the family's templates cover most of the paragraph.

All paragraphs of all texts are looked at. One that holds no word of any weighted
n-gram has only the intercepts' score; it is passed over if those favour
``unknown``, which leaves few paragraphs for the n-grams.

A paragraph is a line with a word. Null and empty texts have none; rows repeating a
key give findings each.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialise
from .blocks import once

UNKNOWN = "unknown"
BACKGROUND = 2_000  # paragraphs of the class unknown that are fitted, at most
SNIPPET = (6, 12, 24)  # words in a snippet of a template

# Notices in the words of the licences.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "BSD": [
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "Proprietary": ["All rights reserved.", "No part of this publication may be reproduced or transmitted in any form without prior written permission of the publisher."],
}


# Notices of licences outside the families, all of the class unknown.
OTHERS: dict[str, list[str]] = {
    "LGPL": [
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
    ],
    "zlib": ["Released under the zlib License.", "This software is provided as-is, without any express or implied warranty.", "This notice may not be removed or altered from any source distribution."],
    "EPL": ["Licensed under the Eclipse Public License 2.0.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License."],
    "BSL": ["Licensed under the Boost Software License, Version 1.0.", "Distributed under the Boost Software License."],
    "Artistic": ["Released under the Artistic License 2.0.", "This work is licensed under the Artistic License."],
    "ISC": ["Released under the ISC License.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"],
    "AGPL": ["This work is licensed under the GNU Affero General Public License, version 3.", "You should have received a copy of the GNU Affero General Public License along with this program."],
    "EUPL": ["Licensed under the European Union Public Licence.", "You may not use this work except in compliance with the Licence."],
}
#: Of those, the families that no fit sees; they calibrate and are counted.
HELD_OUT = ("ISC", "AGPL", "EUPL")
# Sentences with words of licences that license nothing, of the class unknown, too.
PROSE = [
    "All seats in the first row are reserved for members of the club.",
    "The right to appeal was reserved in all cases that the court heard.",
    "Civil rights reserved a place in every speech she gave that year.",
    "His driving licence was renewed last week after a long wait.",
    "The council licensed two new pubs beside the river.",
    "A fishing license costs more in the summer than in the spring.",
    "The report was released under the direction of a new editor.",
    "The album was released under the name of her first band.",
    "You need permission from your parents to attend the trip.",
    "Permission is seldom granted to visit the old tower.",
    "Copyright law was debated in parliament for most of the day.",
    "The general public was invited to the opening of the show.",
    "The creative commons room is open to students until late.",
    "Version 2.0 of the game was published under pressure of time.",
    "Redistribution of wealth was the subject of the evening talk.",
    "No part of the garden may be entered without the owner.",
    "The software is distributed to all schools on the first of May.",
    "The notice above the door was copied from an older house.",
]


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits, with dots and hyphens inside."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"), F.lit(0))


def ngrams(words: Column) -> Column:
    """Distinct pairs and triples of neighbouring words; none where there are fewer."""
    def run(w: Column, n: int) -> Column:
        parts = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, parts).otherwise(F.array().cast("array<string>"))

    return once(words, lambda w: F.array_distinct(F.concat(run(w, 2), run(w, 3))))


def paragraphs(docs: DataFrame, key: str, text: str) -> DataFrame:
    lines = docs.select(F.col(f"`{key}`").alias("key"), F.posexplode(F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), "\n", -1)).alias("paragraph", "line"))
    return lines.select("key", F.col("paragraph").cast("long").alias("paragraph"), "line", tokens(F.col("line")).alias("words"))


def _snippets(spark, notices: dict[str, list[str]], copies: int) -> DataFrame:
    """``(family, words, whole)``: every notice ``copies`` times, and its windows."""
    rows = [(family, notice) for family, texts in notices.items() for notice in texts]
    whole = spark.createDataFrame(rows, "family string, notice string").select("family", tokens(F.col("notice")).alias("words"))
    sizes = F.array(*[F.lit(n) for n in SNIPPET])
    windows = whole.select("family", "words", F.explode(sizes).alias("n")).where(F.size("words") > F.col("n")).select(
        "family", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - F.col("n") + 1), lambda i: F.slice("words", i, F.col("n")))).alias("words")
    )
    # Notices that are one short sentence would be outweighed by the snippets of long ones.
    often = whole.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).drop("copy")
    return often.withColumn("whole", F.lit(True)).unionByName(windows.withColumn("whole", F.lit(False)))


def _sample(docs: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """At most ``most`` different rows, chosen by hash. Only hashes are ordered, and only those under a cut; texts are fetched after."""
    hashed = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).withColumn("h", F.xxhash64("key", "text"))
    share = min(1.0, 2 * most / max(1, docs.count()))
    under = hashed.select("h").where(F.pmod("h", F.lit(1 << 40)) < int(share * (1 << 40)))
    chosen = materialise(under.distinct().orderBy("h").limit(most), "chosen")
    return hashed.join(F.broadcast(chosen), "h").groupBy("h").agg(F.any_value("key").alias("key"), F.any_value("text").alias("text"))


def _templates(spark) -> DataFrame:
    rows = [(family, notice) for family, notices in TEMPLATES.items() for notice in notices]
    return spark.createDataFrame(rows, "family string, notice string").groupBy("family").agg(F.collect_list(ngrams(tokens(F.col("notice")))).alias("templates"))


class Classifier:
    """A fitted model, and what is needed to pass over paragraphs that it cannot find anything in."""

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text", background: int = BACKGROUND):
        spark, self.families = docs.sparkSession, [UNKNOWN, *TEMPLATES]
        numbers = F.create_map(*[F.lit(x) for i, f in enumerate(self.families) for x in (f, float(i))])
        sample = paragraphs(_sample(docs, key, text, background), "key", "text").where(F.size("words") > 0)
        sample = materialise(sample.orderBy(F.xxhash64("line"), "key", "paragraph").limit(4 * background).select("words", ngrams(F.col("words")).alias("grams")), "sample")
        self._count_words(sample)

        known = _snippets(spark, TEMPLATES, 8).withColumn("origin", F.lit("family"))
        others = _snippets(spark, OTHERS, 8).withColumn("origin", F.when(F.col("family").isin(*HELD_OUT), "held out").otherwise("other"))
        prose = spark.createDataFrame([(p,) for p in PROSE], "line string").select(tokens(F.col("line")).alias("words"), F.explode(F.sequence(F.lit(1), F.lit(8))).alias("copy")).drop("copy")
        # A paragraph of the sample that is like a notice has no label; any other is unknown, also with words of licences in it.
        all_templates = F.broadcast(_templates(spark).agg(F.flatten(F.collect_list("templates")).alias("templates")))
        apart = sample.crossJoin(all_templates).where(F.exists("templates", lambda t: F.size(F.array_intersect(t, F.col("grams"))) >= 0.3 * F.size(t)) == F.lit(False))
        rows = known.unionByName(others.withColumn("family", F.lit(UNKNOWN)))
        rows = rows.unionByName(prose.select(F.lit(UNKNOWN).alias("family"), "words", F.lit(False).alias("whole"), F.lit("other").alias("origin")))
        rows = rows.unionByName(apart.limit(background).select(F.lit(UNKNOWN).alias("family"), "words", F.lit(False).alias("whole"), F.lit("corpus").alias("origin")))
        labelled = rows.select(F.element_at(numbers, F.col("family")).alias("label"), "origin", "whole", self._telling(ngrams(F.col("words"))).alias("grams"))
        fold = F.when(F.col("origin") == "held out", 0).when(F.col("whole"), 1).otherwise(F.pmod(F.xxhash64("grams", "label"), F.lit(4)))
        labelled = materialise(labelled.withColumn("fold", fold), "labelled")
        self.vectorizer = CountVectorizer(inputCol="grams", outputCol="features", binary=True, vocabSize=1 << 18).fit(labelled.where("origin IN ('family', 'other') AND fold > 0"))
        fit = LogisticRegression(featuresCol="features", labelCol="label", family="multinomial", regParam=0.0005, elasticNetParam=1.0, maxIter=60)
        # The bounded training rows fit into one partition.
        self.model = fit.fit(self.vectorizer.transform(labelled.where("fold > 0").coalesce(1)))
        self.held_out = self.vectorizer.transform(labelled.where("fold = 0"))
        self.temperature = self._calibrate(self.held_out)
        self.anchors = self._anchors()

    def _count_words(self, sample: DataFrame) -> None:
        """In how many sampled paragraphs each word is; those in twenty of them and one of a hundred are common."""
        counted = sample.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").count().collect()
        self.frequency, total = {r["word"]: r["count"] for r in counted}, sample.count()
        self.common = sorted(w for w, n in self.frequency.items() if n >= 20 and 100 * n > total)

    def _telling(self, grams: Column) -> Column:
        """The n-grams that hold a word that is not common."""
        common = F.array(*[F.lit(w) for w in self.common]).cast("array<string>")
        return F.filter(grams, lambda g: F.size(F.array_except(F.split(g, " "), common)) > 0)

    def _anchors(self) -> list[str] | None:
        """A word of every n-gram that has weight, its rarest in the sample; None if the intercepts alone favour a family."""
        start = self.model.interceptVector.toArray()
        if start.argmax() != 0:
            return None
        weight = abs(self.model.coefficientMatrix.toArray()).max(axis=0)
        grams = [g for g, w in zip(self.vectorizer.vocabulary, weight) if w > 0]
        return sorted({min(g.split(" "), key=lambda w: (self.frequency.get(w, 0), -len(w), w)) for g in grams})

    def _calibrate(self, rows: DataFrame) -> float:
        """The temperature of least log loss on the held-out rows."""
        tried = [0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0, 5.6, 8.0]
        raw = self.model.transform(rows).select(vector_to_array("rawPrediction").alias("raw"), F.col("label").cast("int").alias("label"))
        loss = raw.agg(*[F.sum(-F.log(F.greatest(F.get(_softmax(F.col("raw"), t), F.col("label")), F.lit(1e-12)))).alias(str(t)) for t in tried]).first()
        return min(tried, key=lambda t: (loss[str(t)] or 0.0, abs(t - 1)))

    def reliability(self, bins: int = 5) -> DataFrame:
        """``(bin, n, probability, right)`` of the held-out rows: how sure the winning class was, and how often it was right."""
        p = self.model.transform(self.held_out).select("label", "origin", _softmax(vector_to_array("rawPrediction"), self.temperature).alias("p"))
        won = p.select(F.array_max("p").alias("probability"), (F.array_position("p", F.array_max("p")) == F.col("label") + 1).cast("int").alias("right"))
        place = F.least(F.floor(F.col("probability") * bins), F.lit(bins - 1)).alias("bin")
        return won.groupBy(place).agg(F.count(F.lit(1)).alias("n"), F.avg("probability").alias("probability"), F.avg("right").alias("right"))

    def predict(self, rows: DataFrame, least: float) -> DataFrame:
        """``rows`` with ``grams`` to the columns ``family`` and ``probability``."""
        p = _softmax(vector_to_array("rawPrediction"), self.temperature)
        scored = self.model.transform(self.vectorizer.transform(rows)).withColumn("p", p).withColumn("probability", F.array_max("p"))
        place = F.array_position("p", F.col("probability")).cast("int")
        family = F.element_at(F.array(*[F.lit(f) for f in self.families]), place)
        return scored.withColumn("family", F.when(F.col("probability") >= least, family).otherwise(F.lit(UNKNOWN))).drop("features", "rawPrediction", "prediction", "p")


def _softmax(raw: Column, temperature: float) -> Column:
    def powers(x: Column) -> Column:
        return once(F.array_max(x), lambda top: F.transform(x, lambda y: F.exp((y - top) / temperature)))

    def shares(p: Column) -> Column:
        return once(F.aggregate(p, F.lit(0.0), lambda a, y: a + y), lambda total: F.transform(p, lambda y: y / total))

    return once(raw, lambda x: once(powers(x), shares))


def _similarity() -> Column:
    """The lesser of how far the paragraph's n-grams cover a template of its family, and the family's templates the paragraph."""
    cover = F.transform("templates", lambda t: F.size(F.array_intersect(t, F.col("grams"))) / F.size(t))
    own = F.size(F.array_intersect(F.flatten("templates"), F.col("grams"))) / F.greatest(F.size("grams"), F.lit(1))
    return F.round(F.least(F.array_max(cover), own), 6)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.5, confirm: float = 0.6, background: int = BACKGROUND) -> DataFrame:
    """``key, paragraph, family, probability, similarity, confirmed`` per paragraph that is given a family.

    ``paragraph`` counts from 0. An empty table gives no rows; keys may be of any type.
    """
    spark, source = docs.sparkSession, docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    classifier = Classifier(source, "key", "text", background)
    lines = paragraphs(source, "key", "text").where(F.size("words") > 0)
    if classifier.anchors is not None:
        lines = lines.where(F.exists("words", lambda w: w.isin(classifier.anchors)))
    found = classifier.predict(lines.select("key", "paragraph", ngrams(F.col("words")).alias("grams")), least).where(F.col("family") != UNKNOWN)
    # One row per family of the list above.
    checked = found.join(F.broadcast(_templates(spark)), "family").withColumn("similarity", _similarity())
    return checked.select(F.col("key").alias(key), "paragraph", "family", F.round("probability", 6).alias("probability"), "similarity", (F.col("similarity") >= confirm).alias("confirmed"))
