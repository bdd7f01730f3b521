"""Licence notices by a trained paragraph classifier, in Spark expressions and Spark ML only.

Paragraphs (lines) become sparse counts of word n-grams of a closed vocabulary: the one- and two-word
grams of the notices below that are rare in the paragraphs of all documents. A multinomial logistic
regression tells the licence families and an unknown class apart. Its threshold is calibrated on all
background paragraphs it was not fitted on, so that at most a stated share of them would be named; a named
family must also resemble one of its notices (share of the notice's word pairs found) to be confirmed.

The regression is fitted on the notices, shortened variants of them and the paragraphs of at most
``sample`` documents chosen by a hash of their id; a paragraph of these that resembles a notice is
taken as its family. Counts of families cover every document. A paragraph without any gram of the
vocabulary has the regression's background score, so only paragraphs with one are scored.

Null and empty texts have no paragraphs; repeated rows are reported each; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.quantiles import weighted_quantiles
from panelspark.session import stage_table

# Short notices by which works name their licence.
NOTICES = {
    "apache": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "Apache License Version 2.0, January 2004"],
    "mit": ["Released under the MIT License.", "This project is licensed under the terms of the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "You should have received a copy of the GNU General Public License along with this program."],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "Licensed under the GNU Lesser General Public License, version 2.1."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Licensed under the BSD 3-Clause License.", "Released under the 2-clause BSD license."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
    "cc0": ["To the extent possible under law, the author has dedicated all copyright and related rights to the public domain.", "Released under CC0 1.0 Universal."],
    "proprietary": ["All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.", "Copyright, all rights reserved."],
}
UNKNOWN = "unknown"
FAMILIES = [UNKNOWN, *NOTICES]
RESEMBLANCE = 0.6


def word_list(text: Column) -> Column:
    """Lower-case words without the stops and hyphens around them."""
    bare = F.transform(F.split(F.lower(text), r"[^\p{L}\p{N}.+-]+"), lambda w: F.btrim(w, F.lit(".-")))
    return F.filter(bare, lambda w: F.btrim(w, F.lit(".+-")) != "")


def grams_of(words: Column) -> Column:
    """One- and two-word grams of a word array."""
    pairs = F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat(F.get(words, i), F.lit(" "), w))
    return F.concat(words, pairs)


def grams(text: Column) -> Column:
    """One- and two-word grams of a paragraph; its words are written once in the expression."""
    return F.get(F.transform(F.array(word_list(text)), grams_of), F.lit(0))


def pairs_of(found: Column) -> Column:
    return F.array_distinct(F.filter(found, lambda g: g.contains(" ")))


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph (number from 0), line of every paragraph that is not blank."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lines = rows.select("doc_id", F.posexplode(F.split("text", r"[\r\n]+")).alias("paragraph", "line"))
    return lines.filter(F.length(F.trim("line")) > 0)


def with_words(lines: DataFrame, some: list[str]) -> DataFrame:
    """Lines that hold one of these words, with their word array.

    The array comes out of a generator: conditions on it are not pushed below and it is computed once per line.
    """
    return lines.withColumn("words", F.explode(F.array(word_list(F.col("line"))))).filter(F.exists("words", lambda w: w.isin(some)))


def notice_table(spark: SparkSession) -> DataFrame:
    rows = [(f, n) for f, notices in NOTICES.items() for n in notices]
    values = ", ".join("('{}', '{}')".format(f, n.replace("'", "\\'")) for f, n in rows)
    table = spark.sql(f"SELECT * FROM VALUES {values} AS t(family, line)").withColumn("grams", grams(F.col("line")))
    return table.withColumn("pairs", pairs_of(F.col("grams")))


def resembled(lines: DataFrame, notices: DataFrame) -> DataFrame:
    """Lines (with grams) and the notice they resemble most: its family ``near`` and the ``share`` of its word pairs found.

    The notices are a fixed list: one literal map leads from a pair to the numbers of the notices that hold it, and
    a line's pairs are looked up and counted once.
    """
    known = notices.select("family", "pairs").collect()
    holders: dict[str, list[int]] = {}
    for i, r in enumerate(known):
        for pair in r.pairs:
            holders.setdefault(pair, []).append(i)
    where = F.create_map(*[x for pair, of in holders.items() for x in (F.lit(pair), F.array(*[F.lit(i) for i in of]))])
    mine = F.filter(pairs_of(F.col("grams")), lambda g: g.isin(list(holders)))
    hits = lines.withColumn("_hits", F.explode(F.array(F.flatten(F.transform(mine, lambda g: F.element_at(where, g))))))
    size, family = F.array(*[F.lit(float(len(r.pairs))) for r in known]), F.array(*[F.lit(r.family) for r in known])
    share = lambda i: F.size(F.filter("_hits", lambda h: h == i)) / F.get(size, i)
    best = F.array_max(F.transform(F.array_distinct("_hits"), lambda i: F.struct(share(i).alias("share"), F.get(family, i).alias("family"))))
    out = hits.withColumn("_best", F.explode(F.array(best)))
    return out.withColumns({"near": F.col("_best.family"), "share": F.coalesce("_best.share", F.lit(0.0))}).drop("_hits", "_best")


@dataclass
class Classifier:
    vocabulary: list[str]
    counts: CountVectorizerModel
    regression: LogisticRegressionModel
    threshold: float
    words: list[str]


def _variants(notices: DataFrame) -> DataFrame:
    """Whole notices, and each without up to three first or last words."""
    words = F.split("line", " ")
    cut = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda a: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda z: F.array_join(F.slice(words, a + 1, F.greatest(F.size(words) - a - z, F.lit(3))), " "))))
    return notices.select("family", F.explode(F.array_distinct(cut)).alias("line")).withColumn("grams", grams(F.col("line")))


def _held(line: str = "line") -> Column:
    return F.pmod(F.xxhash64(line), F.lit(4)) == 0


def line_counts(docs: DataFrame, notices: DataFrame, fitted: Column) -> dict[str, int]:
    """Background lines of all documents that hold each gram of the notices; "" counts all, "\n" those not ``fitted``.

    Lines without a word of the notices are background and hold no gram: they are only counted.
    """
    candidates = [r.g for r in notices.select(F.explode("grams").alias("g")).distinct().collect()]
    single, double = [g for g in candidates if " " not in g], [g for g in candidates if " " in g]
    lines = paragraphs(docs).select("line", (~fitted).alias("free"))
    every = lines.groupBy("free").count().collect()
    mine = lambda words: F.concat(
        F.filter(words, lambda w: w.isin(single)),
        F.filter(F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.when(w.isin(single), F.concat(F.get(words, i), F.lit(" "), w))), lambda g: g.isin(double)),
    )
    held = with_words(lines, single).select("free", F.explode(F.array(F.array_distinct(mine(F.col("words"))))).alias("grams"))
    near = F.coalesce(F.col("share") >= RESEMBLANCE, F.lit(False)).alias("near")
    marked = resembled(held, notices).select("free", near, F.explode(F.concat(F.array(F.lit("")), "grams")).alias("g"))
    seen: dict[str, int] = {}
    out = {True: 0, False: 0}
    for r in marked.groupBy("g", "free", "near").count().collect():
        if not r["near"]:
            seen[r["g"]] = seen.get(r["g"], 0) + r["count"]
        elif r["g"] == "":
            out[bool(r["free"])] += r["count"]
    found = {g: seen.get(g, 0) for g in candidates}
    free = {bool(r["free"]): r["count"] for r in every}
    found[""] = sum(free.values()) - sum(out.values())
    found["\n"] = free.get(True, 0) - out[True]
    return found


def calibrated(scores: DataFrame, n: int, named_share: float) -> float:
    """A threshold, 0.5 at least, that at most ``named_share`` of ``n`` lines reach; ``scores`` has p of those with a vocabulary gram."""
    allowed = int(named_share * n)
    data = scores.groupBy("p").agg(F.count(F.lit(1)).alias("c"))
    data = stage_table(data, "scores")
    total, high = data.agg(F.sum("c"), F.sum(F.when(F.col("p") >= 0.5, F.col("c")))).first()
    if (high or 0) <= allowed:
        return 0.5
    rest = data.sparkSession.range(1).select(F.lit(0.0).alias("p"), F.lit(max(n - total, 0)).cast("long").alias("c")).filter("c > 0")
    n = max(n, total)
    at = weighted_quantiles(data.unionByName(rest), [], "p", "c", {"q": (n - 1 - allowed) / max(1, n - 1)}).first()["q"]
    return max(0.5, at + 1e-6)


def marked_lines(lines: DataFrame, words: list[str], vocabulary: list[str], *keep: str) -> DataFrame:
    """``keep`` and the grams of the lines that hold a gram of the vocabulary; ``words`` are the first words of its grams."""
    held = with_words(lines, words).select(*keep, F.explode(F.array(grams_of(F.col("words")))).alias("grams"))
    return held.filter(F.exists("grams", lambda g: g.isin(vocabulary)))


def fit(docs: DataFrame, sample: int = 1024, common_share: float = 0.005, named_share: float = 0.001) -> Classifier:
    return _fit(docs, sample, common_share, named_share)[0]


def fit_and_scan(docs: DataFrame, **options: float) -> DataFrame:
    """:func:`scan` of the documents that the classifier was fitted on: their lines are split once for its threshold and for the search."""
    model, lines = _fit(docs, **options)
    return _named(lines, model)


def _fit(docs: DataFrame, sample: int = 1024, common_share: float = 0.005, named_share: float = 0.001) -> tuple[Classifier, DataFrame]:
    """The classifier, and the marked lines of all documents as a staged table."""
    spark = docs.sparkSession
    notices = notice_table(spark)
    ids = docs.select(F.col("doc_id").cast("long").alias("_id")).dropna().distinct().orderBy(F.xxhash64("_id"), "_id").limit(sample)
    chosen = F.coalesce(F.col("doc_id").cast("long").isin([r[0] for r in ids.collect()]), F.lit(False))
    some = docs.filter(chosen)
    fitted = chosen & ~_held()
    lines = resembled(paragraphs(some).withColumn("grams", grams(F.col("line"))), notices)
    lines = lines.withColumn("family", F.when(F.col("share") >= RESEMBLANCE, F.col("near")).otherwise(UNKNOWN)).select("doc_id", "line", "grams", "family").persist()
    try:
        background = lines.filter(F.col("family") == UNKNOWN)
        often = line_counts(docs, notices, fitted)
        n = max(1, often.get("", 0))
        candidates = notices.select(F.explode("grams").alias("g")).distinct()
        vocabulary = sorted(r.g for r in candidates.collect() if often.get(r.g, 0) <= common_share * n)
        counts = CountVectorizerModel.from_vocabulary(vocabulary, "grams", "features", minTF=1.0).setBinary(True)
        label = F.element_at(F.create_map(*[F.lit(x) for i, f in enumerate(FAMILIES) for x in (f, float(i))]), F.col("family"))
        # A quarter of the sample's lines is not fitted, but calibrates the threshold with all other documents.
        positive = _variants(notices).unionByName(lines.filter(F.col("family") != UNKNOWN).select("family", "line", "grams"))
        rows = positive.withColumn("w", F.lit(4.0)).unionByName(background.filter(~_held()).select("family", "line", "grams").withColumn("w", F.lit(1.0)))
        train = counts.transform(rows.withColumn("label", label))
        regression = LogisticRegression(family="multinomial", regParam=0.002, maxIter=60, weightCol="w", standardization=False).fit(train)
    finally:
        lines.unpersist()
    words = sorted({w for v in vocabulary for w in v.split()[:1]})
    marked = marked_lines(paragraphs(docs).withColumn("free", ~fitted), words, vocabulary, "doc_id", "paragraph", "free")
    marked = stage_table(marked, "licence_lines")
    free = marked.filter("free").select("grams")
    best = F.array_max(F.slice(vector_to_array("probability"), 2, len(FAMILIES)))
    scores = regression.transform(counts.transform(resembled(free, notices).filter(F.col("share") < RESEMBLANCE).select("grams"))).select(best.alias("p"))
    return Classifier(vocabulary, counts, regression, calibrated(scores, often.get("\n", 0), named_share), words), marked


def scan(docs: DataFrame, model: Classifier) -> DataFrame:
    """Paragraphs with a licence notice: doc_id, paragraph, family, probability, resemblance, confirmed."""
    return _named(marked_lines(paragraphs(docs), model.words, model.vocabulary, "doc_id", "paragraph"), model)


def _named(lines: DataFrame, model: Classifier) -> DataFrame:
    notices = notice_table(lines.sparkSession)
    scored = model.regression.transform(model.counts.transform(lines)).withColumn("p", vector_to_array("probability"))
    top = F.array_max(F.transform(F.slice("p", 2, len(FAMILIES)), lambda v, i: F.struct(v.alias("p"), (i + 2).cast("int").alias("i"))))
    named = scored.select("doc_id", "paragraph", "grams", top.alias("top")).filter(F.col("top.p") >= model.threshold)
    named = resembled(named.withColumn("family", F.element_at(F.array(*[F.lit(f) for f in FAMILIES]), F.col("top.i"))), notices)
    return named.select(
        "doc_id", F.col("paragraph").cast("long").alias("paragraph"), "family", F.round("top.p", 6).alias("probability"), F.round("share", 6).alias("resemblance"),
        ((F.col("near") == F.col("family")) & (F.col("share") >= RESEMBLANCE)).alias("confirmed"),
    )
