"""Licence scan: a trained paragraph classifier in DataFrame functions only.

Sparse word 1- to 3-grams of a paragraph go into an L1 multinomial logistic regression over licence
families and an unknown class. It is trained here on notice templates, varied with words of corpus
lines, and on negatives: lines of a bounded corpus sample, with and without licence words, and sentences
that merely sound like licences. Folds hold whole templates and whole negatives. A held-out fold
calibrates: a temperature that minimises the log loss, and the least probability at which no held-out
negative passes; the weights are then fitted on all folds. A prediction is confirmed if the paragraph
holds at least CONFIRM of the word trigrams of one template of the family (of a template of two words, both, in
order).

Every line of every text is looked at, and so is every block of non-blank lines, joined, as notices
come hard-wrapped: a block of more than WINDOW lines by windows of WINDOW lines that overlap by half.
Paragraphs (lines or windows) without any word of GATE are passed over; that loses nothing, as fewer
than CONFIRM of the trigrams of each template have no such word, so no such paragraph can be confirmed.
Of a paragraph's n-grams only those of the model and the templates are kept, in the row itself; their
number is bounded by the training set.

The sample is chosen by hash and ordered by hash: the same rows give the same weights, however they lie.

Edge cases: null and empty texts have no paragraphs; repeated rows, null ids and extra columns do no
harm (rows are told apart by a number of their own); equal probabilities are decided by coverage, then by
the name of the family; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vistrack.session import stored

ANCHOR = r"(?i)licen[cs]|copyright|eclipse|boost software|spdx|permission|redistribut|warrant|public domain|creative commons|\bcc0?[ -]|\bgnu\b|\b[al]?gpl|mozilla|apache|\bmit\b|\bbsd\b|\bisc\b|unencumbered"
#: Words one of which is in any paragraph that can be confirmed (a test counts the trigrams without).
GATE = ANCHOR + r"|software|hereby|granted|purpose|waived|documentation|compliance|modif|binary|permitted|foundation|source"
#: Corpus lines in the training set at most, without and with an anchor word; documents they come from, about.
NEGATIVES, SAMPLE_DOCS = 400, 4000
CONFIRM = 0.6
#: Lines joined at most; a notice of up to half of them and one more lies whole in one window.
WINDOW = 8
FOLDS = 4
UNKNOWN = "unknown"

#: Usual wording of public licence notices by family.
TEMPLATES = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT license.", "This project is licensed under the terms of the MIT license.", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", "License: MIT", "MIT licensed", "Distributed under the MIT license.", "SPDX-License-Identifier: MIT-0", "SPDX-License-Identifier: X11"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "Released under the Apache License 2.0.", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "License: Apache-2.0", "Licensed under Apache 2.0", "Apache License, Version 2.0"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-or-later", "Released under the GPL v3.", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0", "SPDX-License-Identifier: GPL-3.0+", "Licensed under GPLv3", "License: GPL-3.0", "Licensed under the GNU GPL version 3", "GNU General Public License v3.0"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only", "Released under the GPL v2.", "it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation", "SPDX-License-Identifier: GPL-2.0-or-later", "SPDX-License-Identifier: GPL-2.0", "SPDX-License-Identifier: GPL-2.0+", "Licensed under GPLv2", "License: GPL-2.0", "Licensed under the GNU GPL version 2", "GNU General Public License v2.0"),
    "LGPL": ("Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-3.0-or-later", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: LGPL-2.1-only", "SPDX-License-Identifier: LGPL-2.1-or-later", "SPDX-License-Identifier: LGPL-3.0-only", "SPDX-License-Identifier: LGPL-2.1", "SPDX-License-Identifier: LGPL-3.0", "SPDX-License-Identifier: LGPL-2.0-only", "SPDX-License-Identifier: LGPL-2.0-or-later", "Licensed under LGPLv3", "Licensed under LGPLv2.1", "License: LGPL-2.1", "License: LGPL-3.0"),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: AGPL-3.0-or-later", "SPDX-License-Identifier: AGPL-3.0", "Licensed under AGPLv3", "License: AGPL-3.0"),
    "BSD": ("Released under the BSD 3-Clause License.", "Licensed under the BSD license.", "SPDX-License-Identifier: BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "SPDX-License-Identifier: BSD-2-Clause", "SPDX-License-Identifier: 0BSD", "SPDX-License-Identifier: BSD-4-Clause", "Released under the BSD 2-Clause License.", "License: BSD", "License: BSD-3-Clause", "License: BSD-2-Clause", "BSD licensed"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0", "Licensed under the Mozilla Public License, version 2.0.", "License: MPL-2.0", "Licensed under MPL 2.0", "SPDX-License-Identifier: MPL-1.1"),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0", "License: CC-BY-4.0", "SPDX-License-Identifier: CC-BY-3.0"),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0", "License: CC-BY-SA-4.0", "SPDX-License-Identifier: CC-BY-SA-3.0"),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0", "License: CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-3.0"),
    "CC0": ("To the extent possible under law, the author has waived all copyright under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense", "License: Unlicense", "Released under the Unlicense license."),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0", "License: BSL-1.0", "Licensed under the Boost Software License 1.0"),
    "EPL-2.0": ("made available under the terms of the Eclipse Public License 2.0", "SPDX-License-Identifier: EPL-2.0", "SPDX-License-Identifier: EPL-1.0", "License: EPL-2.0", "Licensed under the Eclipse Public License, version 2.0."),
    "ISC": ("Released under the ISC License.", "SPDX-License-Identifier: ISC", "License: ISC", "Licensed under the ISC license.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
}
#: Sentences with licence words that name no licence.
SOUNDS_LIKE = (
    "The driver's licence was issued last year.", "A fishing license is required in this county.", "All rights reserved.", "Copyright by the author.", "The copyright office moved to a new building.", "She asked for permission to leave.", "The warranty covers two years of use.",
    "He studied at MIT for four years.", "The license plate could not be read.", "The Apache helicopter landed.", "Our gnu herd crossed the river.", "The terms of the contract were changed.", "This work is part of a series, version 3.", "Use of the software is restricted.", "The public domain of the town is a park.",
    "Released under pressure from the public.", "Version 2.0 is out now.", "The general public was invited.", "They redistribute the income.", "A creative commons for artists opened.", "You may obtain a copy at the desk.", "License fees went up.",
)


def words_of(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}][\p{L}\p{N}.+-]*"), F.lit(0)), lambda w: F.regexp_replace(w, r"[.+-]+$", ""))


def grams_of(words: Column, n: int) -> Column:
    return F.when(F.size(words) < n, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " ")))


def features_of(words: Column) -> Column:
    return F.array_distinct(F.concat(words, grams_of(words, 2), grams_of(words, 3)))


def joined(text: Column) -> Column:
    """Windows of joined lines of the blocks between blank lines; single lines are left out."""
    half = WINDOW // 2

    def windows(block: Column) -> Column:
        lines = F.split(block, "\n")
        starts = F.sequence(F.lit(1), F.greatest(F.size(lines) - WINDOW, F.lit(0)) + half, F.lit(half))
        return F.when(F.size(lines) > 1, F.transform(starts, lambda i: F.array_join(F.slice(lines, i, WINDOW), " "))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(F.filter(F.split(text, r"\n\s*\n"), lambda b: b.rlike(GATE)), windows))


def corpus_lines(docs: DataFrame, text_col: str = "text") -> tuple[list[str], list[str]]:
    """Lines without and with an anchor word of documents chosen by hash, NEGATIVES each, in the order of
    their hashes. Those with an anchor word share no trigram with a template, so that no notice is among them."""
    text = F.col(f"`{text_col}`").cast("string")
    every = max(1, docs.count() // SAMPLE_DOCS)
    some = docs.select(text.alias("t")).where(F.pmod(F.xxhash64("t"), F.lit(every)) == 0).distinct()
    lines = some.select(F.explode(F.split("t", "\n")).alias("p")).where(F.length("p").between(20, 400)).distinct()
    lines = stored(lines.withColumn("h", F.xxhash64("p")), "licence-lines")
    own = F.array_distinct(F.flatten(F.array(*[grams_of(words_of(F.lit(t)), 3) for texts in TEMPLATES.values() for t in texts])))
    own = docs.sparkSession.range(1).select(own.alias("g")).head()["g"]
    first = lambda d: [r["p"] for r in d.orderBy("h", "p").limit(NEGATIVES).collect()]
    anchored = lines.where(F.col("p").rlike(ANCHOR) & ~F.lower("p").contains("spdx"))
    return first(lines.where(~F.col("p").rlike(ANCHOR))), first(anchored.where(~F.arrays_overlap(grams_of(words_of(F.col("p")), 3), F.array(*map(F.lit, own)))))


def folds_of(templates: dict) -> dict:
    """The fold of each template text; one that is part of another (an identifier with and without -only) shares its fold."""
    fold, roots = {}, {}
    texts = [(t, k) for own in templates.values() for k, t in enumerate(own)]
    for t, _ in texts:
        roots[t] = t
    for t, _ in texts:
        for u, _ in texts:
            if t != u and t in u and roots[t] != roots[u]:
                roots |= {x: roots[t] for x, r in roots.items() if r == roots[u]}
    for t, k in texts:
        fold[t] = next(j for u, j in texts if u == roots[t]) % FOLDS
    return fold


def training_set(spark: SparkSession, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows (fold, text, family): a few hundred templates with variations, and at most 2 x NEGATIVES corpus
    lines. All variations of a template, and all rows with the same sentence, are in one fold."""
    plain, near = corpus_lines(docs, text_col)
    plain = plain or ["lorem ipsum dolor sit amet"]
    rows, fold = [], folds_of(TEMPLATES)
    for family, texts in TEMPLATES.items():
        for k, t in enumerate(texts):
            words = t.split()
            for v in range(8):
                pad = plain[(len(rows) * 7 + v) % len(plain)].split()
                own = list(words)
                if v >= 4 and len(own) > 6:
                    own.pop((v * 5 + k) % len(own))
                before, after = (pad[: v * 3], []) if v % 2 else ([], pad[: v * 3])
                rows.append((fold[t], " ".join([*before, *own, *after]), family))
    for i, x in enumerate(SOUNDS_LIKE):
        rows += [(i % FOLDS, x, UNKNOWN), (i % FOLDS, " ".join([x, *plain[i % len(plain)].split()[:6]]), UNKNOWN)]
    rows += [(i % FOLDS, p, UNKNOWN) for i, p in enumerate([*plain, *near]) if not any(x in p for x in SOUNDS_LIKE)]
    return spark.createDataFrame(rows, "fold int, text string, family string")


def train(spark: SparkSession, docs: DataFrame, text_col: str = "text") -> dict:
    """weights (feature, family, w), intercepts, temperature and least probability."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer

    families = [UNKNOWN, *TEMPLATES]
    label = F.array_position(F.array(*map(F.lit, families)), F.col("family")) - 1
    rows = training_set(spark, docs, text_col).coalesce(1).select("fold", features_of(words_of(F.col("text"))).alias("grams"), label.cast("double").alias("label")).cache()
    counted = CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=2.0, vocabSize=1 << 14).fit(rows)
    data = counted.transform(rows)
    learner = LogisticRegression(family="multinomial", regParam=0.002, elasticNetParam=0.5, maxIter=40, standardization=False)
    # calibration on the fold left out; only families that the other folds know
    part = learner.fit(data.where("fold <> 0"))
    held = [(int(r["label"]), r["rawPrediction"].toArray().tolist()) for r in part.transform(data.where("fold = 0")).select("label", "rawPrediction").collect()]

    def probability(z, t):
        e = [math.exp((x - max(z)) / t) for x in z]
        return [x / sum(e) for x in e]

    temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=lambda t: sum(-math.log(max(1e-12, probability(z, t)[y])) for y, z in held))
    high = [max(probability(z, temperature)[1:]) for y, z in held if y == 0]
    least = min(0.999, max([0.3, *high]) + 0.001)
    model = learner.fit(data)
    matrix, vocabulary = model.coefficientMatrix.toArray(), counted.vocabulary
    weights = sorted((vocabulary[j], families[i], float(matrix[i, j])) for i in range(len(families)) for j in range(len(vocabulary)) if abs(matrix[i, j]) > 1e-6)
    rows.unpersist()
    return {"weights": weights, "intercepts": dict(zip(families, model.interceptVector.toArray().tolist(), strict=True)), "temperature": temperature, "least": least}


def scan(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_paragraphs (lines with an anchor), families (confirmed, sorted, comma
    separated), family, probability and coverage of the surest confirmed paragraph (else unknown)."""
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`").cast("string")
    known = spark.createDataFrame([(f, k, t) for f, texts in TEMPLATES.items() for k, t in enumerate(texts)], "family string, template int, t string")
    known = known.select("family", "template", F.array_distinct(grams_of(words_of(F.col("t")), 3)).alias("g"), words_of(F.col("t")).alias("w"))
    known = known.select("family", "template", F.when(F.size("g") > 0, F.col("g")).otherwise(F.array(F.array_join("w", " "))).alias("g")).select("family", "template", F.size("g").alias("n"), F.explode("g").alias("gram"))
    known = [tuple(r) for r in known.collect()]  # the templates' own grams
    vocabulary = sorted({g for g, _, _ in model["weights"]} | {r[3] for r in known})
    some = lambda a: F.when(text.rlike(GATE), F.filter(a, lambda p: p.rlike(GATE))).otherwise(F.array().cast("array<string>"))
    hits = lambda words: F.filter(features_of(words), lambda g: g.isin(vocabulary))
    # one pass over the texts; a text without any word of the gate is not split
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), some(F.split(text, "\n")).alias("lines"), some(joined(text)).alias("windows"))
    rows = rows.select("id", F.coalesce(F.size(F.filter("lines", lambda p: p.rlike(ANCHOR))), F.lit(0)).alias("n"), F.transform(F.transform(F.concat("lines", "windows"), words_of), hits).alias("hits"))
    rows = stored(rows.withColumn("uid", F.monotonically_increasing_id()), "licences")
    grams = rows.select("uid", F.posexplode("hits").alias("pos", "grams")).select("uid", "pos", F.explode("grams").alias("gram"))
    families = list(model["intercepts"])
    weights = F.broadcast(spark.createDataFrame(model["weights"], "gram string, family string, w double"))  # bounded by the training set
    sums = [F.sum(F.when(F.col("family") == f, F.col("w")).otherwise(0.0)).alias(f) for f in families]
    z = grams.join(weights, "gram").groupBy("uid", "pos").agg(*sums)
    logits = F.array(*[F.struct(((F.col(f"`{f}`") + F.lit(model["intercepts"][f])) / model["temperature"]).alias("z"), F.lit(f).alias("f")) for f in families])
    z = z.select("uid", "pos", logits.alias("l")).select("uid", "pos", F.array_max("l").alias("top"), "l")
    total = F.aggregate("l", F.lit(0.0), lambda a, x: a + F.exp(x["z"] - F.col("top")["z"]))
    predicted = z.select("uid", "pos", F.col("top")["f"].alias("family"), (1 / total).alias("probability")).where((F.col("family") != UNKNOWN) & (F.col("probability") >= model["least"]))
    own = F.broadcast(spark.createDataFrame(known, "family string, template int, n int, gram string"))
    held = grams.join(own, "gram").join(predicted, ["uid", "pos", "family"]).groupBy("uid", "pos", "family", "template").agg((F.count("*") / F.max("n")).alias("c"))
    sure = held.groupBy("uid", "pos", "family").agg(F.max("c").alias("coverage")).where(F.col("coverage") >= CONFIRM).join(predicted, ["uid", "pos", "family"])
    best = F.max(F.struct("probability", "coverage", "family")).alias("best")
    found = sure.groupBy("uid").agg(F.array_join(F.sort_array(F.collect_set("family")), ",").alias("families"), best)
    out = rows.select("uid", "id", "n").join(found, "uid", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_paragraphs"), F.coalesce("families", F.lit("")).alias("families"), F.coalesce(F.col("best")["family"], F.lit(UNKNOWN)).alias("family"), F.round(F.col("best")["probability"], 6).alias("probability"), F.round(F.col("best")["coverage"], 6).alias("coverage"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs, train(spark, docs))
