"""Operator 2: licence scan by a trained paragraph classifier, in DataFrame functions and MLlib only.

Every line of every text is a paragraph. Its features are its distinct words and word pairs. A multinomial logistic
regression gives each family a probability, ``none`` and ``unknown`` being classes too; the model is one table of weights,
joined by n-gram. A family counts only above its calibrated threshold, else the paragraph is ``unknown``. Comparison with
the family's templates, by shared word triples, confirms a prediction.

*Bound.* No list of words decides what is classified. A line can win a class other than ``none`` only if its n-grams raise
that class over ``none`` by more than the intercepts hold it back, so lines whose n-grams cannot sum to that are ``none``
without being joined (``may_win``); the bound is the model's own and loses no line.

*Fit.* On the templates, on names of licences in phrases of four languages, on sentences of unknown licences, on
sentences that only sound like licences, and on ``NEGATIVES`` corpus lines of smallest hash at most. A quarter of the
templates, with everything made from them, is held out to calibrate the thresholds.

Contract. Null and empty texts and lines that the model takes for ``none`` give no row. Long texts are read whole. Repeated
rows are each reported. Equal probabilities go to the family that comes first by name. An empty table gives no rows. Other
columns are never read.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.llm.common import need, shared_folder, staged

NEGATIVES = 2000
VOCABULARY = 20_000  # rows of the weight table at most
CONFIRMED = 0.5      # share of word triples in common with a template
LEVELS = 32         # steps of the shares in ``may_win``
NONE, UNKNOWN = "none", "unknown"

# Sentences by which texts name their licence.
TEMPLATES = {
    "agpl": ["This program is licensed under the GNU Affero General Public License, version 3.",
             "You should have received a copy of the GNU Affero General Public License along with this program.",
             "SPDX-License-Identifier: AGPL-3.0-only"],
    "apache": ["Licensed under the Apache License, Version 2.0.",
               "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
               "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
               "SPDX-License-Identifier: Apache-2.0", "This project is released under the Apache 2.0 license."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
            "Released under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license.",
            "SPDX-License-Identifier: BSD-3-Clause"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.",
              "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
                 "Licensed under CC BY-NC 4.0.", "Released under CC BY-NC-SA 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
                 "Licensed under CC BY-SA 4.0.", "Text is available under the Creative Commons Attribution-ShareAlike License.",
                 "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
            "You should have received a copy of the GNU General Public License along with this program.",
            "SPDX-License-Identifier: GPL-3.0-or-later", "Licensed under the GPL v2 or later."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
            "SPDX-License-Identifier: ISC", "Released under the ISC License."],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1.",
             "You should have received a copy of the GNU Lesser General Public License along with this library.",
             "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "mit": ["Released under the MIT License.", "Licensed under the MIT license.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
            "SPDX-License-Identifier: MIT"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
            "Released under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "proprietary": ["All rights reserved.", "This software is proprietary and confidential; unauthorized copying of this file is strictly prohibited.",
                    "No part of this publication may be reproduced without prior written permission of the publisher; all rights reserved."],
    "public-domain": ["This is free and unencumbered software released into the public domain.",
                      "This work has been dedicated to the public domain under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0",
                      "The author has placed this work in the public domain."],
}
# Short names of the families, and phrases around such a name.
NAMES = {
    "agpl": ["AGPLv3", "GNU AGPL", "AGPL-3.0", "GNU Affero General Public License"],
    "apache": ["Apache-2.0", "Apache 2.0", "Apache License 2.0", "Apache License, Version 2.0"],
    "bsd": ["BSD-3-Clause", "BSD-2-Clause", "BSD", "BSD-style"],
    "cc-by": ["CC BY 4.0", "CC-BY 4.0", "CC BY 3.0", "Creative Commons Attribution 4.0"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC BY-NC-SA 4.0", "CC BY-NC", "Creative Commons Attribution-NonCommercial 4.0"],
    "cc-by-sa": ["CC BY-SA 4.0", "CC BY-SA 3.0", "CC-BY-SA", "Creative Commons Attribution-ShareAlike 4.0"],
    "gpl": ["GPLv3", "GPLv2", "GNU GPL", "GPL-3.0", "GPL v3", "GNU General Public License"], "isc": ["ISC"],
    "lgpl": ["LGPLv2.1", "LGPLv3", "GNU LGPL", "LGPL-2.1", "GNU Lesser General Public License"],
    "mit": ["MIT"], "mpl": ["MPL-2.0", "MPL 2.0", "MPLv2", "Mozilla Public License 2.0"],
    "public-domain": ["CC0 1.0 Universal", "CC0", "CC0-1.0", "public domain"],
}
PHRASES = ["{}", "Released under {}.", "This is distributed under {}.", "Licensed under {}", "Licensed under the {} license.", "License: {}",
           "{} License", "This project uses the {} license.", "The code is available under the terms of the {} licence.",
           "Code unter der {}-Lizenz.", "Veröffentlicht unter der Lizenz {}.", "Dieses Werk steht unter der {} Lizenz.",
           "Publicado bajo licencia {}.", "Este programa se distribuye bajo la licencia {}.", "Publié sous licence {}.",
           "Ce logiciel est distribué sous la licence {}."]
OTHER = ["Licensed under the terms of the vendor agreement.", "Use of this product is subject to the end user license agreement.",
         "This material is distributed under a custom license.", "See the license file for details.", "Licensed under the Foobar Community License.",
         "Contact the author for license terms.", "The license permits evaluation use for thirty days.", "Copyright the authors.",
         "This dataset is released under a research license.", "Released under version 3 of our shared source license.",
         "This work is licensed for internal use.", "Released under the shareware license of the vendor.",
         "Veröffentlicht unter einer eigenen Lizenz.", "Publicado bajo una licencia propia.", "Publié sous une licence particulière."]
STRANGERS = ["He holds a driver's license.", "The restaurant has lost its liquor license.", "The warranty covers all parts for two years.",
             "The city issued a fishing license.", "We reviewed the fishing license at the office.", "A license is required to operate this service.",
             "Permission is needed to enter the building.", "Researchers at MIT found a new result.", "The MIT campus is in Cambridge.",
             "She studied at MIT.", "The Apache helicopter landed.", "The Apache people live in the southwest.", "The file is on the server.",
             "The software was released in May.", "The code is in the cellar of the house.", "The conditions of the work are hard.",
             "He gave notice to the public.", "The use of water is free of charge.", "Redistribution of wealth was debated in parliament.",
             "Version 2.0 of the program was published.", "All seats are reserved.", "The rights of the people are to be respected.",
             "Er kam mit dem Zug.", "Sie spricht mit dem Lehrer.", "The park is open to the public.", "Der Mann verlor seine Lizenz als Pilot.",
             "Das Werk steht unter der Leitung von Herrn Maier.", "El bar perdió su licencia.",
             "Este programa se emite bajo la lluvia.", "Il a perdu sa licence de pilote.", "Ce livre est sous la table."]


def word_list(text: Column) -> Column:
    """Runs of letters and runs of digits, in lower case: 'GPLv3' and 'MIT-Lizenz' are two words each."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+|\p{N}+"), F.lit(0))


def runs(words: Column, n: int) -> Column:
    """Runs of ``n`` words, joined by spaces; none if there are fewer."""
    places = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.array_join(F.slice(words, i, n), " "))


def features(text: Column) -> Column:
    words = word_list(text)
    return F.array_distinct(F.concat(words, runs(words, 2)))


def triples(text: Column) -> Column:
    words = word_list(text)
    return F.array_distinct(F.when(F.size(words) >= 3, runs(words, 3)).otherwise(F.array(F.array_join(words, " "))))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, row, paragraph, text): the lines of all texts, numbered from 0 within their text."""
    rows = need(docs, "doc_id", "text").select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    return rows.select("doc_id", "row", F.posexplode(F.split("text", "\n")).alias("paragraph", "text"))


def sentences() -> list[tuple[str, str, str]]:
    """(text, label, origin): everything that is trained on besides corpus lines; ``origin`` is the template a text is made from."""
    lead = ["", "Copyright 2021 The Authors. ", "Note: ", "The document below follows. "]
    sources = [(t, family) for family, all_of in TEMPLATES.items() for t in all_of]
    sources += [(t, UNKNOWN) for t in OTHER] + [(t, NONE) for t in STRANGERS]
    texts = [(a + t, label, t) for t, label in sources for a in lead]
    for t, label in sources:
        words = t.split()
        if len(words) >= 8:  # parts of long notices, as lines break them
            texts += [(" ".join(words[:len(words) * 2 // 3]), label, t), (" ".join(words[len(words) // 3:]), label, t)]
    return texts + [(p.format(name), family, p.format(name)) for family, all_of in NAMES.items() for name in all_of for p in PHRASES]


def examples(docs: DataFrame) -> DataFrame:
    """(text, label, origin, made) to train on: bounded, whatever the corpus. Corpus lines that are like a template are no strangers."""
    spark = docs.sparkSession
    made = spark.createDataFrame(sentences(), "text string, label string, origin string").withColumn("made", F.lit(True))
    lines = need(docs, "text").select(F.explode(F.split("text", "\n")).alias("text")).filter(F.length("text") > 0)
    few = lines.orderBy(F.xxhash64("text"), "text").limit(NEGATIVES)
    few = staged(few.select("text", F.monotonically_increasing_id().alias("row"), F.lit(0).alias("paragraph")), "strangers", shared_folder(spark))
    like = compared(few, spark).filter(F.col("likeness") >= CONFIRMED).select("row").distinct()
    few = few.join(like, "row", "left_anti")
    return made.unionByName(few.select("text", F.lit(NONE).alias("label"), F.col("text").alias("origin"), F.lit(False).alias("made")))


def fit(docs: DataFrame) -> DataFrame:
    """The model: (gram, weights) with one weight per class, the thresholds in the row of the empty gram's ``cut``."""
    return fit_on(examples(docs))


def fit_on(rows: DataFrame) -> DataFrame:
    spark = rows.sparkSession
    classes = sorted([*TEMPLATES, UNKNOWN, NONE])
    number = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label")) - 1
    data = rows.select("origin", "made", "text", "label", number.cast("double").alias("y"), features(F.col("text")).alias("grams"))
    data = staged(data.withColumn("held", F.pmod(F.xxhash64("origin"), F.lit(4)) == 0), "examples", shared_folder(spark))
    counter = CountVectorizer(inputCol="grams", outputCol="x", binary=True, vocabSize=VOCABULARY)
    counter = counter.fit(data.filter("made"))
    learner = LogisticRegression(featuresCol="x", labelCol="y", family="multinomial", regParam=0.002, maxIter=60)
    vectors = counter.transform(data).coalesce(1).cache()  # some thousand rows, whatever the corpus
    cut = _thresholds(learner.fit(vectors.filter("not held")).transform(vectors.filter("held")), classes)
    model = learner.fit(vectors)
    vectors.unpersist()
    seen = [int(c) for c in range(model.numClasses)]
    weights = model.coefficientMatrix.toArray()
    rows = [(g, [float(weights[c, i]) for c in seen], None) for i, g in enumerate(counter.vocabulary)]
    rows.append(("", [float(b) for b in model.interceptVector.toArray()], cut))
    return spark.createDataFrame(rows, "gram string, weights array<double>, cut array<double>")


def may_win(model: DataFrame, text: Column) -> Column:
    """Whether a line can be of another class than ``none``; true for every line that is.

    The share of an n-gram is the most by which it raises any class over ``none`` (below zero where it lowers all of them),
    rounded up to a step. A line whose shares sum to less than the smallest lead of ``none`` in the intercepts is ``none``.
    """
    none = sorted([*TEMPLATES, UNKNOWN, NONE]).index(NONE)
    share, lead = {}, 0.0
    for r in model.select("gram", "weights").collect():  # VOCABULARY rows at most
        most = max(w - r["weights"][none] for c, w in enumerate(r["weights"]) if c != none)
        if r["gram"] == "":
            lead = -most
        else:
            share[r["gram"]] = most
    step = max(map(abs, share.values()), default=0.0) / LEVELS
    by_level = defaultdict(list)
    for gram, most in sorted(share.items()):
        by_level[math.ceil(most / step) if step else 0].append(gram)
    by_level.pop(0, None)
    known = [gram for grams in by_level.values() for gram in grams]

    def worth(gram: Column) -> Column:
        found = F.lit(0.0)
        for level, grams in sorted(by_level.items()):
            found = F.when(gram.isin(grams), F.lit(level * step)).otherwise(found)
        return found

    words = word_list(text)
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    held = F.array_distinct(F.filter(F.concat(words, pairs), lambda gram: gram.isin(known)))
    return F.aggregate(held, F.lit(0.0), lambda a, gram: a + worth(gram)) >= lead - 1e-6


def _thresholds(judged: DataFrame, classes: list[str]) -> list[float]:
    """For each class the probability between what strangers get at most and members at least, held-out examples."""
    from pyspark.ml.functions import vector_to_array

    p = judged.select("label", F.posexplode(vector_to_array("probability")).alias("c", "p"))
    own = F.array(*[F.lit(c) for c in classes])[F.col("c")] == F.col("label")
    edges = p.groupBy("c").agg(F.max(F.when(~own, F.col("p"))).alias("strange"), F.min(F.when(own, F.col("p"))).alias("member"))
    found = {r["c"]: min(0.9, max(0.4, ((r["strange"] or 0.0) + (r["member"] if r["member"] is not None else 1.0)) / 2)) for r in edges.collect()}
    return [found.get(c, 0.5) for c in range(len(classes))]


def scored(lines: DataFrame, model: DataFrame) -> DataFrame:
    """(row, paragraph, family, probability, threshold): the most probable class of each line."""
    classes = sorted([*TEMPLATES, UNKNOWN, NONE])
    # VOCABULARY rows at most, and the intercepts as weights of the empty gram, which every line holds.
    weighted = F.broadcast(model.select("gram", "weights"))
    sums = [F.sum(F.col("weights")[c]).alias(f"s{c}") for c in range(len(classes))]
    grams = lines.select("row", "paragraph", F.explode(F.concat(features(F.col("text")), F.array(F.lit("")))).alias("gram"))
    base = F.broadcast(model.filter("gram = ''").select("cut"))
    total = grams.join(weighted, "gram").groupBy("row", "paragraph").agg(*sums).join(base, F.lit(True))
    logits = F.array(*[F.col(f"s{c}") for c in range(len(classes))])
    total = total.select("row", "paragraph", "cut", logits.alias("z")).withColumn("top", F.array_max("z"))
    weight = F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    best = (F.array_position("z", F.col("top")) - 1).cast("int")
    return total.select("row", "paragraph", F.array(*[F.lit(c) for c in classes])[best].alias("family"),
                        (1 / weight).alias("probability"), F.col("cut")[best].alias("threshold"))


def compared(lines: DataFrame, spark: SparkSession) -> DataFrame:
    """(row, paragraph, likeness): for each family, the largest share of triples in common with one of its templates."""
    known = [(family, t) for family, all_of in sorted(TEMPLATES.items()) for t in all_of]
    known += [(family, p.format(name)) for family, all_of in sorted(NAMES.items()) for name in all_of for p in PHRASES]
    template = spark.createDataFrame(known, "family string, template string").withColumn("t", triples(F.col("template")))
    template = F.broadcast(template.select("family", "template", F.size("t").alias("n_template"), F.explode("t").alias("triple")))
    held = lines.select("row", "paragraph", triples(F.col("text")).alias("t"))
    held = held.select("row", "paragraph", F.size("t").alias("n_line"), F.explode("t").alias("triple"))
    common = held.join(template, "triple").groupBy("row", "paragraph", "family", "template").agg(
        (F.count("*") / F.least(F.max("n_template"), F.max("n_line"))).alias("likeness"))
    return common.groupBy("row", "paragraph", "family").agg(F.max("likeness").alias("likeness"))


def licenses(docs: DataFrame, model: DataFrame | None = None) -> DataFrame:
    """(doc_id, paragraph, family, probability, confirmed, likeness) of every line that names a licence."""
    spark = docs.sparkSession
    model = fit(docs) if model is None else model
    lines = paragraphs(docs)
    lines = staged(lines.filter(may_win(model, F.col("text"))), "lines", shared_folder(spark))
    judged = scored(lines, model).filter(F.col("family") != NONE)
    judged = judged.join(compared(lines, spark), ["row", "paragraph", "family"], "left")
    sure = F.col("probability") >= F.col("threshold")
    judged = judged.withColumn("likeness", F.coalesce("likeness", F.lit(0.0))).withColumn(
        "family", F.when(sure, F.col("family")).otherwise(UNKNOWN))
    return lines.select("doc_id", "row", "paragraph").join(judged, ["row", "paragraph"]).select(
        "doc_id", "paragraph", "family", F.round("probability", 6).alias("probability"),
        ((F.col("family") != UNKNOWN) & (F.col("likeness") >= CONFIRMED)).alias("confirmed"), F.round("likeness", 6).alias("likeness"))


def query(docs: DataFrame) -> DataFrame:
    return licenses(docs)
