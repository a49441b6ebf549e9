"""Licence notices by a trained paragraph classifier, in DataFrame operations only.

A paragraph's features are the words and word pairs that occur in known
licence notices. A multinomial logistic regression with an L1 penalty, so most
weights are zero, separates the licence families from ordinary paragraphs; it
is trained here, from the notices below, from sentences that name a licence or
other terms, and from a bounded sample of the corpus. On rows kept from it, a
second regression for each family turns the margin over "unknown" into a
calibrated probability. A prediction counts as confirmed if enough of one of
its family's templates stands in the paragraph: of a notice, or a name. The
regression learns from some wordings only and is tested on others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, written

#: Documents whose paragraphs serve as examples of "unknown": the bound of the training sample.
SAMPLE_DOCUMENTS = 400
#: A word in a larger share of the sample's paragraphs is common: a gram of common words is no feature.
COMMON = 0.005
#: Share of a notice's word pairs that confirms its family.
CONFIRM = 0.6
UNKNOWN = "unknown"
#: Paragraphs of the sample that may be grants, so no examples of "unknown"; others may speak of licences.
GRANT = "(licen[sc]ed|released|distributed|published|available|provided) (under|as)|under (the|a|an) .*licen[sc]e|spdx|copyright|public domain|permission is hereby"

# Short licence notices by family, as they are commonly written.
NOTICES = {
    "MIT": [
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Distributed under the MIT License.",
        "Source code is published under the MIT license, see LICENSE.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache": [
        'See the License for the specific language governing permissions and limitations under the License.',
        'Each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license',
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "Released under the Apache License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS",
    ],
    "GPL": [
        'This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.',
        "Released under the GNU General Public License.",
        "Distributed under the GNU General Public License, version 2 or version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Licensed under the GNU General Public License, see COPYING.",
        "Licensed under the GPL.",
    ],
    "LGPL": [
        'You should have received a copy of the GNU Lesser General Public License along with this library.',
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "Released under the LGPL.",
    ],
    "AGPL": [
        'it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version',
        "Licensed under the GNU Affero General Public License, version 3.",
        "Distributed under the terms of the GNU Affero General Public License.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "Released under the AGPL.",
    ],
    "BSD": [
        'Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.',
        'Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.',
        'Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.',
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED",
        "Released under the BSD License.",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "MPL": [
        'If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.',
        "Licensed under the Mozilla Public License, version 2.0.",
        "Distributed under the Mozilla Public License.",
        "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
    "ISC": [
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE",
        'provided that the above copyright notice and this permission notice appear in all copies',
        "Licensed under the ISC License.", "Released under the ISC License.", "SPDX-License-Identifier: ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    ],
    "CC-BY": [
        'You must give appropriate credit, provide a link to the license, and indicate if changes were made, under the Creative Commons Attribution License.',
        "Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "CC-BY-SA": [
        'If you remix, transform, or build upon the material, you must distribute your contributions under the same Creative Commons Attribution-ShareAlike license.',
        "Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "CC-BY-NC": [
        'You may not use the material for commercial purposes under the Creative Commons Attribution-NonCommercial license.',
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "CC0": [
        'The person who associated a work with this deed has dedicated the work to the public domain by waiving all of their rights under CC0.',
        "Released under CC0.", "To the extent possible under law, the author has waived all copyright and related rights to this work.", "SPDX-License-Identifier: CC0-1.0",
    ],
    "Unlicense": [
        'Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.',
        'For more information, please refer to http://unlicense.org',
        "This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense", "Released under the Unlicense.",
    ],
}
# What families are called where they are named in a sentence, the short name first.
NAMES = {
    "MIT": ["MIT", "the MIT License", "an MIT-style license", "the terms of the MIT license", "the Expat license"],
    "Apache": ["Apache", "the Apache License", "Apache License, Version 2.0", "the Apache Software License", "Apache-2.0"],
    "GPL": ["GPL", "the GNU GPL", "the GNU General Public License", "GPLv3 or later", "the General Public License of GNU"],
    "LGPL": ["LGPL", "the GNU LGPL", "the GNU Lesser General Public License", "LGPLv3", "the Lesser GPL"],
    "AGPL": ["AGPL", "the GNU AGPL", "the GNU Affero General Public License", "AGPLv3", "the Affero GPL"],
    "BSD": ["BSD", "the BSD License", "the 3-clause BSD license", "a BSD-style license", "the simplified BSD license"],
    "MPL": ["MPL", "the Mozilla Public License", "MPL 2.0", "the MPL", "Mozilla Public License 2.0"],
    "ISC": ["ISC", "the ISC License", "ISC license", "the terms of the ISC license"],
    "CC-BY": ["CC BY", "CC BY 4.0", "a Creative Commons Attribution license", "the Creative Commons Attribution 4.0 license"],
    "CC-BY-SA": ["CC BY-SA", "CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike license", "the Creative Commons Attribution-ShareAlike 3.0 license"],
    "CC-BY-NC": ["CC BY-NC", "CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial license", "the Creative Commons NonCommercial license"],
    "CC0": ["CC0", "CC0 1.0 Universal", "the CC0 public domain dedication", "Creative Commons Zero"],
    "Unlicense": ["Unlicense", "the Unlicense", "the terms of the Unlicense"],
}
# What else stands where a licence could be named: terms that are no public licence.
OTHER_TERMS = [
    "a proprietary license", "a commercial license", "the license agreement of the vendor", "our terms of service", "an end user license agreement", "a license that has to be bought", "the contract with the customer",
    "all rights reserved", "a site license", "an evaluation license", "the company's own license", "a closed license", "no license", "the rules of the house", "a paid subscription", "the museum's usage terms",
]
# Sentences that name a licence, or anything else; in the second list by its short name.
FRAMES = [
    "Licensed under {}.", "This project is licensed under {}.", "Released under {}.", "This repository uses {}.", "The code is available under {}.", "{}: see the LICENSE file for details.", "Distributed under {}. See LICENSE for more information.",
    "Copyright (c) the authors. {}.", "License: {}", "You may use this software under {}.", "Except where noted, content on this site is licensed under {}.", "{} applies to all files in this directory.", "Published under {} by its contributors.",
    "All source files are covered by {}.", "Contributions are accepted under {}.", "We chose {} for this package.", "Dedicated to the public under {}.", "All content is licensed under {} and may not be used otherwise.",
]
SHORT_FRAMES = ["{} licensed.", "{} licensed. See the file COPYING.", "This is {}-licensed code.", "The package is {}-licensed.", "{} license", "It is open source ({})."]
# Notices in wordings that serve as templates but that the regression never learns from.
HELD_OUT = {
    "MIT": ["Released under the MIT License.", "The code is available under the MIT license."],
    "Apache": ["Licensed under the Apache License, Version 2.0.", "This project is released under the Apache 2.0 license."],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.", "This software is distributed under the GNU GPL."],
    "LGPL": ["This work is licensed under the GNU Lesser General Public License."],
    "AGPL": ["Released under the GNU Affero General Public License."],
    "BSD": ["This work is licensed under the BSD License."],
    "MPL": ["Released under the Mozilla Public License."],
    "ISC": ["This work is licensed under the ISC License."],
    "CC-BY": ["Released under CC BY 4.0."],
    "CC-BY-SA": ["Released under CC BY-SA 4.0."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "Released under CC BY-NC 4.0."],
    "CC0": ["Licensed under CC0."],
    "Unlicense": ["Licensed under the Unlicense."],
}
# Sentences that use the same words and grant nothing.
ORDINARY = [
    "The driver showed a license at the border and was released.",
    "Permission to enter the building is granted by the general office.",
    "This work is the first of its kind and the public was free to visit.",
    "A new version of the source was published by the foundation.",
    "You may use the terms in any form you like.",
    "The library is under the hall, next to the Apache trail.",
    "He was licensed as a pilot under the old law.",
    "Released in spring, the film was a creative success.",
    "Software and documentation were distributed at the fair.",
    "All rights and conditions were discussed with the author.",
    "His driving license was renewed last week.",
    "The shop sells licensed toys under its own name.",
    "A license fee is due for each version of the game.",
    "The bar lost its license under the new public order act.",
    "Copyright law is taught in the second year.",
    "The general asked for permission to use the public road.",
    "An MIT professor described the project in public.",
    "Apache riders crossed the border under arms.",
    "The license plate was found in the public garden.",
    "They study software license terms at the university.",
    "All rights reserved. No part of this work may be reproduced in any form.",
    "This software is confidential and proprietary; unauthorized copying of this file is prohibited.",
    "You may not copy, modify, distribute or sell any part of this program without written permission of the company.",
    "Use of this product requires a valid license key from the vendor.",
    "The license of this product ends when the subscription ends.",
    "This document is the property of the company and may not be released to the public.",
    "Copyright (c) 2020 by the publisher. All rights reserved.",
    "The software is licensed, not sold, and may be installed on one computer only.",
]
# Such sentences that the regression never learns from.
ORDINARY_HELD_OUT = [
    "She got her pilot license in the spring.",
    "The license of the restaurant was checked by the city.",
    "Students at MIT released a film about the sea.",
    "The permission slip was signed by both parents.",
    "A public notice was placed under the bridge.",
    "The minister released a general statement under pressure.",
    "Copyright disputes fill the courts every year.",
    "The Apache helicopter landed on the public square.",
    "The creative commons room is on the first floor.",
    "Fishing without a license is forbidden in this lake.",
]


def grams(paragraph: Column) -> Column:
    """Distinct lower-case words (letters a-z) and pairs of neighbouring words."""
    words = F.filter(F.split(F.lower(paragraph), "[^a-z]+"), lambda w: w != "")

    def with_pairs(ws: Column) -> Column:
        fewer = F.greatest(F.size(ws) - 1, F.lit(0))
        return F.array_distinct(F.concat(ws, F.zip_with(F.slice(ws, 1, fewer), F.slice(ws, 2, fewer), lambda a, b: F.concat(a, F.lit(" "), b))))

    return F.transform(F.array(words), with_pairs)[0]  # the array of one binds the words, so they are split once


def _local_grams(text: str) -> list[str]:
    import re

    words = re.findall("[a-z]+", text.lower())
    return list(dict.fromkeys([*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]))


@dataclass(frozen=True)
class LicenceModel:
    """Weights by gram, in the order of families; families[0] is "unknown". slope and shift calibrate the margin of each family but that.

    anchors: words of which every text with a gram that raises some family holds one.
    """

    families: tuple[str, ...]
    weights: dict[str, tuple[float, ...]]
    bias: tuple[float, ...]
    slope: tuple[float, ...]
    shift: tuple[float, ...]
    anchors: tuple[str, ...]


def wordings() -> list[tuple[str, str]]:
    """(family, text): every name and every other term in sentences of all kinds."""
    rows = []
    for family, names in {**NAMES, UNKNOWN: OTHER_TERMS}.items():
        short = names[:1] if family in NAMES else ["proprietary", "commercial", "closed"]
        rows += [(family, f.format(n)) for n in names for f in FRAMES] + [(family, f.format(n)) for n in short for f in SHORT_FRAMES]
    return rows


def _examples(spark: SparkSession, families: list[str]) -> DataFrame:
    """label, text, part (0 trains, 1 calibrates): notices whole, without each of their words, and within a sentence; names in sentences."""
    rows = []
    for label, family in enumerate(families):
        for text in NOTICES.get(family, ORDINARY):
            words = text.split()
            rows += [(label, text), (label, f"{text} {text}"), *((label, f"{ORDINARY[i % 20]} {text}") for i in range(4))]
            rows += [(label, " ".join(words[:i] + words[i + 1 :])) for i in range(len(words))] if len(words) > 6 else [(label, text)] * 4
    rows += [(families.index(f), text) for f, text in wordings()]
    return spark.createDataFrame([(a, b, i % 3 // 2) for i, (a, b) in enumerate(rows)], "label int, text string, part int")


def calibrated(margins: list[tuple[int, int, float]], families: int, ridge: float = 1e-2) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """(slopes, shifts) of each family's probability of being right, by logistic regression on margins (label, predicted family, margin).

    A family's rows are those it is predicted for and, for every family, all of the unknown.
    """
    import numpy as np

    label, best, margin = (np.array(x) for x in zip(*margins, strict=True))
    slopes, shifts = [], []
    for f in range(1, families):
        some = (best == f) | (label == 0)
        x, y = np.stack([margin[some], np.ones(some.sum())], axis=1), (label[some] == f).astype(float)
        weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)  # both sides count alike
        w = np.array([1.0, 0.0])
        for _ in range(50):  # Newton's steps
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * len(y) * np.eye(2), x.T @ (weight * (p - y)) + ridge * len(y) * w)
            w = w - step
            if abs(step).max() < 1e-9:
                break
        slopes.append(float(w[0]))
        shifts.append(float(w[1]))
    return tuple(slopes), tuple(shifts)


def sample_paragraphs(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """text: paragraphs that don't read like a grant, of the `documents` documents first in the order of their ids' hashes."""
    ids = [r[0] for r in docs.select("doc_id").filter("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents).collect()]
    rows = docs.filter(F.col("doc_id").isin(ids)) if ids else docs.limit(0)
    paragraphs = rows.select(F.explode(F.split("text", "\n")).alias("text"))
    return paragraphs.filter(~F.lower("text").rlike(GRANT))


def fit(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS) -> LicenceModel:
    """Train and calibrate. Only the bounded sample is read; the fitted weights are as many as the notices' grams."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel

    spark, families = docs.sparkSession, [UNKNOWN, *NOTICES]
    known = [t for texts in NOTICES.values() for t in texts] + [t for f, t in wordings() if f != UNKNOWN]
    vocabulary = sorted({g for t in known for g in _local_grams(t)})
    plain = sample_paragraphs(docs, documents).select(F.lit(0).alias("label"), "text", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("part"))
    rows = _examples(spark, families).withColumn("sampled", F.lit(False)).unionByName(plain.withColumn("sampled", F.lit(True)))
    rows = written(rows.withColumn("grams", grams(F.col("text"))).coalesce(4), "licences")
    # Bounded by the notices' grams: how many of the sample's paragraphs hold each.
    held = dict(rows.filter("sampled").select(F.explode("grams").alias("g")).filter(F.col("g").isin(vocabulary)).groupBy("g").count().collect())
    most = COMMON * rows.filter("sampled").count()
    rare = {w for g in vocabulary for w in g.split() if held.get(w, 0) <= most}
    vocabulary = [g for g in vocabulary if rare & {*g.split()}]
    counter = CountVectorizerModel.from_vocabulary(vocabulary, "grams", "features")
    counter.setBinary(True)
    rows = counter.transform(rows).select("label", "features", "part")
    model = LogisticRegression(family="multinomial", regParam=2e-4, elasticNetParam=1.0, maxIter=40, standardization=False).fit(rows.filter("part = 0"))
    matrix, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    weights = {g: tuple(float(x) for x in matrix[:, i]) for i, g in enumerate(vocabulary) if abs(matrix[:, i]).max() > 0}

    from pyspark.ml.functions import vector_to_array

    raw = model.transform(rows.filter("part = 1")).select("label", vector_to_array("rawPrediction").alias("z"))
    others = F.slice("z", 2, len(families))
    # As many rows as the bounded sample and the wordings have.
    margins = raw.select("label", F.array_position(others, F.array_max(others)).cast("int").alias("best"), (F.array_max(others) - F.col("z")[0]).alias("margin")).collect()
    slope, shift = calibrated([tuple(r) for r in margins], len(families))
    raising = [g for g, w in weights.items() if max(w[1:]) > w[0]]
    anchors = {min(g.split(), key=lambda w: (held.get(w, 0), w)) for g in raising}
    return LicenceModel(tuple(families), weights, tuple(float(b) for b in bias), slope, shift, tuple(sorted(anchors)))


def _sql(value) -> str:
    """A literal of strings (letters, spaces and hyphens), numbers, lists and dicts as SQL, so that it is parsed once."""
    if isinstance(value, dict):
        return "map(" + ", ".join(f"{_sql(k)}, {_sql(v)}" for k, v in value.items()) + ")"
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(map(_sql, value)) + ")"
    return f"'{value}'" if isinstance(value, str) else f"CAST('{value!r}' AS DOUBLE)"


def scan(docs: DataFrame, model: LicenceModel, confirm: float = CONFIRM) -> DataFrame:
    r"""doc_id, paragraph, family, probability, similarity, confirmed: a row per paragraph in which a licence is predicted.

    Paragraphs are cut at \n and numbered from 0. probability is the calibrated
    one of being any licence, at least 0.5; similarity is the largest share of
    a template's word pairs (words, for one-word templates) found there; a row
    that is not confirmed is a prediction only. A null
    text has no paragraphs; repeated rows give repeated results; a null doc_id
    is kept; other columns are left out; an empty table gives no rows. No
    shuffle. Paragraphs are skipped unscored only if none of their grams raises
    any family, which leaves the margin below that of an empty paragraph.
    """
    n = len(model.families)
    idle = max(a * (max(model.bias[1:]) - model.bias[0]) + b for a, b in zip(model.slope, model.shift, strict=True))
    rows = id_and_text(docs).select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "body"))
    if idle < 0 and min(model.slope) > 0:
        rows = rows.filter(F.arrays_overlap(F.split(F.lower("body"), "[^a-z]+"), F.expr(_sql(model.anchors))))
    rows = rows.select("doc_id", "paragraph", grams(F.col("body")).alias("grams"))
    table = F.expr(_sql(model.weights))
    known = F.array_intersect("grams", F.expr(_sql(list(model.weights))))
    scores = F.aggregate(known, F.expr(_sql(model.bias)), lambda acc, g: F.zip_with(acc, F.element_at(table, g), lambda a, b: a + b))
    rows = rows.withColumn("scores", scores).withColumn("best", F.array_max(F.slice("scores", 2, n - 1)))
    margin = F.col("best") - F.col("scores")[0]
    rows = rows.withColumn("number", F.array_position(F.slice("scores", 2, n - 1), F.col("best")).cast("int"))
    slope, shift = (F.element_at(F.expr(_sql(list(x))), F.col("number")) for x in (model.slope, model.shift))
    rows = rows.withColumn("probability", 1 / (1 + F.exp(-(margin * slope + shift)))).filter("probability >= 0.5")
    rows = rows.withColumn("family", F.element_at(F.expr(_sql(model.families)), F.col("number") + 1))
    pairs = {f: [[g for g in _local_grams(t) if " " in g] or _local_grams(t) for t in [*texts, *HELD_OUT.get(f, []), *NAMES[f][1:]]] for f, texts in NOTICES.items()}
    templates = F.expr(_sql(pairs))
    share = F.transform(F.element_at(templates, F.col("family")), lambda t: F.size(F.array_intersect(t, F.col("grams"))) / F.size(t))
    rows = rows.withColumn("similarity", F.array_max(share))
    return rows.select("doc_id", F.col("paragraph").cast("long").alias("paragraph"), "family", "probability", "similarity", (F.col("similarity") >= confirm).alias("confirmed"))


def licences(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """fit and scan in one; nulls, repeated rows, empty tables and other columns as in both."""
    return scan(docs, fit(docs, documents))
