"""Licence scans by a trained paragraph classifier.

A paragraph ends at a blank line, or at a line break after the end of a sentence; lines that a wrapped sentence runs over are one
paragraph, and comment marks at their beginnings are no part of it. A sparse multinomial logistic regression over words and pairs of
words says how likely a paragraph is a notice of each licence family, of a licence outside the list (unknown), or no notice at all
(none). A temperature, fitted on wordings and licences that the training didn't see, calibrates it. A prediction is confirmed by
comparison with the family's templates: enough of a template's word pairs must occur in the paragraph.

The regression is trained here, on the driver, from the fixed wordings below; its weights are a small table of fixed size. Over the
rows only DataFrame functions run. A paragraph is classified if it holds any word of a gram whose weight speaks for a notice; without
one, `none` has the largest sum by the weights themselves, whatever else the paragraph says, so nothing is left out by this. Distinct
paragraphs are classified once, by hash, and joined back: a notice that a third of all files carry is one row until then.

Paragraphs that are `none` give no row. Null and empty texts have no paragraphs. Repeated rows repeat their findings. Empty tables have
none. Texts of any length are read whole. Other columns aren't read, whatever their names.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gustframe.llm.shared import written

#: What the licences of each family are called, in words and as SPDX identifiers.
NAMES: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "MIT": (("MIT License", "MIT licence", "MIT/X11 License", "MIT"), ("MIT",)),
    "Apache-2.0": (("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache Software License"), ("Apache-2.0",)),
    "GPL": (
        ("GNU General Public License", "GNU General Public License, version 3", "GNU GPL", "GPL", "GPLv3", "GPLv2", "GPL v2", "GPL v3", "GPL-2.0", "GPL-3.0"),
        ("GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later"),
    ),
    "LGPL": (
        ("GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1", "GNU Library General Public License", "GNU LGPL", "LGPL", "LGPLv3", "LGPL-2.1", "LGPL v3"),
        ("LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-or-later"),
    ),
    "AGPL": (("GNU Affero General Public License", "GNU Affero General Public License, version 3", "GNU AGPL", "AGPL", "AGPLv3", "AGPL-3.0"), ("AGPL-3.0-only", "AGPL-3.0-or-later")),
    "BSD": (("BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "New BSD License", "BSD-style license", "BSD"), ("BSD-2-Clause", "BSD-3-Clause")),
    "MPL": (("Mozilla Public License", "Mozilla Public License, v. 2.0", "Mozilla Public License 2.0", "MPL", "MPL 2.0"), ("MPL-2.0", "MPL-1.1")),
    "CC-BY": (("CC BY 4.0", "CC BY 3.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License"), ("CC-BY-4.0", "CC-BY-3.0")),
    "CC-BY-SA": (("CC BY-SA 4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike License"), ("CC-BY-SA-4.0", "CC-BY-SA-3.0")),
    "CC-BY-NC": (("CC BY-NC 4.0", "CC BY-NC 3.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial License"), ("CC-BY-NC-4.0", "CC-BY-NC-3.0")),
    "CC0": (("CC0 1.0 Universal", "CC0", "CC0 public domain dedication", "Creative Commons Zero", "Unlicense"), ("CC0-1.0", "Unlicense")),
    "Proprietary": ((), ()),
}
#: Usual sentences of notices.
NOTICES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Licensed under MIT.",
        "Released under MIT.",
        "SPDX-License-Identifier: MIT",
        "license: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "GPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify",
        "it under the terms of the GNU General Public License as published by",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    "LGPL": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation",
    ),
    "AGPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "See the GNU Affero General Public License for more details.",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "MPL": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "CC-BY": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/"),
    "CC-BY-SA": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/"),
    "CC-BY-NC": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/"),
    "CC0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "This work is dedicated to the public domain under CC0.",
    ),
    "Proprietary": (
        "All rights reserved.",
        "Copyright. All rights reserved.",
        "Copyright 2020 Example Corporation. All rights reserved.",
        "No license is granted to copy, modify or distribute this software without written permission.",
        "Proprietary and confidential.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited.",
        "This software is the confidential and proprietary information of the company.",
    ),
}
#: Ways to name a licence; {} stands for its name or identifier.
FRAMES = ("{}", "Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "This project is distributed under the terms of the {}.", "This work is licensed under the {}.", "under the terms of the {} as published by", "{}, see the LICENSE file for details.", "The code is available under the {} license.", "This work is published under {}.")
TAGS = ("SPDX-License-Identifier: {}", "license: {}")
#: Names of licences outside the families.
OTHERS = ("European Union Public Licence", "EUPL v1.2", "Artistic License 2.0", "zlib License", "Eclipse Public License 2.0", "CDDL 1.1", "Elastic License 2.0", "Server Side Public License", "Boost Software License 1.0", "SIL Open Font License 1.1", "Microsoft Public License", "ISC License", "WTFPL", "Foo License", "Bar Public License 3.0", "Qux Source License", "Acme Community Licence", "ODbL")
OTHER_NOTICES = (
    "This software is provided 'as-is', without any express or implied warranty.",
    "In no event will the authors be held liable for any damages arising from the use of this software.",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "You may not provide the software to third parties as a hosted or managed service.",
)
#: Wordings and licences that only the calibration sees.
HELD_FRAMES = ("The software is made available under the {}.", "You may use this file under the {}.", "Published under {} terms.", "Distributed under the {}; see COPYING.", "It is free to use under the {}.")
HELD_OTHERS = ("Academic Free License 3.0", "Common Public License 1.0", "PostgreSQL License", "Business Source License 1.1", "Open Software License", "Educational Community License 2.0")
#: Text that may speak of such things without being a notice.
PROSE = (
    "The driver lost his license after the accident and had to take the bus.",
    "Copyright law is often debated by authors and publishers.",
    "A fishing license can be bought at the harbour for a small fee.",
    "Which license should we choose for the project? Opinions differ.",
    "The license plate was covered in mud.",
    "Licensed professionals must renew their license every two years.",
    "The software was released in May and the version 2.0 followed in June.",
    "This program is under review and the terms are not public.",
    "General public opinion of the foundation has improved.",
    "The committee granted permission to any person with a ticket.",
    "He holds a license to trade and the copyright of two songs.",
    "Attribution of the painting to the master is disputed, and copyright has long expired.",
    "An open source license has a few conditions, say the lawyers.",
    "They work in a library and use the file to see more details of the code.",
    "The public may see the work free of charge in the general store.",
    "You can use this program to copy a file, modify it and publish it later.",
    "The source of the river is available on any map, distributed by the foundation.",
    "We received a copy of the program along with the software and the documentation.",
    "The community project was published under a new name with an original version of the terms.",
    "The apache helicopter landed, and students of MIT went home to creative work in common rooms.",
    "A clause in the contract says that the rights of the owner are limited by law.",
    "My neighbour asked whether a boat license covers lakes.",
    "Er kommt mit dem Rad, und sie reist mit der Bahn.",
    "Mit Software und mit Copyright hat das nichts zu tun.",
    "Das Programm mit der Lizenz liegt im Archiv mit den Akten.",
)
#: Words that say nothing about licences; a gram needs another one.
STOP = frozenset("a all an and any are as at be by can for from has have he i if in is it its more no not of on one or other our see so that the their they this to under was we were which will with you your 0 1 2 3 4 5".split())
#: Names that are common words of other languages; alone they say nothing, beside another word they do.
AMBIGUOUS = frozenset(["mit"])
FAMILIES = (*NAMES, "unknown", "none")
#: Least probability of a family, and least share of a template's word pairs.
LEAST_PROBABILITY, LEAST_SIMILARITY = 0.5, 0.6
#: Where a text is cut (only behind a line break is the rest tried): after a line break that follows the end of a sentence or an empty (or only commented) line.
CUT = r"(?<=\n)(?:(?<=[.!?:][ \t\r]{0,8}\n)|(?<=\n[ \t]{0,8}(?:/{0,2}\*{1,2}|//|#|--|;)?[ \t\r]{0,8}\n))"
#: Comment marks at the beginning of a line.
MARKS = r"(?m)^[ \t]*(?:/\*+|\*+/?|//+|#+|--+|;+|<!--)[ \t]*"


def _words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def grams_of(text: str) -> list[str]:
    """Distinct words and pairs of words, without those of STOP words alone."""
    words = _words(text)
    return sorted({g for g in [*words, *map(" ".join, zip(words, words[1:], strict=False))] if g not in AMBIGUOUS and not STOP.issuperset(g.split())})


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def grams(own: Column) -> Column:
    """Distinct words and pairs of an array of words. Those of STOP words alone have no weight, so they needn't go."""
    n = F.greatest(F.size(own) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(own, F.lit(1), n), F.slice(own, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(own, pairs))


def _templates() -> dict[str, list[str]]:
    """What confirms a family: its names, their identifiers and its sentences."""
    return {f: [*NAMES[f][0], *NAMES[f][1], *NOTICES[f]] for f in NAMES}


def _examples(frames: tuple[str, ...], others: tuple[str, ...]) -> list[tuple[str, str]]:
    """(text, class) of every name in every frame."""
    out = []
    for family, (names, tags) in NAMES.items():
        out += [(f.format(n), family) for n in names for f in frames] + [(f.format(n), family) for n in tags for f in TAGS]
    out += [(f.format(n), "unknown") for n in others for f in (*frames, *TAGS)]
    return [(t, f) for t, f in out if grams_of(t)]


@lru_cache(1)
def trained() -> tuple[dict[str, list[float]], list[float]]:
    """(weights by gram, bias), of one value a class, divided by the fitted temperature."""
    whole = [(t, f) for f, own in NOTICES.items() for t in own] + [(t, "unknown") for t in OTHER_NOTICES]
    rows = _examples(FRAMES, OTHERS) + whole * 4 + [(t, "none") for t in PROSE] * 8
    # No gram at all is no notice; a notice may stand among prose.
    rows += [("", "none")] * 40 + [(f"{p} {t}", f) for p in PROSE[::5] for t, f in whole]
    held = _examples(HELD_FRAMES, HELD_OTHERS) + [(f"{t} {p}", f) for p in PROSE[2::7] for t, f in whole] + [(f"{a} {b}", "none") for a in PROSE[::4] for b in PROSE[1::4]]
    place = {g: i for i, g in enumerate(sorted({g for t, _ in rows for g in grams_of(t)}))}

    def matrix(given: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(given), len(place)), np.float32)
        for r, (t, _) in enumerate(given):
            x[r, [place[g] for g in grams_of(t) if g in place]] = 1
        return x, np.eye(len(FAMILIES), dtype=np.float32)[[FAMILIES.index(f) for _, f in given]]

    def softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    x, y = matrix(rows)
    each = 1 / np.sqrt(y.sum(0))[y.argmax(1)]
    each = (each / each.sum())[:, None].astype(np.float32)
    w, b = np.zeros((len(place), len(FAMILIES)), np.float32), np.zeros(len(FAMILIES), np.float32)
    for _ in range(400):
        g = (softmax(x @ w + b) - y) * each
        w -= 3.0 * (x.T @ g)
        w = np.sign(w) * np.maximum(np.abs(w) - 3e-4, 0)  # sparse
        b -= 0.5 * g.sum(0)
    hx, hy = matrix(held)
    z = (hx @ w + b).astype(np.float64)
    temperature = min(np.linspace(0.3, 3, 55), key=lambda t: -np.log((softmax(z / t) * hy).sum(1) + 1e-12).mean())
    return {g: (w[i].astype(np.float64) / temperature).tolist() for g, i in place.items() if w[i].any()}, (b.astype(np.float64) / temperature).tolist()


@lru_cache(1)
def telling_words() -> list[str]:
    """The words of all grams that speak for some class more than for none. A text without any of them is `none`: all it has in
    common with the weights speaks for none, and so does the bias."""
    weights, bias = trained()
    if max(bias[:-1]) >= bias[-1]:
        raise AssertionError("an empty paragraph has to be none")
    return sorted({w for g, own in weights.items() if max(own[:-1]) > own[-1] for w in g.split() if w not in STOP})


def _one_of(given: list[str]) -> str:
    """A pattern of the words with common beginnings written once, so that a place in a text is tried once for each letter."""
    heads: dict[str, list[str]] = {}
    for w in given:
        heads.setdefault(w[:1], []).append(w[1:])
    parts = []
    for c in sorted(heads):
        rest = heads[c]
        parts.append("" if not c else c + (_one_of(rest) if len(rest) > 1 else rest[0]))
    return parts[0] if len(parts) == 1 else "(?:" + "|".join(sorted(parts, reverse=True)) + ")"


@lru_cache(1)
def telling_pattern() -> str:
    """Whether a lower-case text has a telling word."""
    return f"(?<![a-z0-9]){_one_of(telling_words())}(?![a-z0-9])"


def _tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Fixed and small: (gram, weights); (gram, family, template, size) of the templates' word pairs, or of their only words."""
    weights, _ = trained()
    pairs = []
    for family, texts in _templates().items():
        for n, t in enumerate(texts):
            own = _words(t)
            own = sorted(set(map(" ".join, zip(own, own[1:], strict=False))) or set(own) - AMBIGUOUS)
            pairs += [(g, family, n, len(own)) for g in own]
    return (
        spark.createDataFrame(list(weights.items()), "gram string, weights array<double>"),
        spark.createDataFrame(pairs, "gram string, family string, template int, size int"),
    )


def classify(paragraphs: DataFrame, text: str = "paragraph", key: str = "key") -> DataFrame:
    """(key, family, probability, similarity, confirmed) for paragraphs whose keys are distinct; family unknown where none of the list is likely enough."""
    weights, templates = _tables(paragraphs.sparkSession)
    _, bias = trained()
    exploded = paragraphs.select(key, F.explode(grams(words(F.col(text)))).alias("gram"))
    sums = exploded.join(F.broadcast(weights), "gram").groupBy(key).agg(*[F.sum(F.col("weights")[k]).alias(f"z{k}") for k in range(len(FAMILIES))])
    z = [F.coalesce(F.col(f"z{k}"), F.lit(0.0)) + bias[k] for k in range(len(FAMILIES))]
    scored = paragraphs.select(key).join(sums, key, "left").select(key, F.array(*z).alias("z")).withColumn("top", F.array_max("z"))
    scored = scored.withColumn("e", F.transform("z", lambda v: F.exp(v - F.col("top")))).withColumn("sum", F.aggregate("e", F.lit(0.0), lambda a, v: a + v))
    best = scored.select(key, F.element_at(F.array(*[F.lit(f) for f in FAMILIES]), F.array_position("z", F.col("top")).cast("int")).alias("likely"), (1 / F.col("sum")).alias("probability"))
    compared = exploded.join(F.broadcast(templates), "gram").groupBy(key, "family", "template").agg((F.count(F.lit(1)) / F.first("size")).alias("share"))
    compared = compared.groupBy(key, "family").agg(F.max("share").alias("similarity")).withColumnRenamed("family", "likely")
    out = best.join(compared, [key, "likely"], "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    sure = (F.col("probability") >= LEAST_PROBABILITY) & ~F.col("likely").isin("unknown", "none")
    family = F.when(sure | (F.col("likely") == "none"), F.col("likely")).otherwise("unknown")
    return out.select(key, family.alias("family"), "probability", "similarity", (sure & (F.col("similarity") >= LEAST_SIMILARITY)).alias("confirmed"))


def paragraphs(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, no, start, end, paragraph, key) of all paragraphs with a telling word; positions in code points, without the white space around."""
    told = F.lit(telling_pattern())
    source = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")).filter(F.rlike(F.lower("t"), told))
    cut = source.select("doc_id", F.split("t", CUT, -1).alias("parts")).withColumn("sizes", F.transform("parts", F.length))
    # Sums of 256 sizes each, so that the place of a paragraph takes few additions in the longest text.
    cut = cut.withColumn("sums", F.transform(F.sequence(F.lit(0), F.expr("size(sizes) div 256")), lambda b: F.aggregate(F.slice("sizes", b * 256 + 1, 256), F.lit(0), lambda a, v: a + v)))
    each = cut.select("doc_id", "sizes", "sums", F.posexplode("parts").alias("no", "part")).filter(F.rlike(F.lower("part"), told))
    whole = F.aggregate(F.slice("sums", F.lit(1), F.expr("no div 256")), F.lit(0), lambda a, v: a + v)
    rest = F.aggregate(F.slice("sizes", F.expr("no div 256 * 256 + 1"), F.expr("no % 256")), F.lit(0), lambda a, v: a + v)
    # Only ASCII white space goes, which trimming and length agree on.
    blank = F.length(F.regexp_extract("part", r"^[ \t\r\n]*", 0))
    body = F.regexp_replace("part", r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    each = each.select("doc_id", "no", (whole + rest + blank).cast("long").alias("start"), body.alias("body"))
    plain = F.regexp_replace(F.regexp_replace("body", MARKS, ""), r"\s+", " ")
    each = each.select("doc_id", "no", "start", (F.col("start") + F.length("body")).alias("end"), plain.alias("paragraph"))
    return each.withColumn("key", F.sha2(F.col("paragraph").cast("binary"), 256))


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each paragraph that is a notice: doc_id, paragraph_no, start and end (code points), family, probability, similarity, confirmed."""
    found = written(paragraphs(df, doc_id, text), "paragraphs")
    classes = written(classify(found.groupBy("key").agg(F.first("paragraph").alias("paragraph"))).filter("family <> 'none'"), "classes")
    # Both sides are read from files, so that Spark can split a notice that many files carry.
    return found.drop("paragraph").join(classes, "key").select(F.col("doc_id").alias(doc_id), F.col("no").alias("paragraph_no"), "start", "end", "family", "probability", "similarity", "confirmed")
