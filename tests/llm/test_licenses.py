"""Licence scans: notices, wrapped headers, other licences, prose that isn't one, and odd rows; all against plain Python."""

from __future__ import annotations

import re

import numpy as np
import pytest

from gustframe.llm import license_scan as scan
from tests.llm.helpers import ODD, documents

HEADERS = {
    "GPL": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
    "LGPL": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.",
    "MPL": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0.",
    "BSD": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.',
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining\na copy of this software and associated documentation files",
}
OTHER = ["Licensed under the EUPL, Version 1.2.", "Distributed under the Artistic License 2.0.", "This code is under the zlib license.", "Licensed under the Elastic License 2.0.", "Licensed under the Sleepycat License."]
ONE_LINE = {
    "it under the terms of the GNU General Public License as published by": "GPL",
    "Licensed under the GPL-3.0 license": "GPL",
    "Available under CC BY 4.0.": "CC-BY",
    "This work is published under CC BY-SA 4.0.": "CC-BY-SA",
    "Distributed under the GPL v2 or later.": "GPL",
    "This is free and unencumbered software released into the public domain.": "CC0",
    "SPDX-License-Identifier: MIT": "MIT",
    "Licensed under MIT.": "MIT",
    "All rights reserved.": "Proprietary",
}


def _slowly(text):
    """(class, probability) of a paragraph, by the weights."""
    weights, bias = scan.trained()
    z = np.array(bias) + sum((np.array(weights[g]) for g in scan.grams_of(text) if g in weights), np.zeros(len(bias)))
    e = np.exp(z - z.max())
    return scan.FAMILIES[int(e.argmax())], e.max() / e.sum()


@pytest.mark.parametrize("mark", ["", "// ", "# ", " * "])
def test_wrapped_headers_get_their_family(spark, mark):
    texts = [f"int main;\n{mark}Some prose first.\n" + "\n".join(mark + x for x in t.split("\n")) + "\n\nMore code." for t in HEADERS.values()]
    got = {r["doc_id"]: r for r in scan.scan(documents(spark, texts)).filter("confirmed").collect()}
    assert [got[i]["family"] for i in range(len(texts))] == list(HEADERS)
    for i, t in enumerate(HEADERS.values()):
        inside = texts[i][got[i]["start"] : got[i]["end"]]
        assert re.sub(r"(?m)^[/#* ]+", "", inside) == t


def test_single_lines_other_licences_and_prose(spark):
    texts = [f"Prose before é😀.\n{t}\n" for t in [*ONE_LINE, *OTHER, *scan.PROSE]]
    rows = scan.scan(documents(spark, texts)).collect()
    confirmed = {r["doc_id"]: r["family"] for r in rows if r["confirmed"]}
    assert confirmed == dict(enumerate(ONE_LINE.values()))
    assert {r["family"] for r in rows if len(ONE_LINE) <= r["doc_id"] < len(ONE_LINE) + len(OTHER)} == {"unknown"}
    assert not [r for r in rows if r["doc_id"] >= len(ONE_LINE) + len(OTHER)]
    for r in rows:
        assert texts[r["doc_id"]][r["start"] : r["end"]] == texts[r["doc_id"]].split("\n")[1]


def test_names_that_are_words_of_other_languages(spark):
    texts = ["Wir fahren mit dem Zug mit vielen anderen und mit Freude.", "mit", "MIT", "Mit dem Programm der public library."]
    assert scan.scan(documents(spark, texts)).count() == 0


def test_classes_and_probabilities_like_numpy_whatever_was_left_out(spark):
    """Every paragraph, also those without a telling word, has the class that all weights give it."""
    plain = [*ONE_LINE, *OTHER, *scan.PROSE, "Nothing here.", "The quick brown fox.", "any of these work"]
    got = {r["doc_id"]: r for r in scan.scan(documents(spark, plain)).collect()}
    for i, t in enumerate(plain):
        family, probability = _slowly(t)
        assert (i in got) == (family != "none")
        if i in got:
            assert abs(got[i]["probability"] - probability) < 1e-6
            assert got[i]["family"] == (family if probability >= scan.LEAST_PROBABILITY else "unknown")


def test_calibration_on_wordings_that_training_did_not_see():
    held = scan._examples(scan.HELD_FRAMES, scan.HELD_OTHERS)
    said = [(_slowly(t), f) for t, f in held]
    right = np.array([a == f for (a, _), f in said])
    sure = np.array([p for (_, p), _ in said])
    assert right.mean() > 0.9 and abs(right.mean() - sure.mean()) < 0.1


def test_odd_rows_and_names(spark):
    assert scan.scan(documents(spark, ODD)).count() == 0
    same = documents(spark, ["SPDX-License-Identifier: MIT"] * 3).selectExpr("*", "1 as no", "2 as paragraph", "3 as family", "4 as t", "5 as key")
    assert [r["family"] for r in scan.scan(same).collect()] == ["MIT"] * 3
    assert scan.scan(documents(spark, ["a"]).limit(0)).count() == 0


def test_a_long_text(spark):
    line = "Ordinary text without any of it.\n"
    text = line * 3000 + "Released under the MIT License.\n" + line * 3000 + "Licensed under CC BY 4.0."
    got = sorted((r["start"], r["end"], r["family"]) for r in scan.scan(documents(spark, [text])).collect())
    a, b = text.index("Released"), text.index("Licensed")
    assert got == [(a, a + 31, "MIT"), (b, len(text), "CC-BY")]
