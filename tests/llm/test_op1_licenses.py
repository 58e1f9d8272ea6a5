import math
import re

import pytest
from data import DOCS, frame

from reprise.llm import licenses as li

MARKS = re.compile(r"^[ \t]*(?:(?:/\*+|\*+/?|//+|#+|--+|;+|%+|<!--|>+|\"{3}|'{3})[ \t]*)+", re.M)


def split(text):
    """Paragraphs: lines without comment marks, up to a blank line or a line's end after a sentence."""
    out, held = [], []
    for line in MARKS.sub("", text or "").split("\n"):
        if line.strip():
            held.append(line)
        if held and (not line.strip() or re.search(r"[.!?][ \t]*$", line)):
            out.append("\n".join(held))
            held = []
    return [*out, "\n".join(held)] if held else out


def brute(text):
    """(family, confirmed) of each paragraph that is not ordinary prose, over all n-grams, without the gate."""
    weight, constant, heat = li.weights()
    labels = li.classes()
    out = []
    for paragraph in split(text):
        ws = li.words_of(paragraph)
        grams = li.grams_of(ws)
        z = {k: constant[k] + sum(weight.get(g, {}).get(k, 0.0) for g in grams) for k in labels}
        best = max(labels, key=lambda k: (round(z[k], 9), -labels.index(k)))
        if best == li.NONE:
            continue
        p = 1 / sum(math.exp((z[k] - z[best]) / heat) for k in labels)
        own, shares = li._pairs(ws), [0.0]
        for t in li.TEMPLATES.get(best, []):
            pairs = li._pairs(t.split())
            shares.append(len(own & pairs) / min(len(own), len(pairs)) if own else 0.0)
        sure = best != li.UNKNOWN and p >= li.UNKNOWN_BELOW
        out.append((best if sure else li.UNKNOWN, sure and max(shares) >= li.CONFIRM))
    return out


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
GPL = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version."""
EPL = """// This program and the accompanying materials are made
// available under the terms of the Eclipse Public License 2.0
// which is available at https://www.eclipse.org/legal/epl-2.0/"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software."""
AFFERO = "You should have received a copy of the GNU Affero General Public License along with this program."
TEXTS = [
    "Released under the MIT License.\nThe rest is prose.",
    "words\n\nThis work is licensed under the GNU General Public License, version 3.",
    "Licensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0.",
    "He lost his driving license last year. The mit students met.",
    "SPDX-License-Identifier: BSD-3-Clause\n\nCopyright (c) 2020 A. All rights reserved.",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "license", "LICENSE!!!", "", None, "no such words here", "the license of the license of the license is a license",
    MIT, GPL, EPL, ISC, ZLIB, AFFERO, "All rights reserved seats are gone.", "All rights reserved.", "costs $ 5 $license$ .\n \n\n# \n",
    "Distributed under our own community licence, version 4: see the licence file for its terms.",
]


def found(spark, rows):
    got = {}
    for r in li.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect():
        got.setdefault(r.doc_id, []).append((r.paragraph, r.family, r.confirmed))
    return {k: [(f, c) for _, f, c in sorted(v)] for k, v in got.items()}


def test_scan_by_the_definition(spark):
    assert found(spark, list(enumerate(TEXTS))) == {i: b for i, t in enumerate(TEXTS) if (b := brute(t))}


def test_notices_are_named():
    named = [{f for f, c in brute(t) if c} for t in TEXTS]
    assert named[0] == {"MIT"} and named[1] == {"GPL"} and named[2] == {"Apache-2.0", "CC-BY-NC"} and named[4] == {"BSD", "Proprietary"} and named[5] == {"MIT"}
    assert not named[3] and not named[6] and not named[11]


@pytest.mark.parametrize("text,family", [(MIT, "MIT"), (GPL, "GPL"), (EPL, "EPL"), (ISC, "ISC"), (ZLIB, "Zlib"), (AFFERO, "AGPL"), ("All rights reserved.", "Proprietary")])
def test_wrapped_notices_are_one_paragraph_of_their_family(text, family):
    assert brute(text) == [(family, True)]


def test_what_only_sounds_like_a_licence():
    assert not any(c for _, c in brute("All rights reserved seats are gone."))
    assert brute(TEXTS[-1]) == [(li.UNKNOWN, False)]


def test_held_out_variations_are_named():
    """Variations with another seed and other sentences around them than the weights have seen."""
    weight, constant, _ = li.weights()
    labels, right, examples = li.classes(), 0, li._examples(99, li.ORDINARY[::4], 2)
    for grams, label in examples:
        z = {k: constant[k] + sum(weight.get(g, {}).get(k, 0.0) for g in grams) for k in labels}
        right += max(labels, key=z.get) == label
    assert right / len(examples) > 0.95 and len(li.families()) >= 20


def test_every_weight_is_behind_the_gate():
    gate = set(li.gate())
    assert all(gate & set(g.split()) for g in li.weights()[0])
    _, constant, _ = li.weights()
    assert max(li.classes(), key=constant.get) == li.NONE


def test_awkward_rows(spark):
    assert li.scan(frame(spark, extra=True)).count() == 0
    assert li.scan(frame(spark, [])).count() == 0


def test_a_very_long_text(spark):
    long = "plain words of no interest " * 12_000 + "\n\n" + TEXTS[0] + "\n" + "more words. \n" * 2_000
    assert found(spark, [(1, long)]) == {1: [("MIT", True)]}


def test_query_gives_every_document(spark, tmp_path):
    rows = [(1, TEXTS[0], "en", "a", 1), (1, TEXTS[0], "en", "a", 1), (1, AFFERO, "en", "a", 1), (2, None, "en", "a", 1), (None, TEXTS[0], "en", "a", 1), (None, "x", "en", "a", 1)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, li.op1_license_scan(spark, str(tmp_path)).collect()), key=repr)
    mit = ("MIT", "0:MIT", 1, 1)
    assert got == sorted([(1, *mit), (1, *mit), (1, "AGPL", "0:AGPL", 1, 1), (2, "", "", 0, 0), (None, *mit), (None, "", "", 0, 0)], key=repr)


def test_names_written_otherwise(spark):
    lines = ["Distributed under GPLv3 or later", "AGPL-3.0-or-later", "GPLv2+", "This work is in the public domain", "The public domain of the town is kept in good order"]
    got = {i: v[0] for i, v in found(spark, list(enumerate(lines))).items()}
    assert {i: f for i, (f, _) in got.items()} == {0: "GPL", 1: "AGPL", 2: "GPL", 3: "Public-Domain"}
    assert all(got[i][1] for i in (0, 1, 3))
