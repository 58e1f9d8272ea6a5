"""License scans: a trained paragraph classifier, in DataFrame operations only.

A paragraph is a run of lines that ends at a blank line or at a line's end that ends a sentence, with the marks of comments in
front of its lines removed; so a wrapped notice is one paragraph. It is described by its word n-grams of 1 to MAX_N words, lower
case, with END in the place of a sentence's end. Sparse multinomial logistic regression over licence families, licence-like text
of no family (`unknown`) and ordinary prose is fitted on public licence notices, their variations and ordinary sentences. The fit
is a fixed small problem on the driver, so its weights and constants are constants of the library; L1 shrinkage leaves a few
thousand n-grams. Scoring is one broadcast join on n-grams and a sum.

Scores become probabilities by a temperature that is chosen on variations which the weights have not seen, and a paragraph whose
best family is below UNKNOWN_BELOW is `unknown`. Predictions are confirmed by templates: the share of the nearest template's word
pairs that the paragraph holds, or of the paragraph's pairs that the template holds, whichever is higher, has to reach
CONFIRM. A named family without a confirming template stays a candidate with `confirmed` false.

Paragraphs without any word that `gate` derives from the weights are not split into n-grams: every n-gram with a weight has
such a word, so what they would get are the constants alone, which name ordinary prose.

Defined cases: null, empty and wordless texts have no paragraphs and no rows; an empty table gives none; very long texts are
scanned whole; a paragraph that repeats in a document gives a row each time; repeated rows give theirs each, and rows that share
an id but not a text are told apart by the text; ties go to the class that is first in order; a null doc_id is like any other;
extra columns have no say, whatever their names.
"""

from __future__ import annotations

import random
import re
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reprise.llm.common import table
from reprise.llm.neardup import text_key

MAX_N = 3
UNKNOWN = "unknown"
#: The class of ordinary prose, which is not reported.
NONE = "none"
UNKNOWN_BELOW = 0.6
CONFIRM = 0.7
#: In the place of a sentence's end.
END = "$"
#: Weight of the L1 penalty, and steps of the fit.
PENALTY = 3e-4
#: How many times as much as another class ordinary prose counts in the fit.
ORDINARY_WEIGHT = 4
STEPS = 300

#: Public licence notices by family: the words that such notices are made of.
TEMPLATES = {
    "Apache-2.0": [
        "licensed under the apache license version 2 0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
        "spdx license identifier apache 2 0",
    ],
    "MIT": [
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "spdx license identifier mit",
    ],
    "BSD": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "released under the bsd 3 clause license",
        "licensed under the bsd 2 clause license",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "spdx license identifier bsd 3 clause",
    ],
    "GPL": [
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "you should have received a copy of the gnu general public license along with this program",
        "spdx license identifier gpl 3 0 or later",
    ],
    "AGPL": [
        "this work is licensed under the gnu affero general public license version 3",
        "you should have received a copy of the gnu affero general public license along with this program",
        "spdx license identifier agpl 3 0 or later",
        "agpl 3 0 or later",
    ],
    "Public-Domain": [
        "this work is in the public domain",
        "released into the public domain",
        "dedicated to the public domain",
        "placed in the public domain",
    ],
    "LGPL": [
        "licensed under the gnu lesser general public license version 2 1",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
        "spdx license identifier lgpl 2 1 or later",
    ],
    "MPL": [
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        "licensed under the mozilla public license version 2 0",
        "spdx license identifier mpl 2 0",
    ],
    "CC-BY": [
        "licensed under cc by 4 0",
        "this work is licensed under a creative commons attribution 4 0 international license",
    ],
    "CC-BY-SA": [
        "licensed under cc by sa 4 0",
        "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    ],
    "CC-BY-NC": [
        "licensed under cc by nc 4 0",
        "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    ],
    "CC-BY-ND": [
        "licensed under cc by nd 4 0",
        "this work is licensed under a creative commons attribution noderivatives 4 0 international license",
    ],
    "CC0": [
        "to the extent possible under law the author has waived all copyright and related rights cc0 1 0 universal public domain dedication",
        "released under cc0 1 0",
    ],
    "Unlicense": [
        "this is free and unencumbered software released into the public domain",
        "released under the unlicense",
    ],
    "Proprietary": [
        "all rights reserved no part of this publication may be reproduced without the prior written permission of the publisher",
        "copyright all rights reserved $",
        "all rights reserved $",
        "confidential and proprietary unauthorized copying of this file is strictly prohibited",
    ],
    "EPL": [
        "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0 which is available at",
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
        "licensed under the eclipse public license version 1 0",
        "spdx license identifier epl 2 0",
    ],
    "ISC": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages",
        "released under the isc license",
        "spdx license identifier isc",
    ],
    "Zlib": [
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
        "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
        "altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
        "released under the zlib license",
        "spdx license identifier zlib",
    ],
    "Artistic": [
        "this program is free software you can redistribute it and or modify it under the terms of the artistic license",
        "licensed under the artistic license 2 0",
        "you may distribute under the terms of the artistic license as specified in the readme file",
        "spdx license identifier artistic 2 0",
    ],
    "BSL-1.0": [
        "distributed under the boost software license version 1 0",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use reproduce display distribute execute and transmit the software",
        "spdx license identifier bsl 1 0",
    ],
    "OFL": [
        "this font software is licensed under the sil open font license version 1 1",
        "the font software may be sold as part of a larger software package but no copy of the font software may be sold by itself",
        "spdx license identifier ofl 1 1",
    ],
    "CDDL": [
        "the contents of this file are subject to the terms of the common development and distribution license you may not use this file except in compliance with the license",
        "licensed under the common development and distribution license cddl version 1 0",
        "spdx license identifier cddl 1 0",
    ],
    "EUPL": [
        "licensed under the eupl version 1 2 or as soon they will be approved by the european commission subsequent versions of the eupl",
        "licensed under the european union public licence version 1 2",
        "spdx license identifier eupl 1 2",
    ],
    "PSF": [
        "licensed to the python software foundation under a contributor agreement",
        "python software foundation license version 2",
        "spdx license identifier psf 2 0",
    ],
    "WTFPL": [
        "do what the fuck you want to public license",
        "licensed under the wtfpl version 2",
        "spdx license identifier wtfpl",
    ],
}
#: Statements of licences in no family: what all of them are about.
LICENCE_LIKE = [
    "this software may be used only under the terms of the license agreement that came with it",
    "permission to use this material is granted subject to the following conditions of the license",
    "see the license file for the terms under which this package may be copied",
    "you may not copy distribute or modify this program without a license from the company",
    "distributed under the terms of our community license version 3",
    "this file is licensed under the terms in the accompanying license file",
    "the use of this code is governed by the license agreement and by copyright law",
    "licensed under the company source license",
    "no license express or implied to any intellectual property rights is granted by this document",
    "redistribution of this data requires written permission of the owner of the copyright",
    "copyright of the work remains with the authors who license it for research use only",
    "spdx license identifier licenseref custom",
]
#: Names that say by themselves what they name, by family; they stand alone, or with a version in the same word.
NAMES = {
    "AGPL": ["agpl"], "GPL": ["gpl"], "LGPL": ["lgpl"], "MPL": ["mpl"], "EPL": ["epl"],
}
VERSIONS = ("", "v1", "v2", "v3", "1", "2", "3")
NOTICES = ("distributed under {} or later", "licensed under the {}", "released under {}", "{} only")
for _family, _names in NAMES.items():
    for _name in _names:
        TEMPLATES[_family] += [n.format(_name + v) for v in VERSIONS for n in NOTICES]
_BY_NAME = {n.format(name + v) for names in NAMES.values() for name in names for v in VERSIONS for n in NOTICES}
#: Sentences with such words that grant or name nothing.
ORDINARY = [
    "he lost his driving license after the accident last year",
    "the teacher gave permission to leave the room early",
    "the general public was not admitted to the hearing",
    "she wrote a program for the school computer",
    "the patient was released from the hospital on monday",
    "please read the terms and conditions before you buy a ticket",
    "the library is free and open to everyone on sunday",
    "a creative person sees common things in a new way",
    "the company paid for the software and the source of the data",
    "the mit students met at the institute in the morning",
    "the apache helicopter landed near the river",
    "the work was done under the bridge without a permit",
    "a fishing license costs ten dollars in this state",
    "the rights of the author were discussed in the committee",
    "the public domain of the town is kept in good order",
    "you should have received a letter with the new version",
    "they reserved a table for all of the guests",
    "the following list is not complete",
    "to the extent possible we answer every question",
    "all rights reserved seats were sold by noon",
    "the seats in the first row are reserved for members",
    "use the software to copy the files and save your work",
    "this is free of charge for any person under ten",
    "the conditions of the soil are the subject of the study",
    "version 2 of the report was published in the journal",
    "the author of the book claims that the source is not known",
    "in no event was the bridge closed to the public",
    "the following conditions were observed in the field",
    "the document is available at the office without charge",
    "the notice above the door was written by the owner",
    "we provide the data as part of a larger study",
    "the company is liable for the damages of the fire",
    "the python in the zoo is fed once a week",
    "the moon will eclipse the sun on friday",
    "the font in the church is made of stone",
    "artistic freedom is the subject of the exhibition",
    "a boost in sales was reported by the firm",
    "common sense is the foundation of good development",
    "the european commission approved the plan in may",
    "he was identified by the number on his licence plate",
]
_FUNCTION_WORDS = {*"a an and any are as at be by do for from have his if in into is it its may no not of on or s shall so such that the their this to under was we were which will with without you your".split(), END}


def families() -> list[str]:
    return sorted(TEMPLATES)


def classes() -> list[str]:
    return [*families(), NONE, UNKNOWN]


def words_of(paragraph: str) -> list[str]:
    """The words of a paragraph in lower case, END where a sentence ends; Spark's `_words` in plain Python."""
    text = re.sub(r"(?<=[^\W\d_]{3})[.!?]+(?=\s|$)", f" {END} ", paragraph.lower())
    return [w for w in re.split(r"(?:[^\w$]|_)+", text.replace(END, f" {END} ") if END in text else text) if w]


def grams_of(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in range(1, MAX_N + 1) for i in range(len(words) - n + 1)}


def _content(gram: str) -> list[str]:
    return [w for w in gram.split() if w not in _FUNCTION_WORDS and not w.isdigit() and len(w) > 1]


def _examples(seed: int, ordinary: list[str], copies: int) -> list[tuple[set[str], str]]:
    """Notices whole, in part and with sentences around them; ordinary sentences, alone and together."""
    rng = random.Random(seed)
    out = []
    for label, texts in [*sorted(TEMPLATES.items()), (UNKNOWN, LICENCE_LIKE)]:
        for text in texts:
            words = text.split()
            versions = [words, [*words, END], [w.replace("license", "licence") for w in words]]
            for _ in range(1 if text in _BY_NAME else copies):
                before, after = rng.choice(ordinary).split(), rng.choice(ordinary).split()
                versions.append([*before, END, *words, END, *after[: rng.randrange(len(after))]])
                versions.append(["copyright", "c", str(rng.randrange(1990, 2030)), *before[:2], *words])
                if len(words) > 8:
                    a = rng.randrange(len(words) - 7)
                    versions.append(words[a : a + rng.randrange(8, len(words) - a + 1)])
            out += [(grams_of(v), label) for v in versions]
    # a name says by itself what it names
    out += [({name + v}, family) for family, names in NAMES.items() for name in names for v in VERSIONS for _ in range(3)]
    for _ in range(3 * copies):
        for text in ordinary:
            other = rng.choice(ordinary).split()
            out += [(grams_of([*text.split(), END]), NONE), (grams_of([*other, END, *text.split()[: rng.randrange(2, 9)]]), NONE)]
    return out


@cache
def weights() -> tuple[dict[str, dict[str, float]], dict[str, float], float]:
    """({n-gram: {class: weight}}, {class: constant}, temperature) by accelerated proximal gradient steps with an L1 penalty."""
    labels = classes()
    seen, unseen = _examples(5, [t for i, t in enumerate(ORDINARY) if i % 4], 3), _examples(17, ORDINARY[::4], 1)
    found: dict[str, int] = {}
    for grams, _ in seen:
        for g in grams:
            found[g] = found.get(g, 0) + 1
    features = sorted(g for g, n in found.items() if n > 1 and _content(g))
    index = {g: i for i, g in enumerate(features)}

    def matrix(examples: list[tuple[set[str], str]]) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(examples), len(features) + 1), dtype=np.float32)
        x[:, -1] = 1
        for i, (grams, _) in enumerate(examples):
            x[i, [index[g] for g in grams if g in index]] = 1
        return x, np.array([labels.index(label) for _, label in examples])

    def softmax(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    x, y = matrix(seen)
    share = np.bincount(y, minlength=len(labels)).astype(np.float32)
    share[labels.index(NONE)] /= ORDINARY_WEIGHT  # other classes count alike
    share = (1 / share[y] / (len(labels) - 1 + ORDINARY_WEIGHT))[:, None]
    target = np.eye(len(labels), dtype=np.float32)[y]
    v = np.ones(x.shape[1], dtype=np.float32)
    for _ in range(20):  # the largest curvature
        v = x.T @ (share * (x @ v)[:, None])[:, 0]
        size = float(np.linalg.norm(v))
        v /= size
    rate = np.float32(1.9 / size)
    w = np.zeros((x.shape[1], len(labels)), dtype=np.float32)
    ahead, t = w, 1.0
    for _ in range(STEPS):
        new = ahead - rate * (x.T @ (share * (softmax(x @ ahead) - target)))
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * PENALTY, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead = new + np.float32((before - 1) / t) * (new - w)
        w = new
    x, y = matrix(unseen)
    z = (x @ w).astype(np.float64)
    loss = lambda heat: -np.log(np.maximum(softmax(z / heat)[np.arange(len(y)), y], 1e-12)).mean()
    heat = min((0.3, 0.4, 0.5, 0.6, 0.75, 1.0, 1.25, 1.5, 2.0, 3.0), key=loss)
    kept = {g: {k: round(float(a), 4) for k, a in zip(labels, row, strict=True) if abs(a) >= 5e-5} for g, row in zip(features, w, strict=False)}
    return {g: row for g, row in kept.items() if row}, {k: round(float(a), 4) for k, a in zip(labels, w[-1], strict=True)}, heat


@cache
def gate() -> list[str]:
    """Words of which every n-gram with a weight has one: of each, the one that fewest ordinary sentences have."""
    common: dict[str, int] = {}
    for text in ORDINARY:
        for word in set(text.split()):
            common[word] = common.get(word, 0) + 1
    chosen: set[str] = set()
    for g in sorted(weights()[0], key=lambda g: (len(g.split()), g)):
        content = _content(g)
        if not chosen & set(content):
            chosen.add(min(content, key=lambda word: (common.get(word, 0), -len(word), word)))
    return sorted(chosen)


def _alternatives(words: list[str]) -> str:
    """A pattern for any of the words, by their common beginnings."""
    rest: dict[str, list[str]] = {}
    for w in words:
        if w:
            rest.setdefault(w[0], []).append(w[1:])
    out = "(?:" + "|".join(c + _alternatives(r) for c, r in sorted(rest.items())) + ")" if rest else ""
    return out + "?" if rest and "" in words else out


#: Marks of comments and quotations in front of a line.
_MARKS = r"(?m)^[ \t]*(?:(?:/\*+|\*+/?|//+|#+|--+|;+|%+|<!--|>+|\"{3}|'{3})[ \t]*)+"
#: Between paragraphs: line ends after a sentence, and blank lines.
_BREAK = r"(?:(?<=[.!?])[ \t]*\r?\n|\r?\n[ \t]*\r?\n)\s*"


def paragraphs(text: Column) -> Column:
    return F.split(F.regexp_replace(text, _MARKS, ""), _BREAK)


def _words(paragraph: Column) -> Column:
    text = F.regexp_replace(F.lower(F.regexp_replace(paragraph, r"\$", " ")), r"(?<=\p{L}{3})[.!?]+(?=\s|$)", f" \\{END} ")
    return F.filter(F.split(text, r"[^\p{L}\p{N}$]+"), lambda x: x != "")


def _grams(words: Column, n: int) -> Column:
    last = F.size(words) - (n - 1)
    starts = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))


def _pairs(words: list[str]) -> set[str]:
    return {" ".join(p) for p in zip(words, words[1:], strict=False)}


def scan(documents: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row per paragraph that is not ordinary prose: doc_id, text_key, paragraph (from 0), family, probability,
    template_share, confirmed. text_key stands for the text, as ids may be null or shared."""
    spark = documents.sparkSession
    weight, constant, heat = weights()
    labels, named = classes(), families()
    trigger = r"(?i)(?<![\p{L}\p{N}])" + _alternatives(gate()) + r"(?![\p{L}\p{N}])"
    templates = [(f, _pairs(t.split())) for f in named for t in TEMPLATES[f]]
    known: dict[str, list[int]] = {}
    for k, (_, pairs) in enumerate(templates):
        for pair in pairs:
            known.setdefault(pair, []).append(k)
    # constants of the library: a few thousand n-grams, their weights and the templates that hold them
    rows = [(g, [weight.get(g, {}).get(k, 0.0) for k in labels], known.get(g, [])) for g in sorted({*weight, *known})]
    table_of = F.broadcast(spark.createDataFrame(rows, "gram string, w array<double>, templates array<int>"))
    found = (
        documents.where(F.col("text").rlike(trigger))
        .select(F.col(doc_id).alias("doc_id"), text_key().alias("text_key"), F.posexplode(paragraphs(F.col("text"))).alias("paragraph", "words"))
        .where(F.col("words").rlike(trigger))
        .withColumn("words", _words(F.col("words")))
        .select("doc_id", "text_key", "paragraph", F.monotonically_increasing_id().alias("row"), F.size(F.array_distinct(_grams(F.col("words"), 2))).alias("n"),
                F.array_distinct(F.concat(*[_grams(F.col("words"), n) for n in range(1, MAX_N + 1)])).alias("grams"))
    )
    # a paragraph's n-grams are in one task, which sums them up before the shuffle
    z = (
        found.select("doc_id", "text_key", "paragraph", "row", "n", F.explode("grams").alias("gram"))
        .join(table_of, "gram")
        .groupBy("doc_id", "text_key", "paragraph", "row", "n")
        .agg(*[F.sum(F.element_at("w", i + 1)).alias(f"z{i}") for i in range(len(labels))], F.flatten(F.collect_list("templates")).alias("held"))
    )
    z = z.select("doc_id", "text_key", "paragraph", "n", "held", F.array(*[F.col(f"z{i}") + constant[k] for i, k in enumerate(labels)]).alias("z"))
    z = z.withColumn("top", F.array_max("z"))
    z = z.withColumn("best", F.element_at(F.array(*[F.lit(k) for k in labels]), F.array_position("z", F.col("top")).cast("int"))).where(F.col("best") != NONE)
    z = z.withColumn("probability", 1 / F.aggregate("z", F.lit(0.0), lambda total, x: total + F.exp((x - F.col("top")) / heat)))
    own = F.create_map(*[x for f in named for x in (F.lit(f), F.array(*[F.struct(F.lit(k).alias("k"), F.lit(len(pairs)).alias("size")) for k, (g, pairs) in enumerate(templates) if g == f]))])
    shares = F.transform(F.element_at(own, F.col("best")), lambda t: F.size(F.filter("held", lambda k: k == t["k"])) / F.least(F.col("n"), t["size"]))
    z = z.withColumn("share", F.when(F.col("n") > 0, F.coalesce(F.array_max(shares), F.lit(0.0))).otherwise(0.0))
    sure = (F.col("best") != UNKNOWN) & (F.col("probability") >= UNKNOWN_BELOW)
    return z.select(
        "doc_id", "text_key", "paragraph", F.when(sure, F.col("best")).otherwise(UNKNOWN).alias("family"),
        "probability", F.col("share").alias("template_share"), (sure & (F.col("share") >= CONFIRM)).alias("confirmed"),
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: its confirmed families in order, its paragraphs that name a family or an unknown licence
    (number and family, in order), and how many of them there are and are confirmed."""
    docs = table(spark, sf_dir, "documents")
    # a repeated row has the same paragraphs again; they are listed once and given to each
    found = scan(docs).select(F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_key"), "paragraph", "family", "confirmed").distinct()
    listed = F.transform(F.array_sort(F.collect_list(F.struct("paragraph", "family"))), lambda x: F.concat_ws(":", x["paragraph"].cast("string"), x["family"]))
    per = found.groupBy("of_id", "of_key").agg(
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("families"),
        F.array_join(listed, " ").alias("paragraphs"),
        F.count(F.lit(1)).alias("n_candidates"),
        F.count_if("confirmed").alias("n_confirmed"),
    )
    none = F.lit(0).cast("bigint")
    keyed = docs.select("doc_id", text_key().alias("text_key"))
    # findings grow with the documents, so they are never broadcast
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_key"))
    return keyed.join(per.hint("merge"), same, "left").select(
        "doc_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("families", "paragraphs")],
        F.coalesce("n_candidates", none).alias("n_candidates"), F.coalesce("n_confirmed", none).alias("n_confirmed"),
    )
