"""Operator 10: licence scans by a trained paragraph classifier.

A paragraph is a line with a word, or a passage of a wrapped notice: neighbouring lines in which words that speak for a
licence stand close together. Logistic regression over sparse word n-grams, one model for each licence family, gives a
paragraph its families; paragraphs of the corpus in which no licence is confirmed are the unknown class, and a probability
calibrated on notices and paragraphs that weren't fitted to says when a paragraph stays unknown. A prediction counts once a
comparison with the family's templates confirms it: enough of a template's word pairs must be there, or most of the
paragraph's must be a template's, and so must the words that decide between families that are alike: a version, Lesser,
Affero, or the elements of a Creative Commons licence.

Models are fitted on templates, on cut and embedded forms of them, and on a bounded sample of paragraphs. Every paragraph
of every whole text is scanned. The deciding words of every family contain one of ANCHORS, so a text or line without any
has no licence that could be confirmed and is passed over.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, table

#: Notices of public licence families, in lower case and without punctuation, as words() gives them. Fixed values.
TEMPLATES = {
    "MIT": [
        "released under the mit license",
        "licensed under the mit license",
        "this project is licensed under the terms of the mit license",
        "this project is mit licensed",
        "mit license",
        "spdx license identifier mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    ],
    "ISC": [
        "released under the isc license",
        "licensed under the isc license",
        "spdx license identifier isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "BSD": [
        "released under the bsd license",
        "licensed under the bsd 3 clause license",
        "licensed under the bsd 2 clause license",
        "this project is bsd licensed",
        "use of this source code is governed by a bsd style license that can be found in the license file",
        "spdx license identifier bsd 3 clause",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ],
    "Apache-2.0": [
        "licensed under the apache license version 2.0",
        "released under the apache license version 2.0",
        "this project is licensed under the apache 2.0 license",
        "apache license version 2.0",
        "spdx license identifier apache 2.0",
        "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
        "see the license for the specific language governing permissions and limitations under the license unless required by applicable law or agreed to in writing",
    ],
    "GPL-3.0": [
        "this work is licensed under the gnu general public license version 3",
        "released under the gnu general public license version 3",
        "licensed under the gnu gpl version 3",
        "licensed under the gpl v3",
        "licensed under gplv3",
        "spdx license identifier gpl 3.0 or later",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ],
    "GPL-2.0": [
        "this work is licensed under the gnu general public license version 2",
        "released under the gnu general public license version 2",
        "licensed under the gnu gpl version 2",
        "licensed under the gpl v2",
        "licensed under gplv2",
        "spdx license identifier gpl 2.0 or later",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    ],
    "LGPL": [
        "licensed under the gnu lesser general public license",
        "released under the lgpl",
        "licensed under the lgpl version 3",
        "spdx license identifier lgpl 2.1 or later",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version",
    ],
    "AGPL": [
        "licensed under the gnu affero general public license version 3",
        "released under the agpl",
        "licensed under the agpl version 3",
        "spdx license identifier agpl 3.0 or later",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ],
    "MPL-2.0": [
        "licensed under the mozilla public license version 2.0",
        "released under the mpl 2.0",
        "spdx license identifier mpl 2.0",
        "this source code form is subject to the terms of the mozilla public license v 2.0 if a copy of the mpl was not distributed with this file you can obtain one at",
    ],
    "Unlicense": [
        "this is free and unencumbered software released into the public domain",
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        "released under the unlicense",
        "spdx license identifier unlicense",
    ],
    "CC0": [
        "released under cc0 1.0",
        "licensed under cc0 1.0 universal",
        "dedicated to the public domain under cc0",
        "spdx license identifier cc0 1.0",
        "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    ],
    "Proprietary": [
        "all rights reserved",
        "copyright all rights reserved",
        "no part of this publication may be reproduced distributed or transmitted in any form or by any means without the prior written permission of the publisher",
        "proprietary and confidential unauthorized copying of this file is strictly prohibited",
    ],
}
#: Elements of Creative Commons licences by the words for them. Fixed values.
ELEMENTS = {"by": "by", "sa": "sa", "nc": "nc", "nd": "nd", "attribution": "by", "sharealike": "sa", "noncommercial": "nc", "noderivatives": "nd", "noderivs": "nd"}
_COMMONS = {"CC-BY": "", "CC-BY-SA": "sharealike", "CC-BY-NC": "noncommercial", "CC-BY-ND": "noderivatives", "CC-BY-NC-SA": "noncommercial sharealike", "CC-BY-NC-ND": "noncommercial noderivatives"}
for _family, _long in _COMMONS.items():
    _short = _family.lower().replace("-", " ")
    _long = " ".join(["attribution", *_long.split()])
    TEMPLATES[_family] = [f"licensed under {_short} 4.0", f"released under {_short}", f"this work is licensed under {_short} 3.0", f"this work is licensed under a creative commons {_long} 4.0 international license", f"available under the creative commons {_long} license", f"spdx license identifier {_short} 4.0"]
FAMILIES = tuple(TEMPLATES)

_GNU, _NOT_PLAIN = r"\bgnu general public\b|\bgpl(?:v[0-9.]+)?\b|\bgnu gpl\b", r"\blesser\b|\blibrary general\b|\baffero\b|\blgpl|\bagpl"


def _version(n: int) -> str:
    return rf"\b(?:version|v|gpl|licen[cs]e) {n}(?:\.0)?\b|\b(?:gpl)?v{n}(?:\.0)?\b"


#: Of each family the ways to be decided: expressions over words joined by spaces that must all be found, then one that
#: mustn't.
DECIDING = {
    "MIT": [([r"\bmit\b", r"licen[cs]"], None), (["permission is hereby granted free of charge"], None), (["copyright notice and this permission notice shall be included"], None), (["the software is provided as is without warranty of any kind"], None)],
    "ISC": [([r"\bisc\b", r"licen[cs]"], None), (["permission to use copy modify", "with or without fee"], None)],
    "BSD": [([r"\bbsd\b", r"licen[cs]"], None), (["redistribution and use in source and binary forms"], None), ([r"redistributions (?:of source code must retain|in binary form must reproduce)"], None)],
    "Apache-2.0": [([r"\bapache\b", r"\bv?2(?:\.0)?\b"], None), (["unless required by applicable law or agreed to in writing"], None)],
    "GPL-3.0": [([_GNU, _version(3)], _NOT_PLAIN)],
    "GPL-2.0": [([_GNU, _version(2)], _NOT_PLAIN)],
    "LGPL": [([r"\blesser general public\b|\bgnu library general public\b|\blgpl"], None)],
    "AGPL": [([r"\baffero\b|\bagpl"], None)],
    "MPL-2.0": [([r"\bmozilla public\b", r"\bv?2(?:\.0)?\b"], None), ([r"\bmpl\b", r"\bv?2(?:\.0)?\b", r"licen[cs]|releas|spdx"], None), (["if a copy of the mpl was not distributed", "licen[cs]e"], None)],
    "Unlicense": [([r"\bunlicense\b"], None), (["free and unencumbered software"], None), (["anyone is free to copy modify publish"], None)],
    "CC0": [([r"\bcc0\b"], None), (["waived all copyright and related"], None)],
    "Proprietary": [(["all rights reserved"], None), (["without the prior written permission"], None), (["proprietary and confidential"], None)],
}
#: One of these, or the beginning of a Creative Commons name, is in whatever decides a family.
ANCHORS = ("licens", "licenc", "permission", "copyright", "redistribut", "spdx", "unencumbered", "reserved", "gpl", "apache", "mozilla", "releas", "affero", "lesser", "gnu", "warrant", "applicable", "anyone", "commons", "cc0", "proprietary")
_CC = re.compile(r"\bcc[^a-z0-9]+by\b")
_ANCHOR = re.compile("|".join((*ANCHORS, _CC.pattern)))
#: Paragraphs of the corpus from which the unknown class is learned, about: those of a hash below a threshold.
SAMPLE = 4_000
#: Longest n-grams.
GRAMS = 3
#: Share of a template's word pairs, or of a paragraph's, that confirms a prediction.
CONFIRM = 0.7
#: Words around one that speaks for a licence that a passage reaches, and lines around a line with an anchor.
REACH, LINES = 8, 6
#: Sentences that speak about licences without granting one. With corpus paragraphs they are the unknown class.
NEAR_MISSES = (
    "the driver needs a license to drive in this country",
    "her license was valid for three years and then expired",
    "the version 2.0 release notes are available on the site",
    "the general public was invited to the opening",
    "apache is the name of a people and of a helicopter",
    "permission to enter the building is granted to staff only",
    "this work is part of a series of public lectures",
    "free software is discussed in the next chapter",
    "the rights of the people are reserved in the constitution",
    "a student at mit wrote this program under the guidance of a professor",
    "released under the name of another author",
    "this work is version 3 of the report",
    "the license fee for the apache helicopter simulator version 2 was waived",
    "he compared the mit license with other licenses in a long article",
)

_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")


def words(line: str) -> list[str]:
    """Lower-case words of letters and digits; a number keeps its points."""
    return _WORD.findall(line.lower())


def grams(own: list[str]) -> list[str]:
    return [" ".join(own[k : k + n]) for n in range(1, GRAMS + 1) for k in range(len(own) - n + 1)]


def elements(own: list[str]) -> str | None:
    """The Creative Commons family that the words name, by its elements; None if they name none."""
    for k, w in enumerate(own):
        long = w == "creative" and own[k + 1 : k + 2] == ["commons"]
        if not long and w != "cc":
            continue
        found, at = [], k + 1 + long
        while at < len(own) and own[at] in ELEMENTS:
            found.append(ELEMENTS[own[at]])
            at += 1
        if "by" in found:
            return "-".join(["CC", "BY", *(x.upper() for x in ("nc", "nd", "sa") if x in found)])
    return None


def decided(family: str, own: list[str]) -> bool:
    """Whether the words that tell a family from its likes are there."""
    if family in _COMMONS:
        return elements(own) == family
    text = " ".join(own)
    return any(all(re.search(x, text) for x in must) and not (no and re.search(no, text)) for must, no in DECIDING[family])


def _pairs(own: list[str]) -> Counter:
    return Counter(zip(own, own[1:]))


class LicenceModel:
    """One regression for each family over an explicit vocabulary, all small: built from templates and the sample."""

    def __init__(self, sample: list[str]):
        self.templates = {f: [_pairs(t.split()) for t in own] for f, own in TEMPLATES.items()}
        clean = [w for w in map(words, sample) if w and not any(self.confirm(f, w) >= CONFIRM for f in FAMILIES)]
        rng = np.random.default_rng(5)
        rows: list[tuple[int, list[str], bool]] = []  # family, words, whether for calibration in the first fit
        for k, f in enumerate(FAMILIES):
            for t in map(str.split, TEMPLATES[f]):
                rows.append((k, t, False))
                for variant in range(12):
                    held = variant % 4 == 3
                    filler = clean[int(rng.integers(len(clean)))] if clean else ["note", "that"]
                    at = int(rng.integers(0, max(1, len(filler) - REACH)))
                    cut = filler[at : at + int(rng.integers(1, REACH + 1))]
                    rows.append((k, [*cut, *t] if rng.random() < 0.5 else [*t, *cut], held))
                    if len(t) > 12:
                        at = int(rng.integers(0, len(t) - 11))
                        rows.append((k, t[at : at + int(rng.integers(12, len(t) + 1))], held))
        rows += [(-1, w, i % 4 == 3) for i, w in enumerate(clean)] + [(-1, n.split(), False) for n in NEAR_MISSES for _ in range(6)]
        held, y = np.array([r[2] for r in rows]), np.array([r[0] for r in rows])
        background = Counter(w for k, r, _ in rows if k < 0 for w in set(r))
        # The vocabulary is of the positives: other n-grams can only speak against, which the intercept does.
        vocabulary = {g: i for i, g in enumerate(sorted({g for k, r, _ in rows if k >= 0 for g in grams(r) if not background[g] > len(clean) / 10}))}
        lists = [np.fromiter(sorted({vocabulary[g] for g in grams(r) if g in vocabulary}), np.int64) for _, r, _ in rows]
        # What the probabilities mean is learned where nothing was fitted to: other notices and other paragraphs.
        first, bias = self._fit([x for x, h in zip(lists, held) if not h], y[~held], len(vocabulary))
        z = np.array([(first[:, x].sum(1) + bias).max() for x in lists])
        self.scale, self.shift = self._calibrate(z[held], (y[held] >= 0).astype(float))
        self.weights, self.bias = self._fit(lists, y, len(vocabulary))
        self.vocabulary = {g: i for g, i in vocabulary.items() if np.abs(self.weights[:, i]).max() > 1e-3}
        #: Words that speak for a family and are rare elsewhere: passages gather around them.
        self.speaking = frozenset(w for g, i in self.vocabulary.items() if self.weights[:, i].max() > 1e-3 for w in g.split() if background[w] <= max(2, len(clean) / 200))

    def _fit(self, lists: list, y: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(x) for x in lists])
        idx, of = np.concatenate([*lists, np.empty(0, np.int64)]).astype(np.int64), np.repeat(np.arange(len(lists)), sizes)
        weights, bias = np.zeros((len(FAMILIES), width)), np.full(len(FAMILIES), -3.0)
        for k in range(len(FAMILIES)):
            goal = (y == k).astype(float)
            balance = np.where(goal > 0, 0.5 / max(1, goal.sum()), 0.5 / max(1, (1 - goal).sum()))
            w, v = np.zeros(width), np.zeros(width)
            b = -3.0  # fixed: without evidence a paragraph isn't of the family
            for _ in range(100):
                z = np.bincount(of, w[idx], len(lists)) + b
                g = np.bincount(idx, (balance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - goal))[of], width)
                v = 0.9 * v + g
                w = w - 4.0 * v
                w = np.sign(w) * np.maximum(np.abs(w) - 4e-4, 0)  # sparse: small weights are none
            weights[k], bias[k] = w, b
        return weights, bias

    def _calibrate(self, z: np.ndarray, right: np.ndarray) -> tuple[float, float]:
        """Platt scaling of the best family's logit to the probability that a paragraph isn't of the unknown class."""
        goal = np.where(right > 0, (right.sum() + 1) / (right.sum() + 2), 1 / ((1 - right).sum() + 2))
        width = max(1.0, float(z.std()))
        z, a, c = z / width, 1.0, 0.0
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(a * z + c, -30, 30)))
            r = np.maximum(p * (1 - p), 1e-6)
            h = np.array([[(r * z * z).sum() + 1e-2, (r * z).sum()], [(r * z).sum(), r.sum() + 1e-2]])
            d = np.linalg.solve(h, [((p - goal) * z).sum() + 1e-2 * (a - 1), (p - goal).sum()])
            a, c = a - np.clip(d[0], -0.5, 0.5), c - np.clip(d[1], -0.5, 0.5)
        return max(0.01, float(a)) / width, float(c)

    def predict(self, own: list[str]) -> np.ndarray:
        """Of each family the calibrated probability that a paragraph with so much evidence of it isn't unknown."""
        at = sorted({i for g in grams(own) if (i := self.vocabulary.get(g)) is not None})
        z = self.weights[:, at].sum(1) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30)))

    def confirm(self, family: str, own: list[str]) -> float:
        """Best over the family's templates: the share of a template's word pairs that are there or, for parts of a long
        template, of the paragraph's that are the template's. 0 if the deciding words aren't there."""
        if not decided(family, own):
            return 0.0
        mine, best = _pairs(own), 0.0
        for t in self.templates[family]:
            shared = sum((mine & t).values())
            best = max(best, shared / sum(t.values()), shared / max(10, len(own) - 1))
        return best

    def judge(self, own: list[str]) -> list[tuple[str, float, float]]:
        """family, probability, confirmation of each family that the words of a paragraph are found to be of."""
        p = self.predict(own)
        return [(FAMILIES[k], float(p[k]), c) for k in np.flatnonzero(p >= 0.5).tolist() if (c := self.confirm(FAMILIES[k], own)) >= CONFIRM]

    def passages(self, own: list[str]) -> list[tuple[int, int]]:
        """Runs of words in which those that speak for a licence are at most REACH apart, and REACH words around them."""
        out: list[list[int]] = []
        for k, w in enumerate(own):
            if w in self.speaking:
                if out and k - out[-1][1] <= REACH:
                    out[-1][1] = k
                else:
                    out.append([k, k])
        return [(max(0, a - REACH), min(len(own), b + REACH + 1)) for a, b in out]

    def scan(self, line: str) -> tuple[str, float, float] | None:
        """The likeliest finding of one paragraph, or None if it is unknown or not confirmed."""
        found = self.scan_text(line)
        return max(found, key=lambda f: f[2])[1:] if found else None

    def scan_text(self, text: str, skip: bool = True) -> list[tuple[int, str, float, float]]:
        """paragraph (its first line, from 0), family, probability, confirmation of all findings in a text, in order. skip:
        pass over texts and lines without an anchor."""
        low = text.lower()
        if skip and not any(a in low for a in ANCHORS) and not _CC.search(low):
            return []
        lines, out, taken = low.split("\n"), [], set()
        if skip:
            ends = np.cumsum([len(x) + 1 for x in lines])
            wanted = np.unique(np.searchsorted(ends, [m.start() for m in _ANCHOR.finditer(low)], "right")).tolist()
        else:
            wanted = [k for k, x in enumerate(lines) if x.strip()]
        cut: dict[int, list[str]] = {}
        for k in wanted:
            own = cut[k] = words(lines[k])
            for a, b in self.passages(own):
                for found in self.judge(own[a:b]):
                    out.append((k, *found))
                    taken.add(k)
        # Wrapped notices: lines around anchors that nothing was found in, up to a blank line.
        for group in _blocks([k for k in wanted if k not in taken], lines, taken):
            own = [(k, w) for k in group for w in (cut.get(k) or words(lines[k]))]
            plain = [w for _, w in own]
            for a, b in self.passages(plain):
                for found in self.judge(plain[a:b]):
                    first = next((k for k, w in own[a:b] if w in self.speaking), own[a][0])
                    out.append((first, *found))
        return sorted(dict.fromkeys(out))


def _blocks(wanted: list[int], lines: list[str], taken: set[int]) -> list[list[int]]:
    """Runs of lines around the wanted ones, LINES on either side, that are neither blank nor taken."""
    near = sorted({j for k in wanted for step in (-1, 1) for j in _along(k, step, lines, taken)} | set(wanted))
    out: list[list[int]] = []
    for k in near:
        if out and out[-1][-1] == k - 1:
            out[-1].append(k)
        else:
            out.append([k])
    return [b for b in out if len(b) > 1]


def _along(k: int, step: int, lines: list[str], taken: set[int]) -> list[int]:
    out = []
    for j in range(k + step, k + step * (LINES + 1), step):
        if not 0 <= j < len(lines) or j in taken or not lines[j].strip():
            break
        out.append(j)
    return out


def train(docs: DataFrame, text_col: str = "text") -> LicenceModel:
    """The model, with about SAMPLE of the paragraphs of all whole texts as unknown ones: those whose hash lies below a
    threshold that follows from their number. Equal paragraphs count once, however often they stand."""
    text = F.col(text_col)
    n = docs.agg(F.sum(F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1).alias("n")).first()["n"] or 1
    steps = 1 << 40
    picked = docs.select(F.explode(F.split(text, "\n")).alias("_p")).filter((F.pmod(F.xxhash64("_p", F.lit(31)), F.lit(steps)) < min(steps, steps * SAMPLE // n)) & F.rlike("_p", F.lit(r"\w")))
    return LicenceModel(sorted(r["_p"] for r in picked.distinct().collect()))  # about SAMPLE rows


def scan(docs: DataFrame, model: LicenceModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_paragraphs, n_licences, families (distinct, sorted), findings (array of struct: paragraph, the number of
    its first line from 0, family, probability, confirmation); a row for each row of docs.

    A null text has no paragraphs. Lines without a word count as none, but lines are numbered with them. Texts of any
    length are scanned whole. A paragraph may be of several families; each is a finding. Repeated rows, null and repeated
    ids come out as they went in. An empty table gives an empty one. Other columns of docs, whatever their names, play no
    part.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model or train(docs, text_col))
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        m = sent.value

        def step(cols):
            for i, t in zip(*cols):
                found = [dict(zip(("paragraph", "family", "probability", "confirmation"), f)) for f in m.scan_text(t or "")]
                yield i, sum(1 for x in (t or "").split("\n") if x.strip(" \t\x0b\x0c\r")), len(found), sorted({f["family"] for f in found}), found

        return step

    return map_rows(docs.select(id_col, text_col), make, f"`{id_col}` {kind}, n_paragraphs long, n_licences long, families array<string>, findings array<struct<paragraph:int,family:string,probability:double,confirmation:double>>", rows=5_000)


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest: doc_id, n_paragraphs, n_licences, families joined by a bar."""
    return scan(table(spark, sf_dir, "documents")).select("doc_id", "n_paragraphs", "n_licences", F.concat_ws("|", "families").alias("families"), F.to_json("findings").alias("findings"))
