"""Licence scans by a trained paragraph classifier.

A multinomial logistic regression over sparse word n-grams (n = 1 to 3) names the licence family of a paragraph, or
"none", or "unknown" for licence wording of no family known here. It is trained in numpy on a bounded set, PER_CLASS
paragraphs a class: the licences' own wording (WORDING_OF), cut at any word, and the phrases by which texts name a licence
(FAMILIES), amid prose, against near misses. A temperature fitted on held-out paragraphs calibrates the probabilities. A
family is named only where its calibrated probability reaches a threshold chosen on held-out known and foreign licences;
licence wording below it is "unknown". A named family is then confirmed by comparison with its templates, the sentences of
its wording and its phrases: the share of a template's word pairs that the paragraph contains.

The features are exact (64-bit hashes of n-grams, no folding), and an n-gram that training never kept weighs nothing, so
a licence sentence counts the same inside a long paragraph. All paragraphs of all texts are scored, whole. A paragraph is a
run of lines up to a blank one or one that ends a sentence, so a notice wrapped at any width is read as it was written;
marks of comments, quotes and tables at a line's ends don't count. Scoring is a lookup in the scan: no shuffle.

save() and load() keep a trained model in a folder that Spark can write.

Defined results: null, empty and blank texts have no paragraphs of interest and no row. Null ids and repeated rows are
scanned like any other row and give their rows each. Equal paragraphs of a text give a row each. Ties between families go
to the one first in name. Extra columns are ignored. No documents give no rows.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PER_CLASS = 250
SEED = 11
GRAMS = (1, 2, 3)
LEAST_FREQUENCY = 3
CONFIRM = 0.6
#: Least calibrated probability of any licence wording for a paragraph to be named at all.
WORDING = 0.9
#: How much worse than the best threshold the chosen one may tell known from foreign licences (of 2 in all).
SLACK = 0.02

#: Sentences of each family; {a|b} is a choice.
FAMILIES: dict[str, tuple[str, ...]] = {
    "agpl": ("{Licensed under|Distributed under|This program is under} the GNU Affero General Public License, version 3.", "See the GNU Affero General Public License for more details.", "SPDX-License-Identifier: AGPL-3.0-{only|or-later}", "{Released|Available} under the AGPL{v3| 3.0| version 3}."),
    "apache": ("Licensed under the Apache License, Version 2.0.", "{Released|Distributed|Available} under the Apache {License |}2.0{ license|}.", "SPDX-License-Identifier: Apache-2.0", "You may not use this file except in compliance with the Apache License.", "A copy of the Apache License 2.0 is at apache.org/licenses."),
    "bsd": ("{Released|Licensed|Distributed} under the {BSD|3-clause BSD|2-clause BSD|new BSD|simplified BSD} license.", "SPDX-License-Identifier: BSD-{2|3}-Clause", "Redistributions of source code must retain the above copyright notice and this list of conditions.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse products."),
    "cc-by": ("Licensed under CC BY {4.0|3.0}.", "This {work|article|text} is licensed under a Creative Commons Attribution {4.0|3.0} International License.", "{Published|Available} under the Creative Commons Attribution license (CC BY {4.0|3.0}).", "SPDX-License-Identifier: CC-BY-{4.0|3.0}"),
    "cc-by-nc": ("Licensed under CC BY-NC {4.0|3.0}.", "This {work|article|text} is licensed under a Creative Commons Attribution-NonCommercial {4.0|3.0} International License.", "{Published|Available} under CC BY-NC-{SA|ND} {4.0|3.0}.", "SPDX-License-Identifier: CC-BY-NC-{4.0|3.0}"),
    "cc-by-sa": ("Licensed under CC BY-SA {4.0|3.0}.", "This {work|article|text} is licensed under a Creative Commons Attribution-ShareAlike {4.0|3.0} International License.", "{Published|Available} under the Creative Commons Attribution-ShareAlike license.", "SPDX-License-Identifier: CC-BY-SA-{4.0|3.0}"),
    "gpl": ("{This work is licensed|This program is licensed|Licensed|Distributed} under the GNU General Public License, version {2|3}.", "{Released|Available} under the {GPL|GNU GPL}{v2|v3| version 2| version 3}.", "SPDX-License-Identifier: GPL-{2.0|3.0}-{only|or-later}", "You can redistribute it under the terms of the GNU General Public License.", "See the GNU General Public License for more details."),
    "lgpl": ("{This library is licensed|Licensed|Distributed} under the GNU Lesser General Public License, version {2.1|3}.", "{Released|Available} under the LGPL{v2.1|v3| version 3}.", "SPDX-License-Identifier: LGPL-{2.1|3.0}-{only|or-later}", "See the GNU Lesser General Public License for more details."),
    "mit": ("{Released|Licensed|Distributed} under the MIT License.", "{This project|This software|The code} is {MIT licensed|available under the MIT license}.", "SPDX-License-Identifier: MIT", "MIT License, see the file LICENSE for the full terms.", "Copies may be used and sold free of charge as the MIT terms permit."),
    "mpl": ("This {file|Source Code Form} is subject to the terms of the Mozilla Public License, v. 2.0.", "{Licensed|Released} under the Mozilla Public License {2.0|version 2.0}.", "SPDX-License-Identifier: MPL-2.0", "{Available|Distributed} under the MPL 2.0."),
    "proprietary": ("All rights reserved.", "Copyright {2019|2021|2023|2024} {the authors|Acme Ltd|the publisher}. All rights reserved.", "No part of this {work|publication|document} may be reproduced without prior written permission.", "{Confidential and proprietary|Proprietary and confidential}. Unauthorised copying is prohibited."),
}

#: The licences' own wording, a paragraph each.
WORDING_OF: dict[str, tuple[str, ...]] = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to You under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        "You must cause any modified files to carry prominent notices stating that You changed the files; and You must retain, in the Source form of any Derivative Works that You distribute, all copyright, patent, trademark, and attribution notices from the Source form of the Work.",
    ),
    "gpl": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version {2|3} of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version {2.1|3} of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation.",
        "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
    ),
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "This Source Code Form is \"Incompatible With Secondary Licenses\", as defined by the Mozilla Public License, v. 2.0.",
        "All distribution of Covered Software in Source Code Form, including any Modifications that You create or to which You contribute, must be under the terms of this License. You must inform recipients that the Source Code Form of the Covered Software is governed by the terms of this License, and how they can obtain a copy of this License.",
    ),
    "cc-by": ("This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/.",),
    "cc-by-sa": ("This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/.",),
    "cc-by-nc": ("This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/.",),
    "proprietary": (
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means, including photocopying, recording, or other electronic or mechanical methods, without the prior written permission of the publisher.",
        "This software is the confidential and proprietary information of {Acme Ltd|the company}. You shall not disclose such confidential information and shall use it only in accordance with the terms of the license agreement.",
    ),
}

#: Licences outside the families: the first list trains "unknown", the second chooses the threshold. Tests have others.
FOREIGN_TRAINING = (
    "{Released|Licensed} under the Eclipse Public License {1.0|2.0}.",
    "{Licensed|Distributed} under the European Union Public Licence, version 1.2.",
    "{Licensed|Distributed} under the Boost Software License, version 1.0.",
    "{Released|Licensed} under the terms of the Zlib licence.",
    "{Distributed|Released} under the Microsoft Public License.",
    "{Licensed|Available} under the Ruby licence.",
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "Permission is hereby granted to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software.",
    "The Program and the accompanying materials are made available under the terms of the Eclipse Public License which accompanies this distribution.",
)
FOREIGN_THRESHOLD = (
    "{Licensed|Available} under the Academic Free License 3.0.",
    "{Released|Licensed} under the Zope Public License.",
    "{Licensed|Distributed} under the Common Development and Distribution License.",
    "{Released|Licensed} under the University of Illinois Open Source License.",
    "{Licensed|Released} under the Open Software License, version 3.0.",
    "{Licensed|Released} under the PostgreSQL licence.",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software.",
    "The contents of this file are subject to the terms of the Common Development and Distribution License. You may not use this file except in compliance with the License.",
)

#: Sentences that speak of such words without licensing anything, and everyday ones.
NEAR_MISSES = (
    "She renewed her {driving|fishing|hunting} licence at the public office.",
    "The {fishing|hunting|driving|gun|marriage|liquor} {license|licence} is {licensed|issued|granted|given} by the {public office|county|state|town} under the terms of the {law|act|state}.",
    "A {license|licence} for the {boat|car|dog|shop} costs {2|3|40} euros and is valid under the law for one year.",
    "The {engineer|doctor|driver|pilot} is licensed to {work|practise|drive|fly} in this state.",
    "A licensed {electrician|plumber|guide} must be present, subject to the following conditions of the {town|house}.",
    "The {pub|restaurant} lost its licence to sell alcohol.",
    "The number on the license plate was hard to read.",
    "Version {2.0|3.0|4.0} of the {app|game|report} was released in {May|June}.",
    "The {software|tool|service} was provided as is to the {school|office} and worked without any trouble.",
    "{He|She} asked for a copy of the software and a copy of the contract.",
    "Permission was granted to {build the house|cross the field|film in the park}, subject to the rules.",
    "The above notice was included in all copies of the newspaper.",
    "The warranty of the {car|phone|pump} does not include damages by water or use without care.",
    "The redistribution of land was met with the following conditions in the village.",
    "In no event was the mayor liable for the damages, the court said.",
    "The apache helicopter landed near the village.",
    "The general public was invited to the opening of the work.",
    "The library is distributed over two floors and is free to use.",
    "Students at MIT built a small boat.",
    "The creative director praised the commons debate.",
    "All rights and duties were discussed at the meeting.",
    "Human rights were reserved for the last chapter.",
    "The table is reserved under the name of the author.",
    "He works under the supervision of a public notary.",
    "The library is open to the public on all days.",
    "This work is the second version of the text.",
    "A notice about the software was printed on the box.",
    "Permission to enter the park is free of charge on Sundays.",
    "The names of its contributors were read out, and the name of the holder of the record as well.",
    "The foundation published the terms of the general agreement, either in print or on film.",
)

#: Function words and made-up words: prose as such says nothing about licences, whatever its length.
_FUNCTION = (
    "the of and to in is that for on with as by this from at or an be are was it which not have may any all no its under terms work".split(),
    "der die das und in zu den von mit ist im für auf dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei".split(),
    "le la les de des et en un une du dans que qui pour par sur au avec ce est pas plus se son il elle sont ou à être".split(),
    "el la los las de y en que un una por con para se es del al lo como más su no sus este está entre o ha ser son".split(),
)
_SYLLABLES = "an ar be cha da de en er for ge hon in ing ka la lo ment no on ou pa que re sa ti tion und ver wa zu".split()


def _spin(rng: random.Random, template: str) -> str:
    out, at = [], 0
    while (a := template.find("{", at)) >= 0:
        b = template.index("}", a)
        out += [template[at:a], rng.choice(template[a + 1 : b].split("|"))]
        at = b + 1
    return "".join([*out, template[at:]])


def _prose(rng: random.Random, most: int = 30) -> str:
    """Up to `most` words of one language, function words and made-up ones."""
    own = rng.choice(_FUNCTION)
    rate = rng.choice((0.0, 0.3, 0.5, 0.7))
    made = lambda: rng.choice(own) if rng.random() < rate else "".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4)))
    return " ".join(made() for _ in range(rng.randint(3, most))).capitalize() + "."


def _cut(rng: random.Random, text: str) -> str:
    """A stretch of a long paragraph, at least two thirds of it: what is quoted isn't always whole."""
    own = text.split()
    if len(own) < 16 or rng.random() < 0.5:
        return text
    size = rng.randint(len(own) * 2 // 3, len(own))
    at = rng.randint(0, len(own) - size)
    return " ".join(own[at : at + size])


def _paragraph(rng: random.Random, phrases: tuple[str, ...], wording: tuple[str, ...] = ()) -> str:
    """One or two phrases, or a piece of the wording, at times with a word lost, amid prose or alone."""
    if wording and rng.random() < 0.5:
        said = [_cut(rng, _spin(rng, rng.choice(wording)))]
    else:
        said = [_cut(rng, _spin(rng, t)) for t in rng.sample(phrases, min(len(phrases), rng.choice((1, 1, 1, 2))))]
    if rng.random() < 0.15:
        own = said[0].split()
        if len(own) > 5:
            own.pop(rng.randrange(len(own)))
        said[0] = " ".join(own)
    if rng.random() < 0.1:
        said = [s.upper() for s in said]
    before = [_prose(rng)] if rng.random() < 0.25 else []
    after = [_prose(rng)] if rng.random() < 0.35 else []
    return " ".join([*before, *said, *after])


def training_set(per_class: int, seed: int, foreign: tuple[str, ...]) -> tuple[list[str], list[str]]:
    """per_class paragraphs of each family and of "unknown", three times as many of "none"."""
    rng = random.Random(seed)
    texts, labels = [], []
    for name, phrases in FAMILIES.items():
        texts += [_paragraph(rng, phrases, WORDING_OF.get(name, ())) for _ in range(per_class)]
        labels += [name] * per_class
    texts += [_paragraph(rng, foreign) for _ in range(per_class)]
    labels += ["unknown"] * per_class
    # prose of every length up to some hundred words: each n-gram counts once, but a long text has many
    texts += [_prose(rng, rng.choice((10, 60, 400))) if k % 2 else _paragraph(rng, NEAR_MISSES) for k in range(3 * per_class)]
    labels += ["none"] * (3 * per_class)
    return texts, labels


_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?:")] = True
#: What may stand at a line's ends without being part of what it says.
_MARKS = b" \t\r\x0b\x0c\"')]}>*#/%-=_~|"
_MARK = np.zeros(256, bool)
_MARK[list(_MARKS)] = True


def paragraphs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the paragraphs of a piece's documents, and the document of each.

    A paragraph ends behind a blank line or a line that ends a sentence; blank lines go with what is before them.
    """
    ends = np.flatnonzero(data == 10)
    # the last character of each line that counts, found by steps back from its end; -1 where the line has none
    floor = np.maximum(np.concatenate([[0], ends[:-1] + 1])[: len(ends)], offsets[np.searchsorted(offsets, ends, "right") - 1])
    last = ends - 1
    todo = np.arange(len(ends))
    for _ in range(32):
        todo = todo[(last[todo] >= floor[todo]) & _MARK[data[np.maximum(last[todo], 0)]]]
        if not len(todo):
            break
        last[todo] -= 1
    for k in todo:
        last[k] = floor[k] + len(data[floor[k] : ends[k]].tobytes().rstrip(_MARKS)) - 1
    blank = last < floor
    done = blank | _ENDS[data[np.maximum(last, 0)]]
    # a paragraph's end is the last of the blank lines that follow it
    following = np.zeros(len(ends), bool)
    following[:-1] = blank[1:] & (floor[1:] == ends[:-1] + 1)
    cut = ends[done & ~following] + 1
    doc = np.searchsorted(offsets, cut - 1, "right") - 1
    cut, doc = cut[cut < offsets[doc + 1]], doc[cut < offsets[doc + 1]]
    cuts, doc = np.concatenate([offsets[:-1], cut]), np.concatenate([np.arange(len(offsets) - 1), doc])
    order = np.lexsort((cuts, doc))
    return np.append(cuts[order], offsets[-1]), doc[order]


def _features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes of n-grams, paragraph of each) by n."""
    w = common.words(data, offsets)
    owner = w.doc()
    for n in GRAMS:
        keys, at = w.grams(n)
        yield keys ^ common.mix(np.array([n], np.uint64)), owner[at]


@dataclass
class Classifier:
    """classes by column of weights; grams ascending; bias by class; temperature and least probability of a family."""

    classes: list[str]
    grams: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.5

    def __post_init__(self) -> None:
        self.bitmap = np.zeros(1 << 20, bool)
        self.bitmap[self.grams & np.uint64((1 << 20) - 1)] = True

    def known(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(paragraph, feature) pairs, each once."""
        rows, columns = [], []
        for keys, owner in _features(data, offsets):
            at = np.flatnonzero(self.bitmap[keys & np.uint64((1 << 20) - 1)])
            place = np.minimum(np.searchsorted(self.grams, keys[at]), len(self.grams) - 1)
            real = self.grams[place] == keys[at]
            rows.append(owner[at[real]])
            columns.append(place[real])
        pairs = np.unique(np.concatenate(rows) * len(self.grams) + np.concatenate(columns))
        return pairs // len(self.grams), pairs % len(self.grams)

    def probabilities(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The paragraphs that hold a known n-gram, and their calibrated probabilities by class."""
        row, column = self.known(data, offsets)
        some, first = np.unique(row, return_index=True)
        if not len(some):
            return some, np.zeros((0, len(self.classes)))
        return some, softmax((np.add.reduceat(self.weights[column], first, axis=0) + self.bias) / self.temperature)

    def name(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class numbers after the unknown rule, and the probability of having wording of a licence, or of the family."""
        none, unknown = self.classes.index("none"), self.classes.index("unknown")
        family = p.copy()
        family[:, [none, unknown]] = -1
        best = family.argmax(1)
        of = family.max(1)
        chosen = np.where(p[:, none] > 1 - WORDING, none, np.where(of >= self.threshold, best, unknown))
        return chosen, np.where(chosen == best, of, 1 - p[:, none])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _as_piece(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    coded = [t.lower().encode() for t in texts]
    return np.frombuffer(b"".join(coded), np.uint8), np.concatenate([[0], np.cumsum([len(c) for c in coded])])


@lru_cache(2)
def train(per_class: int = PER_CLASS, seed: int = SEED) -> Classifier:
    """Fit weights, then temperature and threshold on paragraphs of another seed. Deterministic; some seconds."""
    texts, labels = training_set(per_class, seed, FOREIGN_TRAINING)
    data, offsets = _as_piece(texts)
    keys, rows = (np.concatenate(x) for x in zip(*_features(data, offsets), strict=True))
    pairs = np.unique(np.stack([keys, rows.astype(np.uint64)], axis=1), axis=0)
    grams, frequency = np.unique(pairs[:, 0], return_counts=True)
    classes = sorted(set(labels))
    model = Classifier(classes, grams[frequency >= LEAST_FREQUENCY], np.zeros(((frequency >= LEAST_FREQUENCY).sum(), len(classes))), np.zeros(len(classes)))
    row, column = model.known(data, offsets)
    target = np.zeros((len(texts), len(classes)))
    target[np.arange(len(texts)), [classes.index(x) for x in labels]] = 1
    some, first = np.unique(row, return_index=True)
    by_column = np.argsort(column, kind="stable")
    seen, column_first = np.unique(column[by_column], return_index=True)
    momentum, bias_momentum = np.zeros_like(model.weights), np.zeros_like(model.bias)
    for _ in range(150):  # full-batch gradient with momentum and an L2 penalty
        logits = np.tile(model.bias, (len(texts), 1))
        logits[some] += np.add.reduceat(model.weights[column], first, axis=0)
        error = softmax(logits) - target
        gradient = np.zeros_like(model.weights)
        gradient[seen] = np.add.reduceat(error[row[by_column]], column_first, axis=0) / len(texts)
        momentum = 0.9 * momentum - 2.0 * (gradient + 1e-5 * model.weights)
        bias_momentum = 0.9 * bias_momentum - 0.2 * error.mean(0)
        model.weights += momentum
        model.bias += bias_momentum
    # a paragraph without any known n-gram is "none", whatever the other biases are
    model.bias[classes.index("none")] = max(model.bias[classes.index("none")], np.delete(model.bias, classes.index("none")).max() + 0.7)
    return calibrated(model, per_class // 2, seed + 1)


def calibrated(model: Classifier, per_class: int, seed: int) -> Classifier:
    texts, labels = training_set(per_class, seed, FOREIGN_THRESHOLD)
    data, offsets = _as_piece(texts)
    model.temperature, model.threshold = 1.0, 0.5
    some, p = model.probabilities(data, offsets)
    truth = np.array([model.classes.index(labels[k]) for k in some])
    logits = np.log(np.maximum(p, 1e-300))
    own = np.array([labels[k] != "unknown" for k in some])  # foreign licences have no class of their own to be sure of
    loss = {t: -np.log(np.maximum(softmax(logits[own] / t)[np.arange(own.sum()), truth[own]], 1e-12)).mean() for t in (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0)}
    model.temperature = min(loss, key=loss.get)
    p = softmax(logits / model.temperature)
    none, unknown = model.classes.index("none"), model.classes.index("unknown")
    family = np.delete(p, [none, unknown], axis=1).max(1)
    known, foreign = family[(truth != none) & (truth != unknown)], family[truth == unknown]
    # the least threshold that tells known from foreign as well as any, but for SLACK
    told = {float(t): (known >= t).mean() + (foreign < t).mean() for t in np.linspace(0.3, 0.99, 70)}
    model.threshold = min(t for t, x in told.items() if x >= max(told.values()) - SLACK)
    return model


def save(spark: SparkSession, model: Classifier, path: str) -> None:
    """The model as two tables under path."""
    table = pa.table({"gram": pa.array(model.grams.view(np.int64)), "weights": pa.array(list(model.weights), pa.list_(pa.float64()))})
    spark.createDataFrame(table).coalesce(1).write.mode("overwrite").parquet(f"{path}/grams")
    whole = [(model.classes, model.bias.tolist(), float(model.temperature), float(model.threshold))]
    spark.createDataFrame(whole, "classes array<string>, bias array<double>, temperature double, threshold double").coalesce(1).write.mode("overwrite").parquet(f"{path}/whole")


def load(spark: SparkSession, path: str) -> Classifier:
    """A model that save() wrote; it is as large as training made it, whatever is scanned."""
    table = spark.read.parquet(f"{path}/grams").toArrow()
    grams = table["gram"].to_numpy().view(np.uint64)
    order = np.argsort(grams)
    whole = spark.read.parquet(f"{path}/whole").first()
    weights = table["weights"].combine_chunks().flatten().to_numpy().reshape(len(grams), -1)
    return Classifier(list(whole["classes"]), grams[order], weights[order], np.array(whole["bias"]), whole["temperature"], whole["threshold"])


@lru_cache(1)
def _template_pairs() -> dict[str, list[frozenset]]:
    rng = random.Random(0)
    out = {}
    for name, phrases in FAMILIES.items():
        spun = {_spin(rng, t) for t in phrases for _ in range(40)}
        for paragraph in WORDING_OF.get(name, ()):
            spun |= {x for _ in range(4) for x in re.split(r"(?<=[.;:]) +", _spin(rng, paragraph)) if len(x.split()) > 5}
        out[name] = [pairs for s in sorted(spun) if (pairs := _pairs(s))]
    return out


def _pairs(text: str) -> frozenset:
    own = "".join(c if c.isalnum() or c == "_" else " " for c in text.lower()).split()
    return frozenset(zip(own, own[1:], strict=False)) if len(own) > 1 else frozenset((w,) for w in own)


def similarity(text: str, family: str) -> float:
    """The greatest share of a template's word pairs that the text contains."""
    own = _pairs(text)
    return max((len(own & t) / len(t) for t in _template_pairs().get(family, ())), default=0.0)


def scan(docs: DataFrame, model: Classifier | None = None, confirm: float = CONFIRM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, paragraph, family, probability, similarity, confirmed): every paragraph with licence wording.

    paragraph is its number in the text, from 0. similarity is null for "unknown".
    """
    common.tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model or train())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        none = own.classes.index("none")
        for batch in batches:
            for low, high, data, offsets in common.pieces(common.lowered(batch.column(1))):
                lines, doc = paragraphs(data, offsets)
                some, p = own.probabilities(data, lines)
                chosen, sure = own.name(p) if len(some) else (np.zeros(0, int), np.zeros(0))
                hit = np.flatnonzero(chosen != none)
                at = some[hit]
                number = at - np.searchsorted(doc, doc[at])
                names = [own.classes[k] for k in chosen[hit]]
                likeness = [None if f == "unknown" else round(similarity(bytes(data[lines[k] : lines[k + 1]]).decode("utf-8", "replace"), f), 6) for k, f in zip(at, names, strict=True)]
                ids = batch.column(0).slice(low, high - low).take(pa.array(doc[at]))
                likeness = pa.array(likeness, pa.float64())
                confirmed = pc.fill_null(pc.greater_equal(likeness, confirm), False)
                yield pa.RecordBatch.from_arrays([ids, pa.array(number.astype(np.int32)), pa.array(names, pa.string()), pa.array(np.round(sure[hit], 6)), likeness, confirmed], names=["doc_id", "paragraph", "family", "probability", "similarity", "confirmed"])

    chosen = common.pick(docs, doc_id=id_col, t=text_col).select(F.col("doc_id").cast("long"), F.col("t").cast("string"))
    return chosen.mapInArrow(run, "doc_id long, paragraph int, family string, probability double, similarity double, confirmed boolean")
