"""Held-out accuracy of the licence classifier, and its scan."""

import numpy as np
import pytest

from tests.llm.conftest import prose
from vellumspark.llm import licences


@pytest.fixture(scope="module")
def model():
    return licences.train()


def named(model, texts):
    data, offsets = licences._as_piece(texts)
    some, p = model.probabilities(data, offsets)
    chosen, _ = model.name(p)
    out = ["none"] * len(texts)
    for k, c in zip(some, chosen, strict=True):
        out[k] = model.classes[c]
    return out


#: Licences that neither training nor the threshold has seen.
OTHERS = (
    "{Released|Licensed|Distributed} under the Artistic License 2.0.",
    "This font is licensed under the SIL Open Font License, version 1.1.",
    "{Licensed|Released} under the Python Software Foundation License.",
    "{Licensed|Distributed} under the Common Public Attribution License Version 1.0.",
    "{Licensed|Released} under the terms of the Vim licence.",
    "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License.",
)


def test_held_out_accuracy(model):
    texts, labels = licences.training_set(150, 12345, OTHERS)
    got = named(model, texts)
    by = {c: np.mean([g == x for g, x in zip(got, labels, strict=True) if x == c]) for c in set(labels)}
    assert by["none"] > 0.995 and min(v for c, v in by.items() if c not in ("none", "unknown")) > 0.93
    # licences of no known family, none of which training has seen
    assert by["unknown"] > 0.75


def test_near_misses_are_none(model):
    assert set(named(model, [t.replace("{", "").replace("}", "").replace("|", " ") for t in licences.NEAR_MISSES])) == {"none"}


MIT = '''Copyright (c) 2024 Jo Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
'''
APACHE = '''# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
'''


def test_wrapped_licences_are_named_and_confirmed(spark, model):
    rows = [(1, MIT), (2, APACHE), (3, "The fishing license is licensed by the public office under the terms of the law."), (4, "\r\n".join(MIT.split("\n")))]
    got = licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    for i in (1, 4):
        assert [(r.paragraph, r.family, r.confirmed) for r in sorted(got) if r.doc_id == i] == [(k, "mit", True) for k in (1, 2, 3)]
    apache = [r for r in got if r.doc_id == 2]
    assert {r.family for r in apache} == {"apache"} and sum(r.confirmed for r in apache) >= 2
    assert not [r for r in got if r.doc_id == 3]


FILES = "/opt/py313/lib/python3.13/site-packages"


@pytest.mark.parametrize(
    ("file", "family"),
    [
        (f"{FILES}/pluggy-1.7.0.dist-info/licenses/LICENSE", "mit"),
        (f"{FILES}/pyspark/licenses/LICENSE-jquery.txt", "mit"),
        (f"{FILES}/psutil-7.2.2.dist-info/LICENSE", "bsd"),
        (f"{FILES}/idna-3.20.dist-info/licenses/LICENSE.md", "bsd"),
        (f"{FILES}/packaging-26.3.dist-info/licenses/LICENSE.APACHE", "apache"),
        ("/usr/share/common-licenses/MPL-2.0", "mpl"),
        ("/usr/share/common-licenses/LGPL-2.1", "lgpl"),
        ("/usr/share/common-licenses/GPL-3", "gpl"),
    ],
)
def test_licence_files_of_other_projects(model, file, family):
    """Of the paragraphs that are named and confirmed, the file's licence is named most, by half or more: licences speak of each other."""
    from collections import Counter
    from pathlib import Path

    if not Path(file).exists():
        pytest.skip("not on this machine")
    text = Path(file).read_text(errors="replace").lower().encode()
    cuts, _ = licences.paragraphs(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    said = [text[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    found = Counter(f for f, t in zip(named(model, said), said, strict=True) if f not in ("none", "unknown") and licences.similarity(t, f) >= licences.CONFIRM)
    assert found.most_common(1)[0][0] == family and found[family] >= 0.5 * sum(found.values())


def test_saved_model_scans_alike(spark, model, tmp_path):
    licences.save(spark, model, f"file://{tmp_path}/model")
    again = licences.load(spark, f"file://{tmp_path}/model")
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = lambda m: sorted(map(str, licences.scan(df, m).collect()))
    assert rows(again) == rows(model) and len(rows(model)) > 10


def test_licence_lines_of_the_given_documents(spark, model):
    """Against plain search for the lines that the table holds; nothing else in it is a licence."""
    said = {"Licensed under CC BY-NC 4.0.": "cc-by-nc", "Licensed under the Apache License, Version 2.0.": "apache", "This work is licensed under the GNU General Public License, version 3.": "gpl", "Released under the MIT License.": "mit", "All rights reserved.": "proprietary"}
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    want = sorted((r.doc_id, f) for r in df.collect() for x, f in said.items() for _ in range(r.text.lower().count(x.lower())))
    got = licences.scan(df, model).collect()
    assert sorted((r.doc_id, r.family) for r in got if r.confirmed) == want
    assert len(got) - len(want) < 0.001 * df.count()


def test_scan(spark, model):
    text = f"{prose(1, 30)}\nReleased under the MIT License.\n\nLicensed under CC BY-NC 4.0. {prose(2, 200)}.\nreleased UNDER the mit LICENSE."
    df = spark.createDataFrame([(1, text), (2, prose(3, 500)), (3, "Licensed under the European Union Public Licence, version 1.2.")], "doc_id long, text string")
    got = {(r.doc_id, r.paragraph): r for r in licences.scan(df, model).collect()}
    assert {k: r.family for k, r in got.items()} == {(1, 0): "mit", (1, 1): "cc-by-nc", (1, 2): "mit", (3, 0): "unknown"}
    assert all(r.confirmed and r.similarity == 1 for k, r in got.items() if k[0] == 1)
    assert got[3, 0].similarity is None and not got[3, 0].confirmed and got[3, 0].probability >= licences.WORDING


def test_similarity():
    assert licences.similarity("so it is released under the mit license. thanks", "mit") == 1
    assert licences.similarity("nothing of the kind", "mit") < 0.3 and licences.similarity("x", "unknown") == 0


def slow_paragraphs(text):
    out, held = [], ""
    lines = text.splitlines(keepends=True) if "\n" in text else [text]
    blank = lambda line: not line.strip(" \t\r\n\x0b\x0c\"')]}>*#/%-=_~|")
    for k, line in enumerate(lines):
        held += line
        ended = line.endswith("\n") and (blank(line) or line.rstrip(" \t\r\n\x0b\x0c\"')]}>*#/%-=_~|")[-1] in ".!?:")
        if ended and not (k + 1 < len(lines) and lines[k + 1].endswith("\n") and blank(lines[k + 1])):
            out.append(held)
            held = ""
    return [*out, held] if held or not out else out


def test_paragraphs():
    import random

    rng = random.Random(5)
    texts = ["a\nb", "", "\n\ncd.\n", "one\ntwo.\n\n\nthree\n# four\n#\nfive:" + " " * 50 + "\nsix"]
    texts += ["".join(rng.choice(["word ", "end. ", "\n", "\n", "#", "* ", '"', " ", ":"]) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    data, offsets = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
    cuts, doc = licences.paragraphs(data, offsets)
    got = [[] for _ in texts]
    for k, d in enumerate(doc):
        got[d].append(data[cuts[k] : cuts[k + 1]].tobytes().decode())
    assert got == [slow_paragraphs(t) for t in texts]


def test_awkward_rows(awkward, crowded, empty, model):
    assert licences.scan(awkward, model).count() == licences.scan(crowded, model).count() == licences.scan(empty, model).count() == 0
