"""License texts and notices by a positional index of rare words.

Templates (whole short licences, the notices of long ones, and SPDX lines) are split into words (A-Z lower-cased). One pass counts in how many texts each
template word occurs, over all of them; that gives each word's inverse document
frequency (IDF). The index lists, for every template word, the templates and places
that hold it.

A second pass looks up each text's template words. A template whose words, weighted
by IDF, are there to less than `FLOOR` cannot be in place to more, so it is left. For
the others the text's words of highest IDF vote for the start that their places in
template and text give. At each start with enough votes the share of template words
found in place, by IDF, is counted; the best share of all templates is the score (0 if
none has a start). A template is reported if its share reaches `threshold` and one of
its mandatory key phrases stands there word by word.

Phrases given by the caller are labels of their own, wherever they stand: each is
looked up by its rarest word and verified word by word around it. They are no templates:
a text with nothing but a phrase gets no score from it.

The templates and the IDF table are fixed in size and sent to every task. Nulls: a
null text has no words. Every row gives one row; repeated rows, null doc_ids and
extra columns need nothing else. A very long text is read whole, with memory in
proportion to its length; ties of IDF go by the word. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm import textkit

#: Phrases whose places are counted, with their labels.
PHRASES = [
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
]
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."


def _gnu(name: str, version: str) -> str:
    return f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."


#: Public licence texts and notices, as (label, text, key phrases of which one is mandatory).
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ["apache license"]),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        ["apache license"],
    ),
    ("mit", "Released under the MIT License", ["mit license"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        + _AS_IS
        + " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        ["permission is hereby granted free of charge"],
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        ["for any purpose with or without fee"],
    ),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ["gnu general public license"]),
    ("gpl-2.0", _gnu("General Public License", "2"), ["version 2 of the license"]),
    ("gpl-3.0", _gnu("General Public License", "3"), ["version 3 of the license"]),
    ("lgpl-2.1", _gnu("Lesser General Public License", "2.1"), ["gnu lesser general public license"]),
    ("lgpl-3.0", _gnu("Lesser General Public License", "3"), ["gnu lesser general public license"]),
    ("agpl-3.0", _gnu("Affero General Public License", "3"), ["gnu affero general public license"]),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ["cc by nc"]),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4 0"]),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["creative commons attribution sharealike 4 0"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("bsd-2-clause", f"{_BSD_START} {_BSD_END}", ["redistribution and use in source and binary forms"]),
    ("bsd-3-clause", f"{_BSD_START} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_END}", ["neither the name of"]),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license"]),
    ("unlicense", "This is free and unencumbered software released into the public domain.", ["free and unencumbered software"]),
]
#: SPDX identifiers; "-only" and "-or-later" name the same licence.
SPDX = ["Apache-2.0", "MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "Unlicense", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "CC-BY-4.0", "CC-BY-SA-4.0"]
TEMPLATES = [(name.lower(), f"SPDX-License-Identifier: {name}", [f"spdx license identifier {name.lower()}"]) for name in SPDX] + TEMPLATES
THRESHOLD = 0.8
#: A template with a smaller share of its words in a text, wherever they stand, is not looked for.
FLOOR = 0.5
#: Words of highest IDF that vote for a template's start, as a share of its different words.
ANCHORS = 0.5


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(textkit.ALNUM_FOLD).split()


class Index:
    """Templates and phrases by word and place."""

    def __init__(self, templates, phrases) -> None:
        self.phrases = [(_words(p), label) for p, label in phrases if _words(p)]
        whole = [(label, _words(text), [_words(k) for k in keys]) for label, text, keys in templates if _words(text)]
        self.labels = [label for label, _, _ in whole]
        self.words = [words for _, words, _ in whole]
        self.keys = [[b" " + b" ".join(k) + b" " for k in keys] for _, _, keys in whole]
        self.places: list[dict[bytes, list[int]]] = []
        for words in self.words:
            at: dict[bytes, list[int]] = {}
            for place, w in enumerate(words):
                at.setdefault(w, []).append(place)
            self.places.append(at)
        self.vocabulary = {w for words in [*self.words, *(p for p, _ in self.phrases)] for w in words}

    def weigh(self, frequency: dict[bytes, int], n: int) -> None:
        """Takes the corpus counts: IDF by word, each template's weight, its words by falling IDF."""
        self.idf = {w: math.log((n + 1) / (frequency.get(w, 0) + 1)) + 1.0 for w in self.vocabulary}
        self.total = [sum(self.idf[w] for w in words) for words in self.words]
        self.rarest = [sorted(at, key=lambda w: (-self.idf[w], w)) for at in self.places]
        self.shares: dict[bytes, list[tuple[int, float]]] = {}
        for t, at in enumerate(self.places):
            for w, places in at.items():
                self.shares.setdefault(w, []).append((t, len(places) * self.idf[w] / self.total[t]))


def _count(batches, index: Index):
    total: Counter[bytes] = Counter()
    n = 0
    known = index.vocabulary
    for batch in batches:
        for text in batch.column("text").to_pylist():
            n += 1
            total.update(known & set(_words(text)))
    words = [w.decode() for w in total]
    yield pa.RecordBatch.from_arrays([pa.array([*words, None], pa.string()), pa.array([*total.values(), n], pa.int64())], names=["word", "n"])


class Places:
    """Where words stand in one text, looked up when asked."""

    def __init__(self, words: list[bytes]) -> None:
        self.words = words
        self.found: dict[bytes, list[int]] = {}

    def of(self, word: bytes) -> list[int]:
        if word not in self.found:
            places, at = [], -1
            for _ in range(self.words.count(word)):
                at = self.words.index(word, at + 1)
                places.append(at)
            self.found[word] = places
        return self.found[word]


def match(places: Places, here: set[bytes], index: Index, threshold: float) -> tuple[float, set[str]]:
    """Best share in place, and labels of the templates found."""
    words, best, labels = places.words, 0.0, set()
    bag = [0.0] * len(index.words)
    for w in here:
        for t, share in index.shares.get(w, ()):
            bag[t] += share
    for t, most in enumerate(bag):
        if most < FLOOR - 1e-9:
            continue
        template, at = index.words[t], index.places[t]
        anchors = [w for w in index.rarest[t] if w in here][: max(1, math.ceil(ANCHORS * len(at)))]
        votes = Counter(i - place for w in anchors for i in places.of(w) for place in at[w])
        least = max(1, len(anchors) // 2)
        for start, n in votes.items():
            if n < least:
                continue
            low, high = max(0, start), min(len(words), start + len(template))
            share = sum(index.idf[words[i]] for i in range(low, high) if words[i] == template[i - start]) / index.total[t]
            best = max(best, share)
            if share >= threshold:
                near = b" ".join([b"", *words[max(0, low - len(template)) : high + len(template)], b""])
                if any(k in near for k in index.keys[t]):
                    labels.add(index.labels[t])
    return min(1.0, best), labels


def phrase_places(places: Places, here: set[bytes], index: Index) -> list[tuple[int, str]]:
    """(place, label) of each phrase, looked up by its rarest word."""
    found = []
    for words, label in index.phrases:
        if here.issuperset(words):
            rare = min(words, key=lambda w: (-index.idf[w], w))
            lead = words.index(rare)
            found += [(i - lead, label) for i in places.of(rare) if i >= lead and places.words[i - lead : i - lead + len(words)] == words]
    return found


def _scan(batches, index: Index, threshold: float):
    for batch in batches:
        rows: list[list] = [[] for _ in range(8)]
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
            words = _words(text.as_py())
            here = index.vocabulary & set(words)
            score, found, based = 0.0, set(), []
            if here:
                places = Places(words)
                score, found = match(places, here, index, threshold)
                based = phrase_places(places, here, index)
            at, base = [p for p, _ in based], {label for _, label in based}
            for column, value in zip(rows, (doc_id.as_py(), len(words), len(at), min(at, default=None), max(at, default=None), sorted(base), sorted(base | found), score), strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])


def scan_licenses(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels (arrays), score."""
    index = Index(templates, phrases)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = rows.select("text").mapInArrow(lambda batches: _count(batches, index), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # one row per template word
    frequency = {r["word"]: r["n"] for r in counted}
    n = frequency.pop(None, 0)
    index.weigh({w.encode(): c for w, c in frequency.items()}, n)
    return rows.mapInArrow(
        lambda batches: _scan(batches, index, threshold),
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double",
    )


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan_licenses(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")
