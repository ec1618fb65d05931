"""License scans: an exact set-similarity join of text blocks with license templates.

A template has a label, a notice of any length and the phrases that name the license. Its blocks are
all runs of ``width`` consecutive words of a text, line ends ignored; the width is the template's
number of words divided by ``THRESHOLD``, which leaves room for comment marks, names and years. A
text of fewer words is one block. A block and a template match if the block holds at least ``THRESHOLD``
of the template's distinct words and every naming phrase, word after word. Words are ordered by
how many texts of the whole corpus hold them, rarest first; with ``need`` the least overlap:

- prefix filter: a match shares one of the template's first ``size - need + 1`` words;
- length filter: a text with fewer than ``need`` template words has no match;
- positional filter: what follows the first shared word on both sides bounds the overlap.

The filters look at a text's words, which hold those of its blocks, so no block is lost; texts that
pass get the exact overlap of every block, by adding up where each word enters and leaves the blocks.
Words that no template has can't add to an overlap. The index is as large as the templates, whatever
the corpus. Null and empty texts have no words. Ids may be whole numbers or strings.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.common import as_bytes, id_kind, ids_and, map_arrow, plain_words

THRESHOLD = 0.8
#: Words of all templates together: what is sent to the executors.
TEMPLATE_WORDS = 1_000_000


@dataclass(frozen=True)
class Template:
    """A notice, its label and the phrases without which a block is not about this license."""

    label: str
    text: str
    naming: tuple[str, ...] = ()

    @property
    def words(self) -> list[bytes]:
        return plain_words(self.text.encode())

    @property
    def phrases(self) -> list[list[bytes]]:
        return [plain_words(p.encode()) for p in self.naming]


# Notices by which a text says under what license it is.
_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE
OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
software without specific prior written permission."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED
TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT
OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE."""


def _gnu(name: str, version: str) -> str:
    return f"""This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software
Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be
useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more
details. You should have received a copy of the {name} along with this program. If not, see"""


TEMPLATES = [
    Template("agpl-3.0", _gnu("GNU Affero General Public License", "3"), ("gnu affero general public license", "version 3")),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license",)),
    Template(
        "apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
        obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See
        the License for the specific language governing permissions and limitations under the License.""",
        ("apache license",),
    ),
    Template("bsd", _BSD_HEAD, ("source and binary forms",)),
    Template("bsd-2-clause", f"{_BSD_HEAD} {_BSD_TAIL}", ("source and binary forms",)),
    Template("bsd-3-clause", f"{_BSD_HEAD} {_BSD_THIRD} {_BSD_TAIL}", ("source and binary forms", "endorse or promote products")),
    Template(
        "bsl-1.0",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation
        covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative
        works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:""",
        ("accompanying documentation covered by this license",),
    ),
    Template("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    Template("cc-by-nc-sa-4.0", "Licensed under CC BY-NC-SA 4.0", ("cc by nc sa 4 0",)),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    Template("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ("creative commons attribution 4 0",)),
    Template("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ("creative commons attribution sharealike 4 0",)),
    Template("gpl-2.0", _gnu("GNU General Public License", "2"), ("gnu general public license", "version 2")),
    Template("gpl-3.0", _gnu("GNU General Public License", "3"), ("gnu general public license", "version 3")),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    Template(
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
        copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
        REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
        DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
        CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
        ("with or without fee",),
    ),
    Template("lgpl-3.0", _gnu("GNU Lesser General Public License", "3"), ("gnu lesser general public license", "version 3")),
    Template("mit", "Released under the MIT License", ("mit license",)),
    Template(
        "mit",
        f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
        "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. {_WARRANTY}""",
        ("to deal in the software without restriction",),
    ),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla public license",)),
    Template("public-domain", "This work has been released into the public domain", ("public domain",)),
    Template(
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
        distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
        ("unencumbered software",),
    ),
    Template(
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising
        from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to
        alter it and redistribute it freely, subject to the following restrictions:""",
        ("alter it and redistribute it freely",),
    ),
]

# Phrases whose places are counted, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def of_table(table: DataFrame) -> list[Template]:
    """Templates of a table ``label, text, naming`` (an array of phrases or null); rows without label or text are left out.

    Raises ValueError if the table has more than ``TEMPLATE_WORDS`` words.
    """
    rows = table.where("label is not null and text is not null")
    if (rows.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0) > TEMPLATE_WORDS:
        raise ValueError(f"more than {TEMPLATE_WORDS} words of templates")
    return sorted((Template(r.label, r.text, tuple(r.naming or ())) for r in rows.select("label", "text", "naming").collect()), key=repr)


class TemplateIndex:
    """Templates with their words in global order, and an index of their prefixes."""

    def __init__(self, templates: Iterable[Template], frequency: dict[bytes, int], threshold: float) -> None:
        order = lambda w: (frequency.get(w, 0), w)
        self.templates = [t for t in templates if t.words]
        if bad := [t.label for t in self.templates if not all(set(t.words).issuperset(p) for p in t.phrases)]:
            raise ValueError(f"naming phrases with words that the template lacks: {bad}")
        self.sorted = [sorted(set(t.words), key=order) for t in self.templates]
        self.need = [max(1, math.ceil(threshold * len(t) - 1e-9)) for t in self.sorted]
        self.width = [max(1, math.ceil(len(t.words) / threshold - 1e-9)) for t in self.templates]
        self.phrases = [t.phrases for t in self.templates]
        self.vocabulary = {w for t in self.sorted for w in t}
        self.order = order
        self.prefix: dict[bytes, list[tuple[int, int]]] = {}
        for k, (t, need) in enumerate(zip(self.sorted, self.need)):
            for i, w in enumerate(t[: len(t) - need + 1]):
                self.prefix.setdefault(w, []).append((k, i))
        self.rare = set(self.prefix)

    def candidates(self, words: set[bytes]) -> Iterator[int]:
        """Templates that some block of a text with these words may match."""
        if self.rare.isdisjoint(words):
            return
        block = sorted(self.vocabulary.intersection(words), key=self.order)
        tried = set()
        for j, w in enumerate(block):
            for k, i in self.prefix.get(w, ()):
                t, need = self.sorted[k], self.need[k]
                if k in tried or len(block) < need:
                    continue
                tried.add(k)  # this is the first word that the two share
                if 1 + min(len(t) - i - 1, len(block) - j - 1) >= need and sum(x in words for x in t) >= need and all(words.issuperset(p) for p in self.phrases[k]):
                    yield k

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
        """(template, first, end, overlap): all blocks that start at ``first`` or later and end by ``end``
        match, and ``overlap`` is the largest of theirs; every matching block is in one of these runs."""
        found = list(self.candidates(set(words)))
        if not found:
            return
        wanted = {w for k in found for w in self.sorted[k]}
        places: dict[bytes, list[int]] = {}
        for i, w in enumerate(words):
            if w in wanted:
                places.setdefault(w, []).append(i)
        for k in found:
            width = min(self.width[k], len(words))
            starts = len(words) - width + 1
            here = [np.array(places[w]) for w in self.sorted[k] if w in places]
            # a word is in the blocks that start up to width - 1 places before it, but after its last place
            low = np.concatenate([np.maximum(p - width + 1, np.r_[0, p[:-1] + 1]) for p in here])
            overlap = _added(low, np.minimum(np.concatenate(here), starts - 1), starts)
            match = overlap >= self.need[k]
            for phrase in self.phrases[k]:
                if match.any():
                    at = np.array([i for i in places[phrase[0]] if words[i : i + len(phrase)] == phrase], dtype=np.int64)
                    match &= _added(np.maximum(at + len(phrase) - width, 0), np.minimum(at, starts - 1), starts) > 0
            edge = np.flatnonzero(np.diff(np.r_[False, match, False]))
            for first, last in zip(edge[::2].tolist(), edge[1::2].tolist()):
                yield k, first, last - 1 + width, int(overlap[first:last].max())


def _added(low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
    """For each of n numbers how many of the ranges [low, high] hold it."""
    ok = low <= high
    steps = np.bincount(low[ok], minlength=n + 1)[: n + 1] - np.bincount(high[ok] + 1, minlength=n + 1)[: n + 1]
    return np.cumsum(steps[:-1])


def frequencies(docs: DataFrame, templates: Iterable[Template] = TEMPLATES, text_col: str = "text") -> dict[bytes, int]:
    """In how many texts of the whole corpus each template word is; as many numbers as templates have words."""
    vocabulary = {w for t in templates for w in t.words}

    def run(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        n: Counter[bytes] = Counter()
        for batch in batches:
            for text in as_bytes(batch.column(0)):
                n.update(vocabulary.intersection(plain_words(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], schema=schema)

    counts = map_arrow(docs.select(F.col(text_col).alias("text")), run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): r.n for r in counts.collect()}


FOUND = "doc_id {id}, n_words bigint, base array<struct<label:string,word:int>>, matches array<struct<template:string,first:int,end:int,containment:double>>"


def find(docs: DataFrame, templates: Iterable[Template] | DataFrame = TEMPLATES, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row the places of the base phrases and the runs of matching blocks, as places in words from 0.

    A run from ``first`` to ``end`` says that all blocks inside it match; ``containment`` is the largest of theirs.
    """
    templates = of_table(templates) if isinstance(templates, DataFrame) else list(templates)
    if sum(len(t.words) for t in templates) > TEMPLATE_WORDS:
        raise ValueError(f"more than {TEMPLATE_WORDS} words of templates")
    index = TemplateIndex(templates, frequencies(docs, templates, text_col), threshold)
    phrases = [(p.encode().split(), label) for p, label in PHRASES.items()]

    def run(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, bases, matches = [], [], []
            for text in as_bytes(batch.column(1)):
                words = plain_words(text)
                base = []
                whole = set(words)
                for phrase, label in phrases:
                    if whole.issuperset(phrase):
                        i = -1
                        while True:
                            try:
                                i = words.index(phrase[0], i + 1)
                            except ValueError:
                                break
                            if words[i : i + len(phrase)] == phrase:
                                base.append({"label": label, "word": i})
                found = [
                    {"template": index.templates[k].label, "first": first, "end": end, "containment": overlap / len(index.sorted[k])}
                    for k, first, end, overlap in index.matches(words)
                ]
                n_words.append(len(words))
                bases.append(base)
                matches.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, f.type) for x, f in zip((n_words, bases, matches), list(schema)[1:]))], schema=schema)

    return map_arrow(ids_and(docs, id_col, text_col), run, FOUND.format(id=id_kind(docs, id_col)))


def report(found: DataFrame) -> DataFrame:
    """The digest of ``find``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    base = F.transform("base", lambda b: b["label"])
    named = F.transform("matches", lambda m: m["template"])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["word"])).cast("bigint").alias("first_word"),
        F.array_max(F.transform("base", lambda b: b["word"])).cast("bigint").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, named)).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)).alias("score"),
    )
