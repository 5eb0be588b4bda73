"""License scans over a positional index of rare words.

Templates are word sequences with mandatory key phrases: notices of a line, and whole texts of short licences. The corpus
gives each word of their vocabulary a document frequency; every template is posted, by position, under its words of highest
IDF (at least `POSTED`, and one for every `EVERY` words of a long one). In a text, those rare words look up their postings,
however many there are, and each hit proposes an alignment (text position less template position). Alignments are verified
by relative position: the key phrases must stand whole, and the IDF mass of the words in place must reach the template's
threshold. A base phrase is a template that is all key phrase, so every place where it stands has its rarest word there and
is found. Words of equal IDF are posted by position. All templates that fit are reported, ties among them too.

Words are maximal runs of ASCII letters and digits and of all characters beyond ASCII, after lower-casing A-Z.
A null text counts as empty: no words, no places, empty label strings, score 0. Repeated rows keep their
multiplicity; other input columns are dropped but doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variorum.llm import bytesops as B

#: Words under which a template is posted: its rarest ones.
POSTED = 3
EVERY = 12


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...]
    least: float = 0.75
    base: bool = False
    words: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "words", tuple(self.text.split()))

    def key_places(self) -> list[int]:
        """Template positions that have to match."""
        out: list[int] = []
        for key in self.keys:
            k = key.split()
            at = next((i for i in range(len(self.words) - len(k) + 1) if list(self.words[i : i + len(k)]) == k), None)
            if at is None:
                raise ValueError(f"{key!r} is not in {self.text!r}")
            out += range(at, at + len(k))
        return sorted(set(out))


#: Phrases whose every place is reported.
BASE = [
    Template("cc-by", "cc by", ("cc by",), 1.0, True),
    Template("gpl", "general public license", ("general public license",), 1.0, True),
    Template("reserved", "all rights reserved", ("all rights reserved",), 1.0, True),
]
#: Opening words of well-known public licences and their usual notices.
NOTICES = [
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "2 0")),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", ("general public license version 2",)),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("general public license version 3",)),
    Template("lgpl", "under the terms of the gnu lesser general public license", ("lesser general public license",), 0.6),
    Template("agpl", "under the terms of the gnu affero general public license", ("affero general public license",), 0.6),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-nd-4.0", "licensed under cc by nd 4 0", ("cc by nd",)),
    Template("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Template("cc0-1.0", "dedicated to the public domain under cc0 1 0 universal", ("cc0 1 0",), 0.6),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted free of charge",), 0.7),
    Template("mit", "licensed under the mit license", ("mit license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",), 0.7),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",), 0.6),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify",), 0.7),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",), 0.7),
]
#: Whole texts of short licences, without titles and copyright lines.
_AS_IS = "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
TEXTS = [
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        ("deal in the software without restriction", "sublicense and or sell copies of the software", "shall be included in all copies or substantial portions"),
        0.6,
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
        ("copy modify and or distribute this software for any purpose", "the author disclaims all warranties", "negligence or other tortious action"),
        0.6,
    ),
    Template("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("redistributions of source code must retain", "redistributions in binary form must reproduce"), 0.6),
    Template("bsd", f"{_AS_IS} in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages", ("by the copyright holders and contributors as is", "special exemplary or consequential damages"), 0.7),
    Template(
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software",
        ("to alter it and redistribute it freely", "the origin of this software must not be misrepresented"),
        0.6,
    ),
]
TEMPLATES = [*BASE, *NOTICES, *TEXTS]

RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,coverage:double>>"


class _Vocabulary:
    """Numbers the templates' words; lookup() numbers a text's words, -1 for all others."""

    def __init__(self, templates: list[Template]) -> None:
        self.words = sorted({w for t in templates for w in t.words})
        hashes = np.array([B.word_hash(w.encode()) for w in self.words], np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two words of the templates have one hash")
        self.lengths = np.unique([len(w.encode()) for w in self.words])
        self.number = {w: i for i, w in enumerate(self.words)}

    def lookup(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word: its row, its place in the row, and its number."""
        low = B.LOWER[raw]
        starts, ends = B.spans(B.WORD[low], offsets[:-1])
        first = np.searchsorted(starts, offsets)
        counts = np.diff(first)
        rows = np.repeat(np.arange(len(counts)), counts)
        places = np.arange(len(starts)) - np.repeat(first[:-1], counts)
        numbers = np.full(len(starts), -1, np.int32)
        some = np.flatnonzero(np.isin(ends - starts, self.lengths))
        if len(some):
            got = B.span_hash(B.running(low), starts[some], ends[some])
            at = np.minimum(np.searchsorted(self.hashes, got), len(self.hashes) - 1)
            hit = self.hashes[at] == got
            numbers[some[hit]] = self.order[at[hit]]
        return rows, places, numbers


def frequencies(docs: DataFrame, templates: list[Template]) -> tuple[dict[str, int], int]:
    """Over all documents: in how many each word of the templates stands, and how many there are.

    What comes to the driver is one row of the vocabulary's size, whatever the corpus's.
    """
    vocabulary = _Vocabulary(templates)
    n = len(vocabulary.words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(n, np.int64), 0
        for batch in batches:
            for lo, hi, raw, offsets in B.pieces(batch.column(0)):
                rows, _, numbers = vocabulary.lookup(raw, offsets)
                there = np.zeros((hi - lo, n), bool)
                known = numbers >= 0
                there[rows[known], numbers[known]] = True
                total += there.sum(axis=0)
                seen += hi - lo
        yield pa.RecordBatch.from_pydict({"word": np.arange(n + 1, dtype=np.int32), "n": np.append(total, seen)})

    counted = docs.select("text").mapInArrow(B.task(count), "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    by = {r["word"]: r["n"] for r in counted}
    return {w: by.get(i, 0) for i, w in enumerate(vocabulary.words)}, by.get(n, 0)


def scan(docs: DataFrame, templates: list[Template] | None = None) -> DataFrame:
    """A row for each document: words, base places, labels, score and the places of all matched templates."""
    templates = TEMPLATES if templates is None else templates
    counts, n_docs = frequencies(docs, templates)
    idf = {w: float(np.log((n_docs + 1) / (c + 1)) + 1e-3) for w, c in counts.items()}
    vocabulary = _Vocabulary(templates)
    weights = np.array([idf[w] for w in vocabulary.words])

    numbered = [np.array([vocabulary.number[w] for w in t.words]) for t in templates]
    index: dict[int, list[tuple[int, int]]] = {}
    for k, (t, numbers) in enumerate(zip(templates, numbered, strict=True)):
        # Key words are the ones sure to be there; the rarest of them finds every place.
        places = sorted(t.key_places(), key=lambda p: (-weights[numbers[p]], p))[: 1 if t.base else max(POSTED, len(numbers) // EVERY)]
        for p in places:
            index.setdefault(int(numbers[p]), []).append((k, p))
    posted = np.zeros(len(vocabulary.words) + 1, bool)  # the last is for -1
    posted[list(index)] = True
    keys = [np.array(t.key_places()) for t in templates]

    def aligned(rows: np.ndarray, numbers: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(template, word positions where it begins, coverage) of all verified alignments."""
        hits = np.flatnonzero(posted[numbers])
        kinds = numbers[hits]
        proposed: dict[int, list[np.ndarray]] = {}
        for number in np.unique(kinds):
            at = hits[kinds == number]
            for k, p in index[int(number)]:
                proposed.setdefault(k, []).append(np.stack([at - p, rows[at]]))
        out = []
        for k, parts in proposed.items():
            begins, row = np.unique(np.concatenate(parts, axis=1), axis=1)
            want, got = numbered[k], np.zeros((begins.size, len(numbered[k])), bool)
            for j, number in enumerate(want):
                at = begins + j
                inside = (at >= 0) & (at < len(numbers))
                got[inside, j] = (numbers[at[inside]] == number) & (rows[at[inside]] == row[inside])
            coverage = np.clip(got @ weights[want] / weights[want].sum(), 0.0, 1.0)
            good = got[:, keys[k]].all(axis=1) & (coverage >= templates[k].least - 1e-9)
            if good.any():
                out.append((k, begins[good], coverage[good]))
        return out

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, offsets in B.pieces(batch.column(1)):
                rows, places, numbers = vocabulary.lookup(raw, offsets)
                n = hi - lo
                found: list[list[tuple[str, int, float]]] = [[] for _ in range(n)]
                base: list[list[tuple[str, int]]] = [[] for _ in range(n)]
                for k, begins, coverage in aligned(rows, numbers):
                    t = templates[k]
                    for at, part in zip(begins.tolist(), coverage.tolist(), strict=True):
                        # A notice may begin before the text does; its place is then the text's first word.
                        row = int(rows[min(max(at + int(keys[k][0]), 0), len(rows) - 1)])
                        first = int(places[at]) if at >= 0 and rows[at] == row else 0
                        found[row].append((t.label, first, part))
                        if t.base:
                            base[row].append((t.label, first))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[lo:hi],
                        pa.array(np.bincount(rows, minlength=n).astype(np.int64)),
                        pa.array([len(b) for b in base], pa.int64()),
                        pa.array([min((p for _, p in b), default=None) for b in base], pa.int64()),
                        pa.array([max((p for _, p in b), default=None) for b in base], pa.int64()),
                        pa.array([",".join(sorted({x for x, _ in b})) for b in base], pa.string()),
                        pa.array([",".join(sorted({x for x, _, _ in f})) for f in found], pa.string()),
                        pa.array([max((c for _, _, c in f), default=0.0) for f in found], pa.float64()),
                        pa.array([[{"label": x, "first_word": p, "coverage": c} for x, p, c in sorted(f)] for f in found], pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("coverage", pa.float64())]))),
                    ],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(B.task(read), RESULT)
