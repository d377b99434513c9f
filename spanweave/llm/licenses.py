"""License scan by sentence rules.

A text is cut into pieces at line ends and after . ! ? ; before white space.
Pieces are normalised (lower case, runs of other than letters and digits made one
space, so that comment marks and bullets do not count). A known licence sentence is
found where one piece, or several that follow each other, make it up: wrapped lines
do, with empty and comment-only lines between them or not. The identifiers
found, in the order of the text, are matched against the rules, the longest rule
first: a rule needs its identifiers next to each other in that order, with ``max_gap``
pieces that are not known between two of them at most (pieces without a letter or digit
do not count), and takes them, so that no other rule counts them.

Null, empty and sentence-free texts have no licence. Very long texts are read whole.
Rows that repeat a doc_id are scanned each. An empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Known licence sentences (identifier, sentence), from the public licence texts and their usual notices.
SENTENCES = [
    ("apache2-notice", "Licensed under the Apache License, Version 2.0."),
    ("apache2-grant", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("apache2-use", "you may not use this file except in compliance with the License."),
    ("apache2-obtain", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache2-warranty", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("apache2-language", "See the License for the specific language governing permissions and limitations under the License."),
    ("mit-notice", "Released under the MIT License."),
    ("mit-notice2", "Licensed under the MIT License."),
    ("mit-grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("mit-include", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit-warranty", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    ("mit-liability", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("gpl3-notice", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl2-free", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("lgpl21-free", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl3-free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-warranty", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("gpl-details", "See the GNU General Public License for more details."),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-endorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd-warranty", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
    ("mpl2-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl2-obtain", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense-notice", "This is free and unencumbered software released into the public domain."),
    ("cc-by-nc4-notice", "Licensed under CC BY-NC 4.0."),
    ("cc-by4-notice", "Licensed under CC BY 4.0."),
    ("cc-by-sa4-notice", "Licensed under CC BY-SA 4.0."),
    ("cc-by4-long", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
]
#: Licence rules (licence, identifiers in order).
LICENSES = [
    ("Apache-2.0", ["apache2-notice"]), ("Apache-2.0", ["apache2-grant", "apache2-use", "apache2-obtain"]), ("Apache-2.0", ["apache2-grant"]),
    ("Apache-2.0", ["apache2-grant", "apache2-use", "apache2-obtain", "apache2-warranty", "apache2-language"]),
    ("MIT", ["mit-notice"]), ("MIT", ["mit-notice2"]), ("MIT", ["mit-grant", "mit-include"]), ("MIT", ["mit-grant", "mit-include", "mit-warranty", "mit-liability"]), ("ISC", ["isc-grant"]),
    ("GPL-3.0-only", ["gpl3-notice"]), ("GPL-3.0-or-later", ["gpl-free"]), ("GPL-2.0-or-later", ["gpl2-free"]), ("GPL-3.0-or-later", ["gpl-free", "gpl-warranty", "gpl-details"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-warranty", "gpl-details"]), ("LGPL-2.1-or-later", ["lgpl21-free"]), ("AGPL-3.0-or-later", ["agpl3-free"]), ("Unlicense", ["unlicense-notice"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]), ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("MPL-2.0", ["mpl2-notice"]), ("CC-BY-NC-4.0", ["cc-by-nc4-notice"]), ("CC-BY-4.0", ["cc-by4-notice"]), ("CC-BY-4.0", ["cc-by4-long"]), ("CC-BY-SA-4.0", ["cc-by-sa4-notice"]),
]
_END = re.compile(r"(?<=[.!?;])\s+|\n+")
_OTHER = re.compile(r"[\W_]+")
_WORD = re.compile(r"[^\W_]+")


def normalised(sentence: str) -> str:
    return _OTHER.sub(" ", sentence.lower()).strip()


def known_sentences(sentences: list[tuple[str, str]]) -> dict[str, list[tuple[str, str]]]:
    """First word -> (identifier, normalised sentence), the longest first."""
    table: dict[str, list] = {}
    for name, text in sentences:
        if known := normalised(text):
            table.setdefault(known.split(" ", 1)[0], []).append((name, known))
    return {k: sorted(v, key=lambda x: -len(x[1])) for k, v in table.items()}


def _taken(pieces: list[str], i: int, sentence: str) -> int:
    """How many pieces from the i-th on make up the sentence; 0: they do not."""
    at = 0
    for j in range(i, len(pieces)):
        piece = normalised(pieces[j])
        if not sentence.startswith(piece, at):
            return 0
        at += len(piece)
        if at == len(sentence):
            return j + 1 - i
        if sentence[at] != " ":
            return 0
        at += 1
    return 0


def identifiers(text: str | None, table: dict) -> list[tuple[str, int, int]]:
    """(identifier, number of the piece it begins at, number of the piece after it) in the order of the text.

    Pieces without a letter or digit (comment marks alone) have no number.
    """
    heads, pieces = [], []
    for piece in _END.split(text.lower()) if text else ():
        if head := _WORD.search(piece):
            heads.append(head.group())
            pieces.append(piece)
    out, i = [], 0
    while i < len(pieces):
        step = 1
        for name, sentence in table.get(heads[i], ()):
            if taken := _taken(pieces, i, sentence):
                out.append((name, i, i + taken))
                step = taken
                break
        i += step
    return out


def matched(found: list[tuple[str, int, int]], rules: list[tuple[str, list[str]]], max_gap: int = 20) -> list[tuple[int, str]]:
    """(place of the first identifier, licence) of each rule that matches, by place."""
    names, near = [n for n, _, _ in found], [b - a <= max_gap for (_, _, a), (_, b, _) in zip(found, found[1:])]
    free, out = [True] * len(names), []
    for licence, needs in sorted(rules, key=lambda r: -len(r[1])):
        n = len(needs)
        for i in range(len(names) - n + 1):
            if names[i : i + n] == needs and all(free[i : i + n]) and all(near[i : i + n - 1]):
                free[i : i + n] = [False] * n
                out.append((i, licence))
    return sorted(out)


def scan(
    docs: DataFrame, sentences: list[tuple[str, str]] | None = None, rules: list[tuple[str, list[str]]] | None = None, id_col: str = "doc_id", text_col: str = "text", max_gap: int = 20
) -> DataFrame:
    """(doc_id, sentence_ids, sentence_places, licenses): lists in the order of the text."""
    table, rules = known_sentences(SENTENCES if sentences is None else sentences), LICENSES if rules is None else rules

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [identifiers(t.as_py(), table) for t in b.column(1)]
            licences = [list(dict.fromkeys(x for _, x in matched(r, rules, max_gap))) if r else [] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([[x[0] for x in r] for r in rows], pa.list_(pa.string())), pa.array([[x[1] for x in r] for r in rows], pa.list_(pa.int32())), pa.array(licences, pa.list_(pa.string()))],
                ["doc_id", "sentence_ids", "sentence_places", "licenses"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, sentence_ids array<string>, sentence_places array<int>, licenses array<string>"
    )
