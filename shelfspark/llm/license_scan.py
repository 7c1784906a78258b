"""Operator 5: license scans by template-markup matching.

A template is wording with three marks: ``<<beginOptional>> ... <<endOptional>>``
encloses words that may be missing (regions may be nested), ``<<var;words=0..12>>``
stands for any words within the bounds, ``<<var;match=holder|holders|author>>`` for
one of the given wordings.  It is compiled into a token automaton; a place in a
text is accepted if the automaton goes from its first word to an end with every
mandatory word met exactly.  Short phrases are templates without marks.

``mit-text``, ``bsd-2-clause``, ``bsd-3-clause``, ``isc-text``, ``zlib-text``,
``bsl-1.0-text`` and ``unlicense-text`` stand for the whole license,
``apache-2.0-header``, ``gpl-header`` and ``mpl-2.0-header`` for the whole notice
that goes into files; the other labels say that an opening phrase or a short
notice is there.

A text meets an automaton only if it holds all its mandatory words, and only at
places of its first word.  Defined results: null is the empty text (0 words, no
label, score 0); repeated rows each give a row; the score is the share of the
words that lie in accepted places.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, text_blocks

#: Bytes of words (digits, letters, all beyond ASCII); A-Z are lowered.
_WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8").translate(_WORD_BYTES).split()


@dataclass(frozen=True)
class Template:
    label: str
    markup: str
    base: bool = False


#: The parts that the two BSD licenses share, and the third clause.
_BSD_OPEN = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
)
_BSD_TWO = (
    " <<beginOptional>>1<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    " <<beginOptional>>2<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation"
    " and/or other materials provided with the distribution."
)
_BSD_THIRD = (
    " <<beginOptional>>3<<endOptional>> Neither the name<<beginOptional>>s<<endOptional>> of <<var;words=1..12>> nor the names of <<var;words=1..4>> contributors may be used to endorse or"
    " promote products derived from this software without specific prior written permission."
)
_BSD_END = (
    ' THIS SOFTWARE IS PROVIDED BY <<var;words=1..12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS'
    " FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;words=1..12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING,"
    " BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN"
    " CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"
)

#: The contract's phrases, then common notices with their free parts marked.
TEMPLATES = (
    Template("mit", "mit license", True),
    Template("apache", "apache license", True),
    Template("gpl", "general public license", True),
    Template(
        "mit-permission",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files <<beginOptional>>(the \"Software\")<<endOptional>>, to deal in the Software without restriction",
    ),
    Template(
        "mit-notice",
        "Released under <<beginOptional>>the terms of<<endOptional>> the MIT License",
    ),
    Template(
        "apache-2.0-notice",
        "Licensed under the Apache License, Version 2.0 <<beginOptional>>(the \"License\"); you may not use this file"
        " except in compliance with the License<<endOptional>>",
    ),
    Template(
        "gpl-3.0-notice",
        "licensed under the GNU <<beginOptional>>Lesser<<endOptional>> <<beginOptional>>Affero<<endOptional>> General Public"
        " License, version 3 <<beginOptional>>or any later version<<endOptional>>",
    ),
    Template(
        "gpl-notice",
        "free software; you can redistribute it and/or modify it under the terms of the GNU"
        " <<beginOptional>>Lesser<<endOptional>> General Public License as published by the Free Software Foundation",
    ),
    Template("cc-by-nc-4.0", "CC BY-NC <<beginOptional>>International<<endOptional>> 4.0"),
    Template("cc-by-4.0", "CC BY <<beginOptional>>International<<endOptional>> 4.0"),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
        " the following conditions are met",
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    ),
    Template(
        "mpl-2.0",
        "subject to the terms of the Mozilla Public License, <<beginOptional>>v. 2.0<<endOptional>>"
        " <<beginOptional>>version 2.0<<endOptional>> <<var;words=0..6>> If a copy of the MPL was not distributed",
    ),
    Template(
        "copyright-line",
        "Copyright <<beginOptional>>(c)<<endOptional>> <<var;words=1..8>> All rights reserved",
    ),
    Template(
        "mit-text",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files'
        ' <<beginOptional>>(the "Software")<<endOptional>>, to deal in the Software without restriction, including without limitation the rights to use, copy,'
        " modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,"
        " subject to the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>>"
        ' shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,'
        " INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL"
        " <<var;match=the authors or copyright holders|the author or copyright holder|the copyright holders|the authors>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,"
        " WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    ),
    Template("bsd-2-clause", _BSD_OPEN + _BSD_TWO + _BSD_END),
    Template("bsd-3-clause", _BSD_OPEN + _BSD_TWO + _BSD_THIRD + _BSD_END),
    Template(
        "isc-text",
        "Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted,"
        " provided that the above copyright notice and this permission notice appear in all copies."
        ' THE SOFTWARE IS PROVIDED "AS IS" AND <<var;match=the author|isc|the authors>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES'
        " OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;match=the author|isc|the authors>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY"
        " DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION"
        " WITH THE USE OR PERFORMANCE OF THIS SOFTWARE",
    ),
    Template(
        "zlib-text",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the <<var;match=author|authors>> be held liable for any damages arising from"
        " the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely,"
        " subject to the following restrictions: <<beginOptional>>1<<endOptional>> The origin of this software must not be misrepresented; you must not claim that you wrote the original"
        " software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required."
        " <<beginOptional>>2<<endOptional>> Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software."
        " <<beginOptional>>3<<endOptional>> This notice may not be removed or altered from any source distribution",
    ),
    Template(
        "bsl-1.0-text",
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software")'
        " to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is"
        " furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the"
        " following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are"
        " solely in the form of machine-executable object code generated by a source language processor."
        ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR'
        " PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT,"
        " TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    ),
    Template(
        "unlicense-text",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source"
        " code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this"
        " software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our"
        " heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."
        ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR'
        " PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,"
        " OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    ),
    Template(
        "apache-2.0-header",
        'Licensed under the Apache License, Version 2.0 <<beginOptional>>(the "License")<<endOptional>>; you may not use this file except in compliance with the License. You may obtain a'
        " copy of the License at <<beginOptional>>http<<endOptional>><<beginOptional>>https<<endOptional>> www.apache.org/licenses/LICENSE-2.0 <<beginOptional>>html<<endOptional>>"
        " <<beginOptional>>txt<<endOptional>> Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an"
        ' "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License',
    ),
    Template(
        "gpl-header",
        "This <<var;match=program|file|library|software>> is free software<<beginOptional>>you<<endOptional>> can redistribute it and/or modify it under the terms of the GNU"
        " <<beginOptional>><<var;match=Lesser|Affero|Library>><<endOptional>> General Public License as published by the Free Software Foundation<<var;words=0..3>> version"
        " <<var;match=2|2 1|3>> of the License<<beginOptional>>, or (at your option) any later version<<endOptional>>. <<var;words=1..4>> distributed in the hope that it will be useful,"
        " but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU"
        " <<beginOptional>><<var;match=Lesser|Affero|Library>><<endOptional>> General Public License for more details",
    ),
    Template(
        "mpl-2.0-header",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"
        " <<var;match=http|https>> <<beginOptional>>www<<endOptional>> mozilla.org/MPL/2.0",
    ),
)

_MARK = re.compile(r"<<(beginOptional|endOptional|var;words=(\d+)\.\.(\d+)|var;match=([^<>]+))>>")


class Automaton:
    """States are places in the template; ``step[s][word]`` and ``any[s]`` give
    the next ones, ``skip`` those reached without a word."""

    def __init__(self, template: Template):
        self.template = template
        self.step: list[dict[bytes, int]] = [{}]
        self.any: list[int | None] = [None]
        skip: list[set[int]] = [set()]
        self.mandatory: set[bytes] = set()
        opened: list[int] = []

        def grow() -> int:
            self.step.append({})
            self.any.append(None)
            skip.append(set())
            return len(self.step) - 1

        at, pos = 0, 0
        marks = [*_MARK.finditer(template.markup), None]
        for mark in marks:
            end = mark.start() if mark else len(template.markup)
            for w in words_of(template.markup[pos:end]):
                nxt = grow()
                self.step[at][w] = nxt
                if not opened:
                    self.mandatory.add(w)
                at = nxt
            if mark is None:
                break
            pos = mark.end()
            if mark[1] == "beginOptional":
                nxt = grow()
                skip[at].add(nxt)
                opened.append(at)
                at = nxt
            elif mark[1] == "endOptional":
                nxt = grow()
                skip[at].add(nxt)
                skip[opened.pop()].add(nxt)
                at = nxt
            elif mark[4]:
                last = grow()
                for wording in mark[4].split("|"):
                    s = grow()
                    skip[at].add(s)
                    for w in words_of(wording):
                        nxt = grow()
                        self.step[s][w] = nxt
                        s = nxt
                    skip[s].add(last)
                at = last
            else:
                low, high = int(mark[2]), int(mark[3])
                exits = [at] if low == 0 else []
                for i in range(high):
                    nxt = grow()
                    self.any[at] = nxt
                    at = nxt
                    if i + 1 >= low:
                        exits.append(at)
                last = grow()
                for s in exits:
                    skip[s].add(last)
                at = last
        if opened:
            raise ValueError(f"{template.label}: an optional region does not end")
        self.end = at
        self.close = [self._closure(s, skip) for s in range(len(skip))]
        first = {w for s in self.close[0] for w in self.step[s]}
        if any(self.any[s] is not None for s in self.close[0]) or not first or self.end in self.close[0]:
            raise ValueError(f"{template.label}: a template must begin with a word")
        self.first = sorted(first)

    @staticmethod
    def _closure(s: int, skip) -> frozenset[int]:
        seen, todo = {s}, [s]
        while todo:
            for n in skip[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return frozenset(seen)

    def match(self, words: list[bytes], at: int) -> int | None:
        """End of the longest accepted place that begins at word ``at``."""
        states, end = set(self.close[0]), None
        for i in range(at, len(words)):
            w, nxt = words[i], set()
            for s in states:
                if (t := self.step[s].get(w)) is not None:
                    nxt |= self.close[t]
                if (t := self.any[s]) is not None:
                    nxt |= self.close[t]
            if not nxt:
                break
            if self.end in nxt:
                end = i + 1
            states = nxt
        return end

    def places(self, words: list[bytes]):
        """(start, end) of all accepted places; own templates' ones do not overlap."""
        for first in self.first:
            at = 0
            while True:
                try:
                    at = words.index(first, at)
                except ValueError:
                    break
                end = self.match(words, at)
                if end is not None:
                    yield at, end
                at = end if end is not None and not self.template.base else at + 1


@lru_cache(maxsize=8)
def automata(templates: tuple[Template, ...] = TEMPLATES) -> list[Automaton]:
    return [Automaton(t) for t in templates]


def find(text: str, templates: tuple[Template, ...] = TEMPLATES) -> tuple[int, list[tuple[int, int, int]]]:
    """(number of words, sorted places as (start, end, template))."""
    words = words_of(text)
    present = set(words)
    out = []
    for i, a in enumerate(automata(templates)):
        if a.mandatory <= present:
            out.extend((s, e, i) for s, e in a.places(words))
    return len(words), sorted(out)


def _covered(places) -> int:
    total, upto = 0, 0
    for s, e, _ in places:
        total += max(0, e - max(s, upto))
        upto = max(upto, e)
    return total


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """``id_col``, ``n_words``, ``places`` (array of label, base, start, end in words), ``score``."""
    kind = docs.schema[id_col].dataType.simpleString()
    place = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(it):
        for batch in it:
            for a, texts in text_blocks(batch, 4 << 20):
                found = [find(t, templates) for t in texts]
                listed = [[{"label": templates[i].label, "base": templates[i].base, "start": s, "end": e} for s, e, i in p] for _, p in found]
                score = np.array([_covered(p) / n if n else 0.0 for n, p in found])
                ids = batch.column("_id").slice(a, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([n for n, _ in found], pa.int64()), pa.array(listed, place), pa.array(score, pa.float64())],
                    ["_id", "n_words", "places", "score"],
                )

    schema = f"_id {kind}, n_words long, places array<struct<label:string,base:boolean,start:long,end:long>>, score double"
    return id_text(docs, id_col, text_col).mapInArrow(run, schema).withColumn("places", F.coalesce("places", F.array().cast("array<struct<label:string,base:boolean,start:bigint,end:bigint>>"))).withColumnRenamed("_id", id_col)
