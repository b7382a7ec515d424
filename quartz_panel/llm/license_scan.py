"""Licence scans: templates with optional and replaceable regions, compiled into token automata.

Markup: ``[[ ... ]]`` encloses wording that a text may leave out, ``{{n}}`` stands for up to n words
of any kind (a name, a year, a version), ``{{a|b}}`` for one of the words named.  The rest is mandatory
and must stand word for word, in order and without other words between.  A run that follows one of
NEGATIONS within two words is no acceptance ("not licensed under the mit license").  A template compiles into an automaton whose states are places
between tokens; optional regions and replaceable words are skips from one state to a later one.  All
states that a text can be in are carried along, so nothing is tried twice; the longest acceptance wins.
The first mandatory word of each template starts the scan, so other texts cost one search.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textops import LOWER, text_chunks

#: Base phrases and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Templates by label, worded by hand after well-known notices.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0 [[the license you may not use this file except in compliance with the license]]",
    "apache-other": "[[this {{1}} is]] licensed under [[the terms of]] the apache license version {{2}}",
    "mit-notice": "[[this {{1}} is]] [[released]] under [[the terms of]] the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [[the software]] to deal in the software without restriction",
    "gpl-notice": "[[this {{1}} is]] licensed under [[the terms of]] the gnu [[lesser]] [[affero]] general public license [[version {{2}}]] [[or any later version]]",
    "gpl-grant": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    **{f"cc-by{k}": f"licensed under [[a]] [[the]] [[creative commons]] cc by{k.replace('-', ' ')} {{{{1|2|3|4}}}} {{{{0|5}}}}" for k in ("", "-sa", "-nd", "-nc", "-nc-sa", "-nc-nd")},
    "cc-attribution": "licensed under [[a]] [[the]] creative commons attribution {{1|2|3|4}} {{0|5}} [[international]] [[unported]] [[generic]] license",
    "rights-reserved": "copyright {{6}} all rights reserved",
    "public-domain": "this {{2}} is [[hereby]] [[released]] [[dedicated]] [[placed]] {{in|into|to}} the public domain",
}

#: A notice after one of these words says what a text is not under.
NEGATIONS = {b"not", b"never", b"nor", b"neither", b"isn", b"aren", b"wasn"}

_BSD = """redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: [[1]] redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. [[2]] redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution. %s this software is provided by {{8}} as is and any express or implied warranties, including, but not limited
to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. in no event shall {{8}}
be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to,
procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on
any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any
way out of the use of this software, even if advised of the possibility of such damage"""

#: Whole licence texts and file headers; wording fixed by the licences, names and numbering optional or replaceable.
TEMPLATES |= {
    "mit-text": """permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the software), to deal in the software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom
the software is furnished to do so, subject to the following conditions: the above copyright notice and this permission
notice [[(including the next paragraph)]] shall be included in all copies or substantial portions of the software. the
software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of
merchantability, fitness for a particular purpose and noninfringement. in no event shall {{8}} be liable for any claim,
damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with
the software or the use or other dealings in the software""",
    "isc-text": """permission to use, copy, modify, and [[/or]] distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies. the software is
provided as is and {{8}} disclaims all warranties with regard to this software including all implied warranties of
merchantability and fitness. in no event shall {{8}} be liable for any special, direct, indirect, or consequential damages or
any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other
tortious action, arising out of or in connection with the use or performance of this software""",
    "bsd-2-text": _BSD % "",
    "bsd-3-text": _BSD % "[[3]] neither the name of {{8}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "apache-2.0-header": """licensed under the apache license, version 2.0 (the license); you may not use this file except in
compliance with the license. you may obtain a copy of the license at [[http]] [[https]] www.apache.org/licenses/license-2.0
unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an as is
basis, without warranties or conditions of any kind, either express or implied. see the license for the specific language
governing permissions and limitations under the license""",
    "mpl-2.0-header": """this source code form is subject to the terms of the mozilla public license, v. 2.0. if a copy of the mpl
was not distributed with this file, you can obtain one at [[http]] [[https]] [[www]] mozilla.org/mpl/2.0""",
    "gpl-header": """this program is free software: you can redistribute it and/or modify it under the terms of the gnu general
public license as published by the free software foundation, either version {{1}} of the license, or [[(at your option)]] any
later version. this program is distributed in the hope that it will be useful, but without any warranty; without even the
implied warranty of merchantability or fitness for a particular purpose. see the gnu general public license for more details""",
    "zlib-text": """this software is provided as-is, without any express or implied warranty. in no event will the authors be held
liable for any damages arising from the use of this software. permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions: [[1]] the origin of this software must not be misrepresented; you must not claim that you wrote the original
software. if you use this software in a product, an acknowledgment in the product documentation would be appreciated but is
not required. [[2]] altered source versions must be plainly marked as such, and must not be misrepresented as being the
original software. [[3]] this notice may not be removed or altered from any source distribution""",
    "unlicense-text": """this is free and unencumbered software released into the public domain. anyone is free to copy, modify, publish,
use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means""",
}
#: The headers of the two sister licences differ in its name and in what they call the work.
TEMPLATES |= {
    f"{short}-header": TEMPLATES["gpl-header"].replace("this program", "this {{program|library|software}}").replace("gnu general", f"gnu {name} general").replace("version {{1}}", "version {{2}}")
    for short, name in (("lgpl", "lesser"), ("agpl", "affero"))
}


def strength(label: str) -> float:
    """How much an accepted template says: a whole text or header 1, a notice 0.8, a grant's beginning 0.6, a mere claim of rights 0.2."""
    if label.endswith(("-text", "-header")):
        return 1.0
    return 0.6 if label.endswith("-grant") else 0.2 if label == "rights-reserved" else 0.8


_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_MARK = re.compile(r"\[\[|\]\]|\{\{(\d+)\}\}|\{\{([0-9a-z]+(?:\|[0-9a-z]+)+)\}\}|([0-9a-z]+)")


@dataclass
class Automaton:
    """Steps from state i to i + 1 on words[i] (None: any word, a set: one of it); skips[i]: states reachable without a word."""

    words: list
    skips: list[list[int]]
    mandatory: list[int]

    def first_words(self) -> set:
        """Words that an acceptance can begin with."""
        firsts = (self.words[s] for s in self._closed({0}) if s < len(self.words))
        return {w for f in firsts for w in (f if isinstance(f, frozenset) else (f,))}

    def _closed(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return out

    def _takes(self, state: int, word) -> bool:
        w = self.words[state]
        return w is None or w == word or (isinstance(w, frozenset) and word in w)

    def longest_from(self, words: list, start: int) -> int:
        """End of the longest accepted run of words from ``start``, or -1."""
        states, end, goal = self._closed({0}), -1, len(self.words)
        for i in range(start, len(words)):
            states = self._closed({s + 1 for s in states if s < goal and self._takes(s, words[i])})
            if goal in states:
                end = i + 1
            if not states:
                break
        return end


def compiled(template: str) -> Automaton:
    """Markup to automaton; brackets must balance and some wording be mandatory."""
    words: list = []
    skips: list[list[int]] = [[]]
    opened: list[int] = []
    mandatory = []
    for m in _MARK.finditer(template):
        if m[0] == "[[":
            opened.append(len(words))
        elif m[0] == "]]":
            skips[opened.pop()].append(len(words))
        else:
            named = [m[3].encode()] if m[3] else [frozenset(m[2].encode().split(b"|"))] if m[2] else [None] * int(m[1])
            for word in named:
                if word is None:
                    skips[-1].append(len(words) + 1)
                elif not opened:
                    mandatory.append(len(words))
                words.append(word)
                skips.append([])
    if opened or not any(isinstance(words[i], bytes) for i in mandatory):
        raise ValueError(f"unbalanced or without mandatory wording: {template}")
    return Automaton(words, skips, mandatory)


class Scanner:
    def __init__(self, templates: dict[str, str], phrases: dict[str, str]):
        self.automata = {label: compiled(t) for label, t in templates.items()}
        self.starts: dict = {}
        for label, a in self.automata.items():
            for w in a.first_words():
                if w is None:
                    raise ValueError(f"{label} may begin with any word")
                self.starts.setdefault(w, []).append(label)
        self.phrases = [(p.encode().split(), label) for p, label in phrases.items()]
        needed = {max((a.words[i] for i in a.mandatory if isinstance(a.words[i], bytes)), key=len) for a in self.automata.values()} | {max(p, key=len) for p, _ in self.phrases}
        self.any_needed = re.compile(b"|".join(map(re.escape, sorted(needed))))

    def scan(self, low: bytes) -> tuple[list[tuple[int, str]], list[tuple[str, int, int]]]:
        """(word place, label) of each base phrase; (label, first word, end word) of each accepted template."""
        if not self.any_needed.search(low):
            return [], []
        words = _WORD.findall(low)
        base, found, after = [], [], {}
        for i, w in enumerate(words):
            for phrase, label in self.phrases:
                if w == phrase[0] and words[i : i + len(phrase)] == phrase:
                    base.append((i, label))
            for label in self.starts.get(w, ()):
                if i >= after.get(label, 0) and not NEGATIONS.intersection(words[max(i - 2, 0) : i]) and (end := self.automata[label].longest_from(words, i)) > 0:
                    found.append((label, i, end))
                    after[label] = end
        return base, found


def _scanned(batches: Iterator[pa.RecordBatch], templates: dict[str, str], phrases: dict[str, str]) -> Iterator[pa.RecordBatch]:
    scanner, word_byte = Scanner(templates, phrases), np.zeros(256, bool)
    word_byte[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
    for batch in batches:
        for lo, hi, data, offsets in text_chunks(batch):
            low = LOWER[data]
            inside = word_byte[low]
            begins = inside.copy()
            begins[1:] &= ~inside[:-1]
            edges = offsets[:-1][offsets[:-1] < len(data)]
            begins[edges] = inside[edges]
            seen = np.concatenate([[0], np.cumsum(begins)])
            n_words = seen[offsets[1:]] - seen[offsets[:-1]]
            low = low.tobytes()
            base, found = zip(*(scanner.scan(low[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)), strict=True)
            spans = [[{"label": x, "first_word": a, "end_word": b} for x, a, b in one] for one in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(lo, hi - lo),
                    pa.array(n_words, pa.int64()),
                    pa.array([[{"label": x, "first_word": i} for i, x in one] for one in base], pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64())]))),
                    pa.array(spans, pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64())]))),
                ],
                names=["doc_id", "n_words", "base", "matches"],
            )


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, base (label and first word of each phrase place), matches (label, first and end
    word of each accepted template), a row for each row of ``docs``; no shuffle.

    A-Z are lower-cased and words are runs of digits, letters and non-ASCII characters.  Null and empty
    texts have no words and empty lists.  Places of one template don't overlap: the longest run from
    the left counts.  Texts of any length are taken whole, one or a batch a task.  Repeated rows give
    repeated rows; other columns are ignored, whatever their names.
    """
    templates, phrases = templates or TEMPLATES, phrases or BASE_PHRASES
    return docs.select("doc_id", "text").mapInArrow(
        lambda batches: _scanned(batches, templates, phrases),
        "doc_id long, n_words long, base array<struct<label:string,first_word:long>>, matches array<struct<label:string,first_word:long,end_word:long>>",
    )
