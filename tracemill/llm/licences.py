"""Licence scans: stretches of text that equal a licence template by the Dice coefficient over word bigrams.

Texts and templates are normalised to words of letters, digits and non-ASCII characters in lower case. A stretch is a
candidate for a template if it begins and ends with one of the template's bigrams and its size allows the threshold:
for Dice t and a template of b bigrams that is t / (2 - t) * b to (2 - t) / t * b. A text that has too few of
a template's bigrams in all is not compared with it.
"""

from __future__ import annotations

import pkgutil
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm import words

DICE = 0.8

# Whole texts in the folder licence_texts, without the appendices that hold notices.
WHOLE = ("Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0")
# Names of licences as short mentions have them, in each of the forms.
FORMS = ("Licensed under {}.", "Released under {}.", "This work is licensed under {}.")
NAMES: dict[str, tuple[str, ...]] = {
    "MIT": ("the MIT License", "the MIT licence"),
    "ISC": ("the ISC License",),
    "Apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0", "Apache-2.0"),
    "BSD-2-Clause": ("the BSD 2-Clause License", "the 2-Clause BSD License", "the Simplified BSD License", "BSD-2-Clause"),
    "BSD-3-Clause": ("the BSD 3-Clause License", "the 3-Clause BSD License", "the New BSD License", "BSD-3-Clause"),
    "MPL-2.0": ("the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "MPL-2.0"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "the Creative Commons CC0 1.0 Universal Public Domain Dedication"),
    **{
        f"{short}-{version}": tuple(f"the GNU {long} Public License{word}{v}" for word in (", version ", " v") for v in ((version, version[0]) if version.endswith(".0") else (version,)))
        + (f"the {short}, version {version[0] if version.endswith('.0') else version}", f"{short} v{version[0] if version.endswith('.0') else version}", f"{short}-{version}")
        for short, long, version in (
            ("GPL", "General", "2.0"), ("GPL", "General", "3.0"), ("LGPL", "Lesser General", "2.1"), ("LGPL", "Lesser General", "3.0"), ("AGPL", "Affero General", "3.0")
        )
    },
    **{
        f"CC-{short}-{version}": (f"CC {short} {version}", f"a Creative Commons {long} {version} {kind} License", f"the Creative Commons {long} {version} {kind} License")
        for version, kind in (("4.0", "International"), ("3.0", "Unported"))
        for short, long in (
            ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
            ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
        )
    },
}

_GNU = (
    "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2} as published by the Free Software Foundation{3} "
    "either version {4} of the License, or (at your option) any later version. This {0} is distributed in the hope that it will be useful, but WITHOUT ANY "
    "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {2} for more details."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "{0}Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "{1}Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
    "in the documentation and/or other materials provided with the distribution. "
)
_BSD_NAMES = (
    "{2}Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission. "
)
_BSD_BEGINS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES'
_BSD_ENDS = (
    ", INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
    "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED "
    "TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF "
    "THE POSSIBILITY OF SUCH DAMAGE."
)

# Notices by which the texts of public licences are put on a work, short licences, and parts that tell similar ones apart.
TEMPLATES: dict[str, str] = {
    "MIT-mention": "Released under the MIT License.",
    "Apache-2.0-mention": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-mention": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-mention": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-mention": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-mention": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD-mention": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
    "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
    "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or "
    "agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF "
    "ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
    "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is "
    "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS "
    "FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial "
    "portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
    "the above copyright notice and this permission notice appear in all copies.",
    # With the first words of the disclaimer, so that a text with a third clause is more like BSD-3-Clause.
    "BSD-2-Clause": _BSD.format("", "") + _BSD_BEGINS,
    "BSD-2-Clause-numbered": _BSD.format("1. ", "2. ") + _BSD_BEGINS,
    "BSD-3-Clause": (_BSD + _BSD_NAMES).format("", "", "") + _BSD_BEGINS + _BSD_ENDS,
    "BSD-3-Clause-numbered": (_BSD + _BSD_NAMES).format("1. ", "2. ", "3. ") + _BSD_BEGINS + _BSD_ENDS,
    "GPL-2.0-notice": _GNU.format("program", ";", "General Public License", ";", "2"),
    "LGPL-2.1-notice": _GNU.format("library", ";", "Lesser General Public License", ";", "2.1"),
    "LGPL-3.0-notice": _GNU.format("program", ":", "Lesser General Public License", ",", "3"),
    "LGPL-3.0-notice-library": _GNU.format("library", ":", "Lesser General Public License", ",", "3"),
    "AGPL-3.0-notice": _GNU.format("program", ":", "Affero General Public License", ",", "3"),
    # The whole text is otherwise that of GPL-3.0 but for its preamble.
    "AGPL-3.0-section-13": "Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all "
    "users interacting with it remotely through a computer network (if your version supports such interaction) an opportunity to receive the Corresponding "
    "Source of your version by providing access to the Corresponding Source from a network server at no charge, through some standard or customary means of "
    "facilitating copying of software.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
    "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and "
    "by any means.",
}



def _catalogue() -> dict[str, str]:
    """The templates above, the whole texts, and each name in each form; of equal words the first is kept."""
    made = TEMPLATES | {name: pkgutil.get_data("tracemill.llm", f"licence_texts/{name}.txt").decode() for name in WHOLE}
    for name, names in NAMES.items():
        for k, text in enumerate(form.format(one) for one in names for form in FORMS):
            made.setdefault(f"{name}-mention{f'-{k}' if k or f'{name}-mention' in TEMPLATES else ''}", text)
    first: dict[str, str] = {}
    for name, text in made.items():
        first.setdefault(" ".join("".join(c if c.isalnum() else " " for c in text.lower()).split()), name)
    return {name: made[name] for name in first.values()}


TEMPLATES = _catalogue()

SCHEMA = "doc_id long, licence string, dice double, word_at long, n_words long, quote string"
# ASCII characters other than letters and digits part words, in place of white space alone.
_PARTS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def _normal(column: pa.Array):
    """(first row, bytes, words) of each slice, normalised; bytes keep their places."""
    for first, _, data, offsets in words.slices(pc.utf8_lower(pc.fill_null(column, ""))):
        data = np.where(_PARTS[data], np.uint8(0x20), data)
        yield first, data, words.Words(data, offsets)


class Templates:
    """The distinct bigrams of each template, and which template has a bigram."""

    def __init__(self, texts: Mapping[str, str]) -> None:
        self.names = sorted(texts)
        with np.errstate(over="ignore"):
            (found,) = (w for _, _, w in _normal(pa.array([texts[n] for n in self.names] or [""])))
            sets = [np.unique(words.grams(found.of(k), 2)) for k in range(len(self.names))]
        self.sizes = [len(s) for s in sets]
        grams = np.concatenate([np.zeros(0, np.uint64), *sets])
        owners = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(grams, kind="stable")
        self.grams, self.owners = grams[order], owners[order]

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of a word sequence's bigrams that some template has, and these bigrams."""
        found = words.grams(hashes, 2)
        if not len(self.grams) or not len(found):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.grams[np.minimum(np.searchsorted(self.grams, found), len(self.grams) - 1)] == found)
        return at, found[at]

    def owned(self, gram: np.uint64) -> np.ndarray:
        return self.owners[np.searchsorted(self.grams, gram, "left") : np.searchsorted(self.grams, gram, "right")]


def spans(every: np.ndarray, at: list[int], size: int, least: float) -> list[tuple[float, int, int]]:
    """(dice, first bigram, last bigram) of the stretches of a text that reach ``least``, best for each first bigram.

    ``every``: the text's bigrams; ``at``: the positions of those that the template has; ``size``: its distinct bigrams.
    """
    low, high = least / (2 - least) * size, (2 - least) / least * size
    out = []
    if not at:
        return out
    end = at[-1] + 1
    held = np.zeros(end, bool)
    held[at] = True
    # Place of the same bigram before each: a bigram is new in a stretch if that lies before it.
    order = np.argsort(every[:end], kind="stable")
    before = np.full(end, -1, np.int64)
    same = every[order[1:]] == every[order[:-1]]
    before[order[1:][same]] = order[:-1][same]
    for first in at:
        length = int(2 * high) + 2
        while True:
            to = min(end, first + length)
            new = before[first:to] < first
            seen = np.cumsum(new)
            if to == end or seen[-1] > high:
                break
            length *= 2
        common = np.cumsum(new & held[first:to])
        dice = np.where(held[first:to] & (seen >= low) & (seen <= high), 2 * common / (seen + size), 0.0)
        best = int(dice.argmax())
        if dice[best] >= least and dice[best] > 0:
            out.append((float(dice[best]), first, first + best))
    return out


def found_in(hashes: np.ndarray, templates: Templates, least: float) -> list[tuple[int, float, int, int]]:
    """(template, dice, first word, end word) of a text's licences: best first, none over another."""
    at, grams = templates.hits(hashes)
    if not len(at):
        return []
    places: dict[int, list[int]] = {}
    kinds: dict[int, set[int]] = {}
    for p, gram in zip(at.tolist(), grams):
        for t in templates.owned(gram).tolist():
            places.setdefault(t, []).append(p)
            kinds.setdefault(t, set()).add(int(gram))
    every = words.grams(hashes, 2)
    made = []
    for t, own in places.items():
        size = templates.sizes[t]
        # Of a stretch of n distinct bigrams, t (n + b) / 2 are common, and n is at least t / (2 - t) b.
        if len(kinds[t]) < least / (2 - least) * size - 1e-9:
            continue
        made += [(-dice, -size, first, t, last) for dice, first, last in spans(every, own, size, least)]
    out, taken = [], np.zeros(len(hashes), bool)
    for minus, _, first, t, last in sorted(made):
        if not taken[first : last + 2].any():
            taken[first : last + 2] = True
            out.append((t, -minus, first, last + 2))
    return sorted(out, key=lambda x: x[2])


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, least: float = DICE) -> DataFrame:
    """One row for each licence found in a row of ``docs`` (doc_id, text; others are not read), see SCHEMA.

    ``word_at`` and ``n_words`` count normalised words, ``quote`` is the stretch in them. Stretches of one text do not
    overlap: the higher Dice goes first, then the larger template, then the earlier place, then the template's name.
    Null and empty texts and those without a licence give no row; a null doc_id stays null; repeated rows are scanned
    each. Templates of fewer than two words match nothing. The templates are a small fixed list, sent with the task.
    """
    known = Templates(templates)

    def run(batches):
        for batch in batches:
            rows = []
            with np.errstate(over="ignore"):
                for at, data, found in _normal(batch.column(1)):
                    near, _ = known.hits(found.hashes)
                    for k in np.unique(np.searchsorted(found.bounds, near, "right") - 1).tolist():
                        first = int(found.bounds[k])
                        for t, dice, begin, end in found_in(found.of(k), known, least):
                            quote = bytes(data[found.starts[first + begin] : found.ends[first + end - 1]]).decode()
                            rows.append((batch.column(0)[at + k].as_py(), known.names[t], dice, begin, end - begin, " ".join(quote.split())))
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
