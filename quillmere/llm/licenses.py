"""License scans by conditional compression.

A block (a window of words, over line breaks and comment signs, that mentions licensing and is twice as long as the longest template) is compressed by itself and with each license's template as a raw
zstandard dictionary.  The bytes that a template saves measure how much of the block it explains; the templates are
looked at in that order, and each must be confirmed, unless its words are not there: the words of the template are aligned with the block
(free ends in the block), and the words that differ, counted exactly, must be few, none of them a version number or a
word that names the license.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

# Fixed names of licenses, by SPDX identifier.
LICENSES: dict[str, str] = {
    "0BSD": "BSD Zero Clause License", "AFL-3.0": "Academic Free License, version 3.0", "AGPL-3.0": "GNU Affero General Public License, version 3", "Apache-2.0": "Apache License, Version 2.0",
    "Artistic-2.0": "Artistic License 2.0", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License", "BSL-1.0": "Boost Software License, Version 1.0",
    "CDDL-1.0": "Common Development and Distribution License, version 1.0", "CECILL-2.1": "CeCILL License, version 2.1", "ECL-2.0": "Educational Community License, Version 2.0",
    "EPL-1.0": "Eclipse Public License, version 1.0", "EPL-2.0": "Eclipse Public License, version 2.0", "EUPL-1.2": "European Union Public License, version 1.2",
    "GFDL-1.3": "GNU Free Documentation License, version 1.3", "GPL-2.0": "GNU General Public License, version 2", "GPL-3.0": "GNU General Public License, version 3", "ISC": "ISC License",
    "LGPL-2.1": "GNU Lesser General Public License, version 2.1", "LGPL-3.0": "GNU Lesser General Public License, version 3", "MIT": "MIT License", "MPL-1.1": "Mozilla Public License, version 1.1",
    "MPL-2.0": "Mozilla Public License, version 2.0", "MS-PL": "Microsoft Public License", "NCSA": "University of Illinois/NCSA Open Source License", "ODbL-1.0": "Open Database License, version 1.0",
    "OFL-1.1": "SIL Open Font License, Version 1.1", "OSL-3.0": "Open Software License, version 3.0", "PostgreSQL": "PostgreSQL License", "PSF-2.0": "Python Software Foundation License, version 2",
    "UPL-1.0": "Universal Permissive License, version 1.0", "Unlicense": "Unlicense", "Zlib": "zlib License",
}
# Fixed elements of Creative Commons licenses, with their names.
COMMONS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_WITHOUT_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE '
    "ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS "
    "OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE "
    "USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'
_FORMS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_TWO = (
    f"{_FORMS}: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
    "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_PERMISSION = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"


def _gnu(what: str, name: str, version: str, sign: str) -> str:
    return f"This {what} is free software{sign} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation{',' if sign == ':' else ';'} either version {version} of the License, or (at your option) any later version."


# Fixed wordings of notices and of whole short licenses, by license; each is a template of its own.
NOTICES: dict[str, list[str]] = {
    "MIT": [
        "This project is licensed under the terms of the MIT license.",
        _MIT_GRANT,
        f"{_MIT_GRANT}, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR "
        "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by '
        'applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language '
        "governing permissions and limitations under the License.",
    ],
    "GPL-3.0": [_gnu("program", "General Public License", "3", ":")],
    "GPL-2.0": [_gnu("program", "General Public License", "2", ";")],
    "LGPL-3.0": [_gnu("program", "Lesser General Public License", "3", ":"), _gnu("library", "Lesser General Public License", "3", ";")],
    "LGPL-2.1": [_gnu("library", "Lesser General Public License", "2.1", ";")],
    "AGPL-3.0": [_gnu("program", "Affero General Public License", "3", ":")],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "BSD": [_FORMS],  # of two clauses or three
    "BSD-2-Clause": [_BSD_TWO, f"{_BSD_TWO} {_WITHOUT_WARRANTY}"],
    "BSD-3-Clause": [
        f"{_BSD_TWO} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        f"{_BSD_TWO} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_WITHOUT_WARRANTY}",
    ],
    "ISC": [f"{_PERMISSION}, provided that the above copyright notice and this permission notice appear in all copies."],
    "0BSD": [f"{_PERMISSION}."],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for "
        "any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"
    ],
    "BSL-1.0": [
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and '
        "transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so"
    ],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"],
    "EPL-1.0": ["All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution"],
    "OFL-1.1": ["This Font Software is licensed under the SIL Open Font License, Version 1.1."],
    "CC0-1.0": ["Released under CC0 1.0.", "This work is dedicated to the public domain under CC0 1.0 Universal."],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means.",
    ],
}


def wordings() -> dict[str, list[str]]:
    """All wordings by license: of its notices, then three sentences that name it, then its SPDX tags."""
    out = {name: list(texts) for name, texts in NOTICES.items()}
    for name, title in LICENSES.items():
        out.setdefault(name, []).extend(f"{how} under the {title}." for how in ("Released", "Licensed", "This work is licensed"))
    for version in ("3.0", "4.0"):
        for parts, title in COMMONS.items():
            where = "International" if version == "4.0" else "Unported"
            out[f"CC-{parts}-{version}"] = [f"Licensed under CC {parts} {version}.", f"Released under CC {parts} {version}.", f"This work is licensed under a Creative Commons {title} {version} {where} License."]
    for name in [n for n in out if n != "BSD"]:
        ends = ("", "-only", "-or-later") if "GPL-" in name or "GFDL" in name else ("",)
        out[name] += [f"SPDX-License-Identifier: {name}{end}" for end in ends]
    return out


TEMPLATES = wordings()
# Fixed words that tell licenses apart; one that a wording has must be in the block too.  So must every word of a tag.
NAMES = set(
    "mit apache gnu lesser affero mozilla bsd cc by nc sa nd cc0 noncommercial sharealike noderivatives attribution creative commons zero academic artistic boost cddl development cecill educational eclipse european gfdl isc microsoft illinois ncsa "
    "database sil font osl postgresql python permissive unlicense unencumbered zlib neither spdx only later person organization library"
    .split()
)
# Fixed cues: a window without any of them is no candidate.  Every template has one; line breaks and comment signs may part its words.
CUE = r"licen[sc]|permission|redistribut|public[^a-z0-9]+domain|mozilla[^a-z0-9]+public|cc0|cc[^a-z0-9]+by|spdx|warrant"
CUES, BYTE_CUES = re.compile(CUE), re.compile(CUE.encode())
#: A line break with the comment signs around it, which counts as a space.
BREAK = re.compile(r"[\s*/-]*\n[\s#*/;%!>-]*")
WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
#: Words of a text that are looked at at a time: twice those of the longest template, half of them again in the next window.
#: Templates of up to ``SHORT`` words have windows of their own, others have longer ones.
SHORT = 60


def lowered(text: str) -> str:
    """In lower case, each character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def words_of(text: str) -> list[tuple[str, int, int]]:
    """(word, start, end): lower-case runs of letters and digits, version numbers whole."""
    return [(m[0], m.start(), m.end()) for m in WORD.finditer(lowered(text))]


def alignment(template: list[str], block: list[str]) -> tuple[int, int, int]:
    """(differences, first, end): the fewest single-word edits that turn a run of the block into the template,
    and that run; of equal ones the first that ends, then the longest."""
    before = [(0, j) for j in range(len(block) + 1)]
    for i, t in enumerate(template, 1):
        now = [(i, 0)]
        for j, w in enumerate(block, 1):
            now.append(min((before[j - 1][0] + (t != w), before[j - 1][1]), (before[j][0] + 1, before[j][1]), (now[j - 1][0] + 1, now[j - 1][1])))
        before = now
    end = min(range(len(block) + 1), key=lambda j: (before[j][0], j))
    return before[end][0], before[end][1], end


def edits(template: list[str], run: list[str]) -> list[str]:
    """What turns the template into ``run`` by the fewest single words: ``-gone``, ``+new``, ``gone>new``."""
    cost = [list(range(len(run) + 1))]
    for i, t in enumerate(template, 1):
        cost.append([i])
        for j, w in enumerate(run, 1):
            cost[i].append(min(cost[i - 1][j - 1] + (t != w), cost[i - 1][j] + 1, cost[i][j - 1] + 1))
    out, i, j = [], len(template), len(run)
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (template[i - 1] != run[j - 1]):
            i, j = i - 1, j - 1
            if template[i] != run[j]:
                out.append(f"{template[i]}>{run[j]}")
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            out.append(f"-{template[i]}")
        else:
            j -= 1
            out.append(f"+{run[j]}")
    return out[::-1]


def telling(template: list[str]) -> set[str]:
    """The words that a statement cannot lack: versions, names, all of a tag."""
    return set(template) if template[0] == "spdx" else {w for w in template if w[0].isdigit() and "." in w or w in NAMES} | {b for a, b in zip(template, template[1:], strict=False) if b[0].isdigit() and a in ("version", "v", "bsd")}


class Scanner:
    def __init__(self, templates: dict[str, list[str]], most_diff: float) -> None:
        self.most_diff = most_diff
        self.plain = zstandard.ZstdCompressor(level=3, write_content_size=False)
        known = []
        for name, texts in templates.items():
            for n, text in enumerate(texts):
                raw = zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                packer = zstandard.ZstdCompressor(level=3, dict_data=raw, write_content_size=False, write_dict_id=False)
                words = [w for w, _, _ in words_of(text)]
                known.append((name, n, words, telling(words), packer))
        groups = [[k for k in known if len(k[2]) <= SHORT], [k for k in known if len(k[2]) > SHORT]]
        #: (templates, words of a window) of short and long templates.
        self.groups = [(g, 4 * max(len(k[2]) for k in g)) for g in groups if g]

    def window(self, text: str, words: list[tuple[str, int, int]], known: list[tuple]) -> list[tuple]:
        """(share that differs, - words of the wording, license, wording, first, end, plain bytes, bytes saved, edits) of each
        statement in ``words``, a window of ``text`` in lower case; first and end are places in the window."""
        data = BREAK.sub(" ", text[words[0][1] : words[-1][2]]).encode("utf-8", "replace")
        plain = len(self.plain.compress(data))
        saved = sorted(((plain - len(packer.compress(data)), -i) for i, (*_, packer) in enumerate(known)), reverse=True)
        plainly = [w for w, _, _ in words]
        there = set(plainly)
        found = []
        for gain, i in saved:
            name, n, template, must, _ = known[-i]
            if not must <= there or sum(w not in there for w in template) > self.most_diff * len(template):
                continue  # no alignment can confirm it
            todo = [(0, len(words))]
            while todo:  # a wording may be stated more than once
                low, high = todo.pop()
                differ, first, end = alignment(template, plainly[low:high])
                first, end = first + low, end + low
                if end > first and differ <= self.most_diff * len(template):
                    todo += [(low, first), (end, high)]
                    if must <= set(plainly[first:end]):
                        found.append((differ / len(template), -len(template), name, n, first, end, plain, gain, edits(template, plainly[first:end])))
        return found

    def scan(self, text: str) -> list[tuple[str, int, int, int, int, int, int, str]]:
        """(license, wording, start, end, plain bytes, bytes saved, words that differ, these) of each license that is stated in
        a text, places in code points, runs that overlap going to the best: the least share that differs, then the longest
        wording, then the order of names."""
        low, words = lowered(text), words_of(text)
        cues = [m.start() for m in CUES.finditer(low)]
        found = []
        for known, size in self.groups:
            for at in range(0, max(1, len(words) - size // 2), size // 2):
                part = words[at : at + size]
                if part and bisect_left(cues, part[0][1]) < bisect_left(cues, part[-1][2]):
                    found += [(*r[:4], r[4] + at, r[5] + at, *r[6:]) for r in self.window(low, part, known)]
        out: dict[tuple[int, int], tuple] = {}
        for _, _, name, n, first, end, plain, gain, differ in sorted(found):
            if all(end <= a or b <= first for a, b in out):
                out[first, end] = (name, n, words[first][1], words[end - 1][2], plain, gain, len(differ), " ".join(differ))
        return sorted(out.values(), key=lambda r: (r[2], r[0]))


SCHEMA = "doc_id long, license string, wording int, start long, `end` long, plain_bytes long, saved_bytes long, words_differ long, differing string"


def licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, most_diff: float = 0.2) -> DataFrame:
    """One row for each license statement in ``docs`` (doc_id, text; other columns are not looked at): its place in code
    points, the size of the block compressed alone, what its template saves, how many words differ from the template's, and
    these (see :func:`edits`).

    ``most_diff``: the share of a template's words that may differ.  Null and empty texts state none; a null doc_id stays
    null; repeated rows repeat theirs; an empty table gives an empty one.  Of wordings that fit equally well the longest,
    then the first by name, has the statement.  Texts of any length are scanned whole, in overlapping windows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates or TEMPLATES, most_diff)
        types = [pa.int64(), pa.string(), pa.int32()] + [pa.int64()] * 5 + [pa.string()]
        names = ["doc_id", "license", "wording", "start", "end", "plain_bytes", "saved_bytes", "words_differ", "differing"]
        for b in batches:
            rows = []
            for doc_id, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if data and BYTE_CUES.search(data.lower()):
                    rows += [(doc_id, *r) for r in scanner.scan(data.decode("utf-8", "replace"))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(tidy(each), SCHEMA)
