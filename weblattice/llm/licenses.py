"""License scans by sentence rules.

Known licence sentences are normalised (lower case, no comment marks or punctuation but dots within versions, one blank between
words) and kept as a trie of words. ``<name>`` in a sentence stands for one to twelve words of any kind, such as a holder's. In a document, every line,
sentence, clause after a comma or bracket and list item is tried against the trie; a sentence may run over several lines. What is found is a
sequence of sentence identifiers in the order of the text. It is matched against the licence rules, ordered sequences of
identifiers: from left to right, at each place the longest rule that fits the next identifiers takes them; identifiers that no rule takes are
reported as unmatched. Only documents that contain a trigger, a string that some known sentence cannot do without, are parsed.

Defined cases: null and empty texts hold no sentence. A licence that stands several times is found several times; the list of names has it once, in
alphabetical order. Of two sentences that begin at one word the longer is found. Repeated rows are scanned alike. Whole texts are read. Other columns
are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblattice.llm.arrow import pieces

#: The most words that ``<name>`` stands for.
NAME_WORDS = 12
#: Licence sentences by identifier.
SENTENCES = {
    "mit-released": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "mit-no-event": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "mit-plain-license": "This project is licensed under the MIT License",
    "apache2-line": "Licensed under the Apache License, Version 2.0",
    "apache2-not-except": "you may not use this file except in compliance with the License",
    "apache2-obtain": "You may obtain a copy of the License at",
    "apache2-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "apache2-see": "See the License for the specific language governing permissions and limitations under the License",
    "apache2-title": "Apache License Version 2.0, January 2004",
    "gpl-received": "You should have received a copy of the GNU General Public License along with this program",
    "gpl-see-details": "See the GNU General Public License for more details",
    "lgpl-received": "You should have received a copy of the GNU Lesser General Public License along with this library",
    "lgpl-see-details": "See the GNU Lesser General Public License for more details",
    "agpl-received": "You should have received a copy of the GNU Affero General Public License along with this program",
    "agpl-see-details": "See the GNU Affero General Public License for more details",
    "gpl2-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "gpl3-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "lgpl21-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "lgpl3-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "agpl3-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "gpl3-only": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation",
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3",
    "gpl-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-no-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "cc-by-nc4-line": "Licensed under CC BY-NC 4.0",
    "cc-by4-line": "Licensed under CC BY 4.0",
    "cc-by-sa4-line": "Licensed under CC BY-SA 4.0",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-endorse": "Neither the name of <name> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-endorse-plain": "Neither the name of <name> nor the names of contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-endorse-may-not": "The name of <name> may not be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-advertise": "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-as-is": "THIS SOFTWARE IS PROVIDED BY <name> \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",
    "bsd-no-event": "IN NO EVENT SHALL <name> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES",
    "gpl2-redistribute": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "lgpl21-redistribute": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "lgpl3-redistribute": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl-no-warranty": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "agpl3-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "unlicense-domain": "This is free and unencumbered software released into the public domain",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    "unlicense-more": "For more information, please refer to <http://unlicense.org/>",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-origin": "The origin of this software must not be misrepresented; you must not claim that you wrote the original software",
    "zlib-altered": "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software",
    "zlib-notice": "This notice may not be removed or altered from any source distribution",
    "isc-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\" AND <name> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS",
    "mpl2-obtain": "If a copy of the MPL was not distributed with this file, You can obtain one at",
    "bsl-line": "Distributed under the Boost Software License, Version 1.0",
    "wtfpl-line": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "cc0-line-extent": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "bsl-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "epl2-line": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "epl1-line": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0",
    "cc0-line": "CC0 1.0 Universal",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "mpl2-line": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}
#: Licences whose SPDX line is known.
SPDX = (
    "MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later",
    "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "Unlicense", "CC0-1.0", "EPL-1.0", "EPL-2.0", "BSL-1.0", "Zlib", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0",
)
#: Names that SPDX has replaced.
SPDX_OLD = {
    "GPL-2.0": "GPL-2.0-only", "GPL-2.0+": "GPL-2.0-or-later", "GPL-3.0": "GPL-3.0-only", "GPL-3.0+": "GPL-3.0-or-later", "LGPL-2.1": "LGPL-2.1-only", "LGPL-2.1+": "LGPL-2.1-or-later",
    "LGPL-3.0": "LGPL-3.0-only", "LGPL-3.0+": "LGPL-3.0-or-later", "AGPL-3.0": "AGPL-3.0-only",
}
SPDX_KEY = "spdx"


def _ladder(licence: str, least: int, names: str) -> list[tuple[str, list[str]]]:
    """A rule for all of the sentences, and for as many of the first ones as tell the licence."""
    every = names.split()
    return [(licence, every[:k]) for k in range(least, len(every) + 1)]


#: Licences as ordered sentence identifiers.
RULES = [
    ("MIT", ["mit-released"]), ("MIT", ["mit-licensed"]), ("MIT", ["mit-plain-license"]), *_ladder("MIT", 2, "mit-grant mit-notice mit-as-is mit-no-event"),
    ("Apache-2.0", ["apache2-line"]), *_ladder("Apache-2.0", 2, "apache2-line apache2-not-except apache2-obtain apache2-as-is apache2-see"), ("Apache-2.0", ["apache2-title"]),
    ("GPL-3.0-only", ["gpl3-work"]), ("CC-BY-NC-4.0", ["cc-by-nc4-line"]), ("CC-BY-4.0", ["cc-by4-line"]), ("CC-BY-SA-4.0", ["cc-by-sa4-line"]),
    *_ladder("BSD-2-Clause", 3, "bsd-grant bsd-source bsd-binary bsd-as-is bsd-no-event"), *_ladder("BSD-4-Clause", 4, "bsd-grant bsd-source bsd-binary bsd-advertise"),
    *(rule for x in ("bsd-endorse", "bsd-endorse-plain", "bsd-endorse-may-not") for rule in _ladder("BSD-3-Clause", 4, f"bsd-grant bsd-source bsd-binary {x} bsd-as-is bsd-no-event")),
    *(rule for x in ("bsd-endorse", "bsd-endorse-plain", "bsd-endorse-may-not") for rule in _ladder("BSD-4-Clause", 5, f"bsd-grant bsd-source bsd-binary bsd-advertise {x} bsd-as-is bsd-no-event")),
    *_ladder("ISC", 1, "isc-grant isc-as-is"), *_ladder("MPL-2.0", 1, "mpl2-line mpl2-obtain"),
    *(rule for x, y in (("GPL-2.0-or-later", "gpl2-redistribute"), ("GPL-2.0-only", "gpl2-only"), ("GPL-3.0-or-later", "gpl-redistribute"), ("GPL-3.0-only", "gpl3-only")) for rule in _ladder(x, 1, f"{y} gpl-no-warranty gpl-see-details gpl-received")),
    *(rule for x, y in (("LGPL-2.1-or-later", "lgpl21-redistribute"), ("LGPL-3.0-or-later", "lgpl3-redistribute")) for rule in _ladder(x, 1, f"{y} lgpl-no-warranty lgpl-see-details lgpl-received")),
    *_ladder("AGPL-3.0-or-later", 1, "agpl3-redistribute gpl-no-warranty agpl-see-details agpl-received"),
    ("GPL-2.0-only", ["gpl2-title"]), ("GPL-3.0-only", ["gpl3-title"]), ("LGPL-2.1-only", ["lgpl21-title"]), ("LGPL-3.0-only", ["lgpl3-title"]), ("AGPL-3.0-only", ["agpl3-title"]),
    *_ladder("Unlicense", 1, "unlicense-domain unlicense-anyone unlicense-more"), ("BSL-1.0", ["bsl-grant"]), ("BSL-1.0", ["bsl-line"]),
    *_ladder("Zlib", 1, "zlib-grant zlib-origin zlib-altered zlib-notice"), *_ladder("Zlib", 2, "zlib-as-is zlib-grant zlib-origin zlib-altered zlib-notice"),
    ("EPL-2.0", ["epl2-line"]), ("EPL-1.0", ["epl1-line"]), ("CC0-1.0", ["cc0-line"]), ("CC0-1.0", ["cc0-line-extent"]), ("WTFPL", ["wtfpl-line"]),
]
#: Each known sentence contains one of these, in lower case.
TRIGGERS = ("licen", "permission", "copyright", "redistribut", "warrant", "public domain", "cc0", "advertising", "in no event", "anyone is free", "misrepresented", "copy of the mpl", "this notice may not")

_WORD = re.compile(r"[^\W_]+(?:\.[^\W_]+)*")
_END = re.compile(r"[.!?;:,)\]]+(?=\s|$)|[(\[\n]")
_SPDX_LINE = re.compile(r"spdx-license-identifier:[ \t]*([^\r\n]*)", re.IGNORECASE)
_SPDX_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9.+-]*")
_SPDX_KNOWN = {name.lower(): name for name in SPDX} | {old.lower(): new for old, new in SPDX_OLD.items()}


def normalise(text: str) -> list[str]:
    return [m.lower() for m in _WORD.findall(text)]


def _parts(sentence: str) -> list[str | None]:
    """The words of a known sentence, None for ``<name>``."""
    before, *after = sentence.split("<name>")
    words: list[str | None] = list(normalise(before))
    for part in after:
        words += [None, *normalise(part)]
    return words


class Scanner:
    def __init__(self, sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES):
        self.trie: dict = {}
        for name, sentence in sentences.items():
            if not any(t in sentence.lower() for t in TRIGGERS):
                raise ValueError(f"no trigger in {name}")
            node = self.trie
            for word in _parts(sentence):
                node = node.setdefault(word or "", {})
            node[None] = name
        self.rules: dict[str, list[tuple[str, list[str]]]] = {}
        for licence, names in sorted(rules, key=lambda r: (-len(r[1]), r[0])):
            self.rules.setdefault(names[0], []).append((licence, names))

    def _longest(self, words: list[tuple[str, int, int]], start: int) -> tuple[str, int] | None:
        """The longest known sentence that begins at a word, and the word after it."""
        best, ways = None, [(self.trie, start)]
        while ways:
            node, j = ways.pop()
            if None in node and (best is None or j > best[1]):
                best = (node[None], j)
            if "" in node:  # a name of any words
                ways += [(node[""], k) for k in range(j + 1, min(j + NAME_WORDS, len(words)) + 1)]
            if j < len(words) and (further := node.get(words[j][0])) is not None:
                ways.append((further, j + 1))
        return best

    def sentences(self, text: str) -> list[tuple[str, int, int]]:
        """Identifier, start and end of every known sentence, none within another."""
        words = [(m.group().lower(), m.start(), m.end()) for m in _WORD.finditer(text)]
        ends = [m.end() for m in _END.finditer(text)]
        found, free, e = [], 0, 0
        for k, (_, start, _) in enumerate(words):
            new = k == 0
            while e < len(ends) and ends[e] <= start:
                new, e = True, e + 1
            if new and k >= free and (best := self._longest(words, k)):
                found.append((best[0], start, words[best[1] - 1][2]))
                free = best[1]
        # the names of an SPDX expression, each a sentence of its own
        for line in _SPDX_LINE.finditer(text):
            for m in _SPDX_NAME.finditer(line[1]):
                if name := _SPDX_KNOWN.get(m.group().lower()):
                    found.append((f"{SPDX_KEY}-{name}", line.start() if m.start() == 0 else line.start(1) + m.start(), line.start(1) + m.end()))
        return sorted(found, key=lambda x: x[1:])

    def licences(self, found: list[tuple[str, int, int]]) -> tuple[list[tuple[str, int, int]], int]:
        """Licence, start and end of every rule that fits, and the number of sentences that none takes."""
        out, unmatched, k = [], 0, 0
        while k < len(found):
            if found[k][0].startswith(f"{SPDX_KEY}-"):
                out.append((found[k][0].removeprefix(f"{SPDX_KEY}-"), *found[k][1:]))
                k += 1
                continue
            for licence, names in self.rules.get(found[k][0], ()):
                if [x[0] for x in found[k : k + len(names)]] == names:
                    out.append((licence, found[k][1], found[k + len(names) - 1][2]))
                    k += len(names)
                    break
            else:
                unmatched, k = unmatched + 1, k + 1
        return out, unmatched

    def scan(self, text: str | None) -> tuple[list[tuple[str, int, int]], int, int]:
        """Licences with their spans, the number of known sentences and of those unmatched."""
        lower = (text or "").lower()
        if not any(t in lower for t in TRIGGERS):
            return [], 0, 0
        found = self.sentences(text)
        licences, unmatched = self.licences(found)
        return licences, len(found), unmatched


def scan(docs: DataFrame, scanner: Scanner | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, licenses (names), spans, n_sentences and n_unmatched of every row."""
    scanner = scanner or Scanner()
    span = pa.list_(pa.struct([("license", pa.string()), ("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in pieces(batches, 1):
            rows = [scanner.scan(t) for t in texts]
            names = [sorted({x[0] for x in r[0]}) for r in rows]
            spans = [[{"license": x, "begin": b, "end": e} for x, b, e in r[0]] for r in rows]
            columns = [batch.column(0), pa.array(names, pa.list_(pa.string())), pa.array(spans, span), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "licenses", "spans", "n_sentences", "n_unmatched"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, licenses array<string>, spans array<struct<license:string,begin:long,end:long>>, n_sentences long, n_unmatched long")
