"""Licence recognition by sentence rules.

Text is cut into sentences, and at line ends; each piece, normalised, is looked up among known licence
sentences. A licence is recognised where the sentence identifiers of one of its rules come in order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import chunks

#: Licence sentences, as published, by identifier.
SENTENCES = {
    "mit-title": "MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit0-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit-no-event": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "apache-title": "Apache License Version 2.0, January 2004",
    "apache-terms": "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    "apache-grant": "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-unless": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl-warranty": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-details": "See the GNU General Public License for more details.",
    "gpl-copying": "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "gpl2-title": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "gpl2-preamble": "The licenses for most software are designed to take away your freedom to share and change it.",
    "gpl3-title": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "gpl3-preamble": "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    "lgpl21-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "lgpl3-title": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "lgpl3-terms": "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
    "agpl3-title": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "agpl3-preamble": "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-advert": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-as-is": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "bsd-no-event": "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "isc-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "mpl-title": "Mozilla Public License Version 2.0",
    "mpl-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "mpl11-header": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License.",
    "epl1-terms": "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (\"AGREEMENT\").",
    "epl1-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "epl2-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "cddl-header": "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\").",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-no-event": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "bsl-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "bsl-header": "Distributed under the Boost Software License, Version 1.0.",
    "artistic2-header": "This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0.",
    "wtfpl": "You just DO WHAT THE FUCK YOU WANT TO.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "unlicense-free": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "cc0-header": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "ofl-header": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "psf-grant": "Subject to the terms and conditions of this License Agreement, PSF hereby grants Licensee a nonexclusive, royalty-free, world-wide license to reproduce, analyze, test, perform and/or display publicly, prepare derivative works, distribute, and otherwise use Python alone or in any derivative version, provided, however, that PSF's License Agreement and PSF's notice of copyright are retained in Python alone or in any derivative version prepared by Licensee.",
}
#: Sentence identifiers that make up a licence, in order. A rule whose sentences a longer one has in the same order yields to it.
RULES = {
    "MIT": [["mit-grant", "mit-notice", "as-is", "mit-no-event"], ["mit-grant", "mit-notice", "as-is"], ["mit-grant", "mit-notice"], ["mit-title", "mit-grant"], ["mit-title", "mit-notice"]],
    "MIT-0": [["mit0-grant", "as-is"], ["mit0-grant"]],
    "Apache-2.0": [["apache-header", "apache-copy", "apache-unless", "apache-see"], ["apache-header", "apache-copy"], ["apache-header"], ["apache-title", "apache-terms"], ["apache-title", "apache-grant"], ["apache-terms", "apache-grant"]],
    "GPL-2.0": [["gpl2-title", "gpl-copying", "gpl2-preamble"], ["gpl2-title"]],
    "GPL-3.0": [["gpl3-title", "gpl-copying", "gpl3-preamble"], ["gpl3-title"], ["gpl3-preamble"]],
    "LGPL-2.1": [["lgpl21-title", "gpl-copying"], ["lgpl21-title"]],
    "LGPL-3.0": [["lgpl3-title", "gpl-copying", "lgpl3-terms"], ["lgpl3-title"], ["lgpl3-terms"]],
    "AGPL-3.0": [["agpl3-title", "gpl-copying", "agpl3-preamble"], ["agpl3-title"], ["agpl3-preamble"]],
    "BSD-4-Clause": [["bsd-grant", "bsd-source", "bsd-binary", "bsd-advert"]],
    "BSD-3-Clause": [["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is", "bsd-no-event"], ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]],
    "BSD-2-Clause": [["bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is", "bsd-no-event"], ["bsd-grant", "bsd-source", "bsd-binary"]],
    "ISC": [["isc-grant", "isc-as-is"], ["isc-grant"]],
    "0BSD": [["0bsd-grant", "isc-as-is"], ["0bsd-grant"]],
    "MPL-2.0": [["mpl-header", "mpl-copy"], ["mpl-header"], ["mpl-title"]],
    "MPL-1.1": [["mpl11-header"]],
    "EPL-1.0": [["epl1-terms"], ["epl1-header"]],
    "EPL-2.0": [["epl2-header"]],
    "CDDL-1.0": [["cddl-header"]],
    "Zlib": [["zlib-as-is", "zlib-no-event", "zlib-grant"], ["zlib-grant"]],
    "BSL-1.0": [["bsl-grant"], ["bsl-header"]],
    "Artistic-2.0": [["artistic2-header"]],
    "WTFPL": [["wtfpl"]],
    "Unlicense": [["unlicense", "unlicense-free"], ["unlicense"]],
    "CC0-1.0": [["cc0-header"]],
    "OFL-1.1": [["ofl-header"]],
    "PSF-2.0": [["psf-grant"]],
}
#: Names by which notices mention a licence.
NAMES = {
    "MIT": ["MIT License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
    "GPL-2.0": ["GNU General Public License, version 2", "GPLv2"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPLv3"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "LGPLv3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "AGPLv3"],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License"],
    "ISC": ["ISC License"],
    "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, Version 2.0"],
    "EPL-2.0": ["Eclipse Public License 2.0"],
    "Zlib": ["zlib License"],
    "BSL-1.0": ["Boost Software License 1.0", "Boost Software License, Version 1.0"],
    "Unlicense": ["Unlicense"],
    "CC0-1.0": ["CC0 1.0", "Creative Commons Zero v1.0 Universal License"],
}
#: Notices; {} is a name.
NOTICES = ["Released under the {}.", "Licensed under the {}.", "Licensed under {}.", "This work is licensed under the {}.", "This project is licensed under the {}.", "This software is released under the {}.", "Distributed under the {}."]
#: Elements of the attribution licences, with their names in notices.
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
#: Licences with the notice of the GNU programs: (name in the notice, versions, what is licensed).
_GNU = {"GPL": ("General Public License", ("2", "3"), "program"), "LGPL": ("Lesser General Public License", ("2.1", "3"), "library"), "AGPL": ("Affero General Public License", ("3",), "program")}


def known() -> tuple[dict[str, str], dict[str, list[list[str]]]]:
    """Sentences and rules, with those of notices that differ in a name, a version or a word only."""
    sentences, rules = dict(SENTENCES), {k: [list(r) for r in v] for k, v in RULES.items()}

    def add(licence: str, text: str, *then: str) -> None:
        name = f"{licence} {len(sentences)}"
        sentences[name] = text
        if then:
            rules.setdefault(licence, []).append([name, *then])
        rules.setdefault(licence, []).append([name])

    for licence, names in NAMES.items():
        for name in names:
            for notice in NOTICES:
                add(licence, notice.format(name))
    for code, words in _CC.items():
        for version, kind in (("3.0", "Unported"), ("4.0", "International")):
            for text in (f"Licensed under CC {code} {version}.", f"This work is licensed under CC {code} {version}.", f"This work is licensed under a Creative Commons {words} {version} {kind} License.", f"Licensed under the Creative Commons {words} {version} {kind} License."):
                add(f"CC-{code}-{version}", text)
    for short, (name, versions, what) in _GNU.items():
        for version in versions:
            full = version if "." in version else f"{version}.0"
            for thing in sorted({"program", what}):
                start = f"This {thing} is free software{{}} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation"
                for mark in (":", ";"):
                    for later, rest in (("-or-later", f", either version {version} of the License, or (at your option) any later version."), ("-or-later", f"; either version {version} of the License, or (at your option) any later version."), ("-only", f", version {version}."), ("-only", f"; version {version}."), ("-only", f"; version {version} of the License.")):
                        add(f"{short}-{full}{later}", start.format(mark) + rest, "lgpl-warranty" if thing == "library" else "gpl-warranty")
    return sentences, rules


_ENDS = re.compile(r"(?<=[.!?:;])\s+|\n\s*\n")
_LINES = re.compile(r"\n")
_OTHER = re.compile(r"[^a-z0-9]+")


def _within(short: tuple[str, ...], long: tuple[str, ...]) -> bool:
    rest = iter(long)
    return all(k in rest for k in short)


def normalise(sentence: str) -> str:
    return _OTHER.sub(" ", sentence.lower()).strip()


class Scanner:
    """Known sentences are made of several pieces where they have inner sentence ends; all are looked up piece by piece."""

    def __init__(self, sentences: dict[str, str] | None = None, rules: dict[str, list[list[str]]] | None = None):
        made, ruled = known()
        self.sentences, self.rules = sentences or made, rules or ruled
        self.ids: dict[str, list[str]] = {}
        for k, s in self.sentences.items():
            parts = [p for p in map(normalise, _ENDS.split(s)) if p]
            self.ids.setdefault(parts[0], []).append(k)
        self.parts = {k: [p for p in map(normalise, _ENDS.split(s)) if p] for k, s in self.sentences.items()}
        #: The longest word of each first piece; a text without any of them holds no known sentence.
        self.hints = sorted({max(p.split(), key=len).encode() for p in self.ids}, key=len)

    def sentence_ids(self, text: bytes) -> list[tuple[int, str]]:
        """(piece number, identifier) in text order."""
        low = text.lower()
        if not any(h in low for h in self.hints):
            return []
        s = text.decode(errors="replace")
        found: set[tuple[int, str]] = set()
        for cut in (_LINES, _ENDS):
            at, bits = 0, []
            for m in [*cut.finditer(s), None]:
                bits.append((at, normalise(s[at : m.start() if m else len(s)])))
                at = m.end() if m else at
            bits = [b for b in bits if b[1]]
            for i, (start, piece) in enumerate(bits):
                for k in self.ids.get(piece, self.ids.get(piece[2:], []) if piece[1:2] == " " else []):
                    if all(i + n < len(bits) and bits[i + n][1] == p for n, p in enumerate(self.parts[k][1:], 1)):
                        found.add((start, k))
        return sorted(found)

    def licences(self, text: bytes) -> list[tuple[str, int, int]]:
        """(licence, sentences of its longest rule that matches, offset of the first one)."""
        ids = self.sentence_ids(text)
        if not ids:
            return []
        best: dict[str, tuple[int, int, tuple[str, ...]]] = {}
        for name, rules in self.rules.items():
            for rule in rules:
                i, first = 0, None
                for start, k in ids:
                    if k == rule[i]:
                        first = start if first is None else first
                        i += 1
                        if i == len(rule):
                            if name not in best or best[name][0] < len(rule):
                                best[name] = (len(rule), first, tuple(rule))
                            break
        # a rule whose sentences come in this order in a longer rule of another licence yields to it
        own = {name: v for name, v in best.items() if not any(o != name and len(w[2]) > len(v[2]) and _within(v[2], w[2]) for o, w in best.items())}
        return sorted((name, n, first) for name, (n, first, _) in own.items())


def scan(docs: DataFrame, sentences: dict[str, str] | None = None, rules: dict[str, list[list[str]]] | None = None) -> DataFrame:
    """doc_id, licence, n_sentences, first_char: a row for each licence recognised in a row of ``docs``.

    Matching ignores case, punctuation and the way lines are broken, but needs whole sentences. Null and
    empty texts have no licence. Null doc_ids and repeated rows are scanned like others. No documents: no
    rows. Extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(sentences, rules)
        for part, texts in chunks(batches):
            ids = part.column("doc_id").to_pylist()
            rows = [(i, *m) for i, t in zip(ids, texts, strict=True) for m in scanner.licences(t)]
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "licence", "n_sentences", "first_char"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, licence string, n_sentences long, first_char long")
