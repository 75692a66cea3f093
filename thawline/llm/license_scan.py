"""Licence scans by sentence rules.

A text is cut into pieces at line ends and after ``.!?;:``; a sentence is one piece or several in a row, up to a
full stop or an empty line (one of comment marks only is empty too), so wrapped sentences and those with ``;`` or
``:`` inside are whole.  The longest known licence sentence, in normalised words, that begins at a piece gives an
identifier.  The identifiers, in order, are matched against licence rules, most specific first: a rule is a
sequence of identifiers, and what it matches is used up.  Up to ``gap`` unknown sentences may stand
between two sentences of one rule.  Identifiers that no rule uses are reported as they are.

Besides the sentences of whole licences there is, for every licence of a list, a set of short sentences that name it ("licensed under
...", "SPDX-License-Identifier: ..."), made from templates.

Defined results: null and empty texts hold no licence.  Texts of any length are scanned whole.  Repeated rows are scanned each on its
own; columns of ``docs`` beyond ``keep`` and text are ignored, and a column to keep that bears the name of a result is refused.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows, strings

# Licence sentences, normalised by fold(); {x} stands for any words.
SENTENCES = {
    "MIT_REF": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "distributed under the mit license", "the mit license", "mit license"],
    "MIT_GRANT": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
    ],
    "MIT_NOTICE": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "AS_IS_SOFTWARE": [
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"
    ],
    "AUTHORS_NOT_LIABLE": [
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
    ],
    "APACHE2_REF": ["licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license", "released under the apache license version 2 0", "apache license version 2 0"],
    "APACHE2_COMPLY": ["you may not use this file except in compliance with the license"],
    "APACHE2_COPY": ["you may obtain a copy of the license at {x}"],
    "APACHE2_BASIS": [
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"
    ],
    "APACHE2_SEE": ["see the license for the specific language governing permissions and limitations under the license"],
    "GPL3_REF": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "released under the gnu general public license version 3", "gnu general public license version 3"],
    "GPL2_REF": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2", "gnu general public license version 2"],
    "LGPL3_REF": ["licensed under the gnu lesser general public license version 3", "gnu lesser general public license version 3"],
    "AGPL3_REF": ["licensed under the gnu affero general public license version 3", "gnu affero general public license version 3"],
    "GPL_FREE": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version {x} of the license or at your option any later version"
    ],
    "GPL_HOPE": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "GPL_SEE": ["see the gnu general public license for more details"],
    "GPL_COPY": ["you should have received a copy of the gnu general public license along with this program {x}"],
    "BSD_REDIST": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "BSD_SOURCE": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "BSD_BINARY": [
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
    ],
    "BSD_ENDORSE": ["neither the name of {x} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "BSD_REF": ["licensed under the bsd license", "released under the bsd license"],
    "MPL2_REF": ["this source code form is subject to the terms of the mozilla public license v 2 0", "licensed under the mozilla public license version 2 0"],
    "ISC_REF": ["licensed under the isc license", "released under the isc license"],
    "UNLICENSE": ["this is free and unencumbered software released into the public domain"],
    "CC_BY_NC_4_REF": ["licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "CC_BY_SA_4_REF": ["licensed under cc by sa 4 0", "this work is licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "CC_BY_4_REF": ["licensed under cc by 4 0", "this work is licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "CC0_REF": ["licensed under cc0 1 0", "released under cc0 1 0", "to the extent possible under law {x} has waived all copyright and related or neighboring rights to this work"],
    "ALL_RIGHTS": ["all rights reserved", "copyright {x} all rights reserved"],
    "PROPRIETARY": ["this software is confidential and proprietary", "unauthorized copying of this file via any medium is strictly prohibited"],
}

# Ordered rules, most specific first.
RULES = [
    ("MIT", ("MIT_GRANT", "MIT_NOTICE", "AS_IS_SOFTWARE", "AUTHORS_NOT_LIABLE")),
    ("MIT", ("MIT_GRANT", "MIT_NOTICE", "AS_IS_SOFTWARE")),
    ("MIT", ("MIT_GRANT", "MIT_NOTICE")),
    ("Apache-2.0", ("APACHE2_REF", "APACHE2_COMPLY", "APACHE2_COPY", "APACHE2_BASIS", "APACHE2_SEE")),
    ("Apache-2.0", ("APACHE2_REF", "APACHE2_COMPLY", "APACHE2_COPY")),
    ("GPL-or-later", ("GPL_FREE", "GPL_HOPE", "GPL_SEE", "GPL_COPY")),
    ("GPL-or-later", ("GPL_FREE", "GPL_HOPE", "GPL_SEE")),
    ("BSD-3-Clause", ("BSD_REDIST", "BSD_SOURCE", "BSD_BINARY", "BSD_ENDORSE")),
    ("BSD-2-Clause", ("BSD_REDIST", "BSD_SOURCE", "BSD_BINARY")),
    ("MIT", ("MIT_REF",)),
    ("MIT", ("MIT_GRANT",)),
    ("Apache-2.0", ("APACHE2_REF",)),
    ("LGPL-3.0", ("LGPL3_REF",)),
    ("AGPL-3.0", ("AGPL3_REF",)),
    ("GPL-3.0", ("GPL3_REF",)),
    ("GPL-2.0", ("GPL2_REF",)),
    ("GPL-or-later", ("GPL_FREE",)),
    ("BSD", ("BSD_REF",)),
    ("MPL-2.0", ("MPL2_REF",)),
    ("ISC", ("ISC_REF",)),
    ("Unlicense", ("UNLICENSE",)),
    ("CC-BY-NC-4.0", ("CC_BY_NC_4_REF",)),
    ("CC-BY-SA-4.0", ("CC_BY_SA_4_REF",)),
    ("CC-BY-4.0", ("CC_BY_4_REF",)),
    ("CC0-1.0", ("CC0_REF",)),
    ("Proprietary", ("PROPRIETARY",)),
    ("Proprietary", ("ALL_RIGHTS",)),
]

# Licence identifiers and the names they go by.
NAMED = {
    "0BSD": ["Zero-Clause BSD"], "AFL-3.0": ["Academic Free License 3.0"], "AGPL-3.0": ["GNU Affero General Public License v3.0", "AGPLv3"], "AGPL-3.0-only": [], "AGPL-3.0-or-later": [],
    "Apache-1.1": ["Apache License 1.1"], "Apache-2.0": ["Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0"], "Artistic-2.0": ["Artistic License 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License", "FreeBSD License"], "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "Modified BSD License"],
    "BSD-4-Clause": ["BSD 4-Clause License", "Original BSD License"], "BSL-1.0": ["Boost Software License 1.0", "Boost Software License, Version 1.0"],
    "CC-BY-3.0": ["CC BY 3.0"], "CC-BY-4.0": ["CC BY 4.0"], "CC-BY-NC-4.0": ["CC BY-NC 4.0"], "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0"], "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0"], "CC-BY-ND-4.0": ["CC BY-ND 4.0"],
    "CC-BY-SA-3.0": ["CC BY-SA 3.0"], "CC-BY-SA-4.0": ["CC BY-SA 4.0"], "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal"], "CDDL-1.0": ["Common Development and Distribution License 1.0"],
    "EPL-1.0": ["Eclipse Public License 1.0"], "EPL-2.0": ["Eclipse Public License 2.0", "Eclipse Public License v2.0"], "EUPL-1.2": ["European Union Public License 1.2"],
    "GFDL-1.3": ["GNU Free Documentation License, Version 1.3"], "GPL-2.0": ["GNU General Public License v2.0", "GPLv2"], "GPL-2.0-only": [], "GPL-2.0-or-later": ["GPLv2+"],
    "GPL-3.0": ["GNU General Public License v3.0", "GPLv3"], "GPL-3.0-only": [], "GPL-3.0-or-later": ["GPLv3+"], "ISC": ["ISC License"], "LGPL-2.1": ["GNU Lesser General Public License v2.1", "LGPLv2.1"],
    "LGPL-2.1-only": [], "LGPL-2.1-or-later": [], "LGPL-3.0": ["GNU Lesser General Public License v3.0", "LGPLv3"], "LGPL-3.0-only": [], "LGPL-3.0-or-later": [],
    "MIT": ["MIT License", "Expat License"], "MIT-0": ["MIT No Attribution"], "MPL-1.1": ["Mozilla Public License 1.1"], "MPL-2.0": ["Mozilla Public License 2.0", "Mozilla Public License, v. 2.0"],
    "MS-PL": ["Microsoft Public License"], "ODbL-1.0": ["Open Database License 1.0"], "OFL-1.1": ["SIL Open Font License 1.1", "SIL Open Font License, Version 1.1"], "PostgreSQL": ["PostgreSQL License"],
    "PSF-2.0": ["Python Software Foundation License Version 2"], "Unlicense": ["The Unlicense"], "WTFPL": ["Do What The F*ck You Want To Public License"], "Zlib": ["zlib License"],
}
#: Sentences that name a licence, {} its name.
TEMPLATES = (
    "licensed under {}", "licensed under the {}", "released under the {}", "distributed under the {}", "published under the {}", "available under the {}", "this project is licensed under the {}",
    "this work is licensed under {}", "this work is licensed under the {}", "this software is licensed under the {}", "this file is licensed under the {}", "license {}", "license: {} license",
)
LINE = re.compile(r"\r\n|[\n\r]")
CUT = re.compile(r"(?<=[.!?;:])\s+")
#: Comment marks made of letters; all others fall away with the signs.
MARK = re.compile(r"[\s@]*(?:rem|dnl)\b", re.IGNORECASE)
END = re.compile(r"(?<!\binc)(?<!\bltd)(?<!\bcorp)(?<!\bco)(?<!\bv)[.!?][)\]\"']*\s*(?:\*+/|-->)?\s*$", re.IGNORECASE)
LABEL = re.compile(r"\d{1,2} ")
_WORD = re.compile(r"[a-z0-9]+")


def fold(sentence: str) -> str:
    return " ".join(_WORD.findall(sentence.lower()))


def pieces(text: str) -> list[tuple[str, bool]]:
    """(words, whether the sentence ends there)."""
    out: list[tuple[str, bool]] = []
    for line in LINE.split(text):
        some = [(words, bool(END.search(part))) for part in CUT.split(MARK.sub("", line, count=1)) if (words := fold(part))]
        if some:
            out += some
        elif out:
            out[-1] = (out[-1][0], True)
    return out


def naming_sentences(names: dict[str, list[str]] = NAMED) -> dict[str, str]:
    """Normalised sentence -> licence, for every licence's own identifier, its names, and the templates."""
    out: dict[str, str] = {}
    for licence, also in names.items():
        out.setdefault(fold(f"SPDX-License-Identifier: {licence}"), licence)
        for name in [licence, *also]:
            for template in TEMPLATES:
                out.setdefault(fold(template.format(name)), licence)
    return out


def library() -> tuple[dict[str, list[str]], list]:
    """All sentences and rules: those of whole licences first, then one identifier and rule for each licence that is only named.  What a
    whole licence's own sentences say already stays theirs."""
    sentences, rules = dict(SENTENCES), list(RULES)
    known = {s for some in SENTENCES.values() for s in some}
    for sentence, licence in naming_sentences().items():
        if sentence not in known:
            sentences.setdefault(f"NAMED {licence}", []).append(sentence)
    rules += [(name.removeprefix("NAMED "), (name,)) for name in sentences if name.startswith("NAMED ")]
    return sentences, rules


class Rules:
    def __init__(self, sentences: dict[str, list[str]] | None = None, rules: list | None = None, gap: int = 2) -> None:
        if sentences is None or rules is None:
            own_sentences, own_rules = library()
            sentences, rules = sentences or own_sentences, rules or own_rules
        # the longest fixed word of each sentence: a text that holds none of them holds no sentence
        longest = {max((w for w in s.split() if w != "{x}"), key=len) for some in sentences.values() for s in some}
        self.signs = re.compile("|".join(sorted(w for w in longest if not any(v != w and v in w for v in longest))))
        self.exact = {s: name for name, some in sentences.items() for s in some if "{x}" not in s}
        self.begun = {s[:i] for s in self.exact for i in range(1, len(s) + 1) if s[i : i + 1] in ("", " ")}
        self.open = [(name, *(part.strip() for part in s.split("{x}"))) for name, some in sentences.items() for s in some if "{x}" in s]
        self.rules, self.gap = rules, gap

    def spelt(self, parts: list[tuple[str, bool]], i: int) -> tuple[str | None, int]:
        """Identifier and end of the longest sentence without {x} that begins at piece ``i``."""
        best, words = (None, i), LABEL.sub("", parts[i][0], count=1) if LABEL.match(parts[i][0]) else parts[i][0]
        while words in self.begun:
            i += 1
            if words in self.exact:
                best = self.exact[words], i
            if parts[i - 1][1] or i == len(parts):
                break
            words += " " + parts[i][0]
        return best

    def headed(self, parts: list[tuple[str, bool]], i: int, head: str) -> tuple[list[str], int] | None:
        """Words after ``head``, if it begins at piece ``i``, and the end of the piece where it ends."""
        words = LABEL.sub("", parts[i][0], count=1) if LABEL.match(parts[i][0]) else parts[i][0]
        i += 1
        while head.startswith(words + " ") and not parts[i - 1][1] and i < len(parts):
            words += " " + parts[i][0]
            i += 1
        return (words[len(head) :].split(), i) if (words + " ").startswith(head + " ") else None

    def filled(self, parts: list[tuple[str, bool]], i: int) -> tuple[str | None, int]:
        """Identifier and end of a sentence with {x} that begins at piece ``i``.  {x} ends before the next known
        sentence; at the end of a sentence it may be empty, as what it stands for may follow an empty line."""
        for name, head, tail in self.open:
            if not (begun := self.headed(parts, i, head)):
                continue
            (rest, j), last = begun, tail.split()
            while True:
                if last and len(rest) > len(last) and rest[-len(last) :] == last:
                    return name, j
                if parts[j - 1][1] or j == len(parts) or not last and self.spelt(parts, j)[0]:
                    break
                if not last and any(self.headed(parts, j, h) for _, h, _ in self.open):
                    break
                rest += parts[j][0].split()
                j += 1
                if last and rest[-len(last) :] != last and (self.spelt(parts, j - 1)[0] or self.headed(parts, j - 1, head)):
                    break
            if not last:
                return name, j
        return None, i

    def identify(self, text: str) -> list[tuple[int, str]]:
        """(sentence number, identifier) of the known sentences."""
        if not self.signs.search(text.lower()):
            return []
        parts = pieces(text)
        found, number, within, i = [], 0, False, 0
        while i < len(parts):
            name, stop = self.spelt(parts, i)
            if not name:
                name, stop = self.filled(parts, i)
            if name:
                number += within
                found.append((number, name))
            within = not name and not parts[i][1]
            number += not within
            i = stop if name else i + 1
        return found

    def match(self, known: list[tuple[int, str]]) -> tuple[list[tuple[int, str]], list[tuple[int, str]]]:
        """(first sentence, licence) of the rules that apply, in order of the text, and what is left."""
        used, out = [False] * len(known), []
        starts: dict[str, list[int]] = {}
        for i, (_, name) in enumerate(known):
            starts.setdefault(name, []).append(i)
        for licence, names in self.rules:
            for i in starts.get(names[0], ()):
                span = range(i, i + len(names))
                if span.stop > len(known) or any(used[j] or known[j][1] != n for j, n in zip(span, names)):
                    continue
                if any(known[j + 1][0] - known[j][0] - 1 > self.gap for j in span[:-1]):
                    continue
                for j in span:
                    used[j] = True
                out.append((known[i][0], licence))
        return sorted(out), [k for k, u in zip(known, used) if not u]


def scan_licenses(docs: DataFrame, keep: list[str], gap: int = 2) -> DataFrame:
    """``docs[keep]`` with licenses (distinct, in order of the text), matches (sentence:licence), sentences (all
    identifiers in order) and unmatched (identifiers that no rule used)."""

    def make():
        rules = Rules(gap=gap)

        def work(step: pa.RecordBatch) -> list[pa.Array]:
            rows = []
            for text in strings(step):
                known = rules.identify(text)
                found, rest = rules.match(known)
                rows.append((list(dict.fromkeys(x for _, x in found)), [f"{a}:{x}" for a, x in found], [n for _, n in known], [n for _, n in rest]))
            return [pa.array([r[i] for r in rows], pa.list_(pa.string())) for i in range(4)]

        return work

    return map_rows(docs, make, "licenses array<string>, matches array<string>, sentences array<string>, unmatched array<string>", keep)
