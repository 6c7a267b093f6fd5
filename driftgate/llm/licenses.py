"""Licence scans: known licence sentences become identifiers, and their order is matched against rules."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licences and the notices that refer to them, by identifier.
SENTENCES: dict[str, list[str]] = {
    "copyright": ["All rights reserved."],
    "mit-ref": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the MIT License.",
        "This software is released under the MIT License.",
        "SPDX-License-Identifier: MIT",
    ],
    "mit-grant": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mit-as-is": [
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ],
    "mit-liability": [
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "apache-ref": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License 2.0.",
        "Released under the Apache License, Version 2.0.",
        "This project is licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "apache-grant": [
        "Licensed under the Apache License, Version 2.0 (the \"License\");",
        "Licensed under the Apache License, Version 2.0 (the \"License\")",
    ],
    "apache-compliance": ["you may not use this file except in compliance with the License."],
    "apache-copy": [
        "You may obtain a copy of the License at",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0",
    ],
    "apache-as-is": [
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "apache-see": ["See the License for the specific language governing permissions and limitations under the License."],
    "gpl3-ref": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
        "Released under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-only",
    ],
    "gpl2-ref": [
        "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "gpl3-or-later": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "gpl2-or-later": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-or-later",
    ],
    "gpl-no-warranty": [
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE.",
    ],
    "gpl-see": ["See the GNU General Public License for more details."],
    "gpl-copy": ["You should have received a copy of the GNU General Public License along with this program."],
    "lgpl21-or-later": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the "
        "Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "bsd-grant": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ],
    "bsd-source": [
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ],
    "bsd-binary": [
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution.",
    ],
    "bsd-endorse": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission.",
    ],
    "bsd-as-is": [
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ],
    "bsd3-ref": ["Licensed under the BSD 3-Clause License.", "Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "bsd2-ref": ["Licensed under the BSD 2-Clause License.", "Released under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "isc-grant": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies.",
    ],
    "isc-ref": ["Licensed under the ISC License.", "SPDX-License-Identifier: ISC"],
    "mpl2-grant": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "mpl2-copy": [
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "mpl2-ref": ["Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "cc-by-ref": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-sa-ref": ["Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc-by-nc-ref": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-long": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc0-ref": ["Released under CC0 1.0.", "Licensed under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
    "agpl3-ref": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "Licensed under the GNU Affero General Public License v3.0.",
        "Released under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "agpl3-later-ref": ["SPDX-License-Identifier: AGPL-3.0-or-later"],
    "lgpl21-ref": ["Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-only"],
    "lgpl3-ref": ["Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only"],
    "lgpl3-later-ref": ["SPDX-License-Identifier: LGPL-3.0-or-later"],
    "bsl1-ref": [
        "Boost Software License - Version 1.0",
        "Distributed under the Boost Software License, Version 1.0.",
        "Licensed under the Boost Software License, Version 1.0.",
        "SPDX-License-Identifier: BSL-1.0",
    ],
    "epl2-ref": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "Licensed under the Eclipse Public License 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "zlib-as-is": ["This software is provided 'as-is', without any express or implied warranty."],
    "zlib-grant": [
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
        "subject to the following restrictions:",
    ],
    "zlib-ref": ["Licensed under the zlib License.", "SPDX-License-Identifier: Zlib"],
    "0bsd-ref": ["SPDX-License-Identifier: 0BSD"],
    "unlicense-ref": ["SPDX-License-Identifier: Unlicense"],
    "unlicense-domain": ["This is free and unencumbered software released into the public domain."],
}

# Licences by the order of the sentences that state them; the longer rules are tried first.
RULES: list[tuple[str, list[str]]] = [
    ("Apache-2.0", ["apache-grant", "apache-compliance", "apache-copy", "apache-as-is", "apache-see"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-as-is", "mit-liability"]),
    ("GPL-3.0-or-later", ["gpl3-or-later", "gpl-no-warranty", "gpl-see", "gpl-copy"]),
    ("GPL-2.0-or-later", ["gpl2-or-later", "gpl-no-warranty", "gpl-see", "gpl-copy"]),
    ("MPL-2.0", ["mpl2-grant", "mpl2-copy"]),
    ("ISC", ["isc-grant", "mit-as-is"]),
    ("GPL-3.0-or-later", ["gpl3-or-later"]),
    ("GPL-2.0-or-later", ["gpl2-or-later"]),
    ("LGPL-2.1-or-later", ["lgpl21-or-later"]),
    ("ISC", ["isc-grant"]),
    ("MIT", ["mit-ref"]),
    ("Apache-2.0", ["apache-ref"]),
    ("Apache-2.0", ["apache-grant"]),
    ("GPL-3.0-only", ["gpl3-ref"]),
    ("GPL-2.0-only", ["gpl2-ref"]),
    ("BSD-3-Clause", ["bsd3-ref"]),
    ("BSD-2-Clause", ["bsd2-ref"]),
    ("ISC", ["isc-ref"]),
    ("MPL-2.0", ["mpl2-ref"]),
    ("CC-BY-4.0", ["cc-by-ref"]),
    ("CC-BY-4.0", ["cc-by-long"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-ref"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-ref"]),
    ("CC0-1.0", ["cc0-ref"]),
    ("Unlicense", ["unlicense-domain"]),
    ("Zlib", ["zlib-as-is", "zlib-grant"]),
    ("AGPL-3.0-only", ["agpl3-ref"]),
    ("AGPL-3.0-or-later", ["agpl3-later-ref"]),
    ("LGPL-2.1-only", ["lgpl21-ref"]),
    ("LGPL-3.0-only", ["lgpl3-ref"]),
    ("LGPL-3.0-or-later", ["lgpl3-later-ref"]),
    ("BSL-1.0", ["bsl1-ref"]),
    ("EPL-2.0", ["epl2-ref"]),
    ("Zlib", ["zlib-ref"]),
    ("0BSD", ["0bsd-ref"]),
    ("Unlicense", ["unlicense-ref"]),
]

#: One of these stands in every sentence above, whatever its case, so that what has none is passed over.
CLUES = "licen|copyright|permission|warrant|redistribut|rights reserved|in no event|mozilla|mpl|cc0|public domain"
#: Sentences end at a stop before white space, at a colon before a new line, and at a line that is empty or holds comment signs only.
ENDS = r"([.!?;][ \t\r\n]|:[ \t\r]*\n|\n[ \t\r#*/-]*\n)[ \t\r\n]*"
_MARK = "\u0001"


def _parts(sentence: str) -> list[str]:
    """A stop within a sentence ends it here too, as it does in a text; parts without a clue say nothing."""
    return [_plain(x) for x in re.sub(ENDS, _MARK, sentence).split(_MARK) if re.search(CLUES, x, re.IGNORECASE)]


@dataclass(frozen=True)
class Catalogue:
    """Sentences by identifier and rules of (licence, identifiers in order).

    A sentence without one of ``CLUES`` is never looked for, so each should have one. Identifiers have no comma.
    """

    sentences: Mapping[str, Sequence[str]]
    rules: Sequence[tuple[str, Sequence[str]]]

    @classmethod
    def of_tables(cls, sentences: DataFrame, rules: DataFrame) -> Catalogue:
        """From tables (sentence_id, sentence) and (licence, sentence_ids); a catalogue is as long as the licences in the world."""
        by_id: dict[str, list[str]] = {}
        for name, sentence in sentences.select("sentence_id", "sentence").distinct().orderBy("sentence_id", "sentence").collect():
            by_id.setdefault(name, []).append(sentence)
        listed = rules.select("licence", "sentence_ids").distinct().orderBy("licence", "sentence_ids").collect()
        return cls(by_id, [(licence, list(ids)) for licence, ids in listed])


DEFAULT = Catalogue(SENTENCES, RULES)


def known_sentences(catalogue: Catalogue = DEFAULT) -> dict[str, str]:
    """Identifier by normalised sentence; of a sentence in several parts, the later ones are numbered."""
    known: dict[str, str] = {}
    for name, variants in catalogue.sentences.items():
        for variant in variants:
            for i, part in enumerate(_parts(variant)):
                known[part] = name if i == 0 else f"{name}+{i}"
    return known


def _plain(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def known_rules(catalogue: Catalogue = DEFAULT) -> list[tuple[str, str]]:
    """Licence and the row of identifiers, with the numbered parts of their sentences; each variant is a rule."""
    known = known_sentences(catalogue)
    forms: dict[str, list[list[str]]] = {}
    for name, variants in catalogue.sentences.items():
        rows = {tuple(known[p] for p in _parts(v)) for v in variants}
        forms[name] = [list(r) for r in sorted(rows, key=lambda r: (-len(r), r))]
    rules = []
    for licence, names in catalogue.rules:
        rows: list[list[str]] = [[]]
        for name in names:
            rows = [row + form for row in rows for form in forms[name]]
        rules += [(licence, "," + ",".join(row) + ",") for row in rows]
    return sorted(rules, key=lambda r: -r[1].count(","))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), 0)


def _table(known: dict[str, str]) -> Callable[[Column], Column]:
    """Look-up of a normalised sentence: a list of small maps by a hash, since one long map is searched from end to end."""
    shelves: list[dict[str, str]] = [{} for _ in range(len(known) // 2 + 1)]
    for sentence, name in known.items():
        shelves[zlib.crc32(sentence.encode()) % len(shelves)][sentence] = name
    none = F.create_map().cast("map<string,string>")
    maps = F.array(*(F.create_map(*(F.lit(x) for pair in shelf.items() for x in pair)) if shelf else none for shelf in shelves))
    return lambda sentence: _let(sentence, lambda x: F.element_at(F.get(maps, F.pmod(F.crc32(x.cast("binary")), F.lit(len(shelves))).cast("int")), x))


def sentence_ids(text: Column, catalogue: Catalogue = DEFAULT) -> Column:
    """Identifiers of the known sentences of a text, in their order.

    A sentence may run over several lines; if it is not known as a whole, its lines are looked up each by itself, for
    notices that end without a stop. Case, punctuation and comment signs do not count.
    """
    table = _table(known_sentences(catalogue))
    text = F.translate(text, _MARK, " ")
    clue = F.lit(f"(?i){CLUES}")

    def normal(x: Column) -> Column:
        return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))

    def look_up(sentence: Column) -> Column:
        whole = table(normal(sentence))
        lines = F.filter(F.transform(F.split(sentence, "\n"), lambda x: table(normal(x))), lambda x: x.isNotNull())
        return F.when(whole.isNotNull(), F.array(whole)).otherwise(lines)

    sentences = F.filter(F.split(F.regexp_replace(text, ENDS, _MARK), _MARK), lambda x: F.regexp_like(x, clue))
    found = F.flatten(F.transform(sentences, look_up))
    return F.when(F.regexp_like(text, clue), found).otherwise(F.array().cast("array<string>"))


def licences(ids: Column, catalogue: Catalogue = DEFAULT) -> Column:
    """Licences whose rules a sequence of identifiers holds, sorted; what a longer rule has taken no shorter one takes again."""
    rules = F.array(*(F.struct(F.lit(licence).alias("licence"), F.lit(row).alias("row")) for licence, row in known_rules(catalogue)))
    # every identifier between two commas of its own, so that neighbours do not share one
    start = F.struct(F.concat(F.lit(","), F.array_join(ids, ","), F.lit(",")).alias("left"), F.array().cast("array<string>").alias("found"))

    def step(state: Column, rule: Column) -> Column:
        hit = F.contains(state["left"], rule["row"])
        return F.struct(
            F.when(hit, F.replace(state["left"], rule["row"], F.lit(","))).otherwise(state["left"]).alias("left"),
            F.when(hit, F.array_append(state["found"], rule["licence"])).otherwise(state["found"]).alias("found"),
        )

    return F.when(F.size(ids) == 0, F.array().cast("array<string>")).otherwise(
        F.array_sort(F.array_distinct(F.aggregate(rules, start, step, lambda state: state["found"])))
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", catalogue: Catalogue = DEFAULT) -> DataFrame:
    """(id, sentence_ids, licences) of every row, both arrays; one projection, without a shuffle.

    ``catalogue`` names what is known: by default the sentences and rules above, else one of your own.
    A null or empty text has no sentences. Repeated rows stay repeated, a null id stays null, other columns are ignored.
    """
    ids = docs.select(docs[id_col], sentence_ids(F.coalesce(docs[text_col], F.lit("")), catalogue).alias("sentence_ids"))
    return ids.select(id_col, "sentence_ids", _let(F.col("sentence_ids"), lambda found: licences(found, catalogue)).alias("licences"))


def oracle() -> str:
    """The scan of table documents in DuckDB: doc_id, n_sentences, sentences and licences joined by commas."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    known = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in known_sentences().items())
    left, marks = "',' || ids || ','", []
    for i, (licence, row) in enumerate(known_rules()):
        marks.append(f"CASE WHEN contains(l{i}, {quote(row)}) THEN {quote(licence)} END")
    steps = "WITH s0 AS (SELECT doc_id, ids, " + left + " AS l0 FROM joined)"
    for i, (_, row) in enumerate(known_rules()):
        steps += f", s{i + 1} AS (SELECT *, replace(l{i}, {quote(row)}, ',') AS l{i + 1} FROM s{i})"
    last = f"s{len(marks)}"
    return f"""
    WITH known(sentence, name) AS (VALUES {known}),
    parts AS (SELECT doc_id, string_split(regexp_replace(replace(coalesce(text, ''), chr(1), ' '), '{ENDS}', chr(1), 'g'), chr(1)) AS parts FROM documents),
    cut AS (SELECT doc_id, unnest(parts) AS s, generate_subscripts(parts, 1) AS p FROM parts),
    whole AS (SELECT doc_id, p, s, name FROM cut LEFT JOIN known ON sentence = trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))),
    lines AS (SELECT doc_id, p, unnest(string_split(s, chr(10))) AS s, generate_subscripts(string_split(s, chr(10)), 1) AS q FROM whole WHERE name IS NULL),
    every AS (SELECT doc_id, p, 0 AS q, name FROM whole WHERE name IS NOT NULL
              UNION ALL SELECT doc_id, p, q, name FROM lines JOIN known ON sentence = trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))),
    joined AS (SELECT doc_id, string_agg(name, ',' ORDER BY p, q) AS ids, count(*) AS n FROM every GROUP BY doc_id),
    matched AS ({steps} SELECT doc_id, list_filter([{", ".join(marks)}], lambda x: x IS NOT NULL) AS found FROM {last})
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_sentences, coalesce(ids, '') AS sentences,
           coalesce(array_to_string(list_sort(list_distinct(found)), ','), '') AS licences
    FROM documents LEFT JOIN joined USING (doc_id) LEFT JOIN matched USING (doc_id)
    """
