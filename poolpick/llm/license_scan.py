"""License scan by sentence rules, in DataFrame functions only.

A text is cut into sentences, each is normalised (ASCII lower case, words of
letters and digits, single blanks) and looked up among the known licence
sentences. The document becomes a string of identifiers, with ``_`` for an unknown
sentence; ordered rules, longest first, are matched against it from left to right
(at each place the first rule that fits), with at most ``GAP`` unknown sentences
between two parts. Licence texts come wrapped or one sentence a line, so both
readings are scanned: line ends as cuts, and line ends as blanks.

Only texts that hold one of ``ANCHORS`` are cut up. Every sentence list of a
rule holds an anchor word, so this skips no match (checked on import).

Cases: a null or empty text has no licence; sentences without letters or digits are
dropped; a repeated notice counts once in ``licenses`` and each time in
``n_matches``; an empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolpick.llm.common import text_of

GAP = 1
ANCHORS = ("licen", "warrant", "copyright", "redistribut", "permission", "free software", "released")

# Well-known sentences of public licences, by identifier.
SENTENCES = {
    "AS": ["Licensed under the Apache License, Version 2.0", "Released under the Apache License, Version 2.0",
           "This work is licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")"],
    "AU": ["you may not use this file except in compliance with the License"],
    "AO": ["You may obtain a copy of the License at"],
    "AL": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
           "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
           "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or "
           "agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
           "CONDITIONS OF ANY KIND, either express or implied"],
    "MS": ["Released under the MIT License", "Licensed under the MIT License", "This work is licensed under the MIT License",
           "This project is licensed under the MIT License", "Distributed under the MIT License"],
    "MG": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
           "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
           "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
           "Software is furnished to do so, subject to the following conditions"],
    "MN": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "MW": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
           "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"],
    "BG": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
           "conditions are met"],
    "BS": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "BB": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
           "disclaimer in the documentation and/or other materials provided with the distribution"],
    "BN": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
           "derived from this software without specific prior written permission"],
    "GS": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3",
           "Released under the GNU General Public License, version 3"],
    "GF": ["This program is free software"],
    "G2": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
           "Foundation, either version 2 of the License, or (at your option) any later version"],
    "G3": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
           "Foundation, either version 3 of the License, or (at your option) any later version"],
    "CN": ["Licensed under CC BY-NC 4.0", "Released under CC BY-NC 4.0", "This work is licensed under CC BY-NC 4.0",
           "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CB": ["Licensed under CC BY 4.0", "Released under CC BY 4.0", "This work is licensed under CC BY 4.0",
           "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    # letter and digit, with letters that end no other identifier: no two neighbours read as one of these
    "D2": ["This work is licensed under the GNU General Public License, version 2", "Licensed under the GNU General Public License, version 2",
           "Released under the GNU General Public License, version 2"],
    "E3": ["Licensed under the GNU Lesser General Public License, version 3", "Released under the GNU Lesser General Public License, version 3",
           "This work is licensed under the GNU Lesser General Public License, version 3"],
    "E2": ["Licensed under the GNU Lesser General Public License, version 2.1", "Released under the GNU Lesser General Public License, version 2.1",
           "This work is licensed under the GNU Lesser General Public License, version 2.1"],
    "E0": ["This library is free software"],
    "E5": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software "
           "Foundation, either version 2.1 of the License, or (at your option) any later version"],
    "E6": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software "
           "Foundation, either version 3 of the License, or (at your option) any later version"],
    "H0": ["Licensed under the GNU Affero General Public License, version 3", "Released under the GNU Affero General Public License, version 3",
           "This work is licensed under the GNU Affero General Public License, version 3"],
    "H3": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software "
           "Foundation, either version 3 of the License, or (at your option) any later version"],
    "P0": ["Licensed under the Mozilla Public License, version 2.0",
           "Released under the Mozilla Public License, version 2.0", "This work is licensed under the Mozilla Public License, version 2.0"],
    "P1": ["This Source Code Form is subject to the terms of the Mozilla Public License, v"],
    "K1": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
           "the above copyright notice and this permission notice appear in all copies",
           "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that "
           "the above copyright notice and this permission notice appear in all copies"],
    "K0": ["Licensed under the ISC License", "Released under the ISC License", "This work is licensed under the ISC License"],
    "Z1": ["This software is provided 'as-is', without any express or implied warranty"],
    "Z2": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and "
           "redistribute it freely, subject to the following restrictions"],
    "Z0": ["Licensed under the zlib License", "Released under the zlib License", "This work is licensed under the zlib License"],
    "J1": ["This is free and unencumbered software released into the public domain"],
    "J0": ["Licensed under the Unlicense", "Released under the Unlicense", "This work is licensed under the Unlicense"],
    "Q0": ["Licensed under CC0 1.0", "Released under CC0 1.0", "This work is licensed under CC0 1.0",
           "This work is licensed under a Creative Commons CC0 1.0 Universal License"],
    "R0": ["Licensed under CC BY-SA 4.0", "Released under CC BY-SA 4.0", "This work is licensed under CC BY-SA 4.0",
           "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "T0": ["Licensed under CC BY-ND 4.0", "Released under CC BY-ND 4.0", "This work is licensed under CC BY-ND 4.0",
           "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    # names count only behind SPDX-License-Identifier, so they have small letters and are no sentences of n_known
    "SI": ["SPDX-License-Identifier"],
    "na": ["Apache-2.0"],
    "nm": ["MIT"],
    "nb": ["BSD-3-Clause"],
    "ng": ["GPL-3.0-or-later", "GPL-3.0-only"],
    "nw": ["GPL-3.0"],
    "vb": ["2.0"],  # behind P1, whose "v." ends a sentence
    "nc": ["BSD-2-Clause"],
    "nd": ["GPL-2.0-only", "GPL-2.0"],
    "ne": ["GPL-2.0-or-later"],
    "nf": ["LGPL-2.1-only", "LGPL-2.1"],
    "nh": ["LGPL-2.1-or-later"],
    "ni": ["LGPL-3.0-only", "LGPL-3.0"],
    "nj": ["LGPL-3.0-or-later"],
    "nk": ["AGPL-3.0-only", "AGPL-3.0"],
    "nl": ["AGPL-3.0-or-later"],
    "nn": ["MPL-2.0"],
    "no": ["ISC"],
    "np": ["Zlib"],
    "nq": ["Unlicense"],
    "nr": ["CC0-1.0"],
    "ns": ["CC-BY-4.0"],
    "nt": ["CC-BY-SA-4.0"],
    "nu": ["CC-BY-ND-4.0"],
    "nv": ["CC-BY-NC-4.0"],
}
#: ordered rules: identifier sequence -> licence
RULES = [
    (["BG", "BS", "BB", "BN"], "BSD-3-Clause"),
    (["BG", "BS", "BB"], "BSD-2-Clause"),
    (["AS", "AU", "AO", "AL"], "Apache-2.0"),
    (["MG", "MN", "MW"], "MIT"),
    (["AS", "AU", "AL"], "Apache-2.0"),
    (["GF", "G3"], "GPL-3.0-or-later"),
    (["GF", "G2"], "GPL-2.0-or-later"),
    (["SI", "na"], "Apache-2.0"),
    (["SI", "nm"], "MIT"),
    (["SI", "nb"], "BSD-3-Clause"),
    (["SI", "ng"], "GPL-3.0"),
    (["GF", "H3"], "AGPL-3.0-or-later"),
    (["E0", "E5"], "LGPL-2.1-or-later"),
    (["E0", "E6"], "LGPL-3.0-or-later"),
    (["GF", "E5"], "LGPL-2.1-or-later"),
    (["GF", "E6"], "LGPL-3.0-or-later"),
    (["Z1", "Z2"], "Zlib"),
    (["P1", "vb"], "MPL-2.0"),
    (["SI", "nw"], "GPL-3.0"),
    (["SI", "nc"], "BSD-2-Clause"),
    (["SI", "nd"], "GPL-2.0"),
    (["SI", "ne"], "GPL-2.0-or-later"),
    (["SI", "nf"], "LGPL-2.1"),
    (["SI", "nh"], "LGPL-2.1-or-later"),
    (["SI", "ni"], "LGPL-3.0"),
    (["SI", "nj"], "LGPL-3.0-or-later"),
    (["SI", "nk"], "AGPL-3.0"),
    (["SI", "nl"], "AGPL-3.0-or-later"),
    (["SI", "nn"], "MPL-2.0"),
    (["SI", "no"], "ISC"),
    (["SI", "np"], "Zlib"),
    (["SI", "nq"], "Unlicense"),
    (["SI", "nr"], "CC0-1.0"),
    (["SI", "ns"], "CC-BY-4.0"),
    (["SI", "nt"], "CC-BY-SA-4.0"),
    (["SI", "nu"], "CC-BY-ND-4.0"),
    (["SI", "nv"], "CC-BY-NC-4.0"),
    (["MG", "MN"], "MIT"),
    (["AS"], "Apache-2.0"),
    (["MS"], "MIT"),
    (["GS"], "GPL-3.0"),
    (["CN"], "CC-BY-NC-4.0"),
    (["CB"], "CC-BY-4.0"),
    (["D2"], "GPL-2.0"),
    (["E3"], "LGPL-3.0"),
    (["E2"], "LGPL-2.1"),
    (["H0"], "AGPL-3.0"),
    (["P0"], "MPL-2.0"),
    (["K1"], "ISC"),
    (["K0"], "ISC"),
    (["Z0"], "Zlib"),
    (["J1"], "Unlicense"),
    (["J0"], "Unlicense"),
    (["Q0"], "CC0-1.0"),
    (["R0"], "CC-BY-SA-4.0"),
    (["T0"], "CC-BY-ND-4.0"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD, CUT = "[^a-z0-9]+", "([.!?;:])[ \\t\\r\\n]+"


def normalise(sentence: str) -> str:
    return re.sub(NOT_WORD, " ", sentence.lower()).strip()


KEYS = {normalise(s): code for code, ss in SENTENCES.items() for s in ss}
PATTERN = "|".join((f"_{{0,{GAP}}}").join(codes) for codes, _ in RULES)
RULE_OF = {"".join(codes): licence for codes, licence in RULES}
for _codes, _ in RULES:
    for _key in (k for k, c in KEYS.items() if c == _codes[0]):
        assert any(a in _key for a in ANCHORS), _key


def _map(pairs: dict):
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _identifiers(text, line_ends_cut: bool):
    """The document as a string of identifiers, of one reading."""
    low = F.translate(text, UPPER, LOWER)
    if not line_ends_cut:
        low = F.regexp_replace(low, "[\\r\\n]+", " ")
    cut = F.split(F.regexp_replace(low, CUT, "$1\n"), "\n")
    norm = F.filter(F.transform(cut, lambda s: F.trim(F.regexp_replace(s, NOT_WORD, " "))), lambda s: s != "")
    return F.array_join(F.transform(norm, lambda s: F.coalesce(F.try_element_at(_map(KEYS), s), F.lit("_"))), "")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_known, n_matches, licenses (sorted, comma-joined) for every row of ``docs``."""
    text = text_of(docs)
    low = F.lower(text)
    candidate = F.lit(False)
    for a in ANCHORS:
        candidate = candidate | low.contains(a)
    found = docs.select("doc_id", *[F.when(candidate, _identifiers(text, cut)).otherwise(F.lit("")).alias(f"view_{int(cut)}") for cut in (True, False)])
    hits = lambda v: F.transform(F.regexp_extract_all(F.col(v), F.lit(f"({PATTERN})")),
                                 lambda m: F.element_at(_map(RULE_OF), F.replace(m, F.lit("_"), F.lit(""))))
    found = found.withColumns({"lines": hits("view_1"), "flow": hits("view_0")})
    known = lambda v: (F.length(F.regexp_replace(F.col(v), "[_a-z]", "")) / 2).cast("long")
    return found.select("doc_id", F.greatest(known("view_1"), known("view_0")).alias("n_known"),
                        F.greatest(F.size("lines"), F.size("flow")).cast("long").alias("n_matches"),
                        F.array_join(F.array_sort(F.array_distinct(F.concat("lines", "flow"))), ",").alias("licenses"))


def oracle() -> str:
    """The same scan as DuckDB SQL, over the view ``documents``."""
    lit = lambda s: "'" + s.replace("'", "''") + "'"
    duck_map = lambda d: "MAP {" + ", ".join(f"{lit(k)}: {lit(v)}" for k, v in d.items()) + "}"
    cut = lambda t: (f"list_filter(list_transform(string_split(regexp_replace({t}, '([.!?;:])[ \\t\\r\\n]+', '\\1' || chr(10), 'g'), chr(10)), "  # noqa: E731
                     f"lambda s: trim(regexp_replace(s, '{NOT_WORD}', ' ', 'g'))), lambda s: s <> '')")
    ids = lambda t: f"coalesce(array_to_string(list_transform({cut(t)}, lambda s: coalesce({duck_map(KEYS)}[s], '_')), ''), '')"
    hits = lambda v: f"list_transform(regexp_extract_all({v}, '{PATTERN}'), lambda m: {duck_map(RULE_OF)}[replace(m, '_', '')])"
    return f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents),
v AS (SELECT doc_id, {ids('low')} AS a, {ids("regexp_replace(low, '[\\r\\n]+', ' ', 'g')")} AS b FROM t),
h AS (SELECT doc_id, a, b, {hits('a')} AS lines, {hits('b')} AS flow FROM v)
SELECT doc_id, CAST(greatest(length(regexp_replace(a, '[_a-z]', '', 'g')), length(regexp_replace(b, '[_a-z]', '', 'g'))) // 2 AS BIGINT) AS n_known,
       CAST(greatest(len(lines), len(flow)) AS BIGINT) AS n_matches,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(lines, flow))), ','), '') AS licenses
FROM h
"""
