"""License and secret scans against plain Python, and their edge cases."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import pytest

from poolpick.llm import license_scan, secret_scan
from .conftest import DOCS, rows_of

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def test_license_rules(spark):
    mit = " ".join(license_scan.SENTENCES["MG"] + ["."]) + "\n" + license_scan.SENTENCES["MN"][0] + ".\n" + license_scan.SENTENCES["MW"][0] + "."
    wrapped = mit.replace(" of ", "\nof ")
    cases = {
        1: ("Some prose. Released under the MIT License.", "MIT", 1),
        2: ("Licensed under the Apache License, Version 2.0.\nText.\nLicensed under CC BY-NC 4.0.", "Apache-2.0,CC-BY-NC-4.0", 2),
        3: (mit, "MIT", 1), 4: (wrapped, "MIT", 1), 5: ("# SPDX-License-Identifier: GPL-3.0-only", "GPL-3.0", 1),
        6: ("RELEASED  UNDER THE mit LICENSE !", "MIT", 1), 7: ("We like the MIT License.", "", 0), 8: ("", "", 0), 9: (None, "", 0),
        10: (". ".join(license_scan.SENTENCES[c][0] for c in ("BG", "BS", "BB")) + ".", "BSD-2-Clause", 1),
        11: (". ".join(license_scan.SENTENCES[c][0] for c in ("BG", "BS", "BB", "BN")) + ".", "BSD-3-Clause", 1)}
    df = spark.createDataFrame([(i, c[0], None, None, None) for i, c in cases.items()], DOCS)
    got = {r.doc_id: (r.licenses, r.n_matches) for r in license_scan.scan(df).collect()}
    assert got == {i: c[1:] for i, c in cases.items()}


def test_scans_on_edge_tables(edge_docs, no_docs):
    for scan in (license_scan.scan, secret_scan.scan):
        assert scan(edge_docs).count() == edge_docs.count()
        assert scan(no_docs).count() == 0


def base(t):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    n = [len(found)]
    for k, (pattern, least) in enumerate(((r"AKIA[A-Z0-9]+", 16), (r"[0-9a-f]+", 32)), 1):
        more = [(m.start(), k, m.end()) for m in re.finditer(pattern, t) if len(m[0]) >= least]
        n.append(len(more))
        found += more
    text = ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))
    return (*n, hashlib.sha256(text.encode()).hexdigest())


def test_base_spans_match_plain_python(spark):
    rng = random.Random(3)
    parts = ["password", "Token", "api_key", "apikey", "SECRET", "=", ":", " ", "  ", '"', "'", "abcdefgh1234", "short", "é中", "AKIA", "AKIAABCDEFGHIJKL",
             "0123456789abcdef" * 2, "deadbeef", "\n", "==", "x=1", "İ"]
    ts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(400)] + ["token=secret:abcdefgh1234", "é password = 'abcdefgh'"]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(ts)], DOCS)
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secret_scan.scan(df).collect()}
    assert got == {i: base(t) for i, t in enumerate(ts)}


@pytest.fixture(scope="module")
def markov_case(spark):
    rng = random.Random(4)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(200)]
    plain = ["internationalization", "getElementByIdentifier", "compute_average_distance", "characteristically"]
    rows = [(i, f"token = \"{h}\"", None, None, None) for i, h in enumerate(hexes)]
    rows += [(1000 + i, " ".join(rng.choice(plain) for _ in range(30)), None, None, None) for i in range(100)]
    hidden = "".join(rng.choice("0123456789abcdef") for _ in range(30))  # too short for the base rule
    rows += [(5000, f"see {hidden} there", None, None, None), (5001, "see characteristicallyinternationalization there", None, None, None)]
    return {r.doc_id: r for r in secret_scan.scan(spark.createDataFrame(rows, DOCS)).collect()}


def test_markov_adds_random_runs_and_leaves_identifiers(markov_case):
    assert markov_case[5000].spans == "markov:4:34" and markov_case[5000].n_hex == 0
    assert markov_case[5001].spans == "" and markov_case[1000].n_markov == 0
    assert markov_case[0].spans == "assign:0:49,hex:9:49"  # the base spans stay


def test_further_licence_families(spark):
    spdx = {"BSD-2-Clause": "BSD-2-Clause", "GPL-2.0-only": "GPL-2.0", "GPL-2.0-or-later": "GPL-2.0-or-later", "GPL-3.0": "GPL-3.0", "LGPL-2.1-only": "LGPL-2.1",
            "LGPL-2.1-or-later": "LGPL-2.1-or-later", "LGPL-3.0-only": "LGPL-3.0", "LGPL-3.0-or-later": "LGPL-3.0-or-later", "AGPL-3.0-only": "AGPL-3.0",
            "AGPL-3.0-or-later": "AGPL-3.0-or-later", "MPL-2.0": "MPL-2.0", "ISC": "ISC", "Zlib": "Zlib", "Unlicense": "Unlicense", "CC0-1.0": "CC0-1.0",
            "CC-BY-4.0": "CC-BY-4.0", "CC-BY-SA-4.0": "CC-BY-SA-4.0", "CC-BY-ND-4.0": "CC-BY-ND-4.0", "CC-BY-NC-4.0": "CC-BY-NC-4.0"}
    cases = [(f"/* SPDX-License-Identifier: {k} */\ncode", v) for k, v in spdx.items()]
    later = " of the License, or (at your option) any later version."
    gnu = "you can redistribute it and/or modify it under the terms of the GNU {} General Public License as published by\nthe Free Software Foundation, either version {}"
    cases += [
        ("Licensed under the GNU General Public License, version 2.", "GPL-2.0"),
        ("Released under the GNU Lesser General Public License, version 2.1.", "LGPL-2.1"),
        ("This library is free software; " + gnu.format("Lesser", "2.1") + later, "LGPL-2.1-or-later"),
        ("This program is free software: " + gnu.format("Lesser", "3") + later, "LGPL-3.0-or-later"),
        ("This program is free software: " + gnu.format("Affero", "3") + later, "AGPL-3.0-or-later"),
        ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed.", "MPL-2.0"),
        ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\n"
         "copyright notice and this permission notice appear in all copies.", "ISC"),
        ("This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages.\n\n"
         "Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\n"
         "freely, subject to the following restrictions:", "Zlib"),
        ("This is free and unencumbered software released into the public domain.", "Unlicense"),
        ("This work is licensed under CC0 1.0.", "CC0-1.0"), ("Text. Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"),
        ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "CC-BY-ND-4.0"),
        ("Version 2.0. ISC. The zlib license is short.", "")]
    df = spark.createDataFrame([(i, t, None, None, None) for i, (t, _) in enumerate(cases)], DOCS)
    got = {r.doc_id: (r.licenses, r.n_matches) for r in license_scan.scan(df).collect()}
    assert got == {i: (want, int(want != "")) for i, (_, want) in enumerate(cases)}
    codes = list(license_scan.SENTENCES)
    assert all(len(c) == 2 for c in codes)


BASE = {"assign": (secret_scan.ASSIGN, 2, 8), "access": (secret_scan.ACCESS, 0, 16), "hex": (secret_scan.HEX, 0, 0)}


def plain_scan(rows):
    """The whole scan in plain Python: base spans, runs that touch none, both character models and the ratio."""
    found, samples = {}, {0: [], 1: []}
    for i, t in rows:
        t = t or ""
        spans = sorted((m.start(), list(BASE).index(k), m.end(), m.group(g)) for k, (p, g, least) in BASE.items() for m in re.finditer(p, t) if len(m.group(g)) >= least)
        runs = [(m.start(), m.end(), m.group()) for m in re.finditer(secret_scan.RUN, t)]
        found[i] = spans, [r for r in runs if not any(s < r[1] and r[0] < e for s, _, e, _ in spans)]
        samples[1] += [v for *_, v in spans]
        if not re.search(secret_scan.ASSIGN, t) and "AKIA" not in t and not re.search(secret_scan.HEX, t):
            samples[0] += re.findall(secret_scan.WORDLIKE, t)
    code = lambda c: secret_scan.ALPHABET.find(c) % secret_scan.SIZE
    counts = {k: Counter((code(a), code(b)) for v in vs for a, b in zip(v, v[1:])) for k, vs in samples.items()}
    trained = counts[0] and counts[1]
    row = {k: Counter() for k in counts}
    for k, c in counts.items():
        for (a, _), n in c.items():
            row[k][a] += n
    step = lambda k, a, b: math.log((counts[k][a, b] + 0.5) / (row[k][a] + 0.5 * secret_scan.SIZE))
    out = {}
    for i, (spans, runs) in found.items():
        markov = []
        for s, e, v in runs if trained else []:
            score = sum(step(1, code(a), code(b)) - step(0, code(a), code(b)) for a, b in zip(v, v[1:]))
            if score >= secret_scan.MIN_SUM and score >= secret_scan.MIN_MEAN * (len(v) - 1):
                markov.append((s, 3, e))
        text = lambda xs: ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in sorted(xs))
        base = [x[:3] for x in spans]
        out[i] = tuple(sum(k == n for _, n, _ in base) for k in range(3)) + (hashlib.sha256(text(base).encode()).hexdigest(), text(base + markov))
    return out


def scanned(spark, rows):
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    return {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in secret_scan.scan(df.repartition(3)).collect()}


def test_scan_equals_plain_python(spark):
    rng = random.Random(6)
    key = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    hexes, every = "0123456789abcdef", secret_scan.ALPHABET.rstrip("_=")

    def part():
        return rng.choice([lambda: f"token = '{key(every, rng.randrange(4, 40))}'", lambda: "AKIA" + key("ABCDEF0123", rng.randrange(8, 30)), lambda: key(hexes, rng.randrange(20, 60)),
                           lambda: key(every, rng.randrange(16, 50)), lambda: "characteristicallyinternational", lambda: "é password:" + key(hexes, 50) + "_tail" * 6,
                           lambda: key(every, 25) + "/" + key(hexes, 40), lambda: "ordinary_identifier words", lambda: "中" * 3])()

    rows = [(i, " ".join(part() for _ in range(rng.randrange(12)))) for i in range(120)]
    rows += [(200 + i, " ".join(rng.choice(["getElementByIdentifier", "compute_average", "plain", "characteristically"]) for _ in range(20))) for i in range(40)]
    rows += [(900, None), (901, ""), (902, " ".join(f"secret: {key(every, 12)}" for _ in range(700)) + " " + key(every, 45))]
    got = scanned(spark, rows)
    assert got == plain_scan(rows)
    assert sum("markov" in x[4] for x in got.values()) > 10 and got[902][0] == 700


def test_a_text_of_many_matches_takes_linear_time(spark):
    def run(n):
        rng = random.Random(n)
        text = " ".join(f"token={rng.getrandbits(64):016x} {rng.getrandbits(128):032x}" for _ in range(n))
        began = time.time()
        got = scanned(spark, [(1, text), (2, "plain words here and there")])[1]
        assert (got[0], got[2]) == (n, n)
        return time.time() - began

    run(500)
    small, large = run(4_000), run(32_000)
    assert large < 8 * small + 20
