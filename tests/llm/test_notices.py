"""Licence notices by cosine with counter-templates: relatives, wrapped headers, negations, mentions, brute force, odd tables."""

from __future__ import annotations

import itertools
import math
import re

import pytest

pytest.importorskip("panelwise.llm.notices")

from pyspark.sql import functions as F  # noqa: E402

from panelwise.llm import licences, notices  # noqa: E402

GPL = notices.SENTENCES[9][1]
CASES = [
    ("This library is free software; you can redistribute it and/or\n# modify it under the terms of the GNU Lesser General Public\n# License as published by the Free Software "
     "Foundation; either\n# version 2.1 of the License, or (at your option) any later version.", "LGPL-2.1"),
    ("// This program is free software: you can redistribute it and/or modify\n// it under the terms of the GNU Affero General Public License as published\n"
     "// by the Free Software Foundation, either version 3 of the License, or\n// (at your option) any later version.", "AGPL-3.0"),
    (GPL, "GPL-2.0"), (GPL.replace("version 2", "version 3"), "GPL-3.0"), ("Licensed under GPL version 2.", "GPL-2.0"),
    ("Licensed under CC BY-SA 4.0", "CC-BY-SA-4.0"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("licensed under CC BY 4.0", "CC-BY-4.0"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "CC-BY-NC-ND-4.0"),
    ("This project is not released under the MIT License.", None), ("The code isn't licensed under the Apache License, Version 2.0.", None),
    ("It was never released under the MIT License.", None),
    ("Officials said on Monday that artists could work under the MIT License from next year.", None),
    ("The MIT License is a short text.", None), ("Our terms are compatible with the Apache License, Version 2.0.", None),
    ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice "
     "and this permission notice appear in all copies.", "ISC"),
    ("This is free and unencumbered software released into the public domain.", "Unlicense"),
    ("/*\n * Licensed to the Apache Software Foundation (ASF) under one or more\n * contributor license agreements.  See the NOTICE file.\n */", "Apache-2.0"),
    ("# Licensed under the Apache License,\n# Version 2.0 (the \"License\"); you may not use this file\n# except in compliance with the License.", "Apache-2.0"),
    ("This project is licensed under the MIT License.", "MIT"), ("Released under the MIT License unless noted otherwise below by the author", "MIT"),
    ("Available under the MIT Licence", "MIT"), ("code under the terms of the MIT license", "MIT"),
    ("This project and all of its documentation is licensed under the Apache License, Version 2.0.", "Apache-2.0"),
    ("MIT License\n\nCopyright (c) 2020 Somebody", "MIT"), ("      Apache License\n   Version 2.0, January 2004\n\nTERMS", "Apache-2.0"),
    ("GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n", "LGPL-3.0"), ("BSD 3-Clause License", "BSD-3-Clause"),
    ("Copyright X.\n\nRedistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Keep.",
     "BSD-2-Clause"),
    ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n3. Neither the name of "
     "the copyright holder nor the names of its\ncontributors may be used to endorse or promote products derived from this\nsoftware without specific prior written permission.",
     "BSD-3-Clause"),
    ("word " * 3000 + "released under the MIT License " + "more " * 3000, "MIT"),
    ("under MIT supervision", None), ("Er kam mit einer Lizenz", None), ("the license of this work is unknown", None), ("", None), (None, None),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "MPL-2.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
]


def test_relatives_wrapped_headers_negations_and_mentions(spark):
    files = spark.createDataFrame([(i, t, 1, "x") for i, (t, _) in enumerate(CASES)], "k long, text string, score int, licence string")
    got = {r["key"]: r["licence"] for r in notices.notices(files, "k", F.col("text")).collect()}
    wrong = [(i, t, got.get(i), want) for i, (t, want) in enumerate(CASES) if got.get(i) != want]
    assert not wrong


def brute(texts: list[str | None]) -> list[tuple[str, float] | None]:
    """Every stretch against every template, in plain Python."""
    every = notices.templates()
    known = set(notices.vocabulary(every))
    df = {t: sum(t in notices.terms(x or "") for x in texts) for t in known}
    idf = {t: math.log((1 + len(texts)) / (1 + n)) + 1 for t, n in df.items()}
    unknown = math.log(1 + len(texts)) + 1

    def best(held, foreign, title):
        top: dict[str, float] = {}
        norm = sum(idf[t] ** 2 for t in held) + foreign * unknown ** 2
        for t in every:
            if t.title == title and norm:
                score = round(sum(idf[x] ** 2 for x in t.terms if x in held) / math.sqrt(norm * sum(idf[x] ** 2 for x in t.terms)), 9)
                if score >= (.9 if title else .6):
                    top[t.licence or ""] = max(score, top.get(t.licence or "", 0))
        order = sorted(top.items(), key=lambda x: (-x[1], x[0]))
        if order and order[0][0] and (len(order) == 1 or round(order[0][1] - order[1][1], 9) >= .005):
            return order[0]
        return None

    out = []
    for text in texts:
        found: dict[str, float] = {}
        for part in re.split(notices.BLANK, re.sub(notices.COMMENT, r"\1", (text or "").replace("\r", ""))):
            lines = part.strip(" \t\n").split("\n")
            tries = [("\n".join(lines[:n]), True) for n in (1, 2)] + [(s, False) for s in re.sub(notices.SENTENCE_END, "\\1\n\n\\2", part).split("\n\n")]
            for piece, title in tries:
                w = re.findall(notices.TERM, re.sub(notices.NEGATION, " not", piece.lower(), flags=re.ASCII).replace("licence", "license"))
                if title and len(w) > 12:
                    continue
                starts = range(0, max(1, len(w) - 32), 32) if len(w) > 64 else [0]
                for i in starts:
                    cut = set(w[i:i + 64]) if not title else set(w)
                    hit = best(cut & known, len(cut - known) if title else 0, title)
                    if hit:
                        found[hit[0]] = max(hit[1], found.get(hit[0], 0))
        if "BSD-3-Clause" in found:
            found.pop("BSD-2-Clause", None)
        out.append(min(found.items(), key=lambda x: (-x[1], x[0])) if found else None)
    return out


def test_against_brute_force(spark):
    texts = [t for t, _ in CASES] + [f"{a} {b}\n{c}" for a, b, c in itertools.islice(itertools.permutations([t for t, _ in CASES[:12]], 3), 0, 600, 37)]
    want = brute(texts)
    files = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    got = {r["key"]: (r["licence"], r["score"]) for r in notices.notices(files, "k", F.col("text")).collect()}
    for i, w in enumerate(want):
        assert (got.get(i) is None) == (w is None), texts[i]
        assert w is None or (got[i][0] == w[0] and abs(got[i][1] - w[1]) < 1e-7), texts[i]


def test_directories_and_odd_tables(spark):
    rows = [("p/LICENSE", "MIT License\n\nPermission"), ("p/a/x.py", "# Licensed under CC BY-NC 4.0."), ("p/a/y.py", "no notice"), ("p/b/c/z.py", None), ("q/x", ""),
            ("p/a/COPYING", "Licensed under the Apache License, Version 2.0"), (None, "Released under the MIT License."), ("p/a/x.py", "# Licensed under CC BY-NC 4.0.")]
    files = spark.createDataFrame([(i if i != 7 else 1, p, t, 3, True) for i, (p, t) in enumerate(rows)] + [(None, "p/n", "Released under the MIT License.", 3, False)],
                                  "k long, path string, text string, score int, title boolean")
    got = notices.scan(files, "k", "path", F.col("text"))
    found = {(r["k"], r["path"]): (r["licence"], r["origin"], r["from_directory"]) for r in got.collect()}
    assert got.count() == len(rows) + 1
    assert found[(2, "p/a/y.py")] == ("Apache-2.0", "directory", "p/a/") and found[(3, "p/b/c/z.py")] == ("MIT", "directory", "p/")
    assert found[(4, "q/x")] == (None, "none", None) and found[(6, None)] == ("MIT", "notice", None) and found[(1, "p/a/x.py")][0] == "CC-BY-NC-4.0"
    assert notices.scan(files.where("false"), "k", "path", F.col("text")).count() == 0
    assert licences.directory is notices.directory
