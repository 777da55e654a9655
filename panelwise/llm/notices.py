"""Licence notices by TF-IDF cosine alone: many templates, close relatives side by side, counter-templates for negations and mentions.

A text is cut into paragraphs (comment marks are taken off, wrapped lines are
joined), those into sentences, and sentences of more than ``SPAN`` words into
overlapping stretches. A stretch is the set of its words that any template has;
its weights are the inverse document frequencies of the table. It takes the
class of the template with the highest cosine, if that reaches ``THRESHOLD``
and leads the best template of every other class by ``MARGIN``. Counter-
templates (a grant with "not" in it, a bare mention) are a class of their own
that names no licence, so "not released under the MIT License" and a sentence
that only speaks of that licence have none. The head of a paragraph, its first
line or first two, is compared with titles of licence files; there foreign
words count too.

Only templates that share an anchor term with a stretch are scored. Anchors are
a template's heaviest terms, as many as leave the rest too light to reach the
threshold (Cauchy-Schwarz), so no template is missed. Equal sets are one row,
whatever the number of files that hold them. The driver gets the document
frequencies of the templates' few hundred terms.

Only DataFrame functions run here.

Defined results: null and empty texts have no notice; repeated words of a
stretch count once; a file with several notices takes the highest cosine, then
the licence that sorts first, but a licence that another one of the file
extends (two-clause BSD by three-clause BSD) gives way; of the licence files of
a directory the most frequent licence counts, then the one that sorts first;
files with equal keys are one file; a null path has no directory; an empty
table gives an empty result; other columns do not take part.
"""

from __future__ import annotations

import itertools
import json
import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwise.llm.common import stored
from panelwise.llm.licences import directory

THRESHOLD = 0.6
TITLE_THRESHOLD = 0.9
MARGIN = 0.005
SPAN = 64
TITLE_WORDS = 12

# Licences and the names by which texts refer to them.
NAMES = {
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPL version 3", "AGPLv3"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache 2.0 License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License"),
    "BSL-1.0": ("Boost Software License, Version 1.0",),
    "CC0-1.0": ("CC0 1.0 Universal",),
    "EPL-2.0": ("Eclipse Public License 2.0",),
    "GPL-2.0": ("GNU General Public License, version 2", "GPL version 2", "GPLv2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GPL version 3", "GPLv3"),
    "ISC": ("ISC License",),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "LGPL version 2.1", "LGPLv2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPL version 3", "LGPLv3"),
    "MIT": ("MIT License",),
    "MPL-2.0": ("Mozilla Public License, v. 2.0", "Mozilla Public License Version 2.0"),
    "Unlicense": ("The Unlicense",),
    "Zlib": ("zlib License",),
}
# The parts of the Creative Commons licences, version 4.0.
CREATIVE_COMMONS = {"BY": "Attribution", "NC": "NonCommercial", "SA": "ShareAlike", "ND": "NoDerivatives"}
for _parts in (("BY",), ("BY", "NC"), ("BY", "NC", "ND"), ("BY", "NC", "SA"), ("BY", "ND"), ("BY", "SA")):
    _long = "-".join(CREATIVE_COMMONS[p] for p in _parts)
    NAMES[f"CC-{'-'.join(_parts)}-4.0"] = (f"CC {'-'.join(_parts)} 4.0", f"Creative Commons {_long} 4.0 International License", f"Creative Commons {_long} 4.0")

# Sentences that put a work under the licence named.
GRANTS = ("Released under the {}", "Licensed under the {}", "Available under the {}", "Published under the {}", "Distributed under the {}",
          "Under the terms of the {}", "Distributed under the terms of the {}", "This project is licensed under the {}",
          "This work is licensed under the {}", "This software is released under the {}")
# What speaks of a licence without granting it.
MENTIONS = ("{}", "The {}", "Under the {}", "Work under the {}", "The {} is a license", "Unlike the {}", "Compatible with the {}", "About the {}")

_GNU = ("This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, "
        "either version {} of the License, or (at your option) any later version.")
# Sentences of licence texts and of the headers they ask for.
SENTENCES = (
    ("AGPL-3.0", _GNU.format("program", "Affero General Public License", "3")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements."),
    ("Apache-2.0", "The ASF licenses this file to you under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
                     "without specific prior written permission."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation "
                "covered by this license to use, reproduce, display, distribute, execute, and transmit the Software."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
    ("GPL-2.0", _GNU.format("program", "General Public License", "2")),
    ("GPL-3.0", _GNU.format("program", "General Public License", "3")),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
            "copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", _GNU.format("library", "Lesser General Public License", "2.1")),
    ("LGPL-3.0", _GNU.format("library", "Lesser General Public License", "3")),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
            "to deal in the Software without restriction."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
            "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
            "and/or sell copies of the Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely."),
)
# Heads of licence files beside the names themselves.
TITLES = (
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("MIT", "The MIT License (MIT)"),
)
#: A licence whose text also has the notice of another one.
EXTENDS = {"BSD-2-Clause": "BSD-3-Clause"}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
NEGATION = r"n['’]t\b|\b(?:never|no longer)\b"
COMMENT = r"(^|\n)[ \t]*(?:/\*+|\*+/?|//+|#+|--+|;+|%+)[ \t]*"
SENTENCE_END = r"([.!?][\"')]*)[ \t\n]+([A-Z\"(])"
BLANK = r"\n[ \t]*\n"


@dataclass(frozen=True)
class Template:
    """A class (None: no licence), what it is compared with, and its terms."""

    licence: str | None
    title: bool
    terms: tuple[str, ...]


def terms(text: str) -> tuple[str, ...]:
    """The sorted distinct terms of a text."""
    low = re.sub(NEGATION, " not", text.translate(str.maketrans(UPPER, LOWER)), flags=re.ASCII).replace("licence", "license")
    return tuple(sorted(set(re.findall(TERM, low))))


def templates() -> tuple[Template, ...]:
    """All templates; equal ones once."""
    named = [(licence, name) for licence, names in sorted(NAMES.items()) for name in names]
    out = [Template(licence, False, terms(text)) for licence, text in SENTENCES]
    out += [Template(licence, False, terms(g.format(name))) for licence, name in named for g in GRANTS]
    for name in [name for _, name in named] + ["License"]:  # the last one: a grant or a mention that names no licence
        out += [Template(None, False, terms(g.format(name) + " not")) for g in GRANTS] + [Template(None, False, terms(m.format(name))) for m in MENTIONS]
    out += [Template(None, False, terms(g.format("License"))) for g in GRANTS]
    out += [Template(licence, True, terms(text)) for licence, text in itertools.chain(named, TITLES)]
    return tuple(dict.fromkeys(out))


def vocabulary(of: tuple[Template, ...]) -> list[str]:
    return sorted({t for template in of for t in template.terms})


def anchors(template: Template, idf: dict[str, float]) -> list[str]:
    """The heaviest terms, until the others are too light for the threshold; whatever reaches it has one of them."""
    least = TITLE_THRESHOLD if template.title else THRESHOLD
    order = sorted(template.terms, key=lambda t: (-idf[t], t))
    whole = sum(idf[t] ** 2 for t in order)
    found: list[str] = []
    for t in order:
        if math.sqrt(sum(idf[x] ** 2 for x in order[len(found):]) / whole) < least - 1e-6:
            break
        found.append(t)
    return found


def words(text: Column) -> Column:
    """All terms of a text, in order."""
    low = F.regexp_replace(F.translate(text, UPPER, LOWER), NEGATION, " not")
    return F.regexp_extract_all(F.replace(low, F.lit("licence"), F.lit("license")), F.lit(TERM), 0)


def paragraphs(text: Column) -> Column:
    """Paragraphs of a text, without carriage returns and comment marks."""
    return F.split(F.regexp_replace(F.regexp_replace(text, "\r", ""), COMMENT, "$1"), BLANK)


def sentences(paragraph: Column) -> Column:
    return F.split(F.regexp_replace(paragraph, SENTENCE_END, "$1\n\n$2"), "\n\n")


def inverse_frequencies(files: DataFrame, text: Column, terms_of: list[str]) -> tuple[dict[str, float], float]:
    """ln((1 + files) / (1 + files with the term)) + 1 for every term of the templates, and the value of a term that no file has; null texts are files too."""
    total = files.count()
    held = files.select(F.explode(F.array_distinct(F.filter(words(text), lambda t: t.isin(*terms_of)))).alias("term"))
    found = {r["term"]: r["n"] for r in held.groupBy("term").agg(F.count("*").alias("n")).collect()}
    return {t: math.log((1 + total) / (1 + found.get(t, 0))) + 1 for t in terms_of}, math.log(1 + total) + 1


def spans(files: DataFrame, key: str, text: Column, terms_of: list[str], wanted: set[str]) -> DataFrame:
    """(key, title, held, foreign): the template terms of every stretch that has an anchor; heads of paragraphs also count their foreign words."""
    def anchored(w: Column) -> Column:
        return F.exists(w, lambda t: t.isin(*sorted(wanted)))  # one hash set a task; array functions would build theirs anew for every row

    part = files.select(F.col(key).alias("key"), F.explode_outer(paragraphs(text)).alias("part")).where(anchored(words(F.col("part"))))

    def stretch(s: Column) -> Column:
        n = F.size(s)
        starts = F.sequence(F.lit(1), F.greatest(n - SPAN // 2, F.lit(1)), F.lit(SPAN // 2))
        return F.when(n <= SPAN, F.array(s)).otherwise(F.transform(starts, lambda i: F.slice(s, i, SPAN)))

    def marked(s: Column, title: bool) -> Column:
        held = F.array_sort(F.filter(F.array_distinct(s), lambda t: t.isin(*terms_of)))
        foreign = F.size(F.array_distinct(s)) - F.size(held) if title else F.lit(0)
        return F.struct(F.lit(title).alias("title"), held.alias("held"), foreign.alias("foreign"))

    plain = F.flatten(F.transform(F.filter(F.transform(sentences(F.col("part")), words), anchored), stretch))
    heads = F.filter(F.transform(F.array(*[F.regexp_extract("part", p, 1) for p in (r"^[ \t\n]*([^\n]*)", r"^[ \t\n]*([^\n]*\n[^\n]*)")]), words),
                     lambda s: (F.size(s) > 0) & (F.size(s) <= TITLE_WORDS))
    both = F.concat(F.transform(plain, lambda s: marked(s, False)), F.transform(heads, lambda s: marked(s, True)))
    # the outer form, since Spark tests the array of a plain explode before it, which computes it twice
    return part.select("key", F.explode_outer(F.array_distinct(F.filter(both, lambda x: anchored(x["held"])))).alias("s")) \
        .where("s IS NOT NULL").select("key", "s.*").distinct()


def _from_json(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A fixed table from one literal inside the plan."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def notices(files: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, licence, score): the best notice of every file that has one."""
    spark = files.sparkSession
    every = templates()
    idf, unknown = inverse_frequencies(files, text, vocabulary(every))
    leads = [anchors(t, idf) for t in every]
    found = stored(spans(files, key, text, vocabulary(every), {a for lead in leads for a in lead})
                   .withColumn("k", F.md5(F.concat_ws(" ", F.col("title").cast("string"), F.col("foreign").cast("string"), F.array_join("held", " ")).cast("binary"))), "notice-spans")
    square = F.create_map(*[F.lit(x) for t, w in sorted(idf.items()) for x in (t, w * w)])

    def weight(of: Column) -> Column:
        return F.aggregate(of, F.lit(0.0), lambda a, t: a + F.element_at(square, t))

    rows = _from_json(spark, [{"template": i, "licence": t.licence or "", "title": t.title, "terms": t.terms, "square": sum(idf[x] ** 2 for x in t.terms), "anchors": lead}
                              for i, (t, lead) in enumerate(zip(every, leads))],
                      "template: int, licence: string, title: boolean, terms: array<string>, square: double, anchors: array<string>")
    sets = found.groupBy("k").agg(F.first("title").alias("title"), F.first("held").alias("held"), F.first("foreign").alias("foreign"))
    # a set meets a template once for each anchor they share; the maximum below takes no notice of that
    pairs = sets.withColumn("anchor", F.explode("held")).join(F.broadcast(rows.withColumn("anchor", F.explode("anchors"))), ["anchor", "title"])
    dot = weight(F.array_intersect("held", "terms"))
    norm = F.sqrt((weight(F.col("held")) + F.col("foreign") * (unknown * unknown)) * F.col("square"))
    scored = pairs.select("k", "title", "licence", F.round(dot / norm, 9).alias("score")) \
        .where(F.col("score") >= F.when(F.col("title"), TITLE_THRESHOLD).otherwise(THRESHOLD)) \
        .groupBy("k", "licence").agg(F.max("score").alias("score"))
    ranked = scored.groupBy("k").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "licence")), False), 1, 2).alias("top"))  # one entry a class
    clear = ranked.where((F.size("top") == 1) | (F.round(F.col("top")[0]["score"] - F.get("top", F.lit(1))["score"], 9) >= MARGIN)) \
        .select("k", F.col("top")[0]["licence"].alias("licence"), F.col("top")[0]["score"].alias("score")).where("licence <> ''")
    each = found.select("key", "k").join(stored(clear, "clear-notices"), "k").groupBy("key", "licence").agg(F.max("score").alias("score"))
    wider = F.create_map(*[F.lit(x) for pair in EXTENDS.items() for x in pair])
    listed = each.groupBy("key").agg(F.collect_list(F.struct((-F.col("score")).alias("minus"), "licence")).alias("all"))  # at most one entry a licence
    kept = F.filter("all", lambda x: ~F.coalesce(F.exists("all", lambda y: y["licence"] == F.element_at(wider, x["licence"])), F.lit(False)))
    return listed.select("key", F.array_min(kept).alias("b")).select("key", "b.licence", (-F.col("b.minus")).alias("score"))


def scan(files: DataFrame, key: str, path: str, text: Column, licence_file: str = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$") -> DataFrame:
    """(key, path, licence, score, origin, from_directory) of every file; a file without a notice takes its nearest licensed directory's.

    ``origin`` is notice, directory or none; ``licence_file`` says which paths
    speak for their directory.
    """
    own = stored(notices(files, key, text).withColumnRenamed("key", "_key"), "file-notices")
    named = files.select(F.col(key).alias("key"), F.col(path).alias("path"))
    placed = stored(named.join(own, F.col("key").eqNullSafe(F.col("_key")), "left").drop("_key").withColumn("dir", directory(F.col("path"))), "placed-files")
    speak = placed.where(F.col("licence").isNotNull() & F.col("path").rlike(licence_file)).groupBy("dir", "licence").agg(F.count("*").alias("n"))
    granted = speak.groupBy("dir").agg(F.min_by("licence", F.struct(-F.col("n"), F.col("licence"))).alias("granted"))
    # a directory's ancestors are the prefixes that end in a slash; the deepest licensed one counts
    asks = placed.select("dir").where("dir IS NOT NULL").distinct().withColumn("parts", F.split("dir", "/"))
    asks = asks.select(F.col("dir").alias("below"), F.posexplode(F.transform(F.sequence(F.lit(1), F.size("parts") - 1),
                       lambda n: F.concat(F.array_join(F.slice("parts", F.lit(1), n), "/"), F.lit("/")))).alias("depth", "dir"))
    nearest = asks.join(granted, "dir").groupBy("below").agg(F.max_by(F.struct("granted", "dir"), "depth").alias("near"))
    out = placed.join(stored(nearest, "nearest-licence"), F.col("dir") == F.col("below"), "left")
    silent = F.col("licence").isNull() & F.col("near").isNotNull()
    return out.select(F.col("key").alias(key), F.col("path").alias(path), F.coalesce("licence", "near.granted").alias("licence"), "score",
                      F.when(F.col("licence").isNotNull(), "notice").when(silent, "directory").otherwise("none").alias("origin"),
                      F.when(silent, F.col("near.dir")).alias("from_directory"))
