"""License scans: sparse TF-IDF cosine of notices to templates, then nearest-ancestor inheritance by path joins.

A file's text is cut into statements (lines and sentences). A statement whose
TF-IDF vector has a cosine of at least ``threshold`` with a template is a
notice of that licence, and so is one that is longer than the template and has
a stretch of the template's length that does, or that has one of the fixed
phrases or is a licence file's title. Only statements with an anchor term are
looked at: the anchors are chosen so that, by the Cauchy-Schwarz bound, no
statement or stretch without one can reach the threshold; the same bound drops
stretches whose terms of the template weigh too little. Equal statements and
stretches are scored once, so a notice that stands in a third of all files is
one row. A licence file speaks for its directory; a file without a notice takes
the licence of the nearest directory above it that has one.

Only DataFrame functions run here.

Defined results: null and empty texts have no notice; a file with several
notices takes the one with the highest cosine, then the licence that sorts
first; a directory takes the licence most of its licence files name, then the
one that sorts first; files with equal keys are one file; a null path has no
directory; an empty table gives an empty result; other columns do not take
part.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwise.llm.common import stored
from panelwise.session import literal_table

THRESHOLD = 0.6

#: Licence and the notices by which works are put under it.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)

#: What names a licence word for word wherever it stands in a statement.
PHRASES = (
    ("Apache-2.0", "under the Apache License, Version 2.0"),
    ("BSD-3-Clause", "under the BSD 3-Clause License"),
    ("CC-BY-4.0", "under CC BY 4.0"),
    ("GPL-3.0", "under the GNU General Public License, version 3"),
    ("MIT", "under the MIT License"),
    ("MIT", "terms of the MIT License"),
    ("MPL-2.0", "under the Mozilla Public License, v. 2.0"),
)

#: Statements that head licence files; the whole statement has these words.
TITLES = (
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "Version 2.0, January 2004"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("CC-BY-4.0", "Attribution 4.0 International"),
    ("CC-BY-NC-4.0", "Attribution-NonCommercial 4.0 International"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("MIT", "MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
)

TERM = "[a-z0-9]+"
#: Function words that carry no weight.
STOP = ("a", "an", "and", "any", "are", "as", "at", "be", "by", "can", "for", "from", "in", "is", "it", "may", "not", "of", "on", "or", "that", "the", "this", "to",
        "was", "with", "you", "your")


def terms(text: str) -> list[str]:
    return [t for t in re.findall(TERM, text.lower()) if t not in STOP]


class Weights:
    """Inverse document frequencies over the templates, template vectors of length 1, and the anchor terms."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD):
        counts = [Counter(terms(text)) for _, text in templates]
        df = Counter(t for c in counts for t in c)
        self.unknown = math.log(1 + len(templates)) + 1
        self.idf = {t: math.log((1 + len(templates)) / (1 + n)) + 1 for t, n in df.items()}
        self.vectors = []
        for c in counts:
            weights = {t: n * self.idf[t] for t, n in c.items()}
            norm = math.sqrt(sum(w * w for w in weights.values()))
            self.vectors.append({t: w / norm for t, w in weights.items()})
        # long terms first, which plain text seldom has, until what is left of every template is too short to reach the threshold
        self.anchors: set[str] = set()
        for vector in self.vectors:
            for t in sorted(vector, key=lambda t: (len(t) < 5, -vector[t], t)):
                if math.sqrt(sum(w * w for x, w in vector.items() if x not in self.anchors)) < threshold - 1e-6:
                    break
                self.anchors.add(t)


def statements(text: Column) -> Column:
    """Lines and sentences of a text."""
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"([.!?:;])\s+", "$1\n"), "\n")


def visible_text(html: Column) -> Column:
    """HTML with every tag, and the marks around comments, replaced by a line break; what comments say is kept."""
    return F.regexp_replace(html, "<!--|-->|<[^>]*>", "\n")


def stretches(words: Column, template: int, length: int, vector: dict[str, float], threshold: float) -> Column:
    """(template, words): the whole statement and every run of ``length`` words of a longer one, without those that cannot reach the threshold.

    A cosine is at most the root of the squared template weights of the terms both have.
    """
    known = F.array(*[F.lit(t) for t in vector])
    square = F.create_map(*[F.lit(x) for t, w in vector.items() for x in (t, w * w)])

    def near(s: Column) -> Column:
        return F.aggregate(F.array_intersect(s, known), F.lit(0.0), lambda a, t: a + F.element_at(square, t)) >= (threshold - 1e-6) ** 2

    def marked(s: Column) -> Column:
        return F.struct(F.lit(template).alias("template"), s.alias("words"))

    starts = F.when(F.size(words) > length, F.sequence(F.lit(1), F.size(words) - length + 1)).otherwise(F.array().cast("array<int>"))
    runs = F.filter(F.transform(starts, lambda p: F.slice(words, p, length)), near)
    return F.when(near(words), F.concat(F.array(marked(words)), F.transform(runs, marked))).otherwise(F.array().cast("array<struct<template:int,words:array<string>>>"))


def notices(files: DataFrame, key: str, text: Column, weights: Weights, templates: tuple[tuple[str, str], ...] = TEMPLATES,
            threshold: float = THRESHOLD) -> DataFrame:
    """(key, licence, score): the best notice of every file that has one."""
    spark = files.sparkSession
    fixed = [(name, " " + " ".join(terms(text)) + " ", whole) for group, whole in ((PHRASES, False), (TITLES, True)) for name, text in group]
    anchors = weights.anchors | {max(text.split(), key=len) for _, text, _ in fixed if not weights.anchors & set(text.split())}
    anchor = r"(?i)(?<![a-z0-9])(" + "|".join(sorted(anchors)) + r")(?![a-z0-9])"
    found = stored(files.select(F.col(key).alias("key"), F.explode(F.filter(statements(text), lambda s: s.rlike(anchor))).alias("line"))
                   .withColumn("k", F.md5(F.col("line").cast("binary"))), "statements")
    lines = found.groupBy("k").agg(F.first("line").alias("line")).select(
        "k", F.filter(F.regexp_extract_all(F.lower("line"), F.lit(TERM), 0), lambda t: ~t.isin(*STOP)).alias("words"))
    told = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    named = lines.select("k", F.explode(F.array_compact(F.array(*[
        F.when(told == t if whole else told.contains(t), F.lit(name)) for name, t, whole in fixed]))).alias("licence")).withColumn("score", F.lit(1.0))
    spans = stored(lines.select("k", F.explode(F.flatten(F.array(*[
        stretches(F.col("words"), i, len(terms(templates[i][1])), v, threshold) for i, v in enumerate(weights.vectors)]))).alias("s"))
        .select("k", "s.template", F.array_sort("s.words").alias("words")).withColumn("span", F.md5(F.array_join("words", " ").cast("binary"))), "stretches")
    tf = spans.groupBy("span").agg(F.first("words").alias("words")).select("span", F.explode("words").alias("term")).groupBy("span", "term").agg(F.count("*").alias("tf"))
    idf = literal_table(spark, sorted(weights.idf.items()), "term string, idf double")
    vectors = literal_table(spark, [(t, i, w) for i, v in enumerate(weights.vectors) for t, w in sorted(v.items())], "term string, template int, weight double")
    own = F.col("tf") * F.coalesce("idf", F.lit(weights.unknown))
    weighed = stored(tf.join(F.broadcast(idf), "term", "left").select("span", "term", own.alias("w")), "term-weights")
    norm = weighed.groupBy("span").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dot = weighed.join(F.broadcast(vectors), "term").groupBy("span", "template").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    names = F.array(*[F.lit(name) for name, _ in templates])
    scored = dot.join(norm, "span").select("span", "template", F.round(F.col("dot") / F.col("norm"), 9).alias("score")).where(F.col("score") >= threshold)
    reached = spans.join(scored, ["span", "template"]).select("k", F.element_at(names, F.col("template") + 1).alias("licence"), "score").unionByName(named)
    best = stored(reached.groupBy("k").agg(F.max("score").alias("score"), F.min_by("licence", F.struct(-F.col("score"), F.col("licence"))).alias("licence")), "notices")
    return found.select("key", "k").distinct().join(best, "k").groupBy("key").agg(
        F.min_by("licence", F.struct(-F.col("score"), F.col("licence"))).alias("licence"), F.max("score").alias("score"))


def directory(path: Column) -> Column:
    """The path up to and with its last slash; the whole path and a slash if there is none."""
    return F.when(F.locate("/", path) > 0, F.regexp_extract(path, r"(?s)^(.*/)", 1)).otherwise(F.concat(path, F.lit("/")))


def scan(files: DataFrame, key: str, path: str, text: Column, licence_file: str = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$",
         templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(key, path, licence, score, origin, from_directory) of every file.

    ``origin`` is notice, directory or none; ``licence_file`` says which paths
    speak for their directory.
    """
    weights = Weights(templates, threshold)
    own = stored(notices(files, key, text, weights, templates, threshold).select(F.col("key").alias("_key"), "licence", "score"), "file-licences")
    names = files.select(F.col(key).alias("key"), F.col(path).alias("path"))
    marked = stored(names.join(own, F.col("key").eqNullSafe(F.col("_key")), "left").drop("_key").withColumn("dir", directory(F.col("path"))), "marked")
    votes = marked.where(F.col("licence").isNotNull() & F.col("path").rlike(licence_file)).groupBy("dir", "licence").agg(F.count("*").alias("n"))
    granted = votes.groupBy("dir").agg(F.min_by("licence", F.struct(-F.col("n"), F.col("licence"))).alias("granted"))
    # every directory that holds files asks all directories above it, itself included
    parts = F.split(F.col("dir"), "/")
    above = marked.where("dir IS NOT NULL").select("dir").distinct().select(
        F.col("dir").alias("of"), F.explode(F.sequence(F.lit(1), F.size(parts) - 1)).alias("depth"), parts.alias("parts")) \
        .select("of", "depth", F.concat(F.array_join(F.slice("parts", 1, F.col("depth")), "/"), F.lit("/")).alias("dir"))
    nearest = stored(above.join(granted, "dir").groupBy("of").agg(
        F.max_by("granted", "depth").alias("granted"), F.max_by("dir", "depth").alias("from_directory")), "directory-licences")
    joined = marked.join(nearest, F.col("dir") == F.col("of"), "left")
    inherits = F.col("licence").isNull() & F.col("granted").isNotNull()
    return joined.select(
        F.col("key").alias(key), F.col("path").alias(path), F.coalesce("licence", "granted").alias("licence"), "score",
        F.when(F.col("licence").isNotNull(), "notice").when(inherits, "directory").otherwise("none").alias("origin"),
        F.when(inherits, F.col("from_directory")).alias("from_directory"))
