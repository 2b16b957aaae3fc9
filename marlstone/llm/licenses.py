"""Licence scan: sparse TF-IDF cosine of notices to licence templates, then inheritance from the nearest directory.

Native expressions only. A notice is a line of a text, a short text as a whole, or a run of words as long as a
template and aligned with it, wherever lines and sentences break. Its vector has its terms' counts times their inverse
document frequencies over the whole corpus; a term that no template has counts with the greatest frequency value, so
other words are far from every template. SPDX identifiers are read as such. A file that is mostly notices, or near
enough to the body of a licence as a whole, is a licence file and governs its directory; a file without a notice of
its own takes the licence of the nearest directory above it that has one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_stored, stored

#: Least cosine of a notice; least share of a file's words in notices that makes it a licence file.
COSINE, FILE_SHARE = 0.6, 0.5
#: Least cosine of a run of words, which has a template's length and so no words beside it; least cosine of a whole file to a licence's body.
WINDOW, BODY = 0.8, 0.8
#: Bodies of licences, one file each.
TEXTS = Path(__file__).parent / "licence_texts"
_CUT = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Licences and the wording of their usual notices.
TEMPLATES = [
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
]


def templates(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"({i}, '{name}', '{text}')" for i, (name, text) in enumerate(TEMPLATES)) + " AS t(template, licence, text)")


def terms(text: Column) -> Column:
    """Runs of letters and digits, lower-cased; none of a null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _CUT), "")


def _among(column: str, words: list[str]) -> Column:
    """The elements of an array that are among these terms, as one piece of SQL: a call for each of thousands of literals takes seconds."""
    return F.expr(f"filter({column}, t -> t IN ({', '.join(map(repr, words))}))" if words else "CAST(array() AS array<string>)")


def _frequencies(files: DataFrame, vocabulary: list[str]) -> tuple[dict[str, int], int]:
    """Files that have each term of the vocabulary, and all files, from one scan; as many rows as that has, whatever the size of the corpus."""
    mine = F.array_distinct(_among("w", vocabulary))
    told = files.select(terms(F.col("text")).alias("w")).select(F.explode(F.concat(mine, F.array(F.lit("")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    found = {r["term"]: r["df"] for r in told.collect()}
    return found, found.pop("", 0)


def _table(spark: SparkSession, rows: list[tuple], columns: str, empty: str) -> DataFrame:
    """A small table of literals."""
    return spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, rows or [empty]))} AS t({columns})" + ("" if rows else " LIMIT 0"))


def _bodies() -> dict[str, Counter]:
    return {p.stem: Counter(re.sub(_CUT, " ", p.read_text().lower()).split()) for p in sorted(TEXTS.glob("*.txt"))}


def _weights(known: DataFrame, df: dict[str, int], vocabulary: list[str], total: int) -> tuple[DataFrame, DataFrame]:
    """idf of each template term over all files, and the unit vectors of the templates: (term, idf), (template, licence, term, weight)."""
    words = known.select("template", "licence", F.explode(terms(F.col("text"))).alias("term")).groupBy("template", "licence", "term").agg(F.count(F.lit(1)).alias("tf"))
    found = _table(known.sparkSession, [(t, df.get(t, 0)) for t in vocabulary], "term, df", "('', 0)")
    idf = found.select("term", F.log(F.lit(total + 2.0) / (F.col("df") + 1.0)).alias("idf"))
    vectors = words.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("template")))
    return idf, vectors.withColumn("weight", F.col("w") / norm).select("template", "licence", "term", "weight")


def _anchors(vectors: DataFrame, cosine: float) -> list[str]:
    """Terms of which a line must have one to reach the cosine: without a template's heaviest terms the rest of it is too short."""
    lighter = Window.partitionBy("template").orderBy("weight", "term").rowsBetween(Window.unboundedPreceding, 0)
    rows = vectors.withColumn("reach", F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(lighter))).where(F.col("reach") >= cosine - 1e-9)
    return [r["term"] for r in rows.select("term").distinct().orderBy("term").collect()]


def _aligned(known: DataFrame, anchors: list[str]) -> list[tuple[str, int, int]]:
    """Where the anchor terms stand in templates: term, its place, and the template's length."""
    return sorted({(t, at, len(r["terms"])) for r in known.select(terms(F.col("text")).alias("terms")).collect() for at, t in enumerate(r["terms"]) if t in set(anchors)})


def _near(w: Column, anchors: list[str], most: int) -> Column:
    """The anchor terms among words: each term, the words around it, and its place in them."""
    at = F.transform(w, lambda t, i: F.struct(t.alias("term"), i.alias("i")))
    low = lambda h: F.greatest(h["i"] - most, F.lit(0))
    return F.transform(F.filter(at, lambda h: h["term"].isin(anchors)), lambda h: F.struct(h["term"].alias("term"), (h["i"] - low(h)).alias("i"), F.slice(w, low(h) + 1, F.lit(2 * most)).alias("w")))


def _windows(units: DataFrame, aligned: list[tuple[str, int, int]]) -> DataFrame:
    """id, path, x, words, line: around each anchor term of a file, the words that a template aligned there would cover."""
    start = F.col("hit.i") - F.col("at")
    window = F.slice("hit.w", F.greatest(start, F.lit(0)) + 1, F.col("n") + F.least(start, F.lit(0)))
    table = _table(units.sparkSession, aligned, "anchor, at, n", "('', 0, 1)")
    hits = units.select("id", "path", "x", "words", F.explode("hits").alias("hit"))
    return hits.join(F.broadcast(table), F.col("hit.term") == F.col("anchor")).select("id", "path", "x", "words", F.array_join(window, " ").alias("line")).distinct()


class _Bodies:
    """The bodies as unit vectors, and which files may be near one."""

    def __init__(self, bodies: dict[str, Counter], df: dict[str, int], total: int):
        self.total, self.rows, self.classes = total, [], []
        idf = lambda t: math.log((total + 2.0) / (df.get(t, 0) + 1.0))
        for name, counts in bodies.items():
            weights = {t: n * idf(t) for t, n in counts.items()}
            norm = math.sqrt(sum(w * w for w in weights.values()))
            self.rows += [(name, t, w / norm) for t, w in weights.items()] if norm else []
            # by Cauchy-Schwarz a file of that cosine has body terms whose squared weights sum to BODY^2 of the body's;
            # terms of about one weight are counted together, each as the heaviest of them
            top = max(weights.values(), default=0.0)
            classes: dict[int, list[str]] = {}
            for t, w in sorted(weights.items()):
                classes.setdefault(min(int(2 * math.log2(top / w)), 16) if w > 0 else 16, []).append(t)
            self.classes.append(((BODY * norm) ** 2 * (1 - 1e-9), [(max(weights[t] for t in own) ** 2, own) for _, own in sorted(classes.items())]))
        self.terms = sorted({t for c in bodies.values() for t in c})
        self.idf = [(t, idf(t)) for t in self.terms]

    def own(self, w: str) -> Column:
        """The distinct body terms among the words of a column."""
        return F.array_distinct(_among(w, self.terms))

    def fits(self, own: str) -> Column:
        """Whether a file with these distinct body terms can reach the cosine with a body."""
        fits = F.lit(False)
        for need, classes in self.classes:
            fits = fits | (sum((F.size(_among(own, some)) * F.lit(w) for w, some in classes), F.lit(0.0)) >= need)
        return fits

    def score(self, units: DataFrame) -> DataFrame:
        """id, path, x, words, best: files whose cosine to a body is BODY or more."""
        spark = units.sparkSession
        vectors = _table(spark, self.rows, "licence, term, weight", "('', '', 0.0D)").withColumn("weight", F.col("weight").cast("double"))
        values = _table(spark, self.idf, "term, idf", "('', 0.0D)").withColumn("idf", F.col("idf").cast("double"))
        near = units.where("body is not null")
        seen = near.select("x", "body").dropDuplicates(["x"]).select("x", F.explode("body").alias("term")).groupBy("x", "term").agg(F.count(F.lit(1)).alias("tf"))
        weighed = seen.join(F.broadcast(values), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.log(F.lit(self.total + 2.0))))
        norms = weighed.groupBy("x").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        dots = weighed.join(F.broadcast(vectors), "term").groupBy("x", "licence").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
        score = F.round(F.col("dot") / F.col("norm"), 9)
        best = dots.join(norms, "x").withColumn("score", score).where(F.col("score") >= BODY).groupBy("x").agg(F.min(F.struct((-F.col("score")).alias("order"), F.col("licence"))).alias("best"))
        return near.select("id", "path", "x", "words").join(best, "x").select("id", "path", "x", "words", "best")


def _identifiers(text: Column, names: list[str]) -> Column:
    """SPDX identifiers of the licences in names, later versions allowed or not."""
    told = F.regexp_extract_all(text, F.lit(r"SPDX-License-Identifier:[ \t]*([^\r\n]*)"), F.lit(1))
    ids = F.transform(F.flatten(F.transform(told, lambda t: F.split(t, "[^A-Za-z0-9.+-]+"))), lambda t: F.regexp_replace(t, r"(-only|-or-later|\+)$", ""))
    return F.when(text.contains("SPDX-License-Identifier:"), F.array_distinct(F.filter(ids, lambda t: t.isin(names))))


def scan_licences(files: DataFrame, known: DataFrame | None = None, cosine: float = COSINE, file_share: float = FILE_SHARE) -> DataFrame:
    """files: id, path, text. One row per row of files: id, path, licence, score, origin, licence_path.

    origin: `own` (a notice or an SPDX identifier in the text, or the whole text near a body: the greatest cosine, then
    the first licence by name; an identifier counts as 1),
    `inherited` (from licence_path, the nearest directory above that a licence file governs; the file's own
    directory comes first) or null with null licence. Several licence files of a directory: the greatest cosine, then
    the first by name. Null and empty texts have no notice but inherit; a null path is in no directory. Rows may
    repeat; they get equal answers, and count once each in the share of notices. known: template, licence, text; with other templates no bodies are used. Other
    columns are ignored.

    The texts are read twice: once for the frequencies and once for the few units of each file that are scored, which
    are written out. Lines are scored once per distinct line and directories once per distinct directory, so a notice
    or a directory that a third of the files share is one row until the last joins, which adaptive execution splits.
    """
    spark = files.sparkSession
    files = files.select("id", "path", "text")
    bodies = _bodies() if known is None else {}
    known = templates(spark) if known is None else known
    vocabulary = [r["term"] for r in known.select(F.explode(terms(F.col("text"))).alias("term")).distinct().orderBy("term").collect()]
    df, total = _frequencies(files, sorted({*vocabulary, *(t for c in bodies.values() for t in c)}))
    idf, vectors = _weights(known, df, vocabulary, total)
    anchors, names = _anchors(vectors, cosine), [r["licence"] for r in known.select("licence").distinct().collect()]
    aligned = _aligned(known, _anchors(vectors, max(cosine, WINDOW)))
    most = known.agg(F.max(F.size(terms(F.col("text"))))).first()[0] or 0
    body = _Bodies(bodies, df, total)

    has = lambda w: F.exists(w, lambda t: t.isin(anchors))
    split = files.select("id", "path", "text", F.xxhash64("text").alias("x"), terms(F.col("text")).alias("w")).withColumn("words", F.size("w")).withColumn("marked", has(F.col("w"))).withColumn("own", body.own("w"))
    split = split.select(
        "id", "path", "x", "words",
        F.when(F.col("marked"), F.filter(F.split("text", "\n"), lambda line: has(terms(line)))).alias("lines"),
        F.when(F.col("marked") & (F.col("words") <= 2 * most), F.array_join("w", " ")).alias("short"),
        F.when(F.col("marked"), _near(F.col("w"), sorted({t for t, _, _ in aligned}), max((n for _, _, n in aligned), default=1))).alias("hits"),
        F.when(body.fits("own"), F.col("w")).alias("body"),
        _identifiers(F.col("text"), names).alias("spdx"),
    )
    split = stored(split, "units")
    # a row that repeats has its units once
    units = split.where("lines is not null or body is not null or spdx is not null").dropDuplicates(["id", "path", "x"])
    noted = units.select("id", "path", "x", "words", F.explode("lines").alias("line"), F.lit("line").alias("kind"))
    noted = noted.unionByName(units.where("short is not null").select("id", "path", "x", "words", F.col("short").alias("line"), F.lit("text").alias("kind")))
    noted = stored(noted.unionByName(_windows(units, aligned).withColumn("kind", F.lit("window"))), "noted")

    seen = noted.select("line").distinct().withColumn("term", F.explode(terms(F.col("line")))).groupBy("line", "term").agg(F.count(F.lit(1)).alias("tf"))
    weighed = seen.join(F.broadcast(idf), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.log(F.lit(total + 2.0))))
    norms = weighed.groupBy("line").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum("tf").alias("line_words"))
    dots = weighed.join(F.broadcast(vectors), "term").groupBy("line", "template", "licence").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, "line").withColumn("score", F.round(F.col("dot") / F.col("norm"), 9)).where(F.col("score") >= cosine)
    best = F.struct((-F.col("score")).alias("order"), F.col("licence"))
    notices = stored(scored.groupBy("line").agg(F.min(best).alias("best"), F.first("line_words").alias("line_words")), "notices")

    found = noted.join(notices, "line").where((F.col("kind") != "window") | (-F.col("best.order") >= WINDOW))
    found = found.select("id", "path", "x", "words", "best", F.when(F.col("kind") == "line", F.col("line_words")).otherwise(0).alias("line_words"), (F.col("kind") == "text").alias("whole"))
    named = units.select("id", "path", "x", "words", F.explode("spdx").alias("licence")).select("id", "path", "x", "words", F.struct(F.lit(-1.0).alias("order"), F.col("licence")).alias("best"))
    for more, whole in ((body.score(units), True), (named, False)):
        found = found.unionByName(more.withColumn("line_words", F.lit(0)).withColumn("whole", F.lit(whole)))
    own = found.groupBy("id", "path", "x").agg(F.min("best").alias("best"), F.sum("line_words").alias("noted"), F.first("words").alias("words"), F.max("whole").alias("whole"))
    own = stored(own, "own")
    drop_stored(noted, notices)
    parent = F.regexp_replace("path", "/?[^/]*$", "")
    governed = own.where((F.col("whole") | (F.col("noted") >= file_share * F.col("words"))) & F.col("path").isNotNull()).groupBy(parent.alias("above")).agg(F.min("best").alias("inherited"))
    steps = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))
    dirs = split.where("path is not null").select(parent.alias("dir")).distinct()
    near = dirs.select("dir", F.explode(F.array_distinct(above)).alias("above")).join(governed, "above").groupBy("dir").agg(F.max(F.struct(F.length("above").alias("n"), "above", "inherited")).alias("near"))

    rows = split.select("id", "path", "x", parent.alias("dir"))
    mine = own.select(F.col("id").alias("_id"), F.col("path").alias("_path"), F.col("x").alias("_x"), "best")
    rows = rows.join(mine, F.col("id").eqNullSafe(F.col("_id")) & F.col("path").eqNullSafe(F.col("_path")) & (F.col("x") == F.col("_x")), "left").join(near, "dir", "left")
    has, inherits = F.col("best").isNotNull(), F.col("near").isNotNull()
    return rows.select("id", "path", F.when(has, F.col("best.licence")).otherwise(F.col("near.inherited.licence")).alias("licence"), (-F.when(has, F.col("best.order")).otherwise(F.col("near.inherited.order"))).alias("score"), F.when(has, F.lit("own")).when(inherits, F.lit("inherited")).alias("origin"), F.when(~has, F.col("near.above")).alias("licence_path"))
