"""Licence of each file: by its own statements, or that of the nearest directory above it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_counted, staged, whole_text

# Statements by which licences are commonly named, and whole licence texts.
STATEMENTS = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MPL-2.0", "Subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("Apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-1.1", "The Apache Software License, Version 1.1"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("EPL-1.0", "made available under the terms of the Eclipse Public License v1.0"),
    ("EPL-2.0", "made available under the terms of the Eclipse Public License 2.0"),
    ("ISC", "Licensed under the ISC License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("MIT", "MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1"),
    ("MPL-1.1", "Mozilla Public License Version 1.1"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Zlib", "Licensed under the zlib License"),
)
GNU = (
    ("GPL", "GNU General Public License", ("1", "2", "3"), ("February 1989", "June 1991", "29 June 2007")),
    ("LGPL", "GNU Library General Public License", ("2",), ("June 1991",)),
    ("LGPL", "GNU Lesser General Public License", ("2.1", "3"), ("February 1999", "29 June 2007")),
    ("AGPL", "GNU Affero General Public License", ("3",), ("19 November 2007",)),
)
CREATIVE = {"": "", "-SA": "-ShareAlike", "-NC": "-NonCommercial", "-NC-SA": "-NonCommercial-ShareAlike", "-ND": "-NoDerivatives", "-NC-ND": "-NonCommercial-NoDerivatives"}


def gnu() -> Iterator[tuple[str, str]]:
    for short, name, versions, dates in GNU:
        for version, date in zip(versions, dates):
            full = version if "." in version else f"{version}.0"
            known = f"{short}-{full}"
            yield known, f"{name} Version {version}, {date}"
            yield known, f"under the terms of the {name} version {version} as published by the Free Software Foundation"
            yield f"{known}-or-later", (
                f"under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version"
            )
            for v in dict.fromkeys((version, full)):
                yield known, f"Licensed under the {name}, version {v}"
                yield known, f"{name} version {v}"
                yield known, f"{name} v{v}"
                yield known, f"version {v} of the {name}"
                yield known, f"Licensed under the {short} version {v}"
                yield known, f"Licensed under {short}-{v}"
                yield known, f"Licensed under {short}v{v}"
                yield f"{known}-or-later", f"{name} version {v} or later"
                yield f"{known}-or-later", f"Licensed under {short}-{v}-or-later"


def creative_commons() -> Iterator[tuple[str, str]]:
    for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
        for kind, name in CREATIVE.items():
            kinds = {name, name.replace("NoDerivatives", "NoDerivs"), name.replace("NonCommercial", "Noncommercial").replace("ShareAlike", "Share Alike")}
            scope = "International" if version == "4.0" else "Unported" if version == "3.0" else "Generic"
            known = f"CC-BY{kind}-{version}"
            yield known, f"Licensed under CC BY{kind} {version}"
            for k in sorted(kinds):
                yield known, f"Creative Commons Attribution{k} {version}"
                yield known, f"This work is licensed under a Creative Commons Attribution{k} {version} {scope} License"


NAMES = sorted({n for n, _ in (*STATEMENTS, *gnu(), *creative_commons())})
TEMPLATES = tuple(dict.fromkeys((*STATEMENTS, *gnu(), *creative_commons(), *((n, f"SPDX-License-Identifier: {n}") for n in NAMES))))
#: Names, versions and variants: a place and the template it is taken for hold the same ones.
MARKS = sorted(
    ({w for n in NAMES for w in re.split("[^a-z0-9]+", n.lower())} | set("0123456789") | {"v1", "v2", "v3", "gplv1", "gplv2", "gplv3", "lgplv2", "lgplv3", "agplv3"}
     | {"lesser", "library", "affero", "mozilla", "boost", "eclipse", "noncommercial", "sharealike", "noderivatives", "noderivs", "commercial", "alike", "derivatives", "derivs"})
    - {"by", "or"}
)


def licence_texts() -> list[tuple[str, str]]:
    texts = {f.name.removesuffix(".txt"): f.read_text() for f in sorted(Path(__file__).with_name("license_texts").glob("*.txt"))}
    # differs from the GPL by its name and one section
    texts["AGPL-3.0"] = re.sub("(?i)(GNU) (General Public License)", r"\1 Affero \2", texts["GPL-3.0"])
    return sorted(texts.items())


THRESHOLD = 0.8
#: A file is a licence file by its name, or if so much of its words is licence statements.
NAMED, MOSTLY = r"(?i)(^|/)(un)?(licen[cs]e|copying|copyright)[^/]*$", 0.5


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def marks(words: Column) -> Column:
    return F.array_join(F.sort_array(F.array_intersect(words, F.split(F.lit(" ".join(MARKS)), " "))), " ")


def vocabulary(spark, templates) -> DataFrame:
    """One row per template and word: tid, license, marks, token, tf, offsets (where it stands), length (of the template)."""
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(templates)], "tid int, license string, statement string")
    words = rows.withColumn("words", tokens(F.col("statement"))).select("tid", "license", marks(F.col("words")).alias("marks"), F.size("words").alias("length"), F.posexplode("words").alias("at", "token"))
    return words.groupBy("tid", "license", "marks", "length", "token").agg(F.count(F.lit(1)).alias("tf"), F.collect_set("at").alias("offsets"))


def rarity(files: DataFrame, words: DataFrame) -> DataFrame:
    """(token, idf) of the words of the templates; document frequencies over all whole texts."""
    terms = [r["token"] for r in words.select("token").distinct().collect()]  # bounded by the fixed templates
    known = F.split(F.lit(" ".join(sorted(terms))), " ")
    held = files.select(F.explode(F.array_intersect(F.split(F.lower(whole_text()), "[^a-z0-9]+"), known)).alias("token"))
    df = held.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    n = float(files.count())
    return words.select("token").distinct().join(df, "token", "left").select(
        "token", (F.log((n + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1).alias("idf")
    )


def telling(weights: DataFrame, threshold: float) -> dict[int, list[str]]:
    """For each template the words of which a text must hold one to reach the threshold: the heaviest ones without
    which the others could not make up enough of its length."""
    held: dict[int, list[tuple[float, str]]] = {}
    for r in weights.collect():  # bounded by the fixed templates
        held.setdefault(r["tid"], []).append((r["w"] ** 2, r["token"]))
    found = {}
    for tid, words in held.items():
        rest = total = sum(w for w, _ in words)
        found[tid] = []
        for w, token in sorted(words, reverse=True):
            if rest < threshold**2 * total * (1 - 1e-9):
                break
            found[tid].append(token)
            rest -= w
    return found


def windows(texts: DataFrame, weights: DataFrame, signs: dict[int, list[str]]) -> DataFrame:
    """Places in the running words of whole texts, across lines, as long as a template and laid so that one of its
    telling words stands where the template has it."""
    spark = texts.sparkSession
    rows = spark.createDataFrame([(t, w) for t, ws in signs.items() for w in ws], "tid int, token string")
    laid = staged(rows.join(weights, ["tid", "token"]).select("token", F.col("tid").alias("only"), "length", F.explode("offsets").alias("offset")), "windows")
    longest = weights.agg(F.max("length")).first()[0] or 1
    known = F.split(F.lit(" ".join(sorted({w for ws in signs.values() for w in ws}))), " ")
    placed = texts.select("path", "digest", "total", tokens(F.col("text")).alias("all")).withColumn("hits", F.transform("all", lambda w, i: F.struct(i.alias("i"), w.alias("w"))))
    placed = placed.withColumn("hits", F.filter("hits", lambda h: F.array_contains(known, h["w"])))
    # only the words around each place are carried on
    around = F.transform("hits", lambda h: F.struct(h["i"].alias("i"), h["w"].alias("token"), F.slice(F.col("all"), F.greatest(h["i"] - longest, F.lit(0)) + 1, F.lit(2 * longest + 4)).alias("near")))
    placed = placed.select("path", "digest", "total", F.explode(around).alias("h")).select("path", "digest", "total", "h.i", "h.token", "h.near")
    placed = placed.join(F.broadcast(laid), "token").withColumn("start", F.col("i") - F.col("offset")).where("start >= 0")
    first = F.greatest(F.col("start") - F.greatest(F.col("i") - longest, F.lit(0)), F.lit(0)) + 1
    later = F.array_contains(F.slice("near", first + F.col("length"), F.lit(2)), "later")
    cut = placed.select("path", "digest", "total", "only", "start", F.slice("near", first, F.col("length")).alias("words"), later.alias("later"))
    own = F.when(F.col("later") & ~F.array_contains("words", "later"), F.lit("later")).otherwise(marks(F.col("words")))
    cut = cut.withColumn("marks", own)
    fitting = weights.select(F.col("tid").alias("only"), "marks").distinct()
    return cut.join(F.broadcast(fitting), ["only", "marks"]).select(
        "path", "digest", "total", F.lit("window").alias("kind"), F.col("start").alias("line"), "only", F.size("words").alias("n_words"), "marks", "words"
    ).distinct()


KEY = ["path", "digest", "total", "kind", "line", "only", "n_words", "marks"]


def alike(pieces: DataFrame, weights: DataFrame, idf: DataFrame, threshold: float) -> DataFrame:
    """KEY, license, score: pieces whose sparse TF-IDF vector has at least this cosine with a template's (of lines any
    with the same marks, of windows the one they are laid for); the best template of each. Words that no template has
    carry no weight."""
    norms = weights.groupBy("tid").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("norm"))
    counted = (
        pieces.select(*KEY, F.explode("words").alias("token"))
        .groupBy(*KEY, "token").agg(F.count(F.lit(1)).alias("n"))
        .join(idf.join(weights.select("token").distinct(), "token", "left_semi"), "token").withColumn("v", F.col("n") * F.col("idf"))
    )
    length = counted.groupBy(*KEY).agg(F.sqrt(F.sum(F.col("v") ** 2)).alias("length"))
    fits = (F.col("kind") == "text") | (F.col("marks") == F.col("_marks")) & F.coalesce(F.col("only") == F.col("tid"), F.lit(True))
    terms = weights.select("tid", "license", F.col("marks").alias("_marks"), "token", "w")
    dots = counted.join(terms, "token").where(fits).groupBy(*KEY, "tid", "license").agg(F.sum(F.col("v") * F.col("w")).alias("dot"))
    length = length.select(F.col("path").alias("_p"), F.col("digest").alias("_d"), F.col("kind").alias("_k"), F.col("line").alias("_l"), F.col("only").alias("_o"), "length")
    same = F.col("path").eqNullSafe(F.col("_p")) & (F.col("digest") == F.col("_d")) & (F.col("kind") == F.col("_k")) & (F.col("line") == F.col("_l")) & F.col("only").eqNullSafe(F.col("_o"))
    scored = dots.join(length, same).join(norms, "tid").withColumn("score", F.least(F.lit(1.0), F.col("dot") / (F.col("length") * F.col("norm"))))
    good = scored.where(F.col("score") >= threshold).groupBy(*KEY).agg(F.max("score").alias("score"), F.min(F.struct((-F.round("score", 9)).alias("s"), "license")).alias("b"))
    return good.select(*KEY, F.col("b.license").alias("license"), "score")


def statements(files: DataFrame, words: DataFrame, idf: DataFrame, threshold: float) -> DataFrame:
    """Lines and windows that are like a template, see ``alike``."""
    weights = staged(words.join(idf, "token").withColumn("w", F.col("tf") * F.col("idf")), "template-weights")
    signs = telling(weights, threshold)
    sign = rf"(?i)\b({'|'.join(sorted({w for ws in signs.values() for w in ws}))})\b"
    texts = files.select("path", whole_text().alias("text")).where(F.col("text").rlike(sign))
    # a plus behind a version
    spelt = F.regexp_replace("text", r"(?<=[0-9])\+", " or later ").alias("text")
    texts = texts.select("path", F.unhex(F.md5("text")).alias("digest"), F.size(tokens(F.col("text"))).alias("total"), spelt)
    lines = texts.select("path", "digest", "total", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    lines = lines.where(F.col("text").rlike(sign)).select("path", "digest", "total", "line", tokens(F.col("text")).alias("words"))
    lines = lines.select("path", "digest", "total", F.lit("line").alias("kind"), "line", F.lit(None).cast("int").alias("only"), F.size("words").alias("n_words"), marks(F.col("words")).alias("marks"), "words")
    pieces = lines.unionByName(windows(texts, weights, signs))
    return alike(pieces, weights, idf, threshold)


def whole_licences(files: DataFrame, words: DataFrame, idf: DataFrame, threshold: float) -> DataFrame:
    """Whole files that are like a licence text, see ``alike``. All of these texts speak of a warranty."""
    weights = staged(words.join(idf, "token").withColumn("w", F.col("tf") * F.col("idf")), "text-weights")
    named = files.where(F.col("path").rlike(NAMED) | whole_text().rlike(r"(?i)\bwarrant(y|ies)\b")).select("path", whole_text().alias("text"))
    texts = named.select("path", F.unhex(F.md5("text")).alias("digest"), tokens(F.col("text")).alias("words")).select(
        "path", "digest", F.size("words").alias("total"), F.lit("text").alias("kind"), F.lit(0).alias("line"), F.lit(None).cast("int").alias("only"), F.size("words").alias("n_words"), F.lit("").alias("marks"), "words"
    )
    return alike(texts, weights, idf, threshold)


def directory(path: Column) -> Column:
    """What stands before the last slash; the root is the empty string."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def ancestors(folder: Column) -> Column:
    """Array of (folder, depth): the folder itself and all above it."""
    parts = F.split(folder, "/", -1)
    named = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("above"), i.alias("depth")))
    return F.array_distinct(F.concat(F.array(F.struct(F.lit("").alias("above"), F.lit(0).alias("depth"))), named))


def scan(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per file (path, text): license, score, source ('own', 'inherited' or null), license_dir.

    Lines, windows of the running words and whole files are compared with statements and texts of the known licences
    by TF-IDF cosine; names, versions and variants must be the same. A file's own licence is that of the licence
    text it is like, else that of its best line or window (then the first by name). A directory has the licence of its licence files: files so named,
    or whose words are mostly licence statements; of several the best, then the first by name. A file without
    a licence of its own gets that of the nearest directory above it.

    Cases: null and empty texts have no licence of their own but inherit. A null path inherits nothing. Rows
    that repeat a path and its text give the same; another text under the same path is judged for itself.
    Other columns are ignored. An empty table gives an empty result.
    """
    spark = files.sparkSession
    words, texts = staged(vocabulary(spark, TEMPLATES), "template-words"), staged(vocabulary(spark, licence_texts()), "text-words")
    idf = staged(rarity(files, words.select("token").union(texts.select("token"))), "idf")
    found = staged(statements(files, words, idf, threshold).unionByName(whole_licences(files, texts, idf, threshold)), "statements")
    is_kind = lambda k: F.col("kind") == k
    places = F.collect_list(F.when(is_kind("window"), F.sequence("line", F.col("line") + F.col("n_words") - 1)))
    covered = F.greatest(F.sum(F.when(is_kind("line"), F.col("n_words"))), F.size(F.array_distinct(F.flatten(places))), F.max(F.when(is_kind("text"), F.col("n_words"))))
    own = found.groupBy("path", "digest").agg(
        F.min(F.struct((~is_kind("text")).alias("part"), (-F.round("score", 9)).alias("s"), "license")).alias("b"), (covered >= MOSTLY * F.first("total")).alias("mostly")
    )
    listed = files.select("path", F.unhex(F.md5(whole_text())).alias("digest"))
    own = staged(own.withColumnsRenamed({"path": "_p", "digest": "_t"}), "best-statements")
    files_found = listed.join(own, F.col("path").eqNullSafe(F.col("_p")) & (F.col("digest") == F.col("_t")), "left").select(
        "path", directory(F.col("path")).alias("dir"), F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"),
        (F.col("path").rlike(NAMED) | F.col("mostly")).alias("is_licence"),
    )
    files_found = staged(files_found, "own-licences")
    given = files_found.where("is_licence AND license IS NOT NULL").groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    given = given.select(F.col("dir").alias("above"), F.col("b.license").alias("given"))
    per_dir = files_found.where("dir IS NOT NULL").groupBy("dir").agg(F.count(F.lit(1)).alias("n"))
    above = per_dir.select("dir", "n", F.explode(ancestors(F.col("dir"))).alias("a")).select("dir", "n", "a.above", "a.depth")
    nearest = (
        above.join(given, "above").groupBy("dir", "n").agg(F.max(F.struct("depth", "above", "given")).alias("g"))
        .select("dir", "n", F.col("g.given").alias("given"), F.col("g.above").alias("license_dir"))
    )
    nearest = staged(nearest, "directory-licences")
    out = join_counted(files_found, nearest, "dir", "n", files_found.count())
    owns = F.col("license").isNotNull()
    return out.select(
        "path",
        F.coalesce("license", "given").alias("license"),
        "score",
        F.when(owns, "own").when(F.col("given").isNotNull(), "inherited").alias("source"),
        F.when(~owns, F.col("license_dir")).alias("license_dir"),
    )
