"""Licence scan: Dice coefficient of word bigrams between pieces of a text and licence templates.

A text is compared at four grains: each sentence or line, each block between
blank lines, the whole, and windows of a template's length laid over the words
so that an anchor word stands where the template has it. So neither line breaks
nor what stands around a notice decide whether it is found. A piece and a
template are normalised alike (lower case, everything but a-z and 0-9 as one
space) and become sets of word bigrams. With a and b their sizes, Dice
2c / (a + b) can reach ``t`` only if a lies between b t / (2 - t) and
b (2 - t) / t: pieces outside the bounds of all templates are dropped before
the join, and each (piece, template) outside its own bounds in it. The
threshold also means that a match holds one of a few anchor words (see
``anchor_words``): texts and pieces without any of them are passed over by one
regular expression, which loses no match. Common bigrams are counted by a hash
join with the templates' bigrams, a table of fixed size.

Only built-in functions are used.

Edge cases: a null or empty text has no licence; a null doc_id is carried;
each row has its own licences, also where rows share a doc_id; repeated rows
give repeated results; a very long text is scanned whole; pieces of one word
have no bigram and match nothing; a piece takes its best template, the first in
the alphabet of equal ones; a template that is part of another one found in the
text is not named; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reconweave.llm.common import durable, small

THRESHOLD = 0.8

# Public licence texts and the short notices that name them.
TEMPLATES = {
    "agpl-3.0/notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "apache-2.0/line": "Licensed under the Apache License, Version 2.0",
    "apache-2.0/notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd-2-clause/text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-3-clause/clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "cc-by-4.0/line": "Licensed under CC BY 4.0",
    "cc-by-4.0/notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0/line": "Licensed under CC BY-NC 4.0",
    "cc-by-nc-4.0/notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-sa-4.0/line": "Licensed under CC BY-SA 4.0",
    "cc-by-sa-4.0/notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-2.0/line": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0/line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0/notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc/text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl-3.0/line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "mit/line": "Released under the MIT License.",
    "mit/notice": "This project is licensed under the terms of the MIT License.",
    "mit/text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "mpl-2.0/notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense/text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def template_rows(templates: dict[str, str], threshold: float) -> list[tuple[str, int, int, int, str]]:
    """(template, bigrams, least and most bigrams of a candidate, bigram), one row per distinct bigram."""
    rows = []
    for name, text in sorted(templates.items()):
        words = _words(text)
        pairs = sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})
        n, scale = len(pairs), round(threshold * 1000)
        least, most = -(-n * scale // (2000 - scale)), n * (2000 - scale) // scale
        rows += [(name, n, least, most, p) for p in pairs]
    return rows


def anchor_words(rows: list[tuple[str, int, int, int, str]], threshold: float) -> list[str]:
    """Words of which every piece that reaches the threshold with some template has at least one.

    A match shares at least c bigrams with its template. If fewer than c of the
    template's bigrams are free of its anchor words, a match has an anchor.
    Long words are taken first, as they are rare.
    """
    anchors: set[str] = set()
    for name in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == name]
        left = {r[4] for r in own if not set(r[4].split()) & anchors}
        shared = -(-round(threshold * 1000) * (own[0][2] + own[0][1]) // 2000)
        while len(left) >= shared:
            words = {w for pair in left for w in pair.split()}
            best = max(sorted(words), key=lambda w: (len(w) ** 3 * sum(w in pair.split() for pair in left), w))
            anchors.add(best)
            left = {pair for pair in left if best not in pair.split()}
    return sorted(anchors)


def _words(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def window_rows(templates: dict[str, str], anchors: list[str]) -> list[tuple[str, int, int]]:
    """(anchor, its place in a template, words of the template), from 0, each once."""
    rows = set()
    for text in templates.values():
        words = _words(text)
        rows |= {(w, i, len(words)) for i, w in enumerate(words) if w in anchors}
    return sorted(rows)


def contained(templates: dict[str, str]) -> list[tuple[str, str]]:
    """(template, another one whose words hold its words side by side)."""
    flat = {n: f" {' '.join(_words(t))} " for n, t in templates.items()}
    return [(a, b) for a in sorted(flat) for b in sorted(flat) if a != b and flat[a] in flat[b]]


def template_table(spark: SparkSession, templates: dict[str, str], threshold: float) -> DataFrame:
    """The rows of ``template_rows`` as a table."""
    quote = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    values = ", ".join("(" + ", ".join(map(quote, row)) + ")" for row in template_rows(templates, threshold))
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(template, n_template, least, most, bigram)")


def pieces(text: Column) -> Column:
    """Array of (grain, piece) of a text, the pieces still as written."""
    sentences = F.split(F.regexp_replace(text, r"([.!?])[ \t]+", "$1\n"), "\n")
    blocks = F.split(text, "\n[ \t\r]*\n")
    grain = lambda name, parts: F.transform(parts, lambda p: F.struct(F.lit(name).alias("grain"), p.alias("piece")))
    several = F.when(F.size(blocks) > 1, grain("block", blocks)).otherwise(F.array().cast("array<struct<grain:string,piece:string>>"))
    return F.concat(grain("line", sentences), several, F.array(F.struct(F.lit("text").alias("grain"), text.alias("piece"))))


def windows(texts: DataFrame, rows: list[tuple[str, int, int]]) -> DataFrame:
    """(uid, at, w): windows over the words ``w`` of each text that put an anchor where a template has it; ``at`` below 0."""
    places: dict[str, list[tuple[int, int]]] = {}
    for word, place, n in rows:
        places.setdefault(word, []).append((place, n))
    spots = lambda xs: F.array(*[F.struct(F.lit(p).alias("place"), F.lit(n).alias("n")) for p, n in xs])
    table = F.create_map(*[x for w, xs in places.items() for x in (F.lit(w), spots(xs))])
    seen = F.filter(F.transform("w", lambda x, i: F.struct(x.alias("word"), i.alias("i"))), lambda s: s["word"].isin(*places))
    starts = F.flatten(F.transform(seen, lambda s: F.transform(F.element_at(table, s["word"]),
        lambda p: F.struct(F.greatest(s["i"] - p["place"], F.lit(0)).alias("start"), p["n"].alias("n")))))
    cut = F.transform(F.array_distinct(starts), lambda s: F.slice("w", s["start"] + 1, s["n"]))
    return texts.select("uid", F.posexplode(cut).alias("i", "w")).select("uid", (-1 - F.col("i")).alias("at"), "w")


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, licenses (comma-joined templates found), best, best_score, n_licenses."""
    spark = docs.sparkSession
    templates = templates or TEMPLATES
    table = template_table(spark, templates, threshold)
    rows = template_rows(templates, threshold)
    anchors = anchor_words(rows, threshold)
    low, high = min(r[2] for r in rows), max(r[3] for r in rows)
    scale = round(threshold * 1000)
    anchored = f"(?<![a-z0-9])(?:{'|'.join(anchors)})(?![a-z0-9])"
    # a row is counted under an id of its own; its result goes to all rows of equal doc_id and text
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"),
        F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    texts = marked.withColumn("uid", F.struct(F.monotonically_increasing_id().alias("n"), "doc_id", "mark"))
    # a word that counts as such once normalised may stand beside a letter that does not: boundaries are those of a-z and 0-9
    texts = texts.where(F.lower("text").rlike(anchored))
    flat = lambda x: F.split(F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " ")), " ")
    parts = texts.select("uid", F.posexplode(pieces(F.col("text"))).alias("at", "p")).select("uid", "at", "p.piece")
    # low bigrams take a word more, of one character at least, and as many spaces
    parts = parts.where((F.length("piece") >= 2 * low + 1) & F.lower("piece").rlike(anchored))
    words = parts.select("uid", "at", flat(F.col("piece")).alias("w")).unionByName(windows(texts.select("uid", flat(F.col("text")).alias("w")),
        window_rows(templates, anchors)))
    # distinct bigrams may be fewer than words, so only the lower bound holds for words; the upper one for their bigrams
    words = words.where(F.size("w") > low)
    shorter = F.size("w") - 1
    bigrams = F.array_distinct(F.zip_with(F.slice("w", 1, shorter), F.slice("w", 2, shorter), lambda a, b: F.concat_ws(" ", a, b)))
    sets = words.select("uid", "at", bigrams.alias("b")).withColumn("n", F.size("b")).where(F.col("n").between(low, high))
    common = sets.select("uid", "at", "n", F.explode("b").alias("bigram")).join(F.broadcast(table),
        "bigram").where(F.col("n").between(F.col("least"), F.col("most")))
    counted = common.groupBy("uid", "at", "n", "template", "n_template").agg(F.count("*").alias("c"))
    hits = counted.where(F.col("c") * 2000 >= scale * (F.col("n") + F.col("n_template")))
    dice = F.round(2 * F.col("c") / (F.col("n") + F.col("n_template")), 6)
    # of templates close to one another a piece takes the nearest
    nearest = hits.groupBy("uid", "at").agg(F.min(F.struct((-dice).alias("score"), "template")).alias("best"))
    scored = nearest.groupBy("uid", "best.template").agg(F.min("best.score").alias("score"))
    found = scored.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("score", "template"))).alias("all"))
    found = found.groupBy("uid.doc_id", "uid.mark").agg(F.first("all").alias("all"))
    names = F.transform("all", lambda x: x["template"])
    for part, whole in contained(templates):
        inside = F.array_contains(names, part) & F.array_contains(names, whole)
        without = F.expr(f"filter(all, x -> x.template <> '{part}')")
        found = found.withColumn("all", F.when(inside, without).otherwise(F.col("all")))
    found = durable(found.select(F.col("doc_id").alias("__doc_id"), F.col("mark").alias("__mark"),
        F.array_join(F.array_sort(names), ",").alias("licenses"), F.get("all", 0).alias("best"), F.size("all").cast("long").alias("n_licenses")),
        "licenses")
    out = marked.select("doc_id", "mark").join(small(found, 112),
        F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("mark") == F.col("__mark")), "left")
    return out.select("doc_id", "licenses", F.col("best.template").alias("best"), (-F.col("best.score")).alias("best_score"),
        F.coalesce("n_licenses", F.lit(0)).cast("long").alias("n_licenses"))
