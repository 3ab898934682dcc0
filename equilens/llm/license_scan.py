"""License scan: Dice coefficient over word bigrams (with repeats) between pieces of a text and license templates.

DataFrame and SQL functions only.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Dice coefficient from which a piece counts as a license text.
LEAST = 0.8
#: Letters from which a word is rare enough to tell that a license may follow.
LONG_WORD = 7
#: License ids and public notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This project is licensed under the Apache License 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Released under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)


def normalised(text: Column) -> Column:
    """Lower case; all but letters and digits becomes one space, line ends stay."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\n]+", " ")


def words(piece: Column) -> Column:
    return F.filter(F.split(F.translate(piece, "\n", " "), " "), lambda w: w != "")


def bigrams(w: Column) -> Column:
    """Pairs of neighbouring words, repeats included; none for fewer than two words."""
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda x, y: F.concat_ws(" ", x, y))


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """(template, license, bigrams, size)."""
    listed = F.array(*(F.struct(F.lit(i).alias("template"), F.lit(name).alias("license"), F.lit(text).alias("text")) for i, (name, text) in enumerate(templates)))
    rows = spark.range(1).select(F.inline(listed))
    return rows.select("template", "license", bigrams(words(normalised(F.col("text")))).alias("bigrams")).withColumn("size", F.size("bigrams")).where("size > 0")


def anchors(templates: DataFrame, low: float) -> list[str]:
    """Strings of which a text must hold one to have a window that reaches the bound.

    A window may lack some bigrams of its template, but not all those that a
    few long words are in. Words, and bigrams where words are short, are chosen
    for all templates at once, in each step the one that is in most bigrams
    still to be touched; as a text without "license" has no "licensed" either,
    parts of words count.
    """
    todo = []
    for t in templates.select("bigrams").collect():  # a few hundred texts
        todo.append([list(t.bigrams), len(t.bigrams) - math.ceil(low * len(t.bigrams) - 1e-9) + 1])
    strings = {b for own, _ in todo for b in own} | {w for own, _ in todo for b in own for w in b.split(" ") if len(w) >= LONG_WORD}
    found = []
    while any(n > 0 for _, n in todo):
        gain = lambda w: sum(min(n, sum(w in b for b in own)) for own, n in todo if n > 0)
        rare = lambda w: gain(w) > 0 and (len(w) >= LONG_WORD and " " not in w or len(w) >= LONG_WORD + 3)
        best = max(strings, key=lambda w: (rare(w), gain(w), len(w), w))
        found.append(best)
        for t in todo:
            left = [b for b in t[0] if best not in b]
            t[:] = left, t[1] - (len(t[0]) - len(left))
    return [w for w in found if not any(o != w and o in w for o in found)]


def best_windows(hits: Column, size: Column, low: float, high: float) -> Column:
    """For each hit with enough others near by, the best window that starts there: array of (start, end, dice).

    `hits` has (pos, lag) in order; a hit counts in a window that starts after `lag`, the place of the occurrence that it repeats too often.
    """
    need = F.ceil(size * low - 1e-9).cast("int")

    def grow(first: Column, rest: Column) -> Column:
        start = F.struct(F.lit(0).alias("c"), F.lit(-1).alias("end"), F.lit(0.0).alias("dice"))

        def add(acc: Column, k: Column) -> Column:
            c = acc["c"] + (k["lag"] < first["pos"]).cast("int")
            dice = 2.0 * c / (k["pos"] - first["pos"] + 1 + size)
            better = dice > acc["dice"]
            return F.struct(c.alias("c"), F.when(better, k["pos"]).otherwise(acc["end"]).alias("end"), F.when(better, dice).otherwise(acc["dice"]).alias("dice"))

        return F.aggregate(rest, start, add, lambda a: F.struct(first["pos"].alias("start"), a["end"].alias("end"), a["dice"].alias("dice")))

    dense = lambda h, x: F.get(hits, x + need - 1)["pos"] - h["pos"] + 1 <= size * high + 1e-9  # noqa: E731  null beyond the last hit
    each = F.transform(hits, lambda h, x: F.when(dense(h, x), grow(h, F.slice(hits, x + 1, F.floor(size * high).cast("int") + 1))))
    return F.filter(each, lambda w: w.isNotNull())


def scan(docs: DataFrame, templates: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """(key, license, dice, pieces): licenses found in a text, the best coefficient, and how many of its pieces have it.

    The pieces of a text are its lines, its paragraphs of several lines, the
    whole text, and windows that start and end at any word. A piece of a bigrams
    can reach `least` only with templates of b bigrams for which
    least / (2 - least) <= a / b <= (2 - least) / least; all others are pruned
    before the bigrams meet in an equi-join, which counts the common ones.
    Windows are grown from each hit of a template that has enough other hits
    within that size; of windows that overlap, the best one counts. Lines,
    paragraphs and the whole text come first: where one of them has a license,
    `dice` is theirs, and `pieces` the larger of their number and that of the
    windows (which lie within them too). A null text counts as empty; a piece
    of fewer than two words matches nothing. Rows that are equal but for blanks
    and signs count once, other rows of one key together; a null key is a key
    like others. Of equally good windows the first counts. Without texts or
    templates nothing is found.
    """
    low, high = least / (2 - least), (2 - least) / least
    norm = docs.select(F.col(key).alias("id"), normalised(F.col(text)).alias("norm"))
    bound = templates.agg(F.min("size"), F.max("size")).first()
    least_size, most_size = (bound[0] * low, bound[1] * high) if bound[0] else (1.0, 0.0)
    some = anchors(templates, low)
    flat = lambda t: F.regexp_replace(t, r" ?\n[ \n]*", " ")  # noqa: E731  runs of blank lines are one gap
    holds = lambda t: reduce(lambda p, q: p | q, (t.contains(a) for a in some), F.lit(False))

    def pieces(t: Column) -> Column:
        """The pieces of a text that hold an anchor, each as bigrams, and the whole text for windows."""
        piece = lambda level: lambda x, i: F.struct(F.lit(level).alias("level"), i.alias("n"), x.alias("piece"))
        lines = F.transform(F.split(t, "\n"), piece("line"))
        several = F.filter(F.split(t, r"\n(?: ?\n)+"), lambda x: x.contains("\n"))
        paragraphs = F.transform(F.transform(several, flat), piece("paragraph"))
        whole = F.transform(F.filter(F.array(t), lambda x: x.rlike(r"\n ?\n")), lambda x, i: piece("whole")(flat(x), i))
        split = F.transform(F.filter(F.concat(lines, paragraphs, whole), lambda x: holds(x["piece"])), lambda x: F.struct(x["level"].alias("level"), x["n"].alias("n"), words(x["piece"]).alias("w")))
        fit = F.filter(split, lambda x: (F.size(x["w"]) - 1).between(least_size - 1e-9, most_size + 1e-9))
        window = F.array(F.struct(F.lit("window").alias("level"), F.lit(0).alias("n"), words(t).alias("w")))
        return F.transform(F.concat(fit, window), lambda x: F.struct(x["level"].alias("level"), x["n"].alias("n"), bigrams(x["w"]).alias("b")))

    # a text without an anchor is never split; the inner form would build the pieces again to filter empty ones
    both = F.array(F.struct(F.col("norm").alias("t"), flat(F.col("norm")).alias("flat")))
    likely = F.transform(F.filter(both, lambda x: holds(x["flat"])), lambda x: x["t"])
    sized = norm.select("id", F.xxhash64("norm").alias("row"), F.inline_outer(F.flatten(F.transform(likely, pieces)))).where("b IS NOT NULL").withColumn("a", F.size("b"))
    each = sized.select("id", "row", "level", "n", "a", F.posexplode("b").alias("pos", "bigram"))
    index = templates.select("template", "license", "size", F.explode("bigrams").alias("bigram")).groupBy("template", "license", "size", "bigram").agg(F.count("*").alias("here"))
    window = F.col("level") == "window"
    met = each.join(F.broadcast(index), "bigram").where(window | (F.col("a") >= F.col("size") * low - 1e-9) & (F.col("a") <= F.col("size") * high + 1e-9))  # the templates are a parameter: a few hundred texts
    places = F.sort_array(F.collect_set("pos"))  # equal rows have equal places
    counted = met.groupBy("id", "row", "level", "n", "a", "template", "license", "size", "bigram", "here").agg(places.alias("at")).withColumn("there", F.size("at"))
    here = F.col("here").cast("int")
    placed = F.when(window, F.transform("at", lambda p, x: F.struct(p.alias("pos"), F.when(x >= here, F.get(F.col("at"), x - here)).otherwise(-1).alias("lag"))))
    common = counted.groupBy("id", "row", "level", "n", "a", "template", "license", "size").agg(F.sum(F.least("here", "there")).alias("c"), F.array_sort(F.flatten(F.collect_list(placed))).alias("hits"))
    hold = common.where(F.col("c") >= F.col("size") * low - 1e-9)
    one = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), (2.0 * F.col("c") / (F.col("a") + F.col("size"))).alias("dice")))
    found = hold.select("id", "row", "level", "n", "template", "license", F.inline(F.when(window, best_windows(F.col("hits"), F.col("size"), low, high)).otherwise(one)))
    per_piece = found.where(F.col("dice") >= least).groupBy("id", "row", "level", "n", "license").agg(F.max("dice").alias("dice"), F.collect_list(F.struct("dice", "start", "end", "template")).alias("ws"))
    before = lambda v, w: (v["dice"] > w["dice"]) | (v["dice"] == w["dice"]) & (F.struct(v["start"], v["end"], v["template"]) < F.struct(w["start"], w["end"], w["template"]))
    unbeaten = F.filter("ws", lambda w: ~F.exists("ws", lambda v: (v["start"] <= w["end"]) & (v["end"] >= w["start"]) & before(v, w)))
    pieces = per_piece.select("id", "license", window.alias("window"), "dice", F.when(window, F.size(unbeaten)).otherwise(1).alias("k"))
    of = lambda f, c, w: f(F.when(F.col("window") == w, F.col(c)))
    t = pieces.groupBy("id", "license").agg(F.coalesce(of(F.max, "dice", False), F.max("dice")).alias("dice"), F.greatest(of(F.sum, "k", False), of(F.sum, "k", True)).cast("long").alias("pieces"))
    return t.withColumnRenamed("id", key)
