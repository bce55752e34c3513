"""License scan by diagonal voting, in DataFrame expressions alone.

One pass cuts each text into words, counts them, finds the base phrases and hashes all rolling word k-grams. Those that
may be a template's, by a small bitmap of the templates' hashes (three bits each; it passes every k-gram of a template),
are settled with the words around them, and joined with the templates' positions (a table of fixed size, so it is
broadcast). A match at word p of the text and word q of the template votes for the diagonal p - q; neighbouring
diagonals (small edits) merge into a span. Spans with enough votes are verified by aligning their words with the template's
by exact edit distance (words become single characters, so Spark's own function does it). Of spans that overlap the
most similar one stays. Only matches travel, and votes are summed per text and diagonal by partial aggregates: rows never
meet by phrase, however common it is.

Defined cases: a null text is empty (no words, no labels, score 0); repeated rows are scanned each on its own, and each is
returned; of overlapping spans that are equally similar the one of the longer template stays, then that of the first
label; a text of any length is read whole, a notice that stands in it many times giving as many spans; an empty table
gives none; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, once, settle

#: Exact phrases and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Usual notices, paragraph by paragraph, and usual sentences, with their labels.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit", "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software"),
    ("mit", "This project is released under the MIT license"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http www apache org licenses LICENSE 2.0"),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis, without warranties or conditions of any kind, either express or implied. See the License for the specific language governing permissions and limitations under the License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl-3", "either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non commercial, and by any means"),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced without the prior written permission of the copyright owner"),
)
#: Words of a k-gram; diagonals that merge; least share of a template's k-grams that vote; least similarity of a span's
#: words to the template's; a span's length against its template; words that two spans side by side may share.
GRAM, SLACK, VOTES, SIMILAR, STRETCH, TOUCH = 3, 3, 0.35, 0.7, 1.5, 3

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BITS = 1 << 16


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def places(words: Column, phrase: str) -> Column:
    """Starts (from 0) of the phrase's words standing one after the other."""
    want = phrase.split()
    at = lambda i: F.when(F.get(words, i) == want[0], F.array_join(F.slice(words, i + 1, len(want)), " ") == phrase).otherwise(F.lit(False))
    return F.when(F.size(words) >= len(want), F.filter(F.sequence(F.lit(0), F.size(words) - len(want)), at)).otherwise(F.expr("cast(array() as array<int>)"))


def bitmap(hashes: list[int]) -> list[int]:
    """``_BITS`` bits as longs, three of them set for each hash."""
    bits = [0] * (_BITS // 64)
    for g in hashes:
        for shift in (0, 16, 32):
            at = (g >> shift) % _BITS
            bits[at // 64] |= 1 << at % 64
    return [x - (1 << 64) if x >> 63 else x for x in bits]


def passes(bits: Column, g: Column) -> Column:
    """The three bits of a hash are set."""
    out = F.lit(True)
    for shift in (0, 16, 32):
        at = F.shiftright(g, shift).bitwiseAND(F.lit(_BITS - 1)).cast("int")
        word = F.get(bits, F.shiftright(at, 6))
        out = out & (F.call_function("getbit", word, at.bitwiseAND(F.lit(63))) == 1)
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, votes: float = VOTES, similar: float = SIMILAR) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, places of the phrases, verified spans, labels, score."""
    spark = docs.sparkSession
    texts = [words_of(t) for _, t in TEMPLATES]
    rows = [(i, len(w), q, w[q : q + gram]) for i, w in enumerate(texts) for q in range(len(w) - gram + 1)]
    known = spark.createDataFrame(rows, "template int, size int, q int, w array<string>").withColumn("g", F.xxhash64(*[F.get("w", F.lit(j)) for j in range(gram)])).drop("w")
    bits = F.lit(bitmap([r[0] for r in known.select("g").collect()]))  # as many as the templates have k-grams
    margin, least = max(map(len, texts)), min(int(votes * (len(w) - gram + 1)) or 1 for w in texts)

    seen = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    words = F.regexp_extract_all(ascii_lower(F.col("_t")), F.lit(WORD), F.lit(0))
    none_at = F.expr("cast(array() as array<int>)")

    def read(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(w) - gram), lambda i: F.struct(i.alias("p"), F.xxhash64(*[F.get(w, i + j) for j in range(gram)]).alias("g")))
        hits = F.when(F.size(w) >= gram, F.filter(each, lambda x: passes(bits, x["g"]))).otherwise(F.expr("cast(array() as array<struct<p:int,g:bigint>>)"))
        near = F.array_contains(w, "license") | F.array_contains(w, "nc")  # each phrase holds one of these

        def keep(h: Column) -> Column:
            low = F.greatest(F.get(h, F.lit(0))["p"] - margin, F.lit(0))
            some = F.size(h) >= least
            around = F.slice(w, low + 1, F.element_at(h, -1)["p"] - low + gram + margin)
            return F.struct(F.size(w).alias("n_words"), *[F.when(near, places(w, p)).otherwise(none_at).alias(f"p{i}") for i, (p, _) in enumerate(PHRASES)], F.when(some, h).alias("hits"), F.when(some, low).alias("low"), F.when(some, around).alias("around"))

        return once(hits, keep)

    cut = settle(seen.select("_id", F.monotonically_increasing_id().alias("_row"), once(words, read).alias("x")).select("_id", "_row", "x.*"), "licenses")
    hit = cut.where("hits is not null")

    line = Window.partitionBy("_row", "template").orderBy("diagonal")
    summed = hit.select("_row", F.explode("hits").alias("x")).select("_row", F.col("x.p").alias("p"), F.col("x.g").alias("g")).join(F.broadcast(known), "g")
    summed = summed.groupBy("_row", "template", "size", (F.col("p") - F.col("q")).alias("diagonal")).agg(F.min("p").alias("first"), F.max("p").alias("last"), F.collect_set("q").alias("qs"))
    fresh = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(line) > SLACK).cast("int"), F.lit(1))
    merged = summed.withColumn("run", F.sum(fresh).over(line)).groupBy("_row", "template", "size", "run")
    merged = merged.agg(F.min("first").alias("start"), (F.max("last") + gram).alias("end"), F.array_distinct(F.flatten(F.collect_list("qs"))).alias("qs"))
    merged = merged.where((F.size("qs") >= votes * (F.col("size") - gram + 1)) & (F.col("end") - F.col("start") <= STRETCH * F.col("size") + SLACK))

    vocabulary = list(dict.fromkeys(x for w in texts for x in w))
    letter = {x: chr(0x4E00 + i) for i, x in enumerate(vocabulary)}
    notices = spark.createDataFrame([(i, label, "".join(letter[x] for x in w)) for i, ((label, _), w) in enumerate(zip(TEMPLATES, texts))], "template int, label string, letters string")
    alphabet, known_words = F.lit("\u4dff" + "".join(letter.values())), F.lit(vocabulary)
    begin = F.greatest(F.col("start") - F.array_min("qs") - F.col("low"), F.lit(0))
    end = F.col("end") + F.col("size") - F.array_max("qs") - gram - F.col("low")
    span = F.array_join(F.transform(F.slice("around", begin + 1, F.greatest(end - begin, F.lit(0))), lambda x: F.substring(alphabet, F.array_position(known_words, x).cast("int") + 1, F.lit(1))), "")
    likeness = (1 - F.levenshtein(span, F.col("letters")) / F.col("size")).alias("similarity")
    verified = merged.join(hit.select("_row", "low", "around"), "_row").join(F.broadcast(notices), "template").select("_row", (begin + F.col("low")).alias("start"), F.greatest(end + F.col("low"), F.col("end")).alias("end"), "label", "size", likeness).where(F.col("similarity") >= similar)

    along = Window.partitionBy("_row").orderBy("start", "end", "label", "size")
    island = F.coalesce((F.col("start") > F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1)) - TOUCH).cast("int"), F.lit(1))
    best = F.max_by(F.struct("start", "end", "label", "similarity"), F.struct("similarity", "size", F.translate("label", "abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba"), -F.col("start"))).alias("x")
    placed = verified.withColumn("island", island).withColumn("island", F.sum("island").over(along)).groupBy("_row", "island").agg(best)
    found = placed.groupBy("_row").agg(F.array_sort(F.collect_list("x")).alias("spans"), F.max("x.similarity").alias("similarity"))

    every, none = F.concat(*[f"p{i}" for i in range(len(PHRASES))]), F.expr("cast(array() as array<string>)")
    labels = F.array_sort(F.array_compact(F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(PHRASES)])))
    based = cut.select("_id", "_row", F.col("n_words").cast("long"), F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), labels.alias("base"))
    out = based.join(found, "_row", "left")
    spans = F.coalesce("spans", F.expr("array()").cast(found.schema["spans"].dataType))
    both = F.array_sort(F.array_distinct(F.concat(F.coalesce("base", none), F.transform(spans, lambda x: x["label"]))))
    score = F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("similarity", F.lit(0.0)))
    return out.select(F.col("_id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base", both.alias("labels"), score.alias("score"), spans.alias("spans"))


def digest(scanned: DataFrame) -> DataFrame:
    return scanned.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")
