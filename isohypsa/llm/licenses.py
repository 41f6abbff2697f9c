"""License scans by diagonal voting, with Spark expressions only.

All word pairs of all texts are hashed and joined to the places of the same pairs in license templates. A match votes
for the diagonal (place in the text minus place in the template); whole phrases are diagonals that got every vote. For long
templates, which texts quote with changes, neighbouring diagonals are merged and the merged span is verified: enough places
of the template, each counted once, in a span not much longer than the template. Where the merged span is too long, as other text around a quotation
uses its words, the neighbouring diagonals that such a span can hold are verified by themselves; the best of those that overlap counts.
"""

from __future__ import annotations

from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are runs of letters, digits and anything beyond ASCII; A-Z count as a-z.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Phrases that must stand word for word: label and words, the base ones first (fixed values).
BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
PHRASES = (
    ("cc-by-nc", "licensed under cc by nc"), ("cc-by-nc", "attribution noncommercial"), ("cc-by-sa", "licensed under cc by sa"), ("cc-by-sa", "attribution sharealike"),
    ("cc-by", "licensed under cc by"), ("cc0", "cc0 1 0"), ("cc0", "creative commons zero"), ("bsd", "bsd license"), ("bsd", "bsd 3 clause"), ("bsd", "bsd 2 clause"),
    ("mpl", "mozilla public license"), ("lgpl", "lesser general public license"), ("agpl", "affero general public license"), ("isc", "isc license"), ("epl", "eclipse public license"),
)
#: Passages of public license texts that may be quoted with changes (fixed values).
PASSAGES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
)
#: Pairs of two of these carry no vote in a passage: they stand everywhere.
COMMON = ("a", "an", "and", "any", "as", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "with", "you")
#: Diagonals this near are one quotation; it must hold this share of the passage's voting places, in a span this much longer at most.
BAND, COVER, STRETCH = 6, 0.5, 2.0


def pairs(words: Column) -> Column:
    """Neighbouring words, joined by a blank; the last word has none."""
    return F.transform(words, lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1)))


def lower_words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase), F.lit(WORD), F.lit(0))


def templates(spark: SparkSession) -> DataFrame:
    """template, label, exact, base, length (words), votes (voting pairs), place, pair, hash: a few hundred rows, fixed by the lists above."""
    rows = [(i, label, True, i < len(BASE), t) for i, (label, t) in enumerate(BASE + PHRASES)]
    rows += [(len(rows) + i, label, False, False, t) for i, (label, t) in enumerate(PASSAGES)]
    row = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("template", "label", "exact", "base", "text"), r)]) for r in rows])
    one = spark.range(1).select(F.inline(row)).withColumn("w", lower_words(F.col("text"))).select("*", F.size("w").alias("length"), F.posexplode(pairs(F.col("w"))).alias("place", "pair"))
    common = F.forall(F.split("pair", " "), lambda w: w.isin(*COMMON))
    one = one.filter(F.col("pair").isNotNull() & (F.col("exact") | ~common))
    return one.select("template", "label", "exact", "base", "length", F.count("*").over(Window.partitionBy("template")).alias("votes"), "place", F.col("pair").alias("t_pair"), F.xxhash64("pair").alias("hash"))


def spans(docs: DataFrame) -> DataFrame:
    """row, doc_id, n_words and, per verified span, label, base, first_word, last_word, cover; every row also has one line with null label.

    That line is the place without a pair: the last word, or the one of a text without words. It matches no template, whatever the text begins with.
    Null and blank texts have no words. Rows are told apart by their place in the input, so repeated rows and null ids stay."""
    spark = docs.sparkSession
    split = docs.select(F.col("doc_id"), F.monotonically_increasing_id().alias("row"), lower_words(F.col("text")).alias("w"))
    each = split.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), F.posexplode_outer(pairs(F.col("w"))).alias("pos", "pair"))
    t = F.broadcast(templates(spark))
    hit = each.join(t, (F.xxhash64("pair") == t["hash"]) & (F.col("pair") == t["t_pair"]), "left")
    hit = hit.filter(F.col("template").isNotNull() | F.col("pair").isNull())
    key = ["row", "doc_id", "n_words", "template", "label", "exact", "base", "length", "votes"]
    slots = range(max(len(t.split()) for _, t in BASE + PHRASES + PASSAGES) // 63 + 1)
    bits = [F.bit_or(F.expr(f"if(place DIV 63 = {k}, shiftleft(1L, place % 63), 0L)")).alias(f"places{k}") for k in slots]
    diagonal = hit.withColumn("diagonal", F.col("pos") - F.col("place")).groupBy(*key, "diagonal").agg(
        F.count("template").alias("got"), F.min("pos").alias("first"), F.max("pos").alias("last"), *bits)
    whole = diagonal.filter(F.col("template").isNull() | ~F.col("exact") | (F.col("got") == F.col("votes")))
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    fresh = F.coalesce(F.col("exact") | (F.col("diagonal") - F.lag("diagonal").over(along) > BAND), F.lit(True))
    run = whole.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(along))

    def verified(frame: str) -> Column:
        """cover, span (negative), first_word, last_word, diagonal of the diagonals in a frame of the run; null if they don't verify."""
        over = lambda f: F.expr(f"{f} OVER (PARTITION BY row, template, run {frame})")
        places = reduce(lambda a, k: a + F.bit_count(F.coalesce(over(f"bit_or(places{k})"), F.lit(0).cast("long"))), slots, F.lit(0))
        cover, first, last = places / F.col("votes"), over("min(first)"), over("max(last)") + 1
        found = F.struct(cover.alias("cover"), (first - last).alias("span"), first.alias("first_word"), last.alias("last_word"), F.col("diagonal"))
        return F.when(F.col("exact") | ((cover >= COVER) & (last - first < STRETCH * F.col("length"))), found)

    width = STRETCH - 1 + 1e-6  # of the diagonals that a span can hold, in lengths of the template
    ahead = f"ORDER BY diagonal / length RANGE BETWEEN CURRENT ROW AND {width}D FOLLOWING"
    near = f"ORDER BY diagonal / length RANGE BETWEEN {width + 1e-6}D PRECEDING AND {width + 1e-6}D FOLLOWING"
    tried = run.withColumn("all", verified("")).withColumn("part", verified(ahead))
    tried = tried.withColumn("best", F.expr(f"max(part) OVER (PARTITION BY row, template, run {near})"))
    best = F.when(F.col("all").isNotNull(), F.when(F.col("diagonal") == F.expr("min(diagonal) OVER (PARTITION BY row, template, run)"), F.col("all")))
    best = best.otherwise(F.when(F.col("part") == F.col("best"), F.col("part")))
    found = tried.withColumn("found", best).filter(F.col("template").isNull() | F.col("found").isNotNull())
    told = lambda c: F.when(F.col("found").isNotNull(), F.col(c)).alias(c)
    return found.select("row", "doc_id", "n_words", told("label"), told("base"), "found.first_word", "found.last_word", "found.cover")


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the best cover)."""
    base = lambda c: F.when(F.col("base"), F.col(c))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return spans(docs).groupBy("row", "doc_id", "n_words").agg(
        F.count(base("label")).alias("n_base"), F.min(base("first_word")).cast("long").alias("first_word"), F.max(base("first_word")).cast("long").alias("last_word"),
        joined(base("label")).alias("base_labels"), joined(F.col("label")).alias("labels"), F.coalesce(F.max("cover"), F.lit(0.0)).alias("score")).drop("row")
