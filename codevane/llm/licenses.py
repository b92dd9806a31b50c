"""License texts in documents, found by votes on diagonals.

Every rolling run of ``K`` words of a document is joined by its hash to the
places where license templates have it.  A hit at document word i and template
word j votes for the diagonal i - j.  A template that stands in a document
gives its votes to one diagonal, or, after small edits, to a few close ones;
diagonals up to GAP apart are merged into a placement and their votes counted
together.  A placement thus covers at most the template's length and GAP words
more, however many diagonals stand next to each other.

A placement with enough votes is then verified.  Only votes that stand in the
same order in document and template count for its score.  Where the text of
another template would reach the threshold too, the document must have the
words that tell the two apart; a number stands for any number, as versions
differ.  Of templates on the same words the one with the best score stays.

The join compares the words of a hit as well as the hash, so votes are exact.
Hashes that no template has are left out before rows are made of the others,
and a row holds its own words only, so the cost grows with the length of a
text.  All steps are DataFrame operations.  The templates are a fixed table of
a few hundred rows, hence broadcast; votes are summed before they are shuffled.

Defined results: a null or empty text has no words and no labels; rows that
repeat a doc_id with the same text are counted together and returned once for
each row; a table without rows gives none; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = 3
#: Diagonals of one template at most this far apart are one placement.
GAP = 8
#: Share of a template's word runs that a placement needs.
THRESHOLD = 0.6

# The phrases that are looked for, and their labels.
PHRASES = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}

# Opening passages of public license texts, and their labels.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache-2": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "cc-by-nc": "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-sa": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
}

P = "__lic_"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text: runs of digits, letters and everything beyond ASCII, A-Z lowered."""
    plain = F.octet_length(text) == F.length(text)
    lowered = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(lowered, BREAKS), "")


def telling(w: list[str], others: list[list[str]]) -> str | None:
    """A pattern of what tells a template from those whose text reaches its threshold, for words without blanks; None without such."""

    def runs(x: list[str], n: int) -> set[tuple[str, ...]]:
        return set(zip(*[x[i:] for i in range(n)], strict=False))

    found = set()
    for v in others:
        if len(runs(w, K) & runs(v, K)) >= THRESHOLD * len(runs(w, K)):
            # words of its own, or else what stands next to each other only here
            parts = runs(w, 1) - runs(v, 1) or runs(w, 2) - runs(v, 2)
            found |= {"".join("[0-9]+" if x.isdigit() else x for x in part) for part in parts}
    return "".join(f"(?=.*{x})" for x in sorted(found)) or None


def _split(text: str) -> list[str]:
    return "".join(c.lower() if c.isalnum() and c.isascii() else " " for c in text).split()


def grams(spark: SparkSession) -> DataFrame:
    """Every K-gram place of every template: (template, label, base, own, j, total, hash, a, b, c)."""
    rows = []
    texts = [(label, text, True) for label, text in PHRASES.items()] + [(label, text, False) for label, text in TEMPLATES.items()]
    split = [_split(text) for _, text, _ in texts]
    for t, ((label, _, base), w) in enumerate(zip(texts, split, strict=True)):
        own = None if base else telling(w, [v for v, (_, _, phrase) in zip(split, texts, strict=True) if v is not w and not phrase])
        rows += [(t, label, base, own, j, len(w) - K + 1, *w[j : j + K]) for j in range(len(w) - K + 1)]
    df = spark.createDataFrame(rows, "template int, label string, base boolean, own string, j int, total int, a string, b string, c string")
    return df.withColumn("hash", F.xxhash64("a", "b", "c"))


def votes(df: DataFrame) -> DataFrame:
    """One row for each text and diagonal with votes, and one with a null template for each text.

    Columns: doc_id, text key, n_words, template, label, base, total, diagonal,
    votes (the template's places that voted), told (the words that tell the
    template from others are there) and rows.
    """
    table = grams(df.sparkSession)
    rows = table.select("hash", "own", "total").collect()
    # a fixed table's hashes, and those of templates whose neighbourhood is looked at
    known, around = {r["hash"] for r in rows}, {r["hash"] for r in rows if r["own"] is not None}
    reach = max((r["total"] + K for r in rows if r["own"] is not None), default=0)
    w, hit = P + "w", P + "hit"
    docs = df.select("doc_id", F.xxhash64("text").alias(P + "key"), words(F.coalesce("text", F.lit(""))).alias(w))
    docs = docs.withColumn(P + "n", F.size(w))

    def run(i: Column) -> Column:
        return F.struct(i.alias("i"), F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("hash"))

    def enriched(p: Column) -> Column:
        near = F.when(p.hash.isin(around), F.slice(w, F.greatest(p.i - reach, F.lit(0)) + 1, F.lit(2 * reach + K)))
        return F.struct(p.i.alias("i"), p.hash.alias("hash"), F.get(w, p.i).alias("x"), F.get(w, p.i + 1).alias("y"), F.get(w, p.i + 2).alias("z"), near.alias("near"))

    places = F.when(F.col(P + "n") >= K, F.sequence(F.lit(0), F.col(P + "n") - K)).otherwise(F.expr("cast(array() as array<int>)"))
    found = F.transform(F.filter(F.transform(places, run), lambda p: p.hash.isin(known)), enriched)
    docs = docs.withColumn(P + "hits", found).drop(w)
    # the null keeps texts without any hit, and counts every text once
    hits = docs.select("doc_id", P + "key", P + "n", F.explode(F.concat(P + "hits", F.array(F.lit(None)))).alias(hit))
    hits = hits.select("doc_id", P + "key", P + "n", *[F.col(f"{hit}.{c}").alias(P + c) for c in ("i", "hash", "x", "y", "z", "near")])
    same = (F.col(P + "hash") == F.col("hash")) & (F.col(P + "x") == F.col("a")) & (F.col(P + "y") == F.col("b")) & (F.col(P + "z") == F.col("c"))
    hits = hits.join(F.broadcast(table), same, "left").where(F.col("template").isNotNull() | F.col(P + "hash").isNull())
    i = F.col(P + "i")
    diagonal = i - F.col("j")
    first = F.greatest(diagonal, F.lit(0)) - F.greatest(i - reach, F.lit(0))
    span = F.array_join(F.slice(P + "near", first + 1, F.col("total") + K - 1), "")
    told = F.when(F.col("own").isNull(), True).otherwise(F.regexp_like(span, F.col("own")))
    hits = hits.select("doc_id", P + "key", P + "n", "template", "label", "base", "total", "j", diagonal.alias("diagonal"), told.alias("told"))
    return hits.groupBy("doc_id", P + "key", P + "n", "template", "label", "base", "total", "diagonal").agg(F.collect_set("j").alias("votes"), F.max("told").alias("told"), F.count(F.lit(1)).alias(P + "rows"))


def ordered(pairs: Column, total: Column) -> Column:
    """The longest row of votes (i, j) that grows in both: how many (n), its first place and its last."""
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("first"), F.lit(0).alias("last"))

    def step(best: Column, p: Column) -> Column:
        # best: for each template place the longest row that ends there
        before = F.array_max(F.concat(F.array(none), F.slice(best, 1, p.j)))
        new = F.struct((before.n + 1).alias("n"), F.when(before.n == 0, p.i).otherwise(before.first).alias("first"), p.i.alias("last"))
        return F.transform(best, lambda x, at: F.when((at == p.j) & (new.n > x.n), new).otherwise(x))

    # of one document place the later template place goes first, so that a row takes one of them
    in_order = F.transform(F.array_sort(F.transform(pairs, lambda p: F.struct(p.i.alias("i"), (-p.j).alias("back")))), lambda p: F.struct(p.i.alias("i"), (-p.back).alias("j")))
    return F.aggregate(in_order, F.array_repeat(none, total), step, F.array_max)


def beaten(spot: Column, near: Column) -> Column:
    """Whether a verified spot has half of the shorter span in common with a better one near it.

    Of spots of one label and score the first is the better one.
    """

    def by(y: Column) -> Column:
        shared = F.least(spot.end, y.end) - F.greatest(spot.start, y.start)
        first = (y.score == spot.score) & (y.label == spot.label) & ((y.start < spot.start) | (y.start == spot.start) & (y.place < spot.place))
        return ((y.score > spot.score) | first) & (2 * shared >= F.least(spot.end - spot.start, y.end - y.start))

    return F.exists(near, by)


def scan(df: DataFrame) -> DataFrame:
    """Placements of each text: doc_id, n_words, copies and ``found``, an array of (label, base, start, end, score).

    ``start`` is the first word's place and ``end`` the place after the last;
    ``score`` the share of the template's word runs that the placement has in
    order.  Phrases need all of theirs.
    """
    v = votes(df)
    text = ["doc_id", P + "key", P + "n"]
    # a placement is a diagonal and those up to GAP after it; a phrase stands on one
    wide = Window.partitionBy(*text, "template").orderBy("diagonal").rangeBetween(0, GAP)
    pairs = F.transform("votes", lambda j: F.struct((F.col("diagonal") + j).alias("i"), j.alias("j")))
    v = v.withColumn(P + "own", F.when(F.col("template").isNotNull(), pairs))
    v = v.withColumn(P + "pairs", F.when(F.col("base"), F.col(P + "own")).otherwise(F.flatten(F.collect_list(P + "own").over(wide))))
    v = v.withColumn(P + "told", F.max("told").over(wide))
    voted = F.size(F.array_distinct(F.transform(P + "pairs", lambda p: p.j)))
    enough = F.when(F.col("base"), voted == F.col("total")).otherwise(F.col(P + "told") & (voted >= THRESHOLD * F.col("total")))
    spot = v.withColumn(P + "row", F.when(enough, ordered(F.col(P + "pairs"), F.col("total"))))
    # the rows without a template count the copies of a text
    copies = F.sum(F.when(F.col("template").isNull(), F.col(P + "rows")))
    row = F.col(P + "row")
    score = row["n"] / F.col("total")
    one = F.struct("label", "base", row["first"].cast("long").alias("start"), (row["last"] + K).cast("long").alias("end"), score.alias("score"), F.col("diagonal").alias("place"))
    spot = spot.withColumn(P + "spot", F.when(row.isNotNull() & (F.col("base") | (score >= THRESHOLD)), one))
    # spots further apart than the longest template have nothing in common
    longest = max(len(_split(text)) for text in TEMPLATES.values()) + GAP + K
    close = Window.partitionBy(*text).orderBy(P + "spot.start").rangeBetween(-longest, longest)
    spot = spot.withColumn(P + "near", F.collect_list(F.when(~F.col("base"), F.col(P + "spot"))).over(close))
    s = F.col(P + "spot")
    kept = F.when(F.col("base") | ~beaten(s, F.col(P + "near")), F.struct(*[s[c].alias(c) for c in ("label", "base", "start", "end", "score")]))
    docs = spot.groupBy(*text).agg(copies.alias("copies"), F.collect_list(F.when(s.isNotNull(), kept)).alias("found"))
    return docs.select("doc_id", F.col(P + "n").cast("long").alias("n_words"), "copies", F.array_sort("found").alias("found"))


def digest(df: DataFrame) -> DataFrame:
    """doc_id, word and phrase counts, the first and last phrase's place, labels and score, for each row."""
    docs = scan(df)
    base = F.filter("found", lambda x: x.base)
    starts = F.transform(base, lambda x: x.start)

    def names(spots: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spots, lambda x: x.label))), ",")

    docs = docs.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x.score)), F.lit(0.0)).alias("score"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(P + "copy"),
    )
    return docs.drop(P + "copy")
