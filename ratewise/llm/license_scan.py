"""License scan by diagonal voting.

Every rolling word k-gram hash (k = 2) of every text is joined to the template
positions that have it; each match votes for the diagonal (text position minus
template position).  A template that stands in a text unchanged fills one
diagonal; small edits split it over neighbouring diagonals, which are merged.
A merged span counts when the words that match exactly cover enough of the
template.  A phrase counts where its diagonal is full.  DataFrame functions
only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Base phrases with their labels.
PHRASES = [
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
]

#: Notices of public licenses, as words, with their labels.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"
                   " http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing"
                   " software distributed under the license is distributed on an as is basis without warranties or"
                   " conditions of any kind either express or implied"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that"
            " the following conditions are met"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike license"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu"
                " general public license as published by the free software foundation either version 3 of the license"
                " or at your option any later version"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
            " documentation files the software to deal in the software without restriction including without"
            " limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the"
            " software"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("public-domain", "this is free and unencumbered software released into the public domain"),
]

NON_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
K = 2
#: Template positions in one mask column.
MASK_BITS = 63
WINDOWS = "array<struct<votes:int,n_span:int,start:int>>"
#: Stands at position 0 of every text, so that texts without matches stay.
SENTINEL = 0


def words(text):
    """The words of a text with A-Z lower-cased.  ``lower`` also folds other
    letters, which no template has; the two signs that it would turn into
    ASCII letters are replaced by others first."""
    t = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("Ɫ")), F.lit("İ"), F.lit("ı"))
    parts = F.split(F.lower(t), NON_WORD)
    lead = F.when(parts[0] == "", 2).otherwise(1)
    tail = F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return F.slice(parts, lead, F.greatest(F.size(parts) - lead + 1 - tail, F.lit(0)))


def template_table(spark, templates, phrases) -> DataFrame:
    """One row per template gram; a literal table of the length of the lists."""
    rows = [(-1, "", False, 0, 0, "", "")]
    for n, (label, text, base) in enumerate([(a, b, True) for a, b in phrases] + [(a, b, False) for a, b in templates]):
        w = text.split()
        rows += [(n, label, base, len(w), i, w[i], w[i + 1]) for i in range(len(w) - 1)]
    t = spark.createDataFrame(rows, "template int, label string, base boolean, n_template int, t_pos int, w0 string, w1 string")
    return t.withColumn("h", F.when(F.col("template") < 0, F.lit(SENTINEL).cast("long")).otherwise(F.xxhash64("w0", "w1")))


def distinct_hits(masks):
    """Template positions that are set in the masks."""
    return reduce(lambda a, b: a + b, [F.bit_count(m) for m in masks])


def windows(diagonals, n_template, names):
    """The best window from each diagonal on: ``(votes, n_span, start)``, the
    most template positions in at most ``2 * n_template`` words, then the fewest
    words.  A diagonal that would make the window longer is passed over."""
    zero = lambda d: F.struct(
        F.lit(0).alias("votes"), F.lit(0).alias("n_span"), F.lit(0).alias("start"),
        d["start"].alias("lo"), d["end"].alias("hi"), *[F.lit(0).cast("long").alias(m) for m in names])

    def add(acc, d):
        lo, hi = F.least(acc["lo"], d["start"]), F.greatest(acc["hi"], d["end"])
        masks = [acc[m].bitwiseOR(d[m]) for m in names]
        votes, n_span = distinct_hits(masks), hi - lo + K
        more = votes > acc["votes"]
        return F.when(n_span > 2 * n_template, acc).otherwise(F.struct(
            F.when(more, votes).otherwise(acc["votes"]).alias("votes"), F.when(more, n_span).otherwise(acc["n_span"]).alias("n_span"),
            F.when(more, lo).otherwise(acc["start"]).alias("start"), lo.alias("lo"), hi.alias("hi"),
            *[m.alias(name) for m, name in zip(masks, names)]))

    # diagonals are distinct numbers, and one that starts behind the window cannot join it
    return F.transform(diagonals, lambda d, i: F.aggregate(
        F.slice(diagonals, i + 1, 3 * n_template), zero(d), add,
        lambda acc: F.struct(acc["votes"].alias("votes"), acc["n_span"].alias("n_span"), acc["start"].alias("start"))))


def apart(found):
    """The best of the windows that overlap: most votes, fewest words, first."""
    order = F.array_sort(F.transform(found, lambda w: F.struct(
        (-w["votes"]).alias("less"), w["n_span"].alias("n_span"), w["start"].alias("start"))))
    best = F.transform(order, lambda w: F.struct((-w["less"]).alias("votes"), w["n_span"].alias("n_span"), w["start"].alias("start")))
    return F.aggregate(best, F.array().cast(WINDOWS), lambda acc, w: F.when(
        F.exists(acc, lambda a: (a["start"] < w["start"] + w["n_span"]) & (w["start"] < a["start"] + a["n_span"])), acc
    ).otherwise(F.concat(acc, F.array(w)).cast(WINDOWS)))


def license_scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, max_shift: int = 3,
                 min_cover: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """``(per document, spans)``.

    Per row of ``docs``: ``doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score``; ``score`` is the best coverage of any template
    or phrase.  Spans: ``doc_id, label, base, start_word, n_span, votes,
    cover``.  Null text counts as empty (no words, score 0); rows repeated with
    one ``doc_id``, and rows without one, are separate documents; an empty table
    gives empty results; other columns are not read.  A base place needs the
    phrase's words to stand consecutively; overlapping places all count.
    ``votes`` are the distinct template positions of a span, ``cover`` their
    share; spans of one template found in one chain of diagonals do not
    overlap, the best come first."""
    spark = docs.sparkSession
    table = template_table(spark, templates, phrases)
    # the template side is the literal lists above: a few hundred rows
    hashes = [r["h"] for r in table.where("template >= 0").select("h").distinct().collect()]
    # grams without a template's hash go inside the array; the rows that are left don't carry the words
    pair = lambda i: (F.get("words", i), F.get("words", i + 1))
    at = F.when(F.size("words") >= K, F.filter(F.sequence(F.lit(0), F.size("words") - K), lambda i: F.xxhash64(*pair(i)).isin(hashes))
                ).otherwise(F.array().cast("array<int>"))
    grams = F.transform(at, lambda i: F.struct(i.alias("at"), pair(i)[0].alias("g0"), pair(i)[1].alias("g1"), F.xxhash64(*pair(i)).alias("h")))
    sentinel = F.struct(F.lit(-1).alias("at"), F.lit("").alias("g0"), F.lit("").alias("g1"), F.lit(SENTINEL).cast("long").alias("h"))
    joined = (docs.select("doc_id", words(F.col("text").cast("string")).alias("words"))
              .withColumn("row_id", F.monotonically_increasing_id())
              .select("row_id", "doc_id", F.size("words").alias("size"), F.concat(F.array(sentinel), grams).alias("grams"))
              .select("row_id", "doc_id", "size", F.inline("grams"))
              .join(F.broadcast(table), "h")
              .where((F.col("template") < 0) & (F.col("at") < 0)
                     | (F.col("template") >= 0) & (F.col("at") >= 0) & (F.col("g0") == F.col("w0")) & (F.col("g1") == F.col("w1")))
              .select("row_id", "doc_id", F.when(F.col("template") < 0, F.col("size")).alias("n_words"), "template",
                      "label", "base", "n_template", "t_pos", F.col("at").alias("pos"), (F.col("at") - F.col("t_pos")).alias("diagonal")))
    n_masks = -(-max(len(t.split()) for _, t in [*templates, *phrases, ("", "")]) // MASK_BITS) or 1
    names = [f"m{i}" for i in range(n_masks)]
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("t_pos") % MASK_BITS)
    masks = [F.bit_or(F.when(F.floor(F.col("t_pos") / MASK_BITS) == i, bit).otherwise(F.lit(0).cast("long"))).alias(m)
             for i, m in enumerate(names)]
    votes = (joined.repartition("row_id")
             .groupBy("row_id", "template", "diagonal")
             .agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.first("label").alias("label"),
                  F.first("base").alias("base"), F.first("n_template").alias("n_template"), *masks,
                  F.min("pos").alias("start"), F.max("pos").alias("end")))
    by = Window.partitionBy("row_id", "template").orderBy("diagonal")
    # phrases stay on their own diagonal; templates also take neighbouring ones
    step = F.when(F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(by) > max_shift), 1).otherwise(0)
    alone = (F.col("step") == 1) & (F.coalesce(F.lead("step").over(by), F.lit(1)) == 1)
    chains = (votes.withColumn("step", F.when(F.lag("diagonal").over(by).isNull(), 1).otherwise(step))
              .withColumns({"alone": alone, "chain": F.sum("step").over(by)})
              .groupBy("row_id", "template", "chain")
              .agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.first("label").alias("label"),
                   F.first("base").alias("base"), F.first("n_template").alias("n_template"),
                   *[F.bit_or(m).alias(m) for m in names], F.min("start").alias("start"), F.max("end").alias("end"),
                   F.sort_array(F.collect_list(F.when(~F.col("alone"), F.struct("diagonal", "start", "end", *names)))).alias("diagonals"))
              .withColumn("votes", distinct_hits([F.col(m) for m in names]))
              .withColumn("n_span", F.col("end") - F.col("start") + K))
    grams = F.col("n_template") - (K - 1)
    least = F.when(F.col("base"), 1.0).otherwise(min_cover)
    # a chain that is too long or may hold is searched; any other is its own best window
    search = (F.size("diagonals") > 1) & ((F.col("n_span") > 2 * F.col("n_template")) | (F.col("votes") / grams >= least))
    whole = F.array(F.struct("votes", "n_span", "start")).cast(WINDOWS)
    merged = (chains.withColumn("windows", F.when(search, windows(F.col("diagonals"), F.col("n_template"), names).cast(WINDOWS)).otherwise(whole))
              .withColumn("cover", F.when(F.col("template") >= 0, F.array_max("windows").getField("votes") / grams).otherwise(F.lit(0.0)))
              .withColumn("found", F.filter("windows", lambda w: (F.col("template") >= 0) & (w["votes"] / grams >= least)))
              .withColumn("found", F.when(F.size("found") > 1, apart(F.col("found"))).otherwise(F.col("found")))
              .withColumn("holds", F.size("found") > 0))
    at_base = F.col("holds") & F.col("base")
    labels = lambda c: F.array_join(F.sort_array(F.collect_set(F.when(c, F.col("label")))), ",")
    per_doc = merged.groupBy("row_id").agg(
        F.first("doc_id").alias("doc_id"), F.max("n_words").cast("long").alias("n_words"),
        F.count_if(at_base).alias("n_base"), F.min(F.when(at_base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(at_base, F.col("start"))).cast("long").alias("last_word"), labels(at_base).alias("base_labels"),
        labels(F.col("holds")).alias("labels"), F.max("cover").alias("score")).drop("row_id")
    spans = (merged.where("holds").select("doc_id", "label", "base", "n_template", F.inline("found"))
             .select("doc_id", "label", "base", F.col("start").alias("start_word"), "n_span",
                     F.col("votes").cast("long").alias("votes"), (F.col("votes") / grams).alias("cover")))
    return per_doc, spans
