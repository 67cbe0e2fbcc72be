"""License scans by diagonal voting; DataFrame functions only.

All rolling word k-grams of a text are joined with the places of the same k-grams in license templates. A hit at word ``pos`` of the text
and ``tpos`` of the template votes for the diagonal pos - tpos, on which a verbatim copy has all its votes. Neighbouring diagonals are
merged, so words that were put in or left out don't break a copy apart, and what was merged is verified: the share of the template's
k-grams that it has, in a span of about the template's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dockflow.llm.shared import stage

GRAM = 3
END = ""  # after the last word of a text; no word is empty
NEAR = 4  # diagonals at most so far apart are one copy with words put in or left out
LEAST_SHARE, LONGEST = 0.7, 1.5  # of the template's k-grams in a copy; words of a copy, by words of the template

# Fixed values of the contract: phrases with their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Notices of public licenses with their labels, in lower case without punctuation.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software "
     "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
     "persons to whom the software is furnished to do so", "mit"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
     "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "apache-2"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source "
     "code must retain the above copyright notice this list of conditions and the following disclaimer", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this "
     "permission notice appear in all copies", "isc"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software "
     "foundation", "lgpl"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mpl-2"),
    ("this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", "unlicense"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, only A-Z lower-cased, and its end. What the pattern leaves empty before and after the words is left out."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), NOT_WORD)
    return F.array_append(F.array_remove(parts, ""), END)


def template_grams(spark: SparkSession, templates: tuple[tuple[str, str], ...]) -> DataFrame:
    """(h, gram, template, tpos, grams, size): every k-gram of every template, with its hash; as many rows as the templates have words.

    One more row, without template, has the hash of a text's end, so that every text has a row in the join.
    """
    texts = spark.range(1).select(F.posexplode(F.lit([t for t, _ in templates])).alias("template", "text")).select("template", F.split("text", " ").alias("w"))
    size = F.size("w")
    grams = texts.select("template", "w", F.explode(F.sequence(F.lit(1), size - GRAM + 1)).alias("i")).select(
        F.slice("w", F.col("i"), F.lit(GRAM)).alias("gram"), "template", (F.col("i") - 1).alias("tpos"), (size - GRAM + 1).alias("grams"), size.alias("size"))
    none = [F.lit(None).cast("int").alias(c) for c in ("template", "tpos", "grams", "size")]
    return grams.unionByName(spark.range(1).select(F.array(F.lit(END)).alias("gram"), *none)).withColumn("h", F.xxhash64(*(F.get("gram", F.lit(i)) for i in range(GRAM))))


def hits(docs: DataFrame, templates: tuple[tuple[str, str], ...], key: str, text: str) -> DataFrame:
    """(row, key, n_words, template, tpos, grams, size, diagonal): a row for each hit, and one without template for each text.

    Every position of a text is joined with the templates' k-grams, by hash and then by the words. ``row`` numbers the texts, as keys
    may be null or repeated.
    """
    d = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), words(F.col(text)).alias("words"))
    d = d.select("row", "key", (F.size("words") - 1).cast("long").alias("n_words"), "words", F.posexplode("words").alias("pos", "word"))
    gram = [F.col("word"), *(F.get("words", F.col("pos") + i) for i in range(1, GRAM))]
    d = d.withColumn("h", F.xxhash64(*gram)).alias("d")
    t = template_grams(docs.sparkSession, templates)
    # equality of the words as least = greatest: the hash alone is the join's key, a long
    same = [F.coalesce(F.least(g, w) == F.greatest(g, w), F.lit(True)) & (g.isNull() == w.isNull()) for g, w in ((g, F.get("gram", F.lit(i))) for i, g in enumerate(gram))]
    found = d.join(F.broadcast(t), "h").where(same[0] & same[1] & same[2])  # broadcast: of a size fixed by the templates
    return found.select("row", "key", "n_words", "template", "tpos", "grams", "size", (F.col("pos") - F.col("tpos")).alias("diagonal"))


def copies(found: DataFrame) -> DataFrame:
    """(row, template, verbatim, place, share) of the merged diagonals: the text's places with all votes on one diagonal, the share of the
    template's k-grams in the merged span, 0 if the span is too long for a copy."""
    votes = found.where("template is not null").groupBy("row", "template", "grams", "size", "diagonal").agg(F.collect_set("tpos").alias("at"))
    own = Window.partitionBy("row", "template").orderBy("diagonal")
    new = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(own) > NEAR, F.lit(True))
    parts = votes.withColumn("new", new).withColumn("part", F.sum(F.col("new").cast("int")).over(own))
    whole = F.size("at") == F.col("grams")
    first, last = F.col("diagonal") + F.array_min("at"), F.col("diagonal") + F.array_max("at") + GRAM
    merged = parts.groupBy("row", "template", "part", "grams", "size").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("n"), (F.max(last) - F.min(first)).alias("length"),
        F.count_if(whole).alias("places"), F.min(F.when(whole, F.col("diagonal"))).alias("first"), F.max(F.when(whole, F.col("diagonal"))).alias("last"))
    return merged.select("row", "template", "places", "first", "last", F.when(F.col("length") <= LONGEST * F.col("size"), F.col("n") / F.col("grams")).otherwise(0.0).alias("share"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: tuple = PHRASES, templates: tuple = TEMPLATES, least: float = LEAST_SHARE) -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score) of each text.

    n_base: places of the phrases, all their words in a row; first_word and last_word: the smallest and largest of them, else null.
    labels: those of the phrases and of the templates of which a copy with ``least`` of the k-grams was found; score: the best copy's
    share. A null text is empty; empty texts have no words and no labels. Repeated rows and null keys stay; other columns are left out;
    an empty table gives no rows. Of equal copies each counts.
    """
    every = (*phrases, *templates)
    found = stage(hits(docs, every, key, text), "licences-hits")
    label = F.element_at(F.lit([x for _, x in every]), F.col("template") + 1)
    c = copies(found).withColumns({"label": label, "base": F.col("template") < len(phrases)})
    base, good = F.col("base") & (F.col("places") > 0), F.when(F.col("base"), F.col("places") > 0).otherwise(F.col("share") >= least)
    of = c.groupBy("row").agg(
        F.sum(F.when(base, F.col("places"))).alias("n_base"), F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("last"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(good, F.col("label")))), ",").alias("labels"), F.max("share").alias("score"))
    texts = found.where("template is null").select("row", "key", "n_words")
    return texts.join(of, "row", "left").select(
        F.col("key").alias(key), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
