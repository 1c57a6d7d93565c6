r"""Licence scans by diagonal voting, in built-in functions only.

A text's words (A-Z lower-cased, `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`) are numbered from 0. Each rolling
word k-gram is hashed and joined to the template places with that hash. A hit at word i of the text
and word j of the template votes for diagonal i - j. Votes are aggregated by (row, template,
diagonal) before they move. Then:

* a phrase (k = its number of words, 3 at most by two overlapping 2-grams) is present on a diagonal that has all its votes:
  that diagonal is the word where it starts, so every place counts;
* for a longer template, diagonals at most `DRIFT` apart whose spans touch are merged, as words may be
  missing or added, and the merged span is verified: its distinct template places must cover
  `LEAST_COVER` of the template's k-grams. Its score is that share.

Hits are verified word by word, so equal hashes of other words do not count. The templates are fixed and small, so
their table is broadcast with a known bound.

Defined cases: a null text is empty and has no words; without hits first_word and last_word are null,
labels are empty strings and the score 0. Repeated rows are rows of their own. Extra columns are not
touched; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Short notices as commonly printed in files, by label.
NOTICES = {
    "apache-2.0": ["licensed under the apache license version 2 0"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "cc-by": ["this work is licensed under a creative commons attribution 4 0 international license"],
    "cc-by-nc": ["licensed under cc by nc 4 0"],
    "gpl": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"],
    "gpl-3.0": ["this work is licensed under the gnu general public license version 3"],
    "mit": ["released under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
}
BASE_K, NOTICE_K, DRIFT, LEAST_COVER = 2, 3, 3, 0.6


def template_grams(phrases: dict[str, str] = PHRASES, notices: dict[str, list[str]] = NOTICES) -> list[tuple]:
    """(k, words of the gram, template, place, grams in the template, words in it, label, is base)."""
    rows, n = [], 0
    for k, base, entries in ((BASE_K, True, [(label, text) for text, label in phrases.items()]), (NOTICE_K, False, [(label, t) for label, texts in notices.items() for t in texts])):
        for label, text in entries:
            words = re.findall(WORDS, text)
            if len(words) < k:
                raise ValueError(f"{text!r} has under {k} words")
            rows += [(k, words[j : j + k], n, j, len(words) - k + 1, len(words), label, base) for j in range(len(words) - k + 1)]
            n += 1
    return rows


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: dict[str, str] = PHRASES, notices: dict[str, list[str]] = NOTICES) -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of every row."""
    spark = docs.sparkSession
    grams = spark.createDataFrame(template_grams(phrases, notices), "k int, gram array<string>, template int, place int, grams int, size int, label string, base boolean")
    side = {}
    for k in (BASE_K, NOTICE_K):
        hashed = F.xxhash64(*[F.col("gram")[i] for i in range(k)])
        hit = F.struct("template", "place", "grams", "size", "label", "base", "gram")
        side[k] = F.broadcast(grams.where(F.col("k") == k).groupBy(hashed.alias(f"h{k}")).agg(F.collect_list(hit).alias(f"t{k}")))

    # Row 0 of each text is a header that carries the number of words; word i is row i + 1.
    words = F.regexp_extract_all(ascii_lower(F.coalesce(F.col(text), F.lit(""))), F.lit(WORDS), F.lit(0))
    own = docs.select(F.col(key), F.xxhash64(text).alias("_row"), words.alias("w"))
    rows = own.select(key, "_row", "w", F.posexplode(F.concat(F.array(F.lit("")), F.col("w"))).alias("p", "word"))
    at = lambda i: F.get(F.col("w"), F.col("p") + (i - 1))
    for k in (BASE_K, NOTICE_K):
        inside = (F.col("p") > 0) & (F.col("p") + k - 1 <= F.size("w"))
        h = F.when(inside, F.xxhash64("word", *[at(i) for i in range(1, k)]))
        rows = rows.join(side[k], h == F.col(f"h{k}"), "left")
    rows = rows.where((F.col("p") == 0) | F.col(f"t{BASE_K}").isNotNull() | F.col(f"t{NOTICE_K}").isNotNull())
    none = F.array().cast("array<struct<template:int,place:int,grams:int,size:int,label:string,base:boolean,gram:array<string>>>")
    hits = F.concat(F.coalesce(f"t{BASE_K}", none), F.coalesce(f"t{NOTICE_K}", none))
    hits = F.filter(hits, lambda t: t["gram"] == F.slice("w", F.greatest(F.col("p"), F.lit(1)), F.size(t["gram"])))
    votes = rows.select(key, "_row", F.when(F.col("p") == 0, F.size("w")).alias("n"), (F.col("p") - 1).alias("i"), F.explode_outer(hits).alias("t"))
    votes = votes.select(key, "_row", "n", "i", "t.template", "t.place", "t.grams", "t.size", "t.label", "t.base", (F.col("i") - F.col("t.place")).alias("diagonal"))

    # A header's row counts the copies of a row; votes are sets of places, so copies vote once.
    by = votes.groupBy(key, "_row", "template", "diagonal").agg(
        F.max("n").alias("n"), F.count("n").alias("copies"), F.first("grams", True).alias("grams"), F.first("size", True).alias("size"), F.first("label", True).alias("label"), F.first("base", True).alias("base"), F.collect_set("place").alias("places"), F.min("i").alias("lo"), F.max("i").alias("hi")
    )
    spot = F.struct("template", "diagonal", "lo", "hi", "grams", "size", "label", "base", "places")
    found = by.groupBy(key, "_row").agg(
        F.max("n").cast("long").alias("n_words"),
        F.max("copies").alias("copies"),
        F.sort_array(F.collect_list(F.when(F.col("base") & (F.size("places") == F.col("grams")), F.struct("diagonal", "label")))).alias("base"),
        F.sort_array(F.collect_list(F.when(~F.col("base"), spot))).alias("spots"),
    )
    # Merge neighbouring diagonals: spots come sorted by template and diagonal.
    empty = F.array().cast("array<struct<template:int,diagonal:int,lo:int,hi:int,grams:int,size:int,label:string,places:array<int>>>")

    def join(done, s):
        last = F.element_at(done, -1)
        touches = (F.size(done) > 0) & (last["template"] == s["template"]) & (s["diagonal"] - last["diagonal"] <= DRIFT) & (s["lo"] <= last["hi"] + s["size"]) & (last["lo"] <= s["hi"] + s["size"])
        plain = F.struct(s["template"].alias("template"), s["diagonal"].alias("diagonal"), s["lo"].alias("lo"), s["hi"].alias("hi"), s["grams"].alias("grams"), s["size"].alias("size"), s["label"].alias("label"), s["places"].alias("places"))
        merged = F.struct(s["template"].alias("template"), s["diagonal"].alias("diagonal"), F.least(last["lo"], s["lo"]).alias("lo"), F.greatest(last["hi"], s["hi"]).alias("hi"), s["grams"].alias("grams"), s["size"].alias("size"), s["label"].alias("label"), F.array_union(last["places"], s["places"]).alias("places"))
        return F.when(touches, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(merged))).otherwise(F.concat(done, F.array(plain)))

    spans = F.when(F.size("spots") == 0, empty).otherwise(F.aggregate("spots", empty, join))
    cover = lambda s: F.size(s["places"]) / s["grams"]
    spans = F.filter(spans, lambda s: cover(s) >= LEAST_COVER)
    found = found.withColumn("spans", F.transform(spans, lambda s: F.struct(s["label"].alias("label"), s["lo"].cast("long").alias("first"), (s["hi"] + NOTICE_K - 1).cast("long").alias("last"), cover(s).alias("cover"))))
    labels = lambda *arrays: F.array_join(F.array_sort(F.array_distinct(F.concat(*arrays))), ",")
    base = F.transform("base", lambda b: b["label"])
    out = found.select(
        key,
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["diagonal"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda b: b["diagonal"])).cast("long").alias("last_word"),
        labels(base).alias("base_labels"),
        labels(base, F.transform("spans", lambda s: s["label"])).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0))).alias("score"),
        "spans",
        "copies",
    )
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies", "_copy")
