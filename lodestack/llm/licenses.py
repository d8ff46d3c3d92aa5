"""Operator 10, license scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

Built from DataFrame functions only. A text becomes lower-case words (runs of letters and digits) and 64-bit hashes of its
five-word shingles; a join with the table of all templates' shingles leaves the places of those that some template has.
Templates are classed by length (each class up to a quarter longer than its shortest). For a class, windows begin every half of its
shortest length and are so wide that any run of up to twice its longest length lies whole in one of them, at whatever offset. A window
is the set of its shingles that templates of the class have; others no template of the class can share, so that leaving them out only raises
its similarity with each. A window and a template that share one of the class's bands (the least of a permuted hash) are a
candidate pair. There are as many bands as keep the probability to miss below `miss` at the least Jaccard similarity that such a
window, with all its shingles, can have with a template of which it holds `least`.

A candidate is verified over the whole text: it matches if the text has at least 0.8 of the template's distinct shingles.
Reported is the shortest run of words, the first of several, that holds all of the template's shingles that the text
has. A notice stretched by insertions to more than twice its length may or may not be retrieved; its words are far apart then.

Templates are tables: their shingles and band keys are joined, broadcast while they have at most BROADCAST_ROWS rows (two numbers and a
name each) and shuffled beyond. Behind the first join only the places of known shingles are written and shuffled, by document, so that neither a
template that a third of all texts hold nor a long text makes a large group.

Defined results: a null text is an empty one; texts of fewer than five words match nothing; rows that share an id are
scanned one by one and reported together; several templates in a text give a row each; an empty table gives no rows; other columns
are ignored; a text of any length is one row's work; templates have five words or more and names of their own, and their table is a parameter of
bounded size, of which the driver sees names and lengths.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fan_out, written
from .quality import let

SHINGLE = 5
MOST_TEMPLATES = 5_000
#: Rows of a template table up to which it is broadcast.
BROADCAST_ROWS = 1_000_000

#: Notices as their licenses' publishers word them.
TEMPLATES = (
    ("mit-notice", "MIT", "Released under the MIT License."),
    ("mit-grant", "MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("apache-notice", "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-header", "Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl3-notice", "GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-header", "GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl-header", "LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd-clauses", "BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl2-header", "MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc-grant", "ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-nc-4-notice", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4-notice", "CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4-notice", "CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("unlicense", "Unlicense", "This is free and unencumbered software released into the public domain."),
)


def words_column(text: Column) -> Column:
    w = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+")
    return F.filter(w, lambda x: x != "")


def shingles(words: Column) -> Column:
    n = F.size(words)
    return F.when(n >= SHINGLE, F.transform(F.sequence(F.lit(1), n - (SHINGLE - 1)), lambda i: F.xxhash64(F.slice(words, i, SHINGLE)))).otherwise(F.array().cast("array<bigint>"))


def words_of_template(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def bands_of(sizes: list[int], width: int, least: float, miss: float) -> int:
    """Bands of one MinHash each that miss with a probability under `miss`, for templates of these numbers of shingles.

    A window of `width` shingles that holds `least` of a template's m shares need of at most width + m - need.
    """
    worst = min(math.ceil(least * m) / (width + m - math.ceil(least * m)) for m in sizes)
    return 1 if worst >= 1 else math.ceil(math.log(miss) / math.log(1 - worst))


def layout(lengths: dict[str, tuple[int, int]], least: float, miss: float) -> list[tuple[list[str], int, int, int]]:
    """template -> (words, distinct shingles) to (templates, stride, width, bands) of each class of lengths."""
    classes: dict[int, list[str]] = {}
    for name, (n, _) in lengths.items():
        classes.setdefault(math.floor(math.log(n / SHINGLE) / math.log(1.25) + 1e-9), []).append(name)
    out = []
    for names in classes.values():
        words = [lengths[t][0] for t in names]
        stride = max(1, min(words) // 2)
        width = 2 * max(words) - SHINGLE + stride
        out.append((names, stride, width, bands_of([lengths[t][1] for t in names], width, least, miss)))
    return out


def bands_for(templates: tuple, least: float, miss: float) -> int:
    """The most bands of any class."""
    words = {name: words_of_template(text) for name, _, text in templates}
    lengths = {name: (len(w), len({tuple(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)})) for name, w in words.items()}
    return max(n for *_, n in layout(lengths, least, miss))


def signature(hashes: Column, bands: Column) -> Column:
    """The least of each band's permuted hashes, hashed with the band's number."""
    return F.transform(F.sequence(F.lit(1), bands), lambda k: F.xxhash64(k, F.array_min(F.transform(hashes, lambda x: F.xxhash64(x, k)))))


def table_of(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """rows as a table: one literal, whatever their number."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{ddl}>>")))


def template_table(spark: SparkSession, templates: tuple) -> DataFrame:
    """(template, license, length in words, distinct shingle hashes)."""
    if len(templates) > MOST_TEMPLATES or len({name for name, _, _ in templates}) < len(templates) or any(len(words_of_template(t)) < SHINGLE for _, _, t in templates):
        raise ValueError(f"at most {MOST_TEMPLATES} templates, of {SHINGLE} words or more and names of their own")
    texts = table_of(spark, [{"template": a, "license": b, "text": c} for a, b, c in templates], "template string, license string, text string")
    words = texts.withColumn("words", words_column(F.col("text")))
    return words.select("template", "license", F.size("words").alias("length"), let(F.col("words"), lambda w: F.array_distinct(shingles(w))).alias("hashes"))


def hinted(rows: DataFrame, n: int) -> DataFrame:
    """A table of n rows to be joined: broadcast if it is small."""
    return F.broadcast(rows) if n <= BROADCAST_ROWS else rows


def shortest(places: Column, m: Column) -> Column:
    """(n_words, first_word) of the shortest run that holds every shingle of places: sorted (at, shingle), at from 1.

    Where no shingle comes twice, that is the run from the first to the last.
    """
    held = F.transform(places, lambda p: p["shingle"])
    ends = F.get(places, F.size(places) - 1)["at"], F.get(places, F.lit(0))["at"]
    whole = F.struct((ends[0] - ends[1] + SHINGLE).alias("n_words"), (ends[1] - 1).alias("first_word"))
    last = let(F.array_distinct(held), lambda h: F.transform(F.sequence(F.lit(0), m - 1), lambda j: F.when(F.array_contains(h, j), 0)))
    none = F.struct(F.lit(2**31 - 1).alias("n_words"), F.lit(0).alias("first_word"))

    def step(state: Column, p: Column) -> Column:
        seen = F.transform(state["last"], lambda v, j: F.when(j == p["shingle"], p["at"]).otherwise(v))
        start = F.array_min(seen)  # 0 until every shingle has come
        run = F.struct((p["at"] - start + SHINGLE).alias("n_words"), (start - 1).alias("first_word"))
        return let(F.struct(seen.alias("seen"), start.alias("start"), run.alias("run")), lambda x: F.struct(x["seen"].alias("last"), F.when((x["start"] > 0) & (x["run"]["n_words"] < state["best"]["n_words"]), x["run"]).otherwise(state["best"]).alias("best")))

    swept = F.aggregate(places, F.struct(last.alias("last"), none.alias("best")), step, lambda state: state["best"])
    return F.when(F.size(F.array_distinct(held)) == F.size(held), whole).otherwise(swept)


def scan(docs: DataFrame, templates: tuple = TEMPLATES, least: float = 0.8, miss: float = 1e-6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, template, license, containment and the words (first_word, n_words) that hold the most."""
    spark = docs.sparkSession
    known = written(template_table(spark, templates))
    told = {r["template"]: (r["length"], r["m"]) for r in known.select("template", "length", F.size("hashes").alias("m")).collect()}  # at most MOST_TEMPLATES
    classes = [{"template": t, "class": c, "stride": stride, "width": width, "bands": n} for c, (names, stride, width, n) in enumerate(layout(told, least, miss)) for t in names]
    classed = known.join(F.broadcast(table_of(spark, classes, "template string, class int, stride int, width int, bands int")), "template")
    n_shingles = sum(m for _, m in told.values())
    index = written(classed.select("template", "license", "class", "stride", "width", F.size("hashes").alias("m"), F.posexplode("hashes").alias("shingle", "hash")))
    signed = written(classed.select("class", "template", F.explode(signature(F.col("hashes"), F.col("bands"))).alias("key")))
    layouts = table_of(spark, list({c["class"]: {k: c[k] for k in ("class", "bands")} for c in classes}.values()), "class int, bands int")

    # The outer form keeps Spark from inferring a filter on the hashes, which would compute them twice.
    words = let(words_column(F.col(text_col)), shingles)
    texts = docs.select(F.col(id_col).alias("__id"), F.xxhash64(F.col(text_col)).alias("__row"), F.posexplode_outer(words).alias("at", "hash"))
    places = written(texts.join(hinted(index.select("hash").distinct(), n_shingles), "hash", "left_semi"))

    # at lies in the windows that begin at stride * k for each k from the first to the last.
    first = F.greatest(F.lit(0), F.ceil((F.col("at") - F.col("width") + 1) / F.col("stride")).cast("int"))
    covering = F.explode(F.sequence(first, F.floor(F.col("at") / F.col("stride")).cast("int"))).alias("window")
    in_class = places.join(hinted(index.select("hash", "class", "stride", "width").distinct(), n_shingles), "hash").select("__id", "__row", "class", covering, "hash")
    windows = in_class.groupBy("__id", "__row", "class", "window").agg(F.sort_array(F.collect_set("hash")).alias("hashes"))
    # Windows of a text that hold the same shingles are one. Their bands are most of the work, so they are dealt evenly.
    each = ["__id", "__row", "class", "hashes"]
    windows = windows.select(*each).repartition(fan_out(docs), *each).distinct().join(F.broadcast(layouts), "class")
    keys = windows.select("__id", "__row", "class", F.explode(signature(F.col("hashes"), F.col("bands"))).alias("key"))
    pairs = keys.join(hinted(signed, sum(c["bands"] for c in classes)), ["class", "key"]).select(F.col("__id").alias("__of"), F.col("__row").alias("__in"), "template").distinct()

    both = places.join(pairs, F.col("__id").eqNullSafe(F.col("__of")) & (F.col("__row") == F.col("__in")))
    shared = both.join(hinted(index.select("template", "license", "m", "shingle", "hash"), n_shingles), ["template", "hash"])
    met = shared.groupBy("__id", "__row", "template").agg(F.first("license").alias("license"), F.first("m").alias("m"), F.collect_set(F.struct((F.col("at") + 1).alias("at"), "shingle")).alias("places"))
    held = met.withColumn("containment", F.size(F.array_distinct(F.transform("places", lambda p: p["shingle"]))) / F.col("m")).where(F.col("containment") >= least)
    runs = held.select("__id", "template", "license", "containment", shortest(F.sort_array("places"), F.col("m")).alias("run"))
    best = F.struct(F.col("containment"), (-F.col("run.first_word")).alias("before"), (-F.col("run.n_words")).alias("words"), F.col("license").alias("license"))
    found = runs.groupBy("__id", "template").agg(F.max(best).alias("b"))
    return found.select(F.col("__id").alias(id_col), "template", F.col("b.license").alias("license"), F.col("b.containment").alias("containment"), (-F.col("b.before")).cast("long").alias("first_word"), (-F.col("b.words")).cast("long").alias("n_words"))
