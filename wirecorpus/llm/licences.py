"""Licence notices by the Dice coefficient over word bigrams, in DataFrame functions alone.

A unit is a line of a text, or the whole text. Units and templates are lower-cased, and all but
letters and digits of ASCII becomes single spaces. The coefficient of two sets of bigrams is
2 * common / (size + size). Two bounds prune before any set is built:

* A unit that reaches the threshold t against a template of B bigrams has between t*B/(2-t) and
  B*(2-t)/t bigrams, so at least the lower number of words plus one.
* It then shares at least t*B/(2-t) of the template's bigrams, so of any B - that + 1 of them it has
  one. A text without one of these probes as a plain substring is done.

``passages`` also compares every run of words of the text, so a notice that is wrapped over lines or
stands inside a longer one is found. A run of the best coefficient begins and ends with a bigram of
the template, since leaving out another at an edge cannot lower it.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, functions as F

# The wording of common licence notices.
NOTICES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at"
    ),
    "bsd-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:"
    ),
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "mit": "Released under the MIT License.",
    "mit-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction'
    ),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def normal_words(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def bigram_set(text: str) -> list[str]:
    words = normal_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def probes(bigrams: list[str], threshold: float) -> list[str]:
    """So many of the bigrams, the longest, that a unit reaching the threshold has one of them."""
    needed = math.ceil(threshold * len(bigrams) / (2 - threshold) - 1e-9)
    return sorted(bigrams, key=lambda b: (-len(b), b))[: len(bigrams) - needed + 1]


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def _bigrams(normal: Column) -> Column:
    words = F.split(normal, " ")
    count = F.size(words) - 1
    return F.array_distinct(F.zip_with(
        F.slice(words, 1, count), F.slice(words, 2, count), lambda a, b: F.concat_ws(" ", a, b)))


def scan(
    docs: DataFrame, notices: dict[str, str] | None = None, threshold: float = 0.8,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(doc_id, hits, n_hits, licence, dice) of every row.

    ``hits`` are the matches (dice, licence, line), best first: line 0 is the whole text, others
    count from 1. ``n_hits`` counts the lines that match; ``licence`` and ``dice`` are the best
    match, of equals the first name, null where none. A null or empty text has no hits. Repeated
    rows give repeated rows. Nothing is shuffled and other columns are not read.
    """
    notices = NOTICES if notices is None else notices
    sets = {name: bigram_set(body) for name, body in sorted(notices.items())}
    if not sets or min(map(len, sets.values())) == 0 or not 0 < threshold <= 1:
        raise ValueError("templates need two words or more, and a threshold above 0")
    all_probes = sorted({p for bigrams in sets.values() for p in probes(bigrams, threshold)})
    fewest = min(math.ceil(threshold * len(b) / (2 - threshold) - 1e-9) for b in sets.values()) + 1

    def any_probe(normal: Column) -> Column:
        found = F.contains(normal, F.lit(all_probes[0]))
        for p in all_probes[1:]:
            found = found | F.contains(normal, F.lit(p))
        return found

    def matches(unit: Column) -> Column:
        """Matches of a unit (n: line, b: its bigrams)."""
        size = F.size(unit["b"])
        tried = []
        for name, bigrams in sets.items():
            low, high = threshold * len(bigrams) / (2 - threshold), len(bigrams) * (2 - threshold) / threshold
            template = F.array(*[F.lit(b) for b in bigrams])
            dice = F.lit(2.0) * F.size(F.array_intersect(unit["b"], template)) / (size + len(bigrams))
            fits = size.between(math.ceil(low - 1e-9), math.floor(high + 1e-9))
            tried.append(F.struct(
                F.when(fits, -dice).alias("less"), F.lit(name).alias("licence"), unit["n"].alias("line")))
        return F.filter(F.array(*tried), lambda m: m["less"] <= -threshold)

    lines = F.transform(
        F.split(F.col("_text"), "\n"),
        lambda line, at: F.struct((at + 1).alias("n"), _normal(line).alias("u")))
    units = F.concat(F.array(F.struct(F.lit(0).alias("n"), F.col("_flat").alias("u"))), lines)
    worth = F.filter(units, lambda u: (F.size(F.split(u["u"], " ")) >= fewest) & any_probe(u["u"]))
    bigrams = F.transform(worth, lambda u: F.struct(u["n"].alias("n"), _bigrams(u["u"]).alias("b")))
    hits = F.array_sort(F.flatten(F.transform(bigrams, matches)))
    none = F.array().cast("array<struct<less: double, licence: string, line: int>>")
    return (
        docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
        .withColumn("_flat", _normal(F.col("_text")))
        .withColumn("_hits", F.when(any_probe(F.col("_flat")), hits).otherwise(none))
        .select(
            "doc_id",
            F.transform("_hits", lambda h: F.struct(
                (-h["less"]).alias("dice"), h["licence"].alias("licence"), h["line"].alias("line"))).alias("hits"),
        )
        .select(
            "doc_id", "hits",
            F.size(F.array_distinct(F.transform(F.filter("hits", lambda h: h["line"] > 0), lambda h: h["line"])))
            .cast("long").alias("n_hits"),
            F.get("hits", F.lit(0))["licence"].alias("licence"), F.get("hits", F.lit(0))["dice"].alias("dice"),
        )
    )


def passages(
    docs: DataFrame, notices: dict[str, str] | None = None, threshold: float = 0.8,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(doc_id, passages, n_passages, licence, dice) of every row.

    A passage (dice, licence, start, words) is a run of words of the text, lines disregarded, that
    reaches the threshold; it has between t*B/(2-t) and B*(2-t)/t bigrams, repeated ones counted.
    ``start`` counts words from 1. Of the runs with one start the best counts, of equals the
    shortest; of runs of one template that overlap, left to right, the better, of equals the first.
    ``licence`` and ``dice`` are the best passage's. Nothing is shuffled; other columns are not read.
    """
    notices = NOTICES if notices is None else notices
    sets = {name: bigram_set(body) for name, body in sorted(notices.items())}
    if not sets or min(map(len, sets.values())) == 0 or not 0 < threshold <= 1:
        raise ValueError("templates need two words or more, and a threshold above 0")
    all_probes = sorted({p for bigrams in sets.values() for p in probes(bigrams, threshold)})
    all_bigrams = sorted({b for bigrams in sets.values() for b in bigrams})
    found = F.contains("_flat", F.lit(all_probes[0]))
    for p in all_probes[1:]:
        found = found | F.contains("_flat", F.lit(p))
    runs = "array<struct<less: double, words: int, start: int>>"

    def of_template(at: str, bigrams: list[str]) -> Column:
        """Runs of one template, from the places ``at`` of its bigrams."""
        needed = math.ceil(threshold * len(bigrams) / (2 - threshold) - 1e-9)
        most = math.floor(len(bigrams) * (2 - threshold) / threshold + 1e-9)
        template = F.array(*[F.lit(b) for b in bigrams])

        def best(first: Column, ends: Column) -> Column:
            cut = F.transform(ends, lambda end: F.struct(
                (end - first + 1).alias("n"),
                F.array_distinct(F.slice("_bigrams", first, end - first + 1)).alias("u")))
            return F.array_min(F.transform(cut, lambda c: F.struct(
                (-(F.lit(2.0) * F.size(F.array_intersect(c["u"], template)) / (F.size(c["u"]) + len(bigrams)))).alias("less"),
                (c["n"] + 1).alias("words"), first.alias("start"))))

        # a run with enough of the template holds the needed-th place from its start on
        begun = F.filter(
            F.transform(at, lambda first, k: F.struct(
                first.alias("a"), F.filter(F.slice(at, k + needed, most), lambda end: end - first < most).alias("ends"))),
            lambda x: F.size(x["ends"]) > 0)
        good = F.filter(F.transform(begun, lambda x: best(x["a"], x["ends"])), lambda m: m["less"] <= -threshold)

        def joined(done: Column, m: Column) -> Column:
            last = F.get(done, F.size(done) - 1)
            apart = last.isNull() | (m["start"] > last["start"] + last["words"] - 2)
            return (
                F.when(apart, F.concat(done, F.array(m)))
                .when(m["less"] < last["less"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(m)))
                .otherwise(done))

        return F.aggregate(good, F.array().cast(runs), joined)

    def places_of(bigrams: list[str]) -> Column:
        return F.transform(F.filter("_places", lambda x: x["b"].isin(bigrams)), lambda x: x["i"])

    def named(name: str, found: Column) -> Column:
        return F.transform(found, lambda m: F.struct(
            m["less"].alias("less"), F.lit(name).alias("licence"), m["start"].alias("start"), m["words"].alias("words")))

    words = F.split("_flat", " ")
    count = F.greatest(F.size(words) - 1, F.lit(0))
    staged = (
        docs.select(F.col(doc_id).alias("doc_id"), _normal(F.coalesce(F.col(text), F.lit(""))).alias("_flat"))
        .select("doc_id", F.when(found, F.zip_with(
            F.slice(words, 1, count), F.slice(words, 2, count), lambda a, b: F.concat_ws(" ", a, b))).alias("_bigrams"))
        .withColumn("_places", F.filter(
            F.transform("_bigrams", lambda b, i: F.struct((i + 1).alias("i"), b.alias("b"))),
            lambda x: x["b"].isin(all_bigrams)))
        .withColumns({
            f"_at{k}": places_of(bigrams) for k, bigrams in enumerate(sets.values())})
    )
    each = [named(name, of_template(f"_at{k}", bigrams)) for k, (name, bigrams) in enumerate(sets.items())]
    none = F.array().cast("array<struct<dice: double, licence: string, start: int, words: int>>")
    listed = F.transform(F.array_sort(F.concat(*each)), lambda m: F.struct(
        (-m["less"]).alias("dice"), m["licence"].alias("licence"), m["start"].alias("start"), m["words"].alias("words")))
    return staged.select("doc_id", F.coalesce(listed, none).alias("passages")).select(
        "doc_id", "passages", F.size("passages").cast("long").alias("n_passages"),
        F.get("passages", F.lit(0))["licence"].alias("licence"), F.get("passages", F.lit(0))["dice"].alias("dice"))


def oracle(notices: dict[str, str], threshold: float = 0.8) -> str:
    """(doc_id, n_hits, licence, dice) as one statement."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    templates = ", ".join(
        f"({quoted(name)}, [{', '.join(map(quoted, bigram_set(body)))}])" for name, body in sorted(notices.items()))
    return f"""
WITH templates(licence, tb) AS (VALUES {templates}),
texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body FROM documents),
units AS (
  SELECT r, 0 AS line, body AS u FROM texts
  UNION ALL
  SELECT r, generate_subscripts(string_split(body, chr(10)), 1) AS line, unnest(string_split(body, chr(10))) AS u FROM texts),
worded AS (SELECT r, line, string_split(trim(regexp_replace(lower(u), '[^a-z0-9]+', ' ', 'g'), ' '), ' ') AS w FROM units),
pairs AS (
  SELECT r, line, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN generate_series(1, len(w) - 1)]) AS ub
  FROM worded WHERE len(w) > 1),
scored AS (
  SELECT r, line, licence, 2.0::DOUBLE * len(list_intersect(ub, tb)) / (len(ub) + len(tb)) AS dice
  FROM pairs JOIN templates ON len(ub) BETWEEN floor({threshold} * len(tb) / (2 - {threshold})) AND ceil(len(tb) * (2 - {threshold}) / {threshold})),
hits AS (SELECT * FROM scored WHERE dice >= {threshold}),
best AS (
  SELECT r, count(DISTINCT CASE WHEN line > 0 THEN line END) AS n_hits,
         arg_min(licence, (-dice, licence, line)) AS licence, max(dice) AS dice
  FROM hits GROUP BY r)
SELECT t.doc_id, coalesce(b.n_hits, 0) AS n_hits, b.licence, b.dice
FROM texts t LEFT JOIN best b ON t.r = b.r"""
