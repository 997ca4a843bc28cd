"""Licence notices in texts: normalised passages compared to templates by the Dice coefficient of their word bigrams.

**Passages** are the lines of a text, and the whole text where it has several lines. They are put in lower case and all but a-z and 0-9 parts words.

**Pruning.** 2 * common / (a + b) >= t asks that the sizes are within t / (2 - t) of each other, and that of a template's b bigrams at
least one of any b - m + 1 is found, m being the fewest common bigrams at the smallest size allowed. Those with the longest words are chosen. A
text in which no chosen bigram's two words stand anywhere is left at once; a passage goes on only if the same holds for it, its size fits
some template and it holds a chosen bigram. A template is compared only where its own size bound fits.

All is done within the row: nothing is shuffled, and neither repeated texts nor a frequent licence make a large group. The templates
are part of the plan; their number is checked.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: fixed values: published short notices and grants of common licences
TEMPLATES = {
    "MIT": ("Released under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
            "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
            "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
            "subject to the following conditions:"),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
                "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "BSD": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("Released under CC0 1.0 Universal.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
MOST_TEMPLATES = 500
LEAST_DICE = 0.8


def normal_words(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))).split()


def bigrams(words: list[str]) -> set[str]:
    return {f"{a} {b}" for a, b in zip(words, words[1:])}


def scan_licenses(df: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, least: float = LEAST_DICE,
                  id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_notices, licenses, license, dice, line), one row per row of ``df``.

    ``n_notices`` counts passages that reach ``least`` with some template, ``licenses`` lists their best ones, sorted and distinct. ``license``, ``dice``
    and ``line`` (from 1; 0 is the whole text) are those of the best passage: highest Dice, then the earliest line, then the smallest name. They are
    null where there is no notice, as for null and empty texts. Templates of a single word are an error: they have no bigram.
    """
    forms = [(name, bigrams(normal_words(t))) for name, texts in (TEMPLATES if templates is None else templates).items() for t in texts]
    if len(forms) > MOST_TEMPLATES or not all(g for _, g in forms):
        raise ValueError(f"from one to {MOST_TEMPLATES} templates of two words and more are asked for")
    rows = df.select(F.col(id_column), F.col(text_column).cast("string").alias("text"))
    if not forms:
        rows = rows.withColumn("notices", F.array().cast(NOTICES))
    else:
        lowest = min(math.ceil(len(g) * least / (2 - least) - 1e-9) for _, g in forms)
        chosen = sorted(_chosen(forms, least))
        lines = F.split(F.coalesce("text", F.lit("")), "\n")
        whole = F.when(F.size("lines") > 1, F.array(F.col("text"))).otherwise(F.array().cast("array<string>"))
        rows = (rows.withColumn("may", _may_hold(F.lower("text"), chosen))
                .withColumn("lines", F.when(F.col("may"), lines).otherwise(F.array().cast("array<string>")))
                .withColumn("passages", F.filter(F.transform(F.concat(whole, "lines"), lambda x, i: F.struct(
                    (i + F.when(F.size("lines") > 1, 0).otherwise(1)).alias("line"), F.lower(x).alias("text"))), lambda p: _may_hold(p["text"], chosen)))
                .withColumn("passages", F.transform("passages", lambda p: F.struct(p["line"].alias("line"), _words(p["text"]).alias("words"))))
                .withColumn("passages", F.filter("passages", lambda p: F.size(p["words"]) > lowest))
                .withColumn("passages", F.transform("passages", lambda p: F.struct(p["line"].alias("line"), _bigrams(p["words"]).alias("grams"))))
                .withColumn("passages", F.filter("passages", lambda p: F.arrays_overlap(p["grams"], _texts(chosen))))
                .withColumn("notices", F.filter(F.transform("passages", lambda p: _best(p, forms, least)), lambda b: b.isNotNull())))
    # array_max takes the highest Dice, then the earliest line
    best = F.array_max(F.transform("notices", lambda n: F.struct(n["dice"].alias("dice"), (-n["line"]).alias("back"), n["license"].alias("license"))))
    return rows.withColumn("best", best).select(
        id_column, F.size("notices").cast("bigint").alias("n_notices"), F.array_sort(F.array_distinct(F.transform("notices", lambda n: n["license"]))).alias("licenses"),
        F.col("best.license").alias("license"), F.col("best.dice").alias("dice"), (-F.col("best.back")).alias("line"))


NOTICES = "array<struct<line:int,license:string,dice:double>>"


def _long_word(gram: str) -> str:
    return max(gram.split(), key=len)


def _chosen(forms: list[tuple[str, set[str]]], least: float) -> set[str]:
    """Bigrams of which a passage that reaches ``least`` with any template holds one."""
    out = set()
    for _, grams in forms:
        b = len(grams)
        smallest = math.ceil(b * least / (2 - least) - 1e-9)
        common = math.ceil(least * (smallest + b) / 2 - 1e-9)
        out |= set(sorted(grams, key=lambda g: (-len(_long_word(g)), -len(g), g))[:b - common + 1])
    return out


def _texts(values) -> Column:
    return F.array(*map(F.lit, values))


def _may_hold(text: Column, chosen: list[str]) -> Column:
    """A cheap test that no passage with a chosen bigram fails: both words stand somewhere in it."""
    beside: dict[str, set[str]] = {}
    for gram in chosen:
        a, b = gram.split()
        long = _long_word(gram)
        beside.setdefault(long, set()).add(b if long == a else a)
    tests = [F.contains(text, F.lit(w)) & reduce(or_, (F.contains(text, F.lit(x)) for x in sorted(others, key=lambda x: (len(x), x))))
             for w, others in sorted(beside.items())]
    return F.coalesce(reduce(or_, tests), F.lit(False))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, "[^a-z0-9]+"), lambda w: w != "")


def _bigrams(words: Column) -> Column:
    return F.array_distinct(F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1),
                                       lambda a, b: F.concat_ws(" ", a, b)))


def _best(passage: Column, forms: list[tuple[str, set[str]]], least: float) -> Column:
    """The best template for a passage, null if none reaches ``least``; among equals the smallest name."""
    grams, found = F.size(passage["grams"]), []
    for name, own in forms:
        b = len(own)
        fits = (grams >= math.ceil(b * least / (2 - least) - 1e-9)) & (grams <= math.floor(b * (2 - least) / least + 1e-9))
        dice = 2.0 * F.size(F.array_intersect(passage["grams"], _texts(sorted(own)))) / (grams + b)
        found.append(F.when(fits & (dice >= least - 1e-12), F.struct((-dice).alias("under"), F.lit(name).alias("license"))))
    best = F.array_min(F.filter(F.array(*found), lambda x: x.isNotNull()))
    return F.when(best.isNotNull(), F.struct(passage["line"].alias("line"), best["license"].alias("license"), (-best["under"]).alias("dice")))


def op10_license_scans(spark: SparkSession, sf: str) -> DataFrame:
    """The scan with flat columns: licenses joined by commas, dice 0 and line -1 where there is no notice."""
    return scan_licenses(spark.read.parquet(f"{sf}/documents.parquet")).select(
        "doc_id", "n_notices", F.array_join("licenses", ",").alias("licenses"), "license", F.coalesce("dice", F.lit(0.0)).alias("dice"),
        F.coalesce("line", F.lit(-1)).cast("bigint").alias("line"))


def _sql() -> str:
    forms = [(name, bigrams(normal_words(t))) for name, texts in TEMPLATES.items() for t in texts]
    values = ", ".join(f"('{n}', {sorted(g)!r})" for n, g in forms)
    return rf"""
WITH t(license, grams) AS (VALUES {values}),
d AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS text FROM documents),
l AS (SELECT row, i - (len(lines) > 1)::INT + (len(lines) = 1)::INT * 0 AS line, passages[i] AS passage FROM (
  SELECT row, lines, passages, unnest(range(1, len(passages) + 1)) AS i FROM (
    SELECT row, lines, CASE WHEN len(lines) > 1 THEN list_prepend(text, lines) ELSE lines END AS passages
    FROM (SELECT *, string_split(text, chr(10)) AS lines FROM d)))),
w AS (SELECT row, line, regexp_extract_all(lower(passage), '[a-z0-9]+') AS words FROM l WHERE regexp_matches(passage, '(?i)licen|permission|redistribution|cc0|software|form')),
g AS (SELECT row, line, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS grams FROM w WHERE len(words) > 1),
m AS (SELECT row, line, license, 2.0 * len(list_intersect(g.grams, t.grams)) / (len(g.grams) + len(t.grams)) AS dice FROM g, t),
n AS (SELECT row, line, max(dice) AS dice, arg_max(license, (dice, -ord_)) AS license FROM (
  SELECT *, rank() OVER (ORDER BY license) AS ord_ FROM m WHERE dice >= 0.8 - 1e-12) GROUP BY 1, 2),
b AS (SELECT row, count(*) AS n_notices, list_sort(list(DISTINCT license)) AS licenses, arg_max(license, (dice, -line)) AS license,
  max(dice) AS dice, arg_max(line, (dice, -line)) AS line FROM n GROUP BY 1)
SELECT doc_id, coalesce(n_notices, 0)::BIGINT AS n_notices, coalesce(array_to_string(licenses, ','), '') AS licenses, license, coalesce(dice, 0)::DOUBLE AS dice, coalesce(line, -1)::BIGINT AS line
FROM d LEFT JOIN b USING (row)
"""


OP10_SQL = _sql()
