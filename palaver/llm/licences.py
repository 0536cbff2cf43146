"""Operator 2: licence scan by Dice coefficient over word bigrams, with DataFrame functions only.

A text is compared as a whole, by paragraphs (if it has blank lines) and by lines. Each unit is normalised (lower case, words of letters and
digits) and becomes its set of word bigrams. With ``m`` and ``n`` bigrams the coefficient is at most ``2 min(m, n) / (m + n)``, so a template can
reach ``t`` only if ``t n / (2 - t) <= m <= n (2 - t) / t``; units outside every template's bounds build no bigrams at all, and
those that share no bigram with any template end there. All of it happens inside the row: no shuffle, whatever the skew.

Defined cases: a null text has no units; a unit of one word has no bigrams and matches nothing; equal coefficients go to the template that
sorts first; repeated rows give repeated results; an empty table gives no rows; templates are a few fixed texts of the call.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 0.8
WORD = r"[\p{L}\p{N}]+"

#: Fixed texts: notices and short licences by name.
TEMPLATES = {
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "All-Rights-Reserved": "All rights reserved.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def bigrams(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def normalised(text: str) -> list[str]:
    """Words of a template: runs of letters and digits in lower case."""
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def size_bounds(n: int, least: float) -> tuple[float, float]:
    """Sizes of bigram sets that can reach ``least`` with one of size ``n``."""
    return n * least / (2 - least) - 1e-9, n * (2 - least) / least + 1e-9


def bigram_set(words: Column) -> Column:
    shorter = F.greatest(F.size(words) - 1, F.lit(0))
    return F.array_distinct(F.zip_with(F.slice(words, F.lit(1), shorter), F.slice(words, F.lit(2), shorter), lambda a, b: F.concat(a, F.lit(" "), b)))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, unit, place, licence, dice): the best template of each unit that reaches ``least``; unit is text, paragraph or line."""
    sets = {name: bigrams(normalised(text)) for name, text in sorted(templates.items())}
    bounds = {name: size_bounds(len(s), least) for name, s in sets.items()}
    fewest = min(low for low, _ in bounds.values())
    text = F.col("text")
    struct = lambda kind: lambda t, i: F.struct(F.lit(kind).alias("unit"), i.alias("place"), t.alias("body"))
    units = F.concat(
        F.transform(F.array(text), struct("text")),
        F.transform(F.when(F.regexp_like(text, F.lit(r"\n[ \t\r]*\n")), F.split(text, r"\n[ \t\r]*\n")).otherwise(F.array().cast("array<string>")), struct("paragraph")),
        F.transform(F.when(text.contains("\n"), F.split(text, "\n")).otherwise(F.array().cast("array<string>")), struct("line")),
    )
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    split = rows.select("doc_id", F.explode(units).alias("u")).select("doc_id", "u.unit", "u.place", F.regexp_extract_all(F.lower("u.body"), F.lit(WORD), F.lit(0)).alias("w"))
    # More words than any template allows may still be a small set, so only the lower bound is read off the number of words.
    sized = split.filter(F.size("w") - 1 >= fewest).withColumn("grams", bigram_set(F.col("w"))).drop("w").withColumn("m", F.size("grams"))
    fits = None
    for low, high in sorted(set(bounds.values())):
        within = F.col("m").between(low, high)
        fits = within if fits is None else fits | within
    every = F.array(*[F.lit(g) for g in sorted({g for s in sets.values() for g in s})])
    near = sized.filter(fits).filter(F.arrays_overlap("grams", every))
    scores = F.array(*[
        F.struct(
            F.when(F.col("m").between(*bounds[name]), 2 * F.size(F.array_intersect("grams", F.array(*map(F.lit, s)))) / (F.col("m") + len(s))).otherwise(F.lit(0.0)).alias("dice"),
            F.lit(-i).alias("first"),
            F.lit(name).alias("licence"),
        )
        for i, (name, s) in enumerate(sets.items())
    ])
    return near.withColumn("best", F.array_max(scores)).filter(F.col("best.dice") >= least).select("doc_id", "unit", "place", "best.licence", F.round("best.dice", 6).alias("dice"))


def _sql() -> str:
    values = ", ".join(f"('{name}', '{text.replace(chr(39), chr(39) * 2)}')" for name, text in sorted(TEMPLATES.items()))
    grams = "list_distinct(list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]))"
    return rf"""
WITH t AS (SELECT name, regexp_extract_all(lower(body), '{WORD}') AS w FROM (VALUES {values}) v(name, body)),
tg AS (SELECT name, {grams.format(w="w")} AS g FROM t),
u AS (SELECT doc_id, 'text' AS unit, 0 AS place, text AS body FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT doc_id, 'paragraph', unnest(range(len(p))), unnest(p) FROM (SELECT doc_id, regexp_split_to_array(text, '\n[ \t\r]*\n') AS p FROM documents) WHERE len(p) > 1
  UNION ALL SELECT doc_id, 'line', unnest(range(len(p))), unnest(p) FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents) WHERE len(p) > 1),
x AS (SELECT doc_id, unit, place, regexp_extract_all(lower(body), '{WORD}') AS w FROM u),
y AS (SELECT doc_id, unit, place, {grams.format(w="w")} AS g FROM x WHERE len(w) > 1),
s AS (SELECT doc_id, unit, place, name AS licence, 2.0 * len(list_intersect(y.g, tg.g)) / (len(y.g) + len(tg.g)) AS dice
  FROM y JOIN tg ON len(y.g) <= 2 * len(tg.g) AND len(tg.g) <= 2 * len(y.g) AND list_has_any(y.g, tg.g))
SELECT doc_id, unit, CAST(place AS INTEGER) AS place, licence, round(dice, 6) AS dice FROM s WHERE dice >= {LEAST}
QUALIFY row_number() OVER (PARTITION BY doc_id, unit, place ORDER BY dice DESC, licence) = 1
"""


SQL = _sql()
