"""Licence scan: text units compared with licence templates by Dice's coefficient over word bigrams.

Units of a document are its lines, its paragraphs of several lines (between blank lines) and the whole text. A unit and a template are multisets of
bigrams of normalised words (lower case letters and digits; a point or hyphen inside a word stays, as in 2.0 or by-nc), and

    dice = 2 * shared / (bigrams of the unit + bigrams of the template)

A coefficient of at least t needs sizes within a factor of t / (2 - t), so a unit only meets templates of such sizes, and a unit of a size
that fits no template is not taken apart. Bigrams of the others meet the templates' bigrams in a join against a table whose size is that of the templates, a
parameter; what no template holds ends there, before any shuffle.

Only DataFrame operations. Defined results. A null or empty text has no match. A unit of one word has that word as its only bigram. Per unit the best
template is returned, ties go to the smaller name. Repeated rows are reported one by one. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlens.functions.columns import constant_rows

MOST_BROADCAST = 4_000_000  # characters of all templates
WORD = r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"

# Wording of public licences and notices, by name; further wordings of one licence after a slash.
TEMPLATES = {
    "MIT/notice": "Released under the MIT License.",
    "MIT/grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "MIT/condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0/notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "GPL-3.0/notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0/header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version."
    ),
    "GPL-2.0/header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; "
        "either version 2 of the License, or (at your option) any later version."
    ),
    "ISC/grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies."
    ),
    "BSD/grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "MPL-2.0/header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "https://mozilla.org/MPL/2.0/."
    ),
    "Unlicense/grant": "This is free and unencumbered software released into the public domain.",
    "CC-BY-4.0/notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0/notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0/notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0/short": "Licensed under CC BY 4.0.",
    "all-rights-reserved/notice": "All rights reserved.",
}


def bigrams(text: Column) -> Column:
    """The bigrams of a text in order, with repeats; a single word stands for itself."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(words) == 1, words).otherwise(F.filter(pairs, lambda p: p.contains(" ")))


def _template_rows(documents: DataFrame, templates: Mapping[str, str]) -> DataFrame:
    given = constant_rows([{"template": n, "wording": t} for n, t in sorted(templates.items())], "template string, wording string")
    made = documents.sparkSession.range(1).select(F.inline(given))
    counted = made.select("template", F.explode(bigrams(F.col("wording"))).alias("bigram")).groupBy("template", "bigram").agg(F.count(F.lit(1)).alias("in_template"))
    sizes = counted.groupBy("template").agg(F.sum("in_template").alias("template_size"))
    known = counted.join(sizes, "template")
    # Spark broadcasts this table, which is about as large as the templates; beyond the limit it is merged instead.
    return known if sum(map(len, templates.values())) <= MOST_BROADCAST else known.hint("merge")


def units(documents: DataFrame, row_id: str, text: str) -> DataFrame:
    """(row_id, row, unit, content): units 1, 2, ... are lines; -1, -2, ... paragraphs of several lines; 0 the whole text of several lines."""
    t = F.coalesce(F.col(text), F.lit(""))
    many = F.contains(t, F.lit("\n"))
    entry = lambda number, content: F.struct(number.cast("int").alias("unit"), content.alias("content"))
    lines = F.transform(F.split(t, "\n"), lambda x, i: entry(i + 1, x))
    blocks = F.split(t, r"\n[ \t\r]*\n")
    nothing = F.array().cast("array<struct<unit:int,content:string>>")
    paragraphs = F.when(F.size(blocks) > 1, F.filter(F.transform(blocks, lambda x, i: entry(-i - 1, x)), lambda e: F.contains(e["content"], F.lit("\n")))).otherwise(nothing)
    whole = F.when(many, F.array(entry(F.lit(0), t))).otherwise(nothing)
    numbered = documents.select(F.col(row_id).alias("row_id"), F.monotonically_increasing_id().alias("row"), F.concat(lines, paragraphs, whole).alias("parts"))
    return numbered.select("row_id", "row", F.explode("parts").alias("part")).select("row_id", "row", "part.*")


def scan(documents: DataFrame, row_id: str = "doc_id", text: str = "text", templates: Mapping[str, str] = TEMPLATES, least: float = 0.8) -> DataFrame:
    """(row_id, unit, licence, template, dice): the best template of each unit that has one of at least `least`."""
    known = _template_rows(documents, templates)
    ratio = least / (2 - least)
    low, high = known.agg(F.min("template_size") * F.lit(ratio), F.max("template_size") / F.lit(ratio)).first()
    size = F.greatest(F.regexp_count(F.col("content"), F.lit(WORD)) - 1, F.lit(1))
    fitting = units(documents, row_id, text).withColumn("unit_size", size).filter(F.col("unit_size").between(float(low or 0), float(high or 0)))
    pairs = fitting.select("row_id", "row", "unit", "unit_size", F.explode(bigrams(F.col("content"))).alias("bigram"))
    fits = (F.col("unit_size") >= F.col("template_size") * ratio - 1e-9) & (F.col("unit_size") <= F.col("template_size") / ratio + 1e-9)
    met = pairs.join(known, "bigram").filter(fits)
    shared = (
        met.groupBy("row_id", "row", "unit", "unit_size", "template", "template_size", "bigram", "in_template").agg(F.count(F.lit(1)).alias("in_unit"))
        .groupBy("row_id", "row", "unit", "unit_size", "template", "template_size").agg(F.sum(F.least("in_unit", "in_template")).alias("shared"))
    )
    dice = shared.withColumn("dice", 2 * F.col("shared") / (F.col("unit_size") + F.col("template_size"))).filter(F.col("dice") >= least - 1e-9)
    best = dice.groupBy("row_id", "row", "unit").agg(F.min(F.struct((-F.col("dice")).alias("order"), "template")).alias("best"))
    return best.select(F.col("row_id").alias(row_id), "unit", F.substring_index("best.template", "/", 1).alias("licence"), F.col("best.template").alias("template"), (-F.col("best.order")).alias("dice"))
