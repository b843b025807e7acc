"""Licences in text: Dice coefficient over word bigrams against templates.

A unit of text, a line or a paragraph (lines between blank ones), is
normalised to words of a-z and 0-9. It matches a template if twice the shared
distinct bigrams are at least 0.8 of both sets together. Sets of sizes a and b
reach at most 2 * min / (a + b), so a unit meets only templates of a size near
its own, and a match has one of the words that most of a template's bigrams
hold, so texts and units without any are passed over. Bigrams of the templates, a fixed list, are looked up as the bigrams
of the units stream by; no pair of unit and template is formed that shares none.

Null and empty texts, and units of one word, have no bigram and match nothing.
Every row of the documents comes back, rows that repeat a doc_id and text alike.
Very long texts are cut into units whole. An empty table gives an empty table.
Other columns are not read, whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from recordloom.llm.common import documents, stored

DICE = 0.8
NO_WORD = "[^a-z0-9]+"

#: Notices as the licences themselves word them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"""),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), NO_WORD), "")


def bigrams(ws: Column) -> Column:
    """Distinct pairs of words that follow one another."""
    pairs = F.zip_with(F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(0))), F.slice(ws, 2, F.greatest(F.size(ws) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    return F.array_distinct(pairs)


def _size(text: str) -> int:
    ws = [w for w in re.split(NO_WORD, text.lower()) if w]
    return len(set(zip(ws, ws[1:], strict=False)))


def telling_words(text: str, least: float = DICE) -> list[str]:
    """Words of a template of which every match has one.

    A match shares at least least / (2 - least) of the template's bigrams, as it
    has no fewer than it shares. So words are taken, long ones first, until the
    bigrams without any of them are fewer than that.
    """
    ws = [w for w in re.split(NO_WORD, text.lower()) if w]
    left, out = set(zip(ws, ws[1:], strict=False)), []
    needed = len(left) * least / (2 - least)
    for w in sorted(set(ws), key=lambda w: (-len(w), w)):
        if len(left) < needed:
            break
        out.append(w)
        left = {b for b in left if w not in b}
    return out


def may_match(text: Column, templates=TEMPLATES, least: float = DICE) -> Column:
    """False only where no unit of the text can match a template."""
    telling = sorted({w for _, t in templates for w in telling_words(t, least)})
    return F.lower(text).rlike(f"(?<![a-z0-9])({'|'.join(telling)})(?![a-z0-9])")


def template_bigrams(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """(licence, template, size, b), a row a bigram."""
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("template"), F.lit(name).alias("licence"), F.lit(text).alias("text")) for k, (name, text) in enumerate(templates)]))
    sets = spark.range(1).select(rows.alias("t")).select("t.template", "t.licence", words(F.col("t.text")).alias("ws")).select("template", "licence", bigrams(F.col("ws")).alias("bs"))
    return sets.select("template", "licence", F.size("bs").alias("size"), F.explode("bs").alias("b"))


def matches(docs: DataFrame, templates=TEMPLATES, least: float = DICE) -> DataFrame:
    """(doc_id, th, kind, unit, licence, template, dice) of each unit and template that match.

    ``kind`` is line or paragraph, ``unit`` its number in the text from 0; a
    paragraph of one line is that line. ``th`` is a hash of the text.
    """
    known = template_bigrams(docs.sparkSession, templates)
    t = F.coalesce(F.col("text"), F.lit(""))
    parts = F.split(t, "\\n[ \\t\\r]*\\n")
    units = F.concat(
        F.transform(F.split(t, "\n"), lambda x, i: F.struct(F.lit("line").alias("kind"), i.alias("unit"), x.alias("text"))),
        F.filter(F.transform(parts, lambda x, i: F.struct(F.lit("paragraph").alias("kind"), i.alias("unit"), x.alias("text"))), lambda u: u["text"].contains("\n")))
    hopeful = docs.select("doc_id", "text").where(may_match(F.col("text"), templates, least))
    rows = hopeful.select("doc_id", F.xxhash64("text").alias("th"), F.explode(units).alias("u")).select("doc_id", "th", "u.kind", "u.unit", "u.text")
    rows = rows.where(may_match(F.col("text"), templates, least)).select("doc_id", "th", "kind", "unit", bigrams(words(F.col("text"))).alias("bs"))
    most = max(_size(text) for _, text in templates) * (2 - least) / least      # a larger set reaches no template
    rows = rows.select("doc_id", "th", "kind", "unit", F.size("bs").alias("n"), F.when(F.size("bs") <= most, F.col("bs")).alias("bs"))
    rows = rows.select("doc_id", "th", "kind", "unit", "n", F.explode("bs").alias("b"))
    near = F.lit(2.0) * F.least("n", "size") >= least * (F.col("n") + F.col("size"))
    met = rows.join(F.broadcast(known), "b").where(near)                  # a fixed list
    shared = met.groupBy("doc_id", "th", "kind", "unit", "n", "template", "licence", "size").agg(F.count_distinct("b").alias("shared"))
    dice = F.lit(2.0) * F.col("shared") / (F.col("n") + F.col("size"))
    return shared.withColumn("dice", dice).where(F.col("dice") >= least).select("doc_id", "th", "kind", "unit", "licence", "template", "dice")


def licensed(docs: DataFrame, templates=TEMPLATES, least: float = DICE) -> DataFrame:
    """doc_id, licences (sorted, comma-joined), n_units, best_dice for each row of ``docs``."""
    found = matches(docs, templates, least)
    per = found.groupBy("doc_id", "th").agg(
        F.concat_ws(",", F.sort_array(F.collect_set("licence"))).alias("licences"),
        F.count_distinct("kind", "unit").alias("n_units"), F.max("dice").alias("best_dice"))
    per = stored(per.select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "licences", "n_units", "best_dice"), "licensed")
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"))
    return rows.join(per, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")), "left").select(
        "doc_id", F.coalesce("licences", F.lit("")).alias("licences"), F.coalesce("n_units", F.lit(0)).cast("bigint").alias("n_units"),
        F.coalesce("best_dice", F.lit(0.0)).alias("best_dice"))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licensed(documents(spark, sf_dir))


def _sql() -> str:
    rows = ", ".join(f"({k}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for k, (name, text) in enumerate(TEMPLATES))
    ws = "list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda x: x <> '')"
    pairs = "list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))"
    return f"""
WITH lists AS (SELECT k, licence, {pairs} AS bs FROM (SELECT k, licence, {ws.format('t')} AS ws FROM (VALUES {rows}) v(k, licence, t))),
templates AS (SELECT k, licence, len(bs) AS size, unnest(bs) AS b FROM lists),
units AS (
  SELECT doc_id, 'l' || i AS unit, p[i] AS t FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents))
  UNION ALL
  SELECT doc_id, 'p' || i, p[i] FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (
    SELECT doc_id, string_split_regex(coalesce(text, ''), '\n[ \t\r]*\n') AS p FROM documents)) WHERE contains(p[i], chr(10))),
own AS (SELECT doc_id, unit, {pairs} AS bs FROM (SELECT doc_id, unit, {ws.format('t')} AS ws FROM units)),
shared AS (SELECT doc_id, unit, n, k, licence, size, count(*) AS c FROM (SELECT doc_id, unit, len(bs) AS n, unnest(bs) AS b FROM own) o JOIN templates USING (b) GROUP BY ALL),
found AS (SELECT *, 2.0 * c::DOUBLE / (n + size) AS dice FROM shared WHERE 2.0::DOUBLE * c / (n + size) >= 0.8::DOUBLE),
per AS (SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences, count(DISTINCT unit) AS n_units, max(dice) AS best_dice FROM found GROUP BY doc_id)
SELECT d.doc_id, coalesce(licences, '') AS licences, coalesce(n_units, 0) AS n_units, coalesce(best_dice, 0.0::DOUBLE) AS best_dice
FROM documents d LEFT JOIN per USING (doc_id)"""


OP7_SQL = _sql()
