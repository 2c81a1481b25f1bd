"""Licence scan: normalised text against licence templates by Dice over word bigrams.

Units are lines, paragraphs of several lines, and whole texts of several paragraphs;
spans of words, whatever line ends are in them, find the notices that share a line or are
wrapped among other lines.  A
unit that reaches the least Dice with a template shares at least ``t / (2 - t)`` of the
template's bigrams, so it holds one of any larger remainder of them: the longest words
of such a remainder are the template's anchors, and units without any anchor go before
their bigrams are made.  Size bounds then leave the templates worth comparing.  All is
one pass of DataFrame functions; no row moves.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugework.functions.constants import let
from gaugework.operators.groups import unnest

LEAST = 0.8
MOST_TEMPLATES = 500

# Notices as their licences' publishers word them.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}

# Looked for in spans only: the SQL carries the list above.
_REDISTRIBUTION = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_GNU = "This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {which} License as published " \
    "by the Free Software Foundation{after} either version {version} of the License, or (at your option) any later version."
NOTICES = {
    "BSD-2-Clause": [_REDISTRIBUTION],
    "BSD-3-Clause": [
        f"{_REDISTRIBUTION} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission."
    ],
    "GPL-2.0": [
        _GNU.format(what="program", mark=";", which="General Public", after=";", version="2"),
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "version 2 as published by the Free Software Foundation.",
    ],
    "LGPL-2.1": [_GNU.format(what="library", mark=";", which="Lesser General Public", after=";", version="2.1")],
    "LGPL-3.0": [_GNU.format(what="program", mark=":", which="Lesser General Public", after=",", version="3")],
    "AGPL-3.0": [_GNU.format(what="program", mark=":", which="Affero General Public", after=",", version="3")],
    "CC0-1.0": [
        "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or "
        "neighboring rights to this work.",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her "
        "rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.",
    ],
}

_BREAKS = r"[^\p{L}\p{N}\n]+"
_BLANK_LINES = r"\n(?: ?\n)+"


def plain_words(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def bigrams(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def shared_least(size: int, least: float) -> int:
    """Bigrams of a template of ``size`` that a unit with at least that Dice shares."""
    return math.ceil(least * size / (2 - least) - 1e-9)


def anchors(grams: list[str], least: float) -> set[str]:
    """Longest words of so many bigrams that no matching unit lacks them all."""
    longest = lambda g: max(g.split(" "), key=lambda w: (len(w), w))
    order = sorted(grams, key=lambda g: (-len(longest(g)), g))
    return {longest(g) for g in order[: len(grams) - shared_least(len(grams), least) + 1]}


def _units(text: Column) -> Column:
    """Array of (unit, place, words as one string); blanks and marks are single spaces."""
    unit = lambda kind, place, words: F.struct(
        F.lit(kind).alias("unit"), place.cast("int").alias("place"), F.trim(F.translate(words, "\n", " ")).alias("words")
    )
    none = F.array().cast("array<struct<unit:string,place:int,words:string>>")

    def all_units(plain: Column, paragraphs: Column) -> Column:
        several = F.filter(
            F.transform(paragraphs, lambda p, i: F.struct(i.alias("i"), p.alias("p"))), lambda s: F.trim(s["p"]).contains("\n")
        )
        return F.concat(
            F.transform(F.split(plain, "\n"), lambda line, i: unit("line", i, line)),
            F.transform(several, lambda s: unit("paragraph", s["i"], s["p"])),
            F.when(F.size(paragraphs) > 1, F.array(unit("text", F.lit(0), plain))).otherwise(none),
        )

    return let(_plain(text), lambda p: let(F.split(p, _BLANK_LINES), lambda parts: all_units(p, parts)))


def _plain(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _BREAKS, " ")


def _words(plain: Column) -> Column:
    return F.split(F.trim(F.translate(plain, "\n", " ")), " +")


def _pairs(w: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i)))


def _table(templates: dict[str, list[str]]) -> list[tuple[str, list[str]]]:
    table = [(name, bigrams(plain_words(t))) for name, texts in sorted(templates.items()) for t in texts]
    return [(name, grams) for name, grams in table if grams]


def _wanted(table: list[tuple[str, list[str]]], least: float) -> list[str]:
    return sorted(set().union(*(anchors(g, least) for _, g in table)))


def span_templates() -> dict[str, list[str]]:
    return {name: TEMPLATES.get(name, []) + NOTICES.get(name, []) for name in {**TEMPLATES, **NOTICES}}


def _judge(table: list[tuple[str, list[str]]], least: float):
    """From the words of a unit to the closest template, as struct (-Dice, name), or null."""
    wanted, smallest = _wanted(table, least), min(shared_least(len(g), least) for _, g in table)
    known = F.array(*[F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, g)).alias("grams")) for n, g in table])
    low, high = least / (2 - least) - 1e-9, (2 - least) / least + 1e-9

    def closest(grams: Column) -> Column:
        near = F.filter(known, lambda t: (F.size(grams) >= low * F.size(t["grams"])) & (F.size(grams) <= high * F.size(t["grams"])))
        return F.array_min(F.transform(near, lambda t: F.struct(
            (-(2 * F.size(F.array_intersect(grams, t["grams"])) / (F.size(grams) + F.size(t["grams"])))).alias("order"), t["name"].alias("name")
        )))

    def judged(w: Column) -> Column:
        held = (F.size(w) > smallest) & F.arrays_overlap(w, F.array(*map(F.lit, wanted)))
        return F.when(held, let(F.array_distinct(_pairs(w)), closest))

    return judged


def _spans(text: Column, table: list[tuple[str, list[str]]], judged, least: float) -> Column:
    """Array of (unit, place, licence, dice) of the spans that no unit of the same licence contains.

    A span begins and ends with a pair of the template and has at most as many pairs as
    may reach the least Dice; starts with too few of the template's pairs ahead go first.
    """
    wanted, smallest = _wanted(table, least), min(shared_least(len(g), least) for _, g in table)
    known = F.array(*[F.struct(
        F.lit(n).alias("name"), F.lit(len(g)).alias("n"), F.lit(shared_least(len(g), least)).alias("fewest"),
        F.lit(int((2 - least) / least * len(g) + 1e-9)).alias("most"), F.array(*map(F.lit, g)).alias("grams"),
    ) for n, g in table])
    every = sorted(set().union(*(g for _, g in table)))
    form = "array<struct<order:int,loss:double,start:int,stop:int,name:string>>"

    def weighed(pairs: Column, t: Column, a: Column, b: Column) -> Column:
        def one(grams: Column, shared: Column) -> Column:
            return F.struct(
                (t["n"] + F.size(grams) - 3 * shared).alias("order"), (-(2 * shared / (t["n"] + F.size(grams)))).alias("loss"),
                a.alias("start"), (b + 2).alias("stop"), t["name"].alias("name"),
            )

        grams = F.array_distinct(F.slice(pairs, a + 1, b - a + 1))
        return let(grams, lambda g: let(F.size(F.array_intersect(g, t["grams"])), lambda shared: one(g, shared)))

    def from_start(pairs: Column, t: Column, h: Column, a: Column, k: Column) -> Column:
        ends = F.filter(F.slice(h, k + t["fewest"], t["most"]), lambda b: b - a < t["most"])
        return F.filter(F.transform(ends, lambda b: weighed(pairs, t, a, b)), lambda x: x["loss"] <= -least)

    def of_template(pairs: Column, hits: Column, t: Column) -> Column:
        def windows(h: Column) -> Column:
            starts = F.filter(
                F.transform(h, lambda a, k: F.struct(a.alias("a"), k.alias("k"))),
                lambda s: F.coalesce(F.get(h, s["k"] + t["fewest"] - 1) - s["a"] < t["most"], F.lit(False)),
            )
            return F.flatten(F.transform(starts, lambda s: from_start(pairs, t, h, s["a"], s["k"])))

        own = F.filter(hits, lambda x: F.array_contains(t["grams"], x["gram"]))
        return let(F.transform(own, lambda x: x["at"]), windows)

    def chosen(pairs: Column) -> Column:
        """Of overlapping windows the one that explains most: pairs shared less pairs missing and pairs besides."""
        hits = F.filter(F.transform(pairs, lambda p, i: F.struct(i.alias("at"), p.alias("gram"))), lambda x: x["gram"].isin(every))
        found = let(hits, lambda h: F.flatten(F.transform(known, lambda t: of_template(pairs, h, t)))).cast(form)
        return F.aggregate(
            F.array_sort(found), F.array().cast(form),
            lambda taken, x: F.when(
                F.exists(taken, lambda y: (y["start"] < x["stop"]) & (x["start"] < y["stop"])), taken
            ).otherwise(F.concat(taken, F.array(x))),
        )

    def inside(parts: Column, x: Column) -> Column:
        def same(of: Column) -> Column:
            i = F.get(of, x["start"])
            best = let(_words(F.get(parts, i)), judged)
            return (i == F.get(of, x["stop"] - 1)) & let(best, lambda d: (d["order"] <= -least) & (d["name"] == x["name"]))

        count = lambda p: F.when(F.trim(F.translate(p, "\n", " ")) == "", 0).otherwise(F.size(_words(p)))
        return F.coalesce(let(F.flatten(F.transform(parts, lambda p, i: F.array_repeat(i, count(p)))), same), F.lit(False))

    def fresh(plain: Column, x: Column) -> Column:
        return ~inside(F.split(plain, "\n"), x) & ~inside(F.split(plain, _BLANK_LINES), x) & ~inside(F.array(plain), x)

    def all_spans(plain: Column, w: Column) -> Column:
        held = (F.size(w) > smallest) & F.arrays_overlap(w, F.array(*map(F.lit, wanted)))
        return F.when(held, F.transform(
            F.filter(let(_pairs(w), chosen), lambda x: fresh(plain, x)),
            lambda x: F.struct(F.lit("span").alias("unit"), x["start"].alias("place"), x["name"].alias("licence"), (-x["loss"]).alias("dice")),
        ))

    return let(_plain(text), lambda p: let(_words(p), lambda w: all_spans(p, w)))


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, least: float = LEAST) -> DataFrame:
    """``doc_id, unit, place, licence, dice`` of every unit that a template matches.

    ``unit`` is line, paragraph or text and ``place`` its number from 0; of several
    templates the one with the greatest Dice counts, then the first name.  ``unit`` span
    is a run of words across any line ends, and ``place`` its first word from 0: notices
    that fill no unit.  Spans do not overlap, and one that lies in a unit matched by its
    licence is not given again.  They are also judged by ``NOTICES``, unless
    ``templates`` are given.  Null and empty texts match nothing, repeated rows match
    alike, a null ``doc_id`` stays null; other columns are not read.  Whole texts are
    scanned.
    """
    table, wide = _table(templates or TEMPLATES), _table(templates or span_templates())
    if len(wide) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates; they are carried in the plan")
    judged = _judge(table, least)

    # words and bigrams are bound once per unit: inside a lambda they would be made anew for every element
    units = unnest(docs, _units(F.col("text")), "u", "doc_id")
    best = units.select("doc_id", "u.unit", "u.place", let(F.split("u.words", " +"), judged).alias("best"))
    best = best.filter(F.col("best.order") <= -least)
    best = best.select("doc_id", "unit", "place", F.col("best.name").alias("licence"), (-F.col("best.order")).alias("dice"))
    return best.union(unnest(docs, _spans(F.col("text"), wide, judged, least), "s", "doc_id").select("doc_id", "s.*"))


def scan_sql(templates: dict[str, list[str]] | None = None, least: float = LEAST) -> str:
    """The same scan in the SQL of a single-node engine, without any pruning."""
    table = [(n, bigrams(plain_words(t))) for n, texts in sorted((templates or TEMPLATES).items()) for t in texts]
    values = ", ".join(f"('{n}', [{', '.join(repr(g) for g in grams)}])" for n, grams in table)
    return f"""
    WITH templates(name, grams) AS (VALUES {values}),
    plain AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g') AS t FROM documents),
    paragraphs AS (SELECT doc_id, t, regexp_split_to_array(t, '\\n(?: ?\\n)+') AS p, string_split(t, chr(10)) AS l FROM plain),
    units AS (
      SELECT doc_id, 'line' AS unit, i AS place, l[i + 1] AS words FROM paragraphs, unnest(range(0, len(l))) AS r(i)
      UNION ALL
      SELECT doc_id, 'paragraph', i, p[i + 1] FROM paragraphs, unnest(range(0, len(p))) AS r(i) WHERE contains(trim(p[i + 1], ' '), chr(10))
      UNION ALL
      SELECT doc_id, 'text', 0, t FROM paragraphs WHERE len(p) > 1
    ), worded AS (
      SELECT doc_id, unit, place, regexp_split_to_array(trim(replace(words, chr(10), ' '), ' '), ' +') AS w FROM units
    ), grams AS (
      SELECT doc_id, unit, place, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS g FROM worded WHERE len(w) > 1
    ), scored AS (
      SELECT doc_id, unit, place, name AS licence, 2 * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice,
             row_number() OVER (PARTITION BY doc_id, unit, place ORDER BY 2 * len(list_intersect(g, grams)) / (len(g) + len(grams)) DESC, name) AS n
      FROM grams, templates
      WHERE len(g) BETWEEN {least / (2 - least) - 1e-9} * len(grams) AND {(2 - least) / least + 1e-9} * len(grams)
    )
    SELECT doc_id, unit, CAST(place AS INTEGER) AS place, licence, CAST(dice AS DOUBLE) AS dice FROM scored WHERE n = 1 AND dice >= {least}
    """
