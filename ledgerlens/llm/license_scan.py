"""Licence scan with a positional rare-token index (operator 3), in DataFrame expressions only.

Each template is a list of words with a mandatory key phrase inside it. Document frequencies
of the templates' words come from all rows; a template's probes are the key-phrase words of
highest inverse document frequency. A file's postings are its positions of the probes; moved back
by a probe's place in the template they are possible template starts, and only starts that all
probes of a template share remain. There the whole key phrase must stand word by word, and the
weights of the template's words found at their places are summed.

Matching is row by row, without a shuffle. Defined cases: a null text is empty; a text without
words has no label and score 0; a text that breaks off inside a template is weighed by what stands
there; a very long text is one row's arrays of words and postings (its size bounds the memory);
repeated rows are reported each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import whole_text

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHARE = 0.8
PROBES = 3


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    key_at: int
    key_words: int
    base: bool = False


def template(label: str, text: str, key: str | None = None) -> Template:
    """A template of a text's lower-case words; without a key phrase all of it is mandatory."""
    words, must = (tuple(w for w in re.split(SEPARATORS, t.lower()) if w) for t in (text, key or text))
    at = next(i for i in range(len(words)) if words[i: i + len(must)] == must)
    return Template(label, words, at, len(must), key is None)


BASE = [template("cc-by", "cc by"), template("gpl", "general public license"), template("reserved", "all rights reserved")]
NOTICES = [
    template("agpl", "gnu affero general public license", "affero general public license"),
    template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2"),
    template("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
             "source and binary forms"),
    template("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc"),
    template("cc-by-sa", "licensed under cc by sa", "cc by sa"),
    template("gpl-3.0", "licensed under the gnu general public license version 3", "general public license version 3"),
    template("lgpl", "gnu lesser general public license", "lesser general public license"),
    template("mit", "released under the mit license", "mit license"),
    template("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted"),
    template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
]
# ---- fixed values: grants and notices of public licences, word for word ---------------
GRANTS = [
    template("apache-2.0-notice", """
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to
in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
             "Licensed under the Apache License"),
    template("boost-text", """
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software,
and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so""",
             "to any person or organization obtaining a copy"),
    template("bsd-2-text", """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution.""",
             "Redistribution and use in source and binary forms"),
    template("gpl-notice", """
This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
             "redistribute it and/or modify it under the terms of the GNU General Public License"),
    template("isc-text", """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies.""",
             "with or without fee is hereby granted"),
    template("mit-text", """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do
so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software.""",
             "Permission is hereby granted, free of charge"),
    template("mpl-2.0-notice", """
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
this file, You can obtain one at http://mozilla.org/MPL/2.0/.""", "Mozilla Public License"),
    template("unlicense-text", """
This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell,
or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and
by any means.""", "unencumbered software released into the public domain"),
]
TEMPLATES = BASE + NOTICES + GRANTS


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) words of a text."""
    return F.array_remove(F.split(F.translate(whole_text(text), UPPER, LOWER), SEPARATORS), "")


def rarity(df: DataFrame, text: str, words: list[str]) -> dict[str, int]:
    """Integer weight of each word: 1 + 1000 ln((rows + 1) / (rows with it + 1)), over all rows."""
    vocabulary = F.split(F.lit(" ".join(words)), " ")
    held = df.select(F.explode(F.array_append(F.array_intersect(words_of(F.col(text)), vocabulary), F.lit(""))).alias("word"))
    rows = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a word
    return {w: 1 + math.floor(1000 * math.log((rows.get("", 0) + 1) / (rows.get(w, 0) + 1)) + 0.5) for w in words}


def scan(df: DataFrame, id: str = "doc_id", text: str = "text", templates: list[Template] = TEMPLATES,
         share: float = SHARE) -> DataFrame:
    """Per row: words, places of base phrases, labels, the best share of a template, and its matches."""
    weight = rarity(df, text, sorted({w for t in templates for w in t.words}))

    def probes(t: Template) -> list[int]:
        """Places of the key-phrase words of highest inverse document frequency."""
        return sorted(range(t.key_at, t.key_at + t.key_words), key=lambda i: (-weight[t.words[i]], i))[:PROBES]

    sought = sorted({t.words[k] for t in templates for k in probes(t)})
    posting = {w: f"at_{i}" for i, w in enumerate(sought)}
    words, hits = F.col("words"), F.col("hits")

    def moved_back(at: str, places: int) -> Column:
        return F.transform(at, lambda p: p - places)

    def postings(word: str) -> Column:
        return F.transform(F.filter(hits, lambda h: h["word"] == word), lambda h: h["at"])

    def starts(t: Template) -> Column:
        """Verified starts of one template with the weight found there."""
        total, key = sum(weight[w] for w in t.words), range(t.key_at, t.key_at + t.key_words)
        shared = reduce(F.array_intersect, [moved_back(posting[t.words[k]], k) for k in probes(t)])
        sure = sum(weight[t.words[k]] for k in key)
        rest = [(k, w) for k, w in enumerate(t.words) if k not in key]

        def holds(at: Column) -> Column:
            unseen = [F.coalesce(F.get(words, at + k) == t.words[k], F.lit(False)) for k in key if k not in probes(t)]
            return reduce(lambda a, b: a & b, unseen, F.lit(True))

        def found(at: Column) -> Column:
            if not rest:
                return F.lit(sure) / float(total)
            each = ", ".join(f"named_struct('k', {k}, 'word', '{w}', 'weight', {weight[w]})" for k, w in rest)  # words hold no quotes
            places = F.expr(f"array({each})")
            return F.aggregate(places, F.lit(sure), lambda got, p: got + F.when(
                F.get(words, at + p["k"]) == p["word"], p["weight"]).otherwise(0)) / float(total)

        return F.transform(F.filter(shared, holds), lambda at: F.struct(
            F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), at.alias("at"), found(at).alias("share")))

    split = df.select(F.col(id), words_of(F.col(text)).alias("words"))
    marked = F.transform(words, lambda w, i: F.when(w.isin(sought), F.struct(w.alias("word"), i.alias("at"))))
    held = split.select(F.col(id), "words", F.filter(marked, lambda h: h.isNotNull()).alias("hits"))
    posted = held.select(F.col(id), "words", *[postings(w).alias(name) for w, name in posting.items()])
    matched = posted.select(F.col(id), F.size("words").cast("long").alias("n_words"), F.flatten(F.array(
        *[starts(t) for t in templates])).alias("matches"))
    base = F.filter("matches", lambda m: m["base"])
    places = F.transform(base, lambda m: m["at"].cast("long"))

    def joined(of: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda m: m["label"]))), ",")

    return matched.select(
        F.col(id), "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"), joined(base).alias("base_labels"),
        joined(F.filter("matches", lambda m: m["share"] >= share)).alias("labels"),
        F.round(F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0)), 4).alias("score"), "matches")


def scan_sql(templates: list[Template] = TEMPLATES, share: float = SHARE) -> str:
    """The same report in SQL, matching all template words at all relative positions."""
    rows = ", ".join(
        f"({i}, '{t.label}', {t.base}, {k}, '{w}', {t.key_at <= k < t.key_at + t.key_words})"
        for i, t in enumerate(templates) for k, w in enumerate(t.words))
    return rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
template AS (SELECT * FROM (VALUES {rows}) v(t, label, base, k, word, must)),
placed AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM words),
weight AS (
  SELECT word, CAST(1 + floor(1000 * ln(((SELECT count(*) FROM documents) + 1) / (count(DISTINCT doc_id) + 1)) + 0.5) AS BIGINT) AS w
  FROM (SELECT DISTINCT word FROM template) v LEFT JOIN placed USING (word) GROUP BY word),
whole AS (SELECT t, sum(w) AS total, count_if(must) AS needed FROM template JOIN weight USING (word) GROUP BY t),
hit AS (
  SELECT doc_id, t, label, base, pos - k AS place, sum(w) AS got, count_if(must) AS had
  FROM placed JOIN template USING (word) JOIN weight USING (word) GROUP BY ALL),
ok AS (SELECT *, CAST(got AS DOUBLE) / CAST(total AS DOUBLE) AS part FROM hit JOIN whole USING (t) WHERE had = needed),
found AS (
  SELECT doc_id, count_if(base) AS n_base, min(place) FILTER (base) AS first_word, max(place) FILTER (base) AS last_word,
    coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
    coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (part >= {share}), '') AS labels, max(part) AS score
  FROM ok GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
  CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, round(coalesce(score, 0), 4) AS score
FROM words LEFT JOIN found USING (doc_id)"""
