"""Licences by sentence: known sentences become identifiers, and rules name licences by ordered identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Unknown sentences that may stand between two sentences of a rule, for each step.
GAP = 2

# Public licence notices, as far as they name the licence; a licence may have several.
NOTICES = [
    ("MIT", "Released under the MIT license."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""),
    ("ISC", """Permission to use, copy, modify, and distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License."""),
    ("GPL-2.0", "This work is licensed under the GNU General Public License version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License version 3."),
    ("GPL-2.0-or-later", """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version."""),
    ("GPL-3.0-or-later", """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""),
    ("AGPL-3.0-or-later", """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Affero General Public License as
published by the Free Software Foundation, either version 3 of the
License, or (at your option) any later version."""),
    ("LGPL-2.1-or-later", """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version."""),
    ("LGPL-3.0-or-later", """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU Lesser General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0."""),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
]
# End of the fixed values.

#: What a line of a comment or list begins with, up to four marks; indentation goes with it.
MARKS = r"(^|\n)[ \t]*(?:(?:/\*+|\*+/|\*+|//+|#+|;+|--+|%+|<!--|>+)[ \t]*){0,4}"
#: A line that begins with a copyright mark is a sentence.
OWNED = r"(^|\n)((?i:copyright|\(c\) )[^\n]*)\n"
BLANK = r"\n[ \t\r]*\n[ \t\r\n]*"
#: Marks end a sentence after two letters, digits, quotes or brackets, so "v. 2.0" stays in one.
ENDED = r"([A-Za-z0-9.)\"'][A-Za-z0-9)\"'][.!?;:])[ \t\r\n]+"
NOT_WORD = r"[^a-z0-9\n]+"
NUMBERED = r"^[0-9]{1,3} "


def sentences(text: Column) -> Column:
    """The sentences of a text in normal form: lower case, letters and digits of ASCII, single spaces; a line end inside one is kept.

    A sentence ends at . ! ? ; or : before white space, at an empty line and after a copyright line. Indentation, comment and list marks go.
    """
    bare = F.regexp_replace(F.regexp_replace(text, MARKS, "$1"), OWNED, "$1$2\n\n")
    apart = F.regexp_replace(F.regexp_replace(bare, BLANK, "\n\n"), ENDED, "$1\n\n")
    return F.split(F.regexp_replace(F.lower(apart), NOT_WORD, " "), " ?\n\n ?")


def _plain(sentence: Column) -> Column:
    """Without a number in front."""
    return F.regexp_replace(F.trim(sentence), NUMBERED, "")


def readings(sentence: Column) -> Column:
    """What a sentence may be known as: all of it, its lines joined; or, as no mark ends a notice of one line, each line of several."""
    whole = _plain(F.regexp_replace(sentence, " ?\n ?", " "))
    return F.when(F.contains(sentence, F.lit("\n")), F.concat(F.array(whole), F.transform(F.split(sentence, " ?\n ?"), _plain))).otherwise(F.array(whole))


def rules_of(notices: DataFrame) -> DataFrame:
    """(rule, licence, ids, first, steps) from (rule, licence, notice): the sentences of each notice in order, made as those of documents are."""
    ids = F.filter(F.transform(sentences(F.col("notice")), lambda x: F.get(readings(x), 0)), lambda x: x != "")
    return notices.select("rule", "licence", ids.alias("ids")).select("*", F.get("ids", 0).alias("first"), F.size("ids").alias("steps")).where("steps > 0")


def licence_matches(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: list[tuple[str, str]] | None = None, gap: int = GAP
) -> DataFrame:
    """(id, licence, first_sentence, last_sentence, n_sentences) for each place in ``docs`` where a rule is met.

    A rule is the sentences of a notice, in order. It is met by known sentences that follow each other so, no other known sentence and at most ``gap``
    unknown ones between two. A match inside a longer one is left out. Sentence numbers start at 0 and count empty sentences.
    Texts without known sentences, null and empty ones give no rows; repeated rows give repeated matches; an
    empty table gives none; other columns are not read. The notices (licence, text) are those passed in by the program, a
    small list, and their sentences are broadcast.
    """
    spark = docs.sparkSession
    given = [(i, *n) for i, n in enumerate(NOTICES if notices is None else notices)]
    wanted = rules_of(spark.createDataFrame(given, "rule int, licence string, notice string"))
    names = wanted.select(F.explode("ids").alias("sentence")).distinct()

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).withColumn("row", F.monotonically_increasing_id())
    each = rows.select("row", "id", F.posexplode(sentences(F.col("text"))).alias("place", "whole"))
    each = each.select("row", "id", "place", F.posexplode(readings(F.col("whole"))).alias("line", "sentence"))
    hits = each.join(F.broadcast(names), "sentence").select("row", "id", F.struct("place", "line", F.col("sentence").alias("sentence_id")).alias("hit"))
    lists = hits.groupBy("row", "id").agg(F.sort_array(F.collect_list("hit")).alias("hits"))
    lists = lists.select(
        "row", "id", F.col("hits.place").alias("places"), F.col("hits.sentence_id").alias("found"), F.posexplode("hits.sentence_id").alias("at", "first")
    )
    tried = lists.join(F.broadcast(wanted), "first")
    places = F.slice("places", F.col("at") + 1, F.col("steps"))
    near = F.forall(F.sequence(F.lit(1), F.col("steps")), lambda i: (i == 1) | (F.element_at("run", i) - F.element_at("run", F.greatest(i - 1, F.lit(1))) <= gap + 1))
    met = tried.where(F.slice("found", F.col("at") + 1, F.col("steps")) == F.col("ids")).withColumn("run", places).where(near)
    met = met.select(
        "row", "id", "licence", F.element_at("run", 1).alias("first_sentence"), F.element_at("run", -1).alias("last_sentence"), "steps", "rule"
    )
    longer = Window.partitionBy("row").orderBy("first_sentence", F.col("last_sentence").desc(), "rule").rowsBetween(Window.unboundedPreceding, -1)
    met = met.withColumn("reach", F.max("last_sentence").over(longer)).where(F.col("reach").isNull() | (F.col("last_sentence") > F.col("reach")))
    return met.select(
        "id", "licence", F.col("first_sentence").cast("bigint").alias("first_sentence"), F.col("last_sentence").cast("bigint").alias("last_sentence"),
        F.col("steps").cast("bigint").alias("n_sentences"),
    )


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _normal(text: str) -> str:
    steps = [(MARKS, "\\1"), (OWNED, "\\1\\2\n\n"), (BLANK, "\n\n"), (ENDED, "\\1\n\n")]
    for pattern, by in steps:
        text = f"regexp_replace({text}, {_text(pattern)}, {_text(by)}, 'g')"
    return f"string_split_regex(regexp_replace(lower({text}), {_text(NOT_WORD)}, ' ', 'g'), ' ?\n\n ?')"


def _bare(sentence: str) -> str:
    return f"regexp_replace(trim({sentence}), {_text(NUMBERED)}, '')"


_WHOLE = _bare("regexp_replace(s, ' ?\\n ?', ' ', 'g')")
_READINGS = f"CASE WHEN contains(s, chr(10)) THEN [{_WHOLE}] || [{_bare('l')} for l in string_split_regex(s, ' ?\\n ?')] ELSE [{_WHOLE}] END"

ORACLE = f"""
WITH given(rule, licence, notice) AS (VALUES {", ".join(f"({i}, {_text(n)}, {_text(t)})" for i, (n, t) in enumerate(NOTICES))}),
rules AS (SELECT rule, licence, [x for x in [{_WHOLE} for s in {_normal('notice')}] if x <> ''] AS ids FROM given),
known AS (SELECT DISTINCT unnest(ids) AS sentence FROM rules),
normal AS (SELECT row_number() OVER () AS row, doc_id, {_normal('text')} AS parts FROM documents),
whole AS (SELECT row, doc_id, unnest(parts) AS s, generate_subscripts(parts, 1) - 1 AS place FROM normal),
read AS (SELECT row, doc_id, place, {_READINGS} AS parts FROM whole),
each AS (SELECT row, doc_id, place, unnest(parts) AS sentence, generate_subscripts(parts, 1) AS line FROM read),
hits AS (SELECT row, doc_id, place, line, sentence FROM each JOIN known USING (sentence)),
lists AS (
  SELECT row, doc_id, list(place ORDER BY place, line) AS places, list(sentence ORDER BY place, line) AS found FROM hits GROUP BY ALL),
starts AS (SELECT *, unnest(range(1, len(found) + 1)) AS nth FROM lists),
met AS (
  SELECT row, doc_id, licence, rule, len(ids) AS steps, places[nth] AS first_sentence, places[nth + len(ids) - 1] AS last_sentence
  FROM starts JOIN rules ON found[nth] = ids[1]
  WHERE found[nth : nth + len(ids) - 1] = ids
    AND len([i for i in range(1, len(ids)) if places[nth + i] - places[nth + i - 1] > {GAP + 1}]) = 0),
reached AS (
  SELECT *, max(last_sentence) OVER (PARTITION BY row ORDER BY first_sentence, last_sentence DESC, rule
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM met)
SELECT doc_id, licence, first_sentence, last_sentence, steps AS n_sentences FROM reached
WHERE reach IS NULL OR last_sentence > reach
"""
