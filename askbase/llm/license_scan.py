"""Licence recognition by sentence rules.

A text is cut into sentences at stops, clause marks and blank lines; comment
and list marks at line starts, letter case and punctuation are dropped. A line
end inside a sentence is kept as a place where a known sentence may start or
end, but need not: wrapped licences and one-line notices between unfinished
lines are both found. A run of whole lines or a whole sentence that equals one
of the table of known sentences becomes its identifier, the longest first;
others disappear. Licences are ordered sequences of
identifiers: a rule holds when its identifiers occur in its order, other known
sentences between them allowed within ``gap``. Rules are tried from the most
specific on; the sentences a rule has used are not used again, so a text may
carry several licences, each reported once, in the order of their first place.

Everything is made of DataFrame functions on the row itself: no shuffle, no
join, no Python. The sentence table and the rules are parameters of fixed size
that become part of the expression.

Defined cases: a null or empty text has no sentence and no licence. A text
with known sentences but no matching rule has status ``unknown rule``. Repeated
rows each get their result.
"""

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from askbase.llm.common import LOWER, UPPER, let, table

GPL_ANY = ("you can redistribute it and or modify it under the terms of the gnu general public license "
           "as published by the free software foundation")
MIT_GRANT = ("permission is hereby granted free of charge to any person obtaining a copy of this software and "
             "associated documentation files the software to deal in the software without restriction")
AS_IS = "the software is provided as is without warranty of any kind"
KINDS = "including but not limited to the warranties of merchantability fitness for a particular purpose and"

#: Sentences of well-known licences and notices in normalised form, and what they say.
SENTENCES = {
    "licensed under cc by nc 4 0": "cc-by-nc-4",
    "licensed under cc by 4 0": "cc-by-4",
    "licensed under cc by sa 4 0": "cc-by-sa-4",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "this work is licensed under the gnu general public license version 2": "gpl-2",
    "this program is free software": "free-software",
    GPL_ANY: "gpl-any",
    "version 3 of the license": "version-3",
    "version 2 of the license": "version-2",
    "either version 3 of the license or at your option any later version": "version-3-on",
    "either version 2 of the license or at your option any later version": "version-2-on",
    **{f"{GPL_ANY} either version {n} of the license or at your option any later version": f"gpl-{n}-on"
       for n in (2, 3)},
    **{f"{GPL_ANY} version {n} of the license": f"gpl-{n}" for n in (2, 3)},
    **{GPL_ANY.replace("license as", f"license version {n} as"): f"gpl-{n}" for n in (2, 3)},
    "gnu general public license version 3 29 june 2007": "gpl-3-text",
    "gnu general public license version 2 june 1991": "gpl-2-text",
    "licensed under the apache license version 2 0": "apache-2",
    "licensed under the apache license version 2 0 the license": "apache-2",
    "the asf licenses this file to you under the apache license version 2 0 the license": "apache-2",
    "apache license version 2 0 january 2004": "apache-2",
    "you may not use this file except in compliance with the license": "apache-comply",
    "you may obtain a copy of the license at": "apache-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is "
    "distributed on an as is basis without warranties or conditions of any kind either express or implied":
        "apache-as-is",
    "released under the mit license": "mit-name",
    "licensed under the mit license": "mit-name",
    MIT_GRANT: "mit-grant",
    f"{MIT_GRANT} including without limitation the rights to use copy modify merge publish distribute sublicense "
    "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject "
    "to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial "
    "portions of the software": "mit-notice",
    "the above copyright notice and this permission notice including the next paragraph shall be included in all "
    "copies or substantial portions of the software": "mit-notice",
    AS_IS: "as-is",
    f"{AS_IS} express or implied": "as-is",
    f"{AS_IS} express or implied {KINDS} noninfringement": "as-is",
    f"{AS_IS} express or implied {KINDS} non infringement": "as-is",
    "redistribution and use in source and binary forms with or without modification are permitted provided "
    "that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice": "bsd-source",
    "redistributions of source code must retain the above copyright notice this list of conditions and the "
    "following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice": "bsd-binary",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
    "following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
    "promote products derived from this software without specific prior written permission": "bsd-endorse",
    "the name of the author may not be used to endorse or promote products derived from this software without "
    "specific prior written permission": "bsd-endorse",
    "all rights reserved": "all-rights",
}

#: Wordings with a name in them, and how the table has them (in marked text, see ``marked``).
NAMED = [(r"neither the names? of (?:[^ ]+ ){1,24}?nor the names of (?:/ )?(?:its|their|any) (?:/ )?contributors",
          "neither the name of the copyright holder nor the names of its contributors")]

#: Whole licences and headers, most specific first.
TEXTS = [
    ("Apache-2.0", ["apache-2", "apache-comply", "apache-copy", "apache-as-is"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("MIT", ["mit-grant", "mit-notice", "as-is"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
]
#: Ordered rules, most specific first.
RULES = [
    *[(name, ["all-rights", *ids]) for name, ids in TEXTS],  # a copyright line above belongs to the licence
    # the licences' own texts end with the notice to use
    ("GPL-3.0-only", ["gpl-3-text", "gpl-3-on"]),
    ("GPL-2.0-only", ["gpl-2-text", "gpl-any", "version-2-on"]),
    ("GPL-2.0-only", ["gpl-2-text", "gpl-2-on"]),
    ("GPL-3.0-only", ["gpl-3-text"]),
    ("GPL-2.0-only", ["gpl-2-text"]),
    ("GPL-3.0-or-later", ["gpl-3-on"]),
    ("GPL-2.0-or-later", ["gpl-2-on"]),
    ("GPL-3.0-or-later", ["gpl-any", "version-3-on"]),
    ("GPL-2.0-or-later", ["gpl-any", "version-2-on"]),
    *TEXTS,
    ("GPL-3.0-only", ["gpl-any", "version-3"]),
    ("GPL-2.0-only", ["gpl-any", "version-2"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("Apache-2.0", ["apache-2"]),
    ("GPL-3.0-only", ["gpl-3"]),
    ("GPL-2.0-only", ["gpl-2"]),
    ("MIT", ["mit-name"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4"]),
    ("CC-BY-4.0", ["cc-by-4"]),
    ("Proprietary", ["all-rights"]),
]
GAP = 3
#: Characters of words: letters and digits, no spaces, signs and quotes beyond ASCII.
_WORD = r"a-z0-9\x{C0}-\x{1FFF}\x{2070}-\x{10FFFF}"
#: A stop before white space, a clause mark, and the bracket of a list mark end a sentence.
_END = r"[.](?=[\s]|$)|[;:]|(?<=\n[0-9a-z]{1,2})[)]"


def marked(text: Column) -> Column:
    """The text's words, " | " between sentences and " / " between the lines of one, at both ends too."""
    lines = F.concat(F.lit("\n\n"), F.coalesce(text, F.lit("")), F.lit("\n\n"))
    out = F.translate(F.regexp_replace(lines, r"\r\n?", "\n"), UPPER, LOWER)
    for pattern, new in [(rf"\n[^{_WORD}\n]++", "\n"), (_END, "\n\n"), (rf"[^{_WORD}\n]++", " "),
                         (r" ?\n[ \n]*\n ?", " | "), (r" ?\n ?", " / "), *NAMED]:
        out = F.regexp_replace(out, pattern, new)
    return out


def sentence_ids(text: Column, sentences: dict[str, str]) -> Column:
    """Identifiers of the known sentences of a text, in order, with their numbers."""
    known = F.create_map(*[F.lit(x) for pair in sentences.items() for x in pair])
    longest = sorted(sentences, key=lambda s: (-len(s), s))
    wrapped = "|".join(" (?:/ )?".join(map(re.escape, s.split())) for s in longest)
    found = F.regexp_extract_all(marked(text), F.lit(f"(?<=[|/] )(?:{wrapped})(?= [|/])"), F.lit(0))
    return F.transform(found, lambda s, i: F.struct(
        F.try_element_at(known, F.replace(s, F.lit(" / "), F.lit(" "))).alias("id"), i.alias("at")))


def apply_rule(state: Column, rule: Column, gap: int) -> Column:
    """``state`` (free: identifiers, used ones null; licences) after one rule, applied as often as it holds.

    From each free first identifier the next ones are sought in order, each at
    most ``gap`` known sentences behind the one before.
    """
    def further(free: Column, path: Column, want: Column) -> Column:
        ahead = F.slice(free, F.element_at(path, -1) + 2, gap + 1)
        return let(F.coalesce(F.array_position(ahead, want), F.lit(0)).cast("int"), lambda k: F.when(
            k > 0, F.array_append(path, F.element_at(path, -1) + k)))

    def once(current: Column, start: Column) -> Column:
        path = F.when(F.get(current["free"], start) == rule["wanted"][0], F.aggregate(
            F.slice(rule["wanted"], F.lit(2), F.size(rule["wanted"]) - 1), F.array(start),
            lambda found, want: further(current["free"], found, want)))
        return let(path, lambda found: F.when(found.isNull(), current).otherwise(F.struct(
            F.transform(current["free"], lambda x, i: F.when(~F.array_contains(found, i), x)).alias("free"),
            F.array_append(current["licences"], F.struct(
                rule["name"].alias("licence"), start.alias("first"))).alias("licences"))))

    return F.aggregate(F.sequence(F.lit(0), F.size(state["free"]) - 1), state, once)


def scan_licences(documents: DataFrame, text_col: str = "text", sentences: dict[str, str] | None = None,
                  rules: list[tuple[str, list[str]]] | None = None, gap: int = GAP) -> DataFrame:
    """``documents`` with sentence_ids, licences (in the text's order) and status.

    Columns of the input with these names are replaced.
    """
    rules = RULES if rules is None else rules
    out = ("sentence_ids", "licences", "status")
    held = documents.select(F.struct("*").alias("row"), sentence_ids(
        F.col(text_col), SENTENCES if sentences is None else sentences).alias("found"))
    held = held.select("row", F.transform("found", lambda x: x["id"]).alias("ids"))
    ruled = F.array(*[F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, w)).alias("wanted")) for n, w in rules])
    start = F.struct(F.col("ids").alias("free"),
                     F.array().cast("array<struct<licence:string,first:int>>").alias("licences"))
    state = F.aggregate(ruled, start, lambda s, rule: apply_rule(s, rule, gap))
    done = held.select("row", "ids", F.when(F.size("ids") > 0, state).alias("state"))
    licences = F.array_distinct(F.transform(F.array_sort(F.transform(
        F.col("state.licences"), lambda x: F.struct(x["first"].alias("first"), x["licence"].alias("licence")))),
        lambda x: x["licence"]))
    status = F.when(F.size("ids") == 0, "none").when(F.size("licences") == 0, "unknown rule").otherwise("licensed")
    done = done.select("row", "ids", F.coalesce(licences, F.array().cast("array<string>")).alias("licences"))
    return done.select(*[F.col("row").getField(c).alias(c) for c in documents.columns if c not in out],
                       F.col("ids").alias("sentence_ids"), "licences", status.alias("status"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = scan_licences(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return scanned.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"),
                          F.array_join("licences", ",").alias("licences"), "status")
