"""License scans: normalised sentences to identifiers, identifier sequences against ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.shared import SPACE, table, text_of

# Sentences of public licences and their usual notices, normalised (lower case,
# runs of anything but a-z and 0-9 as one space).
SENTENCES = {
    "mit-notice": [
        "mit license", "the mit license", "the mit license mit", "released under the mit license", "licensed under the mit license",
        "this project is licensed under the mit license", "distributed under the mit license", "spdx license identifier mit",
    ],
    "mit-grant": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
        " the software to deal in the software without restriction including without limitation the rights to use copy modify merge"
        " publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to"
        " do so subject to the following conditions",
    ],
    "notice-kept": [
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ],
    "software-as-is": [
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of"
        " merchantability fitness for a particular purpose and noninfringement",
    ],
    "apache2-notice": [
        "apache license version 2 0", "licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license",
        "released under the apache license version 2 0", "this work is licensed under the apache license version 2 0", "spdx license identifier apache 2 0",
    ],
    "apache2-compliance": ["you may not use this file except in compliance with the license"],
    "apache2-copy": ["you may obtain a copy of the license at"],
    "gpl3-notice": [
        "this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3",
        "released under the gnu general public license version 3", "gnu general public license version 3", "spdx license identifier gpl 3 0 only",
        "spdx license identifier gpl 3 0 or later",
    ],
    "gpl2-notice": [
        "this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2",
        "gnu general public license version 2", "spdx license identifier gpl 2 0 only", "spdx license identifier gpl 2 0 or later",
    ],
    "gpl-free": ["this program is free software"],
    "gpl3-terms": [
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software"
        " foundation either version 3 of the license or at your option any later version",
    ],
    "gpl2-terms": [
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software"
        " foundation either version 2 of the license or at your option any later version",
    ],
    "lgpl-notice": ["licensed under the gnu lesser general public license version 3", "gnu lesser general public license version 3", "spdx license identifier lgpl 3 0 only", "spdx license identifier lgpl 3 0 or later"],
    "agpl-notice": ["licensed under the gnu affero general public license version 3", "gnu affero general public license version 3", "spdx license identifier agpl 3 0 only", "spdx license identifier agpl 3 0 or later"],
    "bsd3-notice": ["licensed under the bsd 3 clause license", "bsd 3 clause license", "spdx license identifier bsd 3 clause"],
    "bsd2-notice": ["licensed under the bsd 2 clause license", "bsd 2 clause license", "spdx license identifier bsd 2 clause"],
    "isc-notice": ["isc license", "licensed under the isc license", "spdx license identifier isc"],
    "bsd-forms": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    ],
    "bsd-source": [
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    ],
    "bsd-binary": [
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in"
        " the documentation and or other materials provided with the distribution",
    ],
    "bsd-endorse": [
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived"
        " from this software without specific prior written permission",
    ],
    "mpl2-notice": [
        "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license version 2 0",
        "licensed under the mozilla public license version 2 0", "spdx license identifier mpl 2 0",
    ],
    "isc-grant": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided"
        " that the above copyright notice and this permission notice appear in all copies",
    ],
    "unlicense": ["this is free and unencumbered software released into the public domain", "spdx license identifier unlicense"],
    "ccbync4-notice": ["licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "licensed under a creative commons attribution noncommercial 4 0 international license"],
    "ccbysa4-notice": ["licensed under cc by sa 4 0", "this work is licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "licensed under a creative commons attribution sharealike 4 0 international license"],
    "ccby4-notice": ["licensed under cc by 4 0", "this work is licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license", "licensed under a creative commons attribution 4 0 international license"],
    "cc0-notice": ["licensed under cc0 1 0", "this work is dedicated to the public domain under cc0 1 0", "spdx license identifier cc0 1 0"],
    "reserved": ["all rights reserved"],
}

#: Rules in order, the more particular first: a licence and the identifiers that have to follow
#: each other, other sentences between them or not.
RULES = [
    ("MIT", ["mit-grant", "notice-kept", "software-as-is"]),
    ("MIT", ["mit-grant"]),
    ("Apache-2.0", ["apache2-notice", "apache2-compliance", "apache2-copy"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl3-terms"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl2-terms"]),
    ("BSD-3-Clause", ["bsd-forms", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-forms", "bsd-source", "bsd-binary"]),
    ("ISC", ["isc-grant"]),
    ("AGPL-3.0", ["agpl-notice"]),
    ("LGPL-3.0", ["lgpl-notice"]),
    ("GPL-3.0", ["gpl3-notice"]),
    ("GPL-2.0", ["gpl2-notice"]),
    ("MPL-2.0", ["mpl2-notice"]),
    ("CC-BY-NC-4.0", ["ccbync4-notice"]),
    ("CC-BY-SA-4.0", ["ccbysa4-notice"]),
    ("CC-BY-4.0", ["ccby4-notice"]),
    ("CC0-1.0", ["cc0-notice"]),
    ("Unlicense", ["unlicense"]),
    ("BSD-3-Clause", ["bsd3-notice"]),
    ("BSD-2-Clause", ["bsd2-notice"]),
    ("ISC", ["isc-notice"]),
    ("Apache-2.0", ["apache2-notice"]),
    ("MIT", ["mit-notice"]),
    ("Proprietary", ["reserved"]),
]


def rule_met(found: Column, ids: list[str]) -> Column:
    """Whether the identifiers come in this order, others between them or not: one pass that counts how many have come."""
    if len(ids) == 1:
        return F.array_contains(found, ids[0])
    rule = F.array(*map(F.lit, ids))
    return F.aggregate(found, F.lit(0), lambda n, x: n + F.when(x == F.get(rule, n), 1).otherwise(0)) == len(ids)


#: Sentence ends that white space follows; not the colon of an SPDX tag and the point of "v. 2.0", which only cut softly.
SENTENCE_END = r"(?i)([!?;]|(?<!spdx-license-identifier):|(?<!\bv)\.|\.(?!" + SPACE + "+[^a-z0-9]{0,20}[0-9]))" + SPACE + "+"


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def pieces_of(text: Column) -> Column:
    """The normalised pieces (lines, cut after . ! ? ; and : that white space follows), each with a bar, or two at a sentence's end."""
    cut = F.split(F.regexp_replace(F.regexp_replace(text, SENTENCE_END, "$1\u0001\n"), r"([.!?;:])" + SPACE + "+", "$1\n"), "\n")
    plain = lambda s: bare_notice(F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))
    made = F.transform(cut, lambda s: F.struct(plain(s).alias("p"), F.when(s.endswith("\u0001"), "||").otherwise("|").alias("end")))
    # a tag's colon cuts it from its licences
    return let(made, lambda all_: F.transform(all_, lambda x, i: F.concat(F.when(F.get(all_, i - 1)["p"] == TAG, each_tagged(x["p"])).otherwise(x["p"]), x["end"])))


#: What may stand before a notice in its piece, and after it.
SUBJECT, TAIL = "^[a-z0-9 ]{1,80} (licensed|released|distributed) under ", " see (the )?(license|licence|copying)( file)?( for (more )?(details|information))?$"
TAG = "spdx license identifier"


def bare_notice(piece: Column) -> Column:
    """A normalised piece without a notice's subject and reference to a file."""
    return F.regexp_replace(F.regexp_replace(piece, SUBJECT, "$1 under "), TAIL, "")


def each_tagged(piece: Column) -> Column:
    """The licences of a tag, each with a tag of its own, with bars between."""
    kept = F.replace(piece, F.lit(" or later"), F.lit(" or_later"))
    return F.replace(F.regexp_replace(kept, " (or|and) ", f"|{TAG}|"), F.lit(" or_later"), F.lit(" or later"))


def known_pattern(sentences: list[str]) -> str:
    """A regular expression for known sentences in joined pieces: whole pieces, as many as follow each other with one bar between."""
    longest = sorted(sentences, key=lambda t: (-len(t), t))
    return r"(?<=\|)(?:" + "|".join(t.replace(" ", "[ |]") for t in longest) + r")(?=\|)"


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, list[str]] | None = None, rules: list | None = None
) -> DataFrame:
    """The licences that a document's sentences state.

    Known sentences are found in the whole text, on one line or wrapped over the lines of a
    paragraph (also in comments, whose markers aren't letters); where two begin at the same
    place, the longer one counts. A notice may have a subject before it ("Foo is licensed under ...") and
    a reference to a file after it, on its line; a tag may name several licences. n_sentences counts lines and what sentence ends cut them into.
    The identifiers found, in order of the text, are held against the rules in
    order. Returns one row per document: doc_id, n_sentences, n_known, known (identifiers in
    order), license (of the first rule that matches, else null) and licenses (of every rule that
    matches, once each, in order of the rules). Null and empty texts have no sentences; repeated
    rows get equal results; an empty table gives an empty result; other columns are not read.
    There is no shuffle.
    """
    sentences = SENTENCES if sentences is None else sentences
    rules = RULES if rules is None else rules
    known = F.create_map(*[F.lit(x) for name, texts in sentences.items() for t in texts for x in (t, name)])
    pattern = known_pattern([t for texts in sentences.values() for t in texts])
    split = docs.select(F.col(id_col).alias("doc_id"), pieces_of(text_of(text_col)).alias("pieces"))
    met = F.regexp_extract_all(F.concat(F.lit("|"), F.array_join("pieces", "")), F.lit(pattern), F.lit(0))
    found = split.select(
        "doc_id", F.size(F.filter("pieces", lambda s: ~s.startswith("|"))).cast("long").alias("n_sentences"),
        F.transform(met, lambda s: F.element_at(known, F.translate(s, "|", " "))).alias("ids"),
    )
    match = F.array_compact(F.array(*[F.when(rule_met(F.col("ids"), ids), F.lit(name)) for name, ids in rules]))
    return found.withColumn("matched", F.array_distinct(match)).select(
        "doc_id", "n_sentences", F.size("ids").cast("long").alias("n_known"), F.array_join("ids", " ").alias("known"),
        F.get("matched", F.lit(0)).alias("license"), F.array_join("matched", " ").alias("licenses"),
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


QUERIES = {"op4_license_scan": op4_license_scan}

_KNOWN = ", ".join(f"'{t}': '{name}'" for name, texts in SENTENCES.items() for t in texts)
_PATTERN = lambda ids: "(^| )" + " (.* )?".join(ids) + " "
_MATCHED = ", ".join(f"CASE WHEN regexp_matches(seq, '{_PATTERN(ids)}') THEN '{name}' END" for name, ids in RULES)
_DISTINCT = "list_filter(matched, lambda x, i: x IS NOT NULL AND list_position(matched, x) = i)"

ORACLE_SQL = {
    "op4_license_scan": rf"""
WITH cut AS (
  SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?;:])[\x20\x09-\x0D]+', '\1' || chr(10), 'g'), chr(10)) AS parts FROM documents
), sentences AS (
  SELECT doc_id, list_filter(list_transform(parts, lambda s: trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))), lambda s: s <> '') AS s FROM cut
), bare AS (
  SELECT doc_id, len(s) AS n_sentences, list_transform(s, lambda x: regexp_replace(regexp_replace(x, '{SUBJECT}', '\1 under '), '{TAIL}', '')) AS s FROM sentences
), found AS (
  SELECT doc_id, n_sentences, list_filter(list_transform(s, lambda x: (MAP {{{_KNOWN}}})[x]), lambda x: x IS NOT NULL) AS ids FROM bare
), ruled AS (
  SELECT *, coalesce(array_to_string(ids, ' '), '') || ' ' AS seq FROM found
), named AS (
  SELECT *, [{_MATCHED}] AS matched FROM ruled
)
SELECT doc_id, n_sentences, len(ids) AS n_known, coalesce(array_to_string(ids, ' '), '') AS known,
       ({_DISTINCT})[1] AS license, coalesce(array_to_string({_DISTINCT}, ' '), '') AS licenses
FROM named
"""
}
