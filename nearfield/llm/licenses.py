"""Licence scans by sentence rules.

A text is cut into sentences at line feeds and at full stops, colons and semicolons before white space or the end.
Sentences are normalised (A-Z lower-cased, everything but letters and digits to one space) and mapped to the
identifiers of known licence sentences; a licence is found where the identifiers of one of its rules stand in
order, with no other sentence between.  Licences' own texts and notices are mostly wrapped, and may follow a copyright
line without a stop: for them the lines of a paragraph are joined before the cut, comment marks are dropped, and long
sentences may end what a stop ends.  The identifiers given are those of the lines as they are.  JVM expressions only: one pass over the texts, nothing shuffled.

Edge cases: NULL and empty texts have no sentences; rows that repeat get equal results; a very long text is read whole;
ids are passed on as they are; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import documents

# Normalised licence sentences and their identifiers.
SENTENCES = {
    "licensed under the apache license version 2 0": "apache2_ref",
    "licensed under the apache license version 2 0 the license": "apache2_head",
    "you may not use this file except in compliance with the license": "apache2_comply",
    "you may obtain a copy of the license at": "apache2_copy",
    "this work is licensed under the gnu general public license version 3": "gpl3_ref",
    "this program is free software": "gpl_free",
    "you can redistribute it and or modify it under the terms of the gnu general public license": "gpl_terms",
    "released under the mit license": "mit_ref",
    "licensed under the mit license": "mit_ref",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit_grant",
    "the software is provided as is without warranty of any kind": "mit_warranty",
    "licensed under cc by nc 4 0": "ccbync4_ref",
    "licensed under cc by 4 0": "ccby4_ref",
    "licensed under cc by sa 4 0": "ccbysa4_ref",
    "all rights reserved": "arr",
    "redistribution and use in source and binary forms are permitted": "bsd_grant",
}
# Licences and the identifier sequences that tell them, most specific first.
RULES = (
    ("Apache-2.0", ("apache2_head", "apache2_comply", "apache2_copy")),
    ("Apache-2.0", ("apache2_head", "apache2_comply")),
    ("Apache-2.0", ("apache2_ref",)),
    ("GPL-3.0", ("gpl3_ref",)),
    ("GPL", ("gpl_free", "gpl_terms")),
    ("MIT", ("mit_grant", "mit_warranty")),
    ("MIT", ("mit_ref",)),
    ("CC-BY-NC-4.0", ("ccbync4_ref",)),
    ("CC-BY-4.0", ("ccby4_ref",)),
    ("CC-BY-SA-4.0", ("ccbysa4_ref",)),
    ("BSD", ("bsd_grant",)),
    ("Proprietary", ("arr",)),
)
# Whole sentences of the licences' own texts and notices, normalised, and their identifiers.
_GNU = "you can redistribute it and or modify it under the terms of the gnu {} public license"
_GNU_KINDS = {"gpl": "general", "lgpl": "lesser general", "lgpl_old": "library general", "agpl": "affero general"}
_GNU_VERSIONS = {"2": "2", "2_1": "2 1", "3": "3"}
FULL_SENTENCES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "full_mit_grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "full_mit_notice",
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software": "full_mit_notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "full_mit_warranty",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "full_bsd_grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "full_isc_grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "full_isc_grant",
    "this source code form is subject to the terms of the mozilla public license v": "full_mpl_notice",
    "2 0": "full_v2_0",
    "licensed under the apache license version 2 0 the license": "apache2_head",
    "mozilla public license version 2 0": "full_mpl_title",
    "gnu general public license version 3 29 june 2007": "full_gpl_title_3",
    "gnu general public license version 2 june 1991": "full_gpl_title_2",
    "gnu lesser general public license version 3 29 june 2007": "full_lgpl_title_3",
    "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below": "full_lgpl_title_3",
    "gnu lesser general public license version 2 1 february 1999": "full_lgpl_title_2_1",
    "gnu affero general public license version 3 19 november 2007": "full_agpl_title_3",
    **{f"{_GNU.format(words)} as published by the free software foundation": f"full_{kind}" for kind, words in _GNU_KINDS.items()},
    **{f"either version {v} of the license or at your option any later version": f"full_later_{n}" for n, v in _GNU_VERSIONS.items()},
    **{f"version {v} of the license": f"full_only_{n}" for n, v in _GNU_VERSIONS.items()},
    **{f"{_GNU.format(words)} as published by the free software foundation {tail}": f"full_{kind}_{n}" for kind, words in _GNU_KINDS.items() for n, v in _GNU_VERSIONS.items() for tail in (f"either version {v} of the license or at your option any later version", f"version {v} of the license")},
    **{f"{_GNU.format(words)} version {v} as published by the free software foundation": f"full_{kind}_{n}" for kind, words in _GNU_KINDS.items() for n, v in _GNU_VERSIONS.items()},
}
FULL_RULES = (
    ("MIT", ("full_mit_grant", "full_mit_notice", "full_mit_warranty")),
    ("BSD", ("full_bsd_grant",)),
    ("ISC", ("full_isc_grant",)),
    ("MPL-2.0", ("full_mpl_notice", "full_v2_0")),
    ("MPL-2.0", ("full_mpl_title",)),
    *[
        (name, ids)
        for name, kind, n in (("GPL-3.0", "gpl", "3"), ("GPL-2.0", "gpl", "2"), ("LGPL-3.0", "lgpl", "3"), ("LGPL-2.1", "lgpl", "2_1"), ("LGPL-2.0", "lgpl", "2"), ("LGPL-2.0", "lgpl_old", "2"), ("AGPL-3.0", "agpl", "3"))
        for ids in ((f"full_{kind}_{n}",), (f"full_{kind}", f"full_later_{n}"), (f"full_{kind}", f"full_only_{n}"), (f"full_{kind}_title_{n}",))
    ],
)
#: Sentences so long may follow other words without a stop (a copyright line, on one line with the grant).
FULL_LONG = 55
#: What a comment around a text puts before its lines, and words without which no text needs its paragraphs joined.
MARKS = r"(?m)^[ \t]*+(?:(?:/?\*+/?|#+|//+|--+|;+|%+|>+)[ \t]*+)?+"
LIKELY = r"(?i)licen[sc]e|permission|redistribut|reserved"
CUT = r"[\n]+|[.;:]+(?=\s|$)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sentences(text: Column) -> Column:
    """Normalised sentences that are not empty, in order."""
    clean = lambda s: F.trim(F.regexp_replace(F.translate(s, _UPPER, _LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.filter(F.transform(F.split(text, CUT, -1), clean), lambda s: s != "")


def scan(docs: DataFrame, text_col: str = "text", id_cols: tuple[str, ...] = ("doc_id",), known=SENTENCES, rules=RULES) -> DataFrame:
    """id_cols, n_sentences, ids (identifier of each sentence or ""), licenses (distinct, in rule order)."""
    ids = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(*id_cols, sentences(text).alias("_s"), _paragraph_ids(text, known).alias("_p"))
    seq = base.select(*id_cols, "_p", F.size("_s").cast("bigint").alias("n_sentences"), F.transform("_s", lambda s: F.coalesce(F.try_element_at(ids, s), F.lit(""))).alias("ids"))
    seq = seq.withColumn("licenses", F.array_distinct(F.concat(_told("ids", rules), _told("_p", (*rules, *FULL_RULES)))))
    return seq.drop("_p")


def _told(ids: str, rules) -> Column:
    """The licences whose identifiers stand in order."""
    line = F.concat(F.lit(","), F.array_join(ids, ","), F.lit(","))
    hits = F.array(*[F.when(F.contains(line, F.lit("," + ",".join(ids_) + ",")), F.lit(name)) for name, ids_ in rules])
    return F.array_compact(hits)


def _paragraph_ids(text: Column, known) -> Column:
    """Identifiers of the sentences of text's paragraphs, in which wrapped lines are joined."""
    plain = F.regexp_replace(F.regexp_replace(F.translate(text, "\u201c\u201d\u2018\u2019\u00a0\r", "      "), MARKS, ""), r"[ \t]+\n", "\n")
    joined = F.regexp_replace(plain, r"(?<!\n)\n(?!\n)", " ")
    ids = F.create_map(*[F.lit(x) for pair in (known | FULL_SENTENCES).items() for x in pair])
    after = lambda s: F.coalesce(*[F.when(F.endswith(s, F.lit(" " + t)), F.lit(i)) for t, i in FULL_SENTENCES.items() if len(t) >= FULL_LONG])
    one = lambda s: F.coalesce(F.try_element_at(ids, s), F.when(F.length(s) > FULL_LONG, after(s)), F.lit(""))
    return F.when(text.rlike(LIKELY), F.transform(sentences(joined), one)).otherwise(F.array().cast("array<string>"))


def query(spark, sf_dir: str) -> DataFrame:
    got = scan(documents(spark, sf_dir))
    known = F.filter("ids", lambda x: x != "")
    return got.select("doc_id", "n_sentences", F.size(known).cast("bigint").alias("n_known"), F.array_join(known, ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


def _oracle() -> str:
    cases = " ".join(f"WHEN '{s}' THEN '{i}'" for s, i in SENTENCES.items())
    hits = ", ".join(f"CASE WHEN contains(line, ',{','.join(ids)},') THEN '{name}' END" for name, ids in RULES)
    order = "[" + ", ".join(f"'{n}'" for n in dict.fromkeys(n for n, _ in RULES)) + "]"
    return rf"""
WITH s AS (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(coalesce(text, ''), '[.;:]+(\s|$)', chr(10), 'g'), '[\n]+'),
     lambda x: trim(regexp_replace(translate(x, '{_UPPER}', '{_LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'))), lambda x: x <> '') AS s FROM documents),
i AS (SELECT doc_id, len(s) AS n_sentences, list_transform(s, lambda x: CASE x {cases} ELSE '' END) AS ids FROM s),
l AS (SELECT *, ',' || array_to_string(ids, ',') || ',' AS line, list_filter(ids, lambda x: x <> '') AS known FROM i)
SELECT doc_id, n_sentences, len(known) AS n_known, coalesce(array_to_string(known, ','), '') AS sentence_ids,
       coalesce(array_to_string(list_filter({order}, lambda x: list_contains([{hits}], x)), ','), '') AS licenses FROM l"""


ORACLE_SQL = _oracle()
