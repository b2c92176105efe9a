"""Licence phrases: known sentences and notices wherever a sentence, a line or a part after a semicolon begins with one.

Looser than ``licence_rules``: what follows a phrase doesn't count, so shortened and continued sentences are found too.
The identifiers of a text, in order, are matched against rules: a rule is a sequence of identifiers, and it is found
where the text's identifiers hold that sequence without a gap.

Cases: null, empty and unknown texts have no phrases and no licences (empty strings); a repeated phrase gives its
identifier each time; repeated rows stay rows; an empty table gives no rows; other columns are not read. Known phrases
and rules are parameters of bounded size that become part of the expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.quality import let

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Sentences of public licence texts, normalised, and their identifiers.
SENTENCES = {
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "this project is licensed under the terms of the mit license": "mit-notice",
    "licensed under the apache license version 2 0": "apache-notice",
    "licensed under the apache license version 2 0 the license": "apache-notice",
    "you may not use this file except in compliance with the license": "apache-compliance",
    "you may obtain a copy of the license at": "apache-copy",
    "this work is licensed under the gnu general public license version 3": "gpl3-notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl-free",
    "this program is distributed in the hope that it will be useful": "gpl-hope",
    "licensed under cc by nc 4 0": "cc-by-nc-notice",
    "licensed under cc by 4 0": "cc-by-notice",
    "licensed under cc by sa 4 0": "cc-by-sa-notice",
    "all rights reserved": "reserved",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit-grant",
    "the software is provided as is without warranty of any kind": "as-is",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd-grant",
    "redistributions of source code must retain the above copyright notice": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice": "bsd-binary",
}
# Rules in order; a licence may have several.
RULES = (
    ("Apache-2.0", ("apache-notice",)),
    ("Apache-2.0-header", ("apache-notice", "apache-compliance", "apache-copy")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("CC-BY-4.0", ("cc-by-notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-notice",)),
    ("GPL-3.0", ("gpl3-notice",)),
    ("GPL-header", ("gpl-free", "gpl-hope")),
    ("MIT", ("mit-notice",)),
    ("MIT-text", ("mit-grant", "as-is")),
    ("all-rights-reserved", ("reserved",)),
)


# Who or what a notice speaks of, and how.
SUBJECTS = ("", *(f"this {x} is " for x in ("file", "project", "software", "work", "code", "program", "library", "package", "repository")))
VERBS = tuple(x + y for x in ("released under ", "licensed under ", "distributed under ") for y in ("", "the terms of "))
NOTICES = {
    "the mit license": "mit-notice",
    "the apache license version 2 0": "apache-notice",
    "the gnu general public license version 3": "gpl3-notice",
    "cc by 4 0": "cc-by-notice",
    "cc by nc 4 0": "cc-by-nc-notice",
    "cc by sa 4 0": "cc-by-sa-notice",
}
#: Phrases that licence texts and notices begin a sentence, a line or a part after a semicolon with.
PHRASES = SENTENCES | {s + v + n: x for s in SUBJECTS for v in VERBS for n, x in NOTICES.items()}
#: A sentence's end and an empty line end a phrase (|). A single line end (~) or semicolon (^) does not, but one may begin there.
HARD = r"[.!?]+(?:[\x20\x09-\x0D]+|\z)"


def phrase_pattern(phrases: dict[str, str]) -> str:
    longest = sorted(phrases, key=lambda x: (-len(x), x))
    return "[|~^] (" + "|".join(x.replace(" ", " (?:[~^] )*") for x in longest) + ") "


def phrase_identifiers(text: Column, phrases: dict[str, str] = PHRASES) -> Column:
    """The identifiers of the known phrases in a text, in order; lines may be wrapped anywhere between words."""
    s = F.translate(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), "|~^", "   ")
    s = F.translate(F.regexp_replace(s, HARD, "|"), "\n;", "~^")
    for mark in "|~^":
        s = F.replace(s, F.lit(mark), F.lit(f" {mark} "))
    s = F.regexp_replace(F.concat(F.lit("| "), s, F.lit(" ")), "[^a-z0-9|~^]+", " ")
    s = F.regexp_replace(s, "~ (?:~ )+", "| ")
    found = F.regexp_extract_all(s, F.lit(phrase_pattern(phrases)), F.lit(1))
    names = F.create_map(*[F.lit(x) for kv in sorted(phrases.items()) for x in kv])
    return F.transform(found, lambda x: F.element_at(names, F.regexp_replace(x, "[~^] ", "")))


def scan_licence_texts(docs: DataFrame, phrases: dict[str, str] = PHRASES, rules=RULES) -> DataFrame:
    """The columns of ``scan_licences``, from whole licence texts and notices, wrapped or not."""
    trail = F.concat(F.lit("|"), F.array_join("ids", "|"), F.lit("|"))

    def named(t: Column) -> Column:
        found = [F.when(t.contains("|" + "|".join(ids) + "|"), F.lit(name)) for name, ids in rules]
        return F.concat_ws(",", *found)

    return docs.select("doc_id", phrase_identifiers(F.col("text"), phrases).alias("ids")).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_sentences"),
        F.array_join("ids", "|").alias("sentence_ids"),
        let(trail, named).alias("licences"),
    )


def scan_texts_sql(phrases: dict[str, str] = PHRASES, rules=RULES) -> str:
    """``scan_licence_texts`` as SQL for DuckDB."""
    quote = lambda x: "'" + x + "'"
    keys, values = (", ".join(map(quote, x)) for x in zip(*sorted(phrases.items())))
    found = ", ".join(
        f"case when contains(trail, {quote('|' + '|'.join(ids) + '|')}) then {quote(name)} end" for name, ids in rules
    )
    return rf"""
with low as (select doc_id, translate(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '|~^', '   ') as s from documents),
cut as (select doc_id, translate(regexp_replace(s, '{HARD}', '|', 'g'), chr(10) || ';', '~^') as s from low),
apart as (select doc_id, '| ' || replace(replace(replace(s, '|', ' | '), '~', ' ~ '), '^', ' ^ ') || ' ' as s from cut),
plain as (select doc_id, regexp_replace(regexp_replace(s, '[^a-z0-9|~^]+', ' ', 'g'), '~ (?:~ )+', '| ', 'g') as s from apart),
ids as (
  select doc_id, list_transform(regexp_extract_all(s, '{phrase_pattern(phrases)}', 1),
    lambda x: map([{keys}], [{values}])[regexp_replace(x, '[~^] ', '', 'g')]) as ids from plain),
trails as (
  select doc_id, len(ids)::bigint as n_sentences, coalesce(array_to_string(ids, '|'), '') as sentence_ids,
    '|' || coalesce(array_to_string(ids, '|'), '') || '|' as trail from ids)
select doc_id, n_sentences, sentence_ids, concat_ws(',', {found}) as licences from trails"""
