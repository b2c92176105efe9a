"""Licence scans by sentence rules, as one Spark projection.

A text is cut into sentences: at ``.``, ``!``, ``?``, ``:`` or ``;`` before white space or the end, and at lines without
letters or digits (so that an empty comment line ends a paragraph). Line ends within a sentence don't count: wrapped
texts and comment blocks read like plain ones. Sentences are normalised (A-Z lower-cased, all but a-z and 0-9 to single
spaces, which takes comment marks and quotes away) and mapped to the identifiers of known licence sentences; of an
unknown sentence each line is looked up by itself, for notices without a full stop. The rest is dropped. The
identifiers of a text, in order, are matched against rules: a rule is one or more sequences of identifiers and fires
where the text's identifiers hold one without a gap. Rules are tried in order, whole texts and headers before notices;
a rule takes the identifiers it matches away, so that a header isn't reported again as a notice.

Cases: null, empty and unknown texts have no sentences and no licences (empty strings); a repeated sentence gives its
identifier each time; a licence found several times is named once; repeated rows stay rows; very long texts are cut
like others; an empty table gives no rows; other columns are not read. Known sentences and rules are parameters of
bounded size that become part of the expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.quality import let

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAK = r"[.!?:;]+(?:[\x20\x09-\x0D]+|$)|\n(?:[^a-z0-9\n]*\n)+"

# Sentences of public licence texts and of their headers, as they stand there, by identifier.
TEXTS = {
    "mit-grant": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
      files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
      publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
      subject to the following conditions""",
    "mit-keep": """The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software""",
    "as-is": """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
      MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT""",
    "mit-liability": """IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
      ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE""",
    "isc-grant": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
      provided that the above copyright notice and this permission notice appear in all copies""",
    "0bsd-grant": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted""",
    "isc-as-is": """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
      WARRANTIES OF MERCHANTABILITY AND FITNESS""",
    "isc-liability": """IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER
      RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
      CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE""",
    "bsd-grant": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
      conditions are met""",
    "bsd-source": """Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer""",
    "bsd-binary": """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
      in the documentation and/or other materials provided with the distribution""",
    "bsd-advertising": """All advertising materials mentioning features or use of this software must display the following acknowledgement""",
    "bsd-endorse": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
      from this software without specific prior written permission""",
    "bsd-as-is": """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
      NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED""",
    "apache-notice": """Licensed under the Apache License, Version 2.0 (the "License")""",
    "apache-compliance": """you may not use this file except in compliance with the License""",
    "apache-copy": """You may obtain a copy of the License at""",
    "apache-basis": """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
      BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied""",
    "apache-see": """See the License for the specific language governing permissions and limitations under the License""",
    "free-program": """This program is free software""",
    "free-library": """This library is free software""",
    "gpl-free": """you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
      Foundation""",
    "gpl3-later": """you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
      Foundation, either version 3 of the License, or (at your option) any later version""",
    "lgpl-free": """you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free
      Software Foundation""",
    "lgpl3-later": """you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free
      Software Foundation, either version 3 of the License, or (at your option) any later version""",
    "agpl3-later": """you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free
      Software Foundation, either version 3 of the License, or (at your option) any later version""",
    "version-2-later": """either version 2 of the License, or (at your option) any later version""",
    "version-2.1-later": """either version 2.1 of the License, or (at your option) any later version""",
    "version-3-later": """either version 3 of the License, or (at your option) any later version""",
    "gpl-hope": """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY""",
    "lgpl-hope": """This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY""",
    "gpl-implied": """without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE""",
    "gpl-see": """See the GNU General Public License for more details""",
    "lgpl-see": """See the GNU Lesser General Public License for more details""",
    "agpl-see": """See the GNU Affero General Public License for more details""",
    "mpl-subject": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0""",
    "mpl-subject-tail": """This Source Code Form is subject to the terms of the Mozilla Public License, v""",
    "mpl-copy": """If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/""",
    "unlicense": """This is free and unencumbered software released into the public domain""",
    "unlicense-anyone": """Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as
      a compiled binary, for any purpose, commercial or non-commercial, and by any means""",
    "boost-notice": """Distributed under the Boost Software License, Version 1.0""",
    "zlib-as-is": """This software is provided 'as-is', without any express or implied warranty""",
    "zlib-liability": """In no event will the authors be held liable for any damages arising from the use of this software""",
    "zlib-grant": """Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
      redistribute it freely, subject to the following restrictions""",
    "wtfpl": """You just DO WHAT THE FUCK YOU WANT TO""",
    "epl2-terms": """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is
      available at https://www.eclipse.org/legal/epl-2.0/""",
    "eupl-notice": """Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the
      EUPL (the "Licence")""",
    "cc0-waiver": """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work""",
    "gfdl-grant": """Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License,
      Version 1.3 or any later version published by the Free Software Foundation""",
    "reserved": """All rights reserved""",
}
# Shorter forms in which some of the sentences are met.
SHORTER = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy",
    "as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND',
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "bsd-source": "Redistributions of source code must retain the above copyright notice",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice",
    "gpl-hope": "This program is distributed in the hope that it will be useful",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "epl2-terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
}
# What a notice speaks of, how, and the licences it names.
SUBJECTS = ("", *(f"this {x} is " for x in ("file", "project", "software", "work", "code", "program", "library", "package", "repository")))
VERBS = tuple(x + y for x in ("released under ", "licensed under ", "distributed under ") for y in ("", "the terms of "))
NOTICES = {
    "the mit license": "mit-notice", "the isc license": "isc-notice", "the apache license version 2 0": "apache-notice",
    "the bsd 2 clause license": "bsd2-notice", "the bsd 3 clause license": "bsd3-notice", "the unlicense": "unlicense-notice",
    "the gnu general public license version 2": "gpl2-notice", "the gnu general public license version 3": "gpl3-notice",
    "the gnu lesser general public license version 2 1": "lgpl21-notice", "the gnu lesser general public license version 3": "lgpl3-notice",
    "the gnu affero general public license version 3": "agpl3-notice", "the mozilla public license version 2 0": "mpl2-notice",
    "the eclipse public license version 2 0": "epl2-notice", "the boost software license version 1 0": "boost-notice", "the zlib license": "zlib-notice",
}
CC = {f"cc {x} 4 0": f"cc-{x.replace(' ', '-')}-notice" for x in ("by", "by nc", "by sa", "by nd", "by nc sa", "by nc nd")} | {"cc0 1 0": "cc0-notice"}
CC_NAMES = {
    "attribution": "by", "attribution noncommercial": "by-nc", "attribution sharealike": "by-sa", "attribution noderivatives": "by-nd",
    "attribution noncommercial sharealike": "by-nc-sa", "attribution noncommercial noderivatives": "by-nc-nd",
}
# Identifiers of the SPDX list that a tag may give.
SPDX = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0",
    "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "EUPL-1.2", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later",
    "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "WTFPL", "Zlib",
)
# Rules in order: a name and the sequences it stands for.
RULES = (
    ("MIT-text", (("mit-grant", "mit-keep", "as-is", "mit-liability"), ("mit-grant", "as-is"))),
    ("ISC-text", (("isc-grant", "isc-as-is", "isc-liability"),)),
    ("0BSD-text", (("0bsd-grant", "isc-as-is", "isc-liability"),)),
    ("BSD-4-Clause", (("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising"),)),
    ("BSD-3-Clause", (("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"),)),
    ("BSD-2-Clause", (("bsd-grant", "bsd-source", "bsd-binary"),)),
    ("Apache-2.0-header", (("apache-notice", "apache-compliance", "apache-copy", "apache-basis", "apache-see"), ("apache-notice", "apache-compliance", "apache-copy"))),
    ("GPL-2.0-or-later-header", (("free-program", "gpl-free", "version-2-later", "gpl-hope"),)),
    ("GPL-3.0-or-later-header", (("free-program", "gpl3-later", "gpl-hope"), ("free-program", "gpl-free", "version-3-later", "gpl-hope"))),
    ("GPL-header", (("gpl-free", "gpl-hope"),)),
    ("LGPL-2.1-or-later-header", (("free-library", "lgpl-free", "version-2.1-later", "lgpl-hope"),)),
    ("LGPL-3.0-or-later-header", (("free-program", "lgpl3-later", "gpl-hope"), ("free-library", "lgpl3-later", "lgpl-hope"))),
    ("AGPL-3.0-or-later-header", (("free-program", "agpl3-later", "gpl-hope"),)),
    ("MPL-2.0-header", (("mpl-subject", "mpl-copy"), ("mpl-subject-tail", "mpl-copy"))),
    ("Unlicense-text", (("unlicense", "unlicense-anyone"),)),
    ("Zlib-text", (("zlib-as-is", "zlib-liability", "zlib-grant"),)),
    ("WTFPL", (("wtfpl",),)),
    ("EPL-2.0", (("epl2-terms",), ("epl2-notice",))),
    ("EUPL-1.2", (("eupl-notice",),)),
    ("CC0-1.0", (("cc0-waiver",), ("cc0-notice",))),
    ("GFDL-1.3-or-later", (("gfdl-grant",),)),
    *((f"spdx:{x}", ((f"spdx-{x}",),)) for x in SPDX),
    ("AGPL-3.0", (("agpl3-notice",),)),
    ("Apache-2.0", (("apache-notice",),)),
    ("BSD-2-Clause-notice", (("bsd2-notice",),)),
    ("BSD-3-Clause-notice", (("bsd3-notice",),)),
    ("BSL-1.0", (("boost-notice",),)),
    *((f"CC-{x.upper()}-4.0", ((f"cc-{x}-notice",),)) for x in CC_NAMES.values()),
    ("GPL-2.0", (("gpl2-notice",),)),
    ("GPL-3.0", (("gpl3-notice",),)),
    ("ISC", (("isc-notice",),)),
    ("LGPL-2.1", (("lgpl21-notice",),)),
    ("LGPL-3.0", (("lgpl3-notice",),)),
    ("MIT", (("mit-notice",),)),
    ("MPL-2.0", (("mpl2-notice",),)),
    ("Unlicense", (("unlicense-notice",), ("unlicense",))),
    ("Zlib", (("zlib-notice",),)),
    ("all-rights-reserved", (("reserved",),)),
)


def bare(sentence: str) -> str:
    """A sentence as texts are normalised."""
    plain = "".join(c if c.isascii() and c.isalnum() else " " for c in sentence.lower())
    return " ".join(plain.split())


def known_sentences() -> dict[str, str]:
    """Every known sentence, normalised, with its identifier."""
    found = {bare(text): name for names in (TEXTS, SHORTER) for name, text in names.items()}
    found |= {s + v + what: name for s in SUBJECTS for v in VERBS for what, name in (NOTICES | CC).items()}
    found["licensed under the apache license version 2 0 the license"] = "apache-notice"
    for words, name in CC_NAMES.items():
        for s in SUBJECTS:
            found[f"{s}licensed under a creative commons {words} 4 0 international license"] = f"cc-{name}-notice"
    found |= {f"spdx license identifier {bare(x)}": f"spdx-{x}" for x in SPDX}
    return found


SENTENCES = known_sentences()
#: The tag stays one sentence.
TAG, TAG_PLAIN = r"spdx-license-identifier\s*:\s*", "spdx license identifier "


def identifiers(text: Column, sentences: dict[str, str] = SENTENCES) -> Column:
    """The identifiers of a text's known sentences, in order."""
    low = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), TAG, TAG_PLAIN)
    plain = lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))
    known = lambda s: s.isin(sorted(sentences))

    def of(sentence: Column) -> Column:
        whole = lambda p: F.when(known(p), F.array(p)).otherwise(
            F.filter(F.transform(F.split(sentence, "\n"), plain), known)
        )
        return let(plain(sentence), whole)

    found = F.flatten(F.transform(F.split(low, BREAK), of))
    names = F.create_map(*[F.lit(x) for kv in sorted(sentences.items()) for x in kv])
    return F.transform(found, lambda s: F.element_at(names, s))


def wrapped(ids: tuple[str, ...]) -> str:
    return "".join(f"<{i}>" for i in ids)


def scan_licences(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules=RULES) -> DataFrame:
    """doc_id, n_sentences (known ones), sentence_ids, licences (names of the rules that fire, in rule order)."""
    steps = [F.struct(F.lit(name).alias("name"), F.lit(wrapped(ids)).alias("ids")) for name, ways in rules for ids in ways]
    start = lambda ids: F.struct(
        F.array_join(F.transform(ids, lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "").alias("trail"),
        F.array().cast("array<string>").alias("names"),
    )

    def step(s: Column, rule: Column) -> Column:
        taken = F.struct(
            F.replace(s["trail"], rule["ids"], F.lit("<>")).alias("trail"), F.array_append(s["names"], rule["name"]).alias("names")
        )
        return F.when(s["trail"].contains(rule["ids"]), taken).otherwise(s)

    names = F.when(F.size("ids") == 0, F.lit("")).otherwise(
        F.array_join(F.array_distinct(F.aggregate(F.array(*steps), start(F.col("ids")), step)["names"]), ",")
    )
    return docs.select("doc_id", F.transform(F.array("text"), lambda t: identifiers(t, sentences))[0].alias("ids")).select(
        "doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", "|").alias("sentence_ids"), names.alias("licences")
    )


def scan_sql(sentences: dict[str, str] = SENTENCES, rules=RULES) -> str:
    """The same scan as SQL for DuckDB: sentences by joins, rules by a chain of columns."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    keys, values = (", ".join(map(quote, x)) for x in zip(*sorted(sentences.items())))
    columns, names, at = [], [], 0
    for name, ways in rules:
        hits = []
        for ids in ways:
            hits.append(f"contains(t{at}, {quote(wrapped(ids))})")
            columns.append(f"replace(t{at}, {quote(wrapped(ids))}, '<>') as t{at + 1}")
            at += 1
        names.append(f"case when {' or '.join(hits)} then {quote(name)} end")
    plain = lambda s: f"trim(regexp_replace({s}, '[^a-z0-9]+', ' ', 'g'))"
    return rf"""
with known as (select unnest([{keys}]) as sentence, unnest([{values}]) as id),
low as (select doc_id, row_number() over () as r, regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TAG}', '{TAG_PLAIN}', 'g') as text from documents),
cut as (select r, string_split_regex(text, '{BREAK}') as parts from low),
parts as (select r, unnest(parts) as part, generate_subscripts(parts, 1) as i from cut),
whole as (select r, i, 0 as j, id from parts join known on sentence = {plain('part')}),
rest as (select r, i, string_split(part, chr(10)) as lines from parts anti join whole using (r, i)),
lines as (select r, i, unnest(lines) as line, generate_subscripts(lines, 1) as j from rest),
found as (select r, i, j, id from whole union all select r, i, j, id from lines join known on sentence = {plain('line')}),
named as (select r, count(*) as n, string_agg(id, '|' order by i, j) as ids, string_agg('<' || id || '>', '' order by i, j) as t from found group by r),
trails as (select doc_id, coalesce(n, 0) as n_sentences, coalesce(ids, '') as sentence_ids, coalesce(t, '') as t0 from low left join named using (r)),
ruled as (select *, {', '.join(columns)} from trails)
select doc_id, n_sentences, sentence_ids, concat_ws(',', {', '.join(names)}) as licences from ruled"""
