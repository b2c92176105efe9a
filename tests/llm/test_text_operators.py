"""Quality, BPE, SimHash, licences, fingerprints against plain Python."""

import hashlib
import itertools
import random
import re
import textwrap

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from foliant.llm import bpe, iblt, licence_rules, licences, quality, simhash
from foliant.llm.queries import RANKS, op2_licence_texts, op2_licences
from foliant.session import read_table
from tests.compare import differences, duck
from tests.llm.helpers import EDGES, PROSE, WORD, collect, doc, frame


def brute_quality(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen, hit = {}, set()
    for i, g in enumerate(grams):
        seen.setdefault(g, []).append(i)
    for at in seen.values():
        if len(at) > 1:
            hit |= {i + k for i in at for k in range(8)}
    n, rep = len(words), len(hit)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), rep,
            n < 20 or 100 * rep > 30 * n)


def test_quality_matches_plain_python(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    for df in (docs, frame(spark)):
        got = quality.quality_report(df).join(df.groupBy("doc_id").agg({"text": "max"}), "doc_id").collect()
        assert got
        for r in got:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(r["max(text)"])
            assert not (r.base_failed and r.kept)


def test_quality_filter_keeps_columns_and_good_rows(spark):
    df = frame(spark)
    got = quality.quality_filter(df)
    assert got.schema == df.schema
    ids = [r.doc_id for r in got.collect()]
    kept = [r.doc_id for r in quality.quality_report(df).where("kept").collect()]
    assert sorted(ids) == sorted(kept) and ids.count(4) == 2
    assert quality.quality_report(df.limit(0)).count() == 0


def codec():
    return bpe.Codec(bpe.load_ranks(public_tokenizers.path(RANKS)), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, special_tokens={},
        mergeable_ranks=bpe.load_ranks(public_tokenizers.path(RANKS)),
    )


def test_bpe_is_the_librarys(spark, sf, library):
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    for df in (docs, frame(spark).where("doc_id is not null").dropDuplicates(["doc_id"])):
        texts = {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}
        got = bpe.encode_documents(df, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, keep_ids=True)
        for r in got.collect():
            want = library.encode_ordinary(texts[r.doc_id])
            assert r.ids == want and r.n_tokens == len(want)
            assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
        back = {r.doc_id: r.text for r in bpe.decode_documents(got, public_tokenizers.path(RANKS)).collect()}
        assert back == texts
    assert bpe.encode_documents(docs.limit(0), public_tokenizers.path(RANKS), public_tokenizers.PATTERN).count() == 0


def test_bpe_on_odd_characters(library):
    c, rng = codec(), random.Random(1)
    odd = "ab \n\t\x1c\x1d\x1e\x1f\x85\u180e\u200b\u2028\u3000\u00a0'sLL0１٣é汉😀\u0301_-"
    for _ in range(400):
        text = "".join(rng.choice(odd) for _ in range(rng.randrange(40)))
        ids = c.encode(text)
        want = library.encode_ordinary(text)
        assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == want, repr(text)
        assert c.decode(ids).decode() == text


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """fps: list of (doc_id, fp) -> root per row."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i][1] ^ fps[j][1]).bit_count() <= 3:
            root[find(i)] = find(j)
    out = {}
    for i, (d, _) in enumerate(fps):
        out.setdefault(find(i), []).append(d)
    return [min((d for d in out[find(i)] if d is not None), default=None) for i in range(len(fps))]


def test_simhash_matches_all_pairs(spark, sf):
    near = [doc(100 + i, " ".join([*(f"w{k}" for k in range(300)), f"tail{i}"]), "near") for i in range(40)]
    for df in (read_table(spark, sf, "documents"), frame(spark, EDGES + near)):
        rows = df.select("doc_id", "text").collect()
        fps = [(r.doc_id, brute_fingerprint(r.text)) for r in rows]
        want = sorted(((d, f"{fp:016x}", c) for (d, fp), c in zip(fps, brute_components(fps))), key=repr)
        for most in (256, 2):  # with a bound of 2 nearly every bucket is dealt anew
            got = simhash.near_duplicates(df, bucket_most=most)
            assert collect(got, "doc_id", "fingerprint", "component_id") == want


def test_simhash_hot_bucket_loses_no_link(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = {base}
    while len(fps) < 300:  # one crowded ball, so all share index keys
        fps.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6))))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = {tuple(sorted(p)) for p in itertools.combinations(signed, 2) if ((p[0] ^ p[1]) & ((1 << 64) - 1)).bit_count() <= 3}
    got = {tuple(r) for r in simhash.links(df, bucket_most=8).collect()}
    assert got == want


def test_simhash_index_is_not_broadcast(spark):
    fps = spark.range(3000).select(F.xxhash64("id").alias("fp"))
    for most in (256, 2):
        plan = simhash.links(fps, bucket_most=most)._jdf.queryExecution().optimizedPlan().toString()
        joins = [x for x in plan.split("\n") if "Join Inner" in x]
        assert joins and all("merge" in x for x in joins)


def test_near_duplicate_stage_keeps_one(spark):
    df = frame(spark, [doc(1, PROSE), doc(2, PROSE), doc(2, PROSE), doc(3, "quite another text than that"), doc(None, PROSE)])
    got = simhash.drop_near_duplicates(df)
    assert got.schema == df.schema
    assert collect(got, "doc_id") == [(1,), (3,), (None,)]
    assert simhash.drop_near_duplicates(df.limit(0)).count() == 0


def test_near_duplicate_stage_keeps_other_texts_of_an_id(spark):
    other = "completely other words stand in this text of the same document id and share nothing"
    df = frame(spark, [doc(1, PROSE), doc(1, other), doc(2, PROSE), doc(1, other), doc(3, None), doc(4, " ")])
    kept = collect(simhash.drop_near_duplicates(df), "doc_id", "text")
    assert kept == sorted([(1, PROSE), (1, other), (3, None)], key=repr)


def five_word_similarity(a, b):
    one, two = ({tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in (a, b))
    return len(one & two) / len(one | two)


def test_near_duplicate_stage_links_at_four_fifths(spark):
    rng = random.Random(7)
    rows = []
    for i in range(60):  # pairs 2i, 2i + 1: words put in at intervals, for similarities on both sides of 0.8
        words = [f"w{rng.randrange(3000)}" for _ in range(400)]
        changed = list(words)
        for at in rng.sample(range(0, 400, 5), 4 + i % 12):
            changed[at] = f"new{i}x{at}"
        rows += [doc(2 * i, " ".join(words)), doc(2 * i + 1, " ".join(changed))]
    crowd = [f"c{k}" for k in range(400)]
    for i in range(150):  # one crowd around a text, whose members are mostly under 0.8 from each other
        changed = list(crowd)
        for at in rng.sample(range(0, 400, 5), 7):
            changed[at] = f"own{i}x{at}"
        rows.append(doc(1000 + i, " ".join(changed)))
    rows.append(doc(999, " ".join(crowd)))
    kept = {r.doc_id for r in simhash.drop_near_duplicates(frame(spark, rows)).collect()}
    by = {r[0]: r[1] for r in rows}
    near = {i: five_word_similarity(by[2 * i], by[2 * i + 1]) >= 0.8 for i in range(60)}
    assert 10 < sum(near.values()) < 50
    assert all(2 * i in kept for i in near)
    assert not [i for i, x in near.items() if not x and 2 * i + 1 not in kept]  # never one that is not similar
    assert sum(2 * i + 1 in kept for i, x in near.items() if x) <= 1  # a key is missed in four of 1,000
    assert {d for d in kept if d >= 999} == {999}


def test_lanes_tell_similarity():
    rng = np.random.default_rng(3)
    shared, own = rng.integers(0, 1 << 63, (50, 800)).astype(np.uint64), rng.integers(0, 1 << 63, (50, 200)).astype(np.uint64)
    same = [
        (simhash.lanes(np.append(s, o[:100])).view(np.uint8) == simhash.lanes(np.append(s, o[100:])).view(np.uint8)).mean()
        for s, o in zip(shared, own)
    ]
    assert abs(np.mean(same) - 0.8) < 0.03


def test_licences(spark):
    rows = [
        doc(1, "Some text. Released under the MIT License.\nAll rights reserved."),
        doc(2, "Licensed under the Apache License, Version 2.0."),
        doc(3, "Permission is hereby granted, free of charge, to any person obtaining a copy. The software is provided \"as is\", without warranty of any kind."),
        doc(4, "The software is provided \"as is\", without warranty of any kind! Permission is hereby granted, free of charge, to any person obtaining a copy."),
        doc(5, None), doc(6, ""), doc(7, "licensed under cc by-nc 4.0"),
    ]
    got = {r.doc_id: (r.n_sentences, r.licences) for r in licence_rules.scan_licences(frame(spark, rows)).collect()}
    assert got == {1: (2, "MIT,all-rights-reserved"), 2: (1, "Apache-2.0"), 3: (2, "MIT-text"), 4: (2, ""), 5: (0, ""),
                   6: (0, ""), 7: (1, "CC-BY-NC-4.0")}


LICENCE_TEXTS = {
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software, to deal in it. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions.""",
    "GPL-header": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY.""",
    "Apache-2.0,Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0""",
    "MIT": "This file is released under the MIT License, see LICENSE.",
}


def test_licence_texts_whole_and_wrapped(spark):
    rows, want = [], {}
    for name, text in LICENCE_TEXTS.items():
        for width in (10_000, 76, 40, 12):
            for start in ("", " * ", "# "):
                want[len(rows)] = name
                lines = textwrap.wrap(text, width, break_long_words=False, break_on_hyphens=False)
                rows.append(doc(len(rows), "Some title\n\n" + "\n".join(start + x for x in lines)))
    for text, name in (
        ("Licensed under CC BY 4.0\nmore", "CC-BY-4.0"), ("All rights\n\nreserved", ""), ("not all rights reserved", ""), ("All rights. Reserved", ""),
        ("All rights reservedly", ""), (None, ""), ("", ""), ("All | rights ~ reserved", "all-rights-reserved"),
    ):
        want[len(rows)] = name
        rows.append(doc(len(rows), text))
    df = frame(spark, rows)
    assert {r.doc_id: r.licences for r in licences.scan_licence_texts(df).collect()} == want


def test_licence_texts_equal_their_sql(spark, sf):
    assert differences(spark, duck(sf), sf, op2_licence_texts, licences.scan_texts_sql()) == ""


# Whole texts and headers as their licences print them (the copyright line and links included).
WHOLE = {
    "MIT-text": """MIT License

Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    "Apache-2.0-header": """Copyright 2020 Some Body

Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0-or-later-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "LGPL-2.1-or-later-header": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "MPL-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "ISC-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
}
WHOLE["BSD-3-Clause"] = WHOLE["BSD-2-Clause"].replace("THIS SOFTWARE IS", """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS""", 1)  # fmt: skip
WHOLE["GPL-2.0-or-later-header"] = WHOLE["LGPL-2.1-or-later-header"].replace("library", "program").replace("Lesser ", "").replace("2.1", "2")


def test_whole_licences_wrapped_and_in_comments(spark):
    rows, want = [], {}
    for name, text in WHOLE.items():
        for width in (60, 72, 80, 10_000):
            for start, end in (("", ""), (" * ", ""), ("# ", ""), ("// ", ""), ("", " ")):
                lines = [y + end for x in text.split("\n") for y in textwrap.wrap(x, width, break_long_words=False, break_on_hyphens=False) or [""]]
                want[len(rows)] = name
                rows.append(doc(len(rows), "Some title and words before it\n\n" + "\n".join(start + x for x in lines) + "\n\nmore words"))
    tags = {
        "// SPDX-License-Identifier: Apache-2.0\nint x;": "spdx:Apache-2.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.": "CC-BY-4.0",
        "This file is released under the MIT License\nand has more lines": "MIT", "We like the MIT License and all rights reserved here": "",
        "Licensed under CC BY 4.0.\nLicensed under CC BY 4.0.": "CC-BY-4.0", "All rights reserved\r\nx": "all-rights-reserved", "É. All rights reserved!": "all-rights-reserved",
    }
    for text, name in tags.items():
        want[len(rows)] = name
        rows.append(doc(len(rows), text))
    got = {r.doc_id: r.licences for r in licence_rules.scan_licences(frame(spark, rows)).collect()}
    assert {k: (v, got[k]) for k, v in want.items() if got[k] != v} == {}


def test_licence_rules_on_odd_rows_equal_their_sql(spark, sf, tmp_path):
    two = WHOLE["MIT-text"] + "\n\n" + WHOLE["MIT-text"] + " Licensed under the MIT License. " * 3
    rows = EDGES + [doc(20, two), doc(20, two), doc(21, "All rights reserved. " * 20_000), doc(22, "\n\n;;..\n"), doc(23, WHOLE["BSD-3-Clause"])]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    con = duck(sf)
    con.execute(f"create or replace view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert differences(spark, con, str(tmp_path), op2_licences, licence_rules.scan_sql()) == ""
    assert licence_rules.scan_licences(frame(spark, [])).count() == 0
    assert differences(spark, duck(sf), sf, op2_licences, licence_rules.scan_sql()) == ""


def pieces(text):
    found = []
    for line in (text or "").split("\n"):
        words = WORD.finditer(line)
        spans = [m.span() for m in words]
        for i in range(0, len(spans), iblt.PIECE):
            part = spans[i : i + iblt.PIECE]
            found.append(line[part[0][0] : part[-1][1]])
    return set(found)


def test_fingerprints_match_sets_of_paragraphs(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    edges = frame(spark).where("doc_id is null or doc_id not in (4)")
    for df in (docs, edges, frame(spark, [doc(1, PROSE)])):
        rows = sorted(((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()), key=lambda r: (r[0] is None, -(r[0] or 0)))
        want = {}
        for i, (d, t) in enumerate(rows):
            nxt = rows[(i + 1) % len(rows)][1]
            half = len(t) // 2
            edited = t[: len(t) - half] + nxt[:half]
            a, b, c = pieces(t), pieces(edited), pieces(nxt)
            like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
            want[d] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), round(like(a, b), 9), round(like(a, c), 9))
        got = {r.doc_id: (r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in iblt.compare_edits(df).collect()}
        assert got == want


def test_fingerprints_of_repeated_rows_and_no_rows(spark):
    df = frame(spark, [doc(1, PROSE), doc(1, PROSE), doc(2, "b\nc")])
    got = iblt.compare_edits(df).collect()
    assert len(got) == 3 and len({r.fingerprint for r in got if r.doc_id == 1}) == 1
    assert iblt.compare_edits(df.limit(0)).count() == 0


def test_larger_sketches_until_peeled(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for i in range(3000):
        a = {rng.getrandbits(48) << 16 for _ in range(rng.randrange(0, 40))}
        b = {rng.getrandbits(48) << 16 for _ in range(rng.randrange(0, 40))} | set(rng.sample(sorted(a), len(a) // 2))
        signed = lambda xs: sorted(x - (1 << 64) if x >> 63 else x for x in xs)
        rows.append((i, signed(a), signed(b)))
        want[i] = len(a ^ b)
    raw = spark.createDataFrame(rows, "pair long, a array<long>, b array<long>")
    checked = raw.selectExpr("pair", *[f"transform({x}, h -> h | (xxhash64(h) & 65535L)) as keys_{x}" for x in "ab"])
    pairs = checked.select("*", *[iblt.sketch(checked[f"keys_{x}"]).alias(f"cells_{x}") for x in "ab"])
    got = {r.pair: r.n_differing for r in iblt.differences(pairs).collect()}
    odd = {k: (v, got.get(k)) for k, v in want.items() if got.get(k) != v}
    assert not odd


def test_a_pair_is_made_once_for_all_groups_it_shares(spark):
    """Three texts share 40 differences from a pivot, and two of them 200 from another; of a component no pair is made."""
    rows = [(100 + g, 1, e, False, 100, 70, False) for g in range(40) for e in (10, 20, 30)]
    rows += [(1000 + g, 2, e, e == 20, 100, 70, True) for g in range(200) for e in (20, 40)]
    dealt = spark.createDataFrame(rows, "grp long, pivot long, entry long, linked boolean, size int, both int, lacks boolean")
    known = spark.createDataFrame([(e, [0] * 8) for e in (10, 20, 30, 40)], "entry long, sketch array<long>")
    made = lambda *roots: sorted(tuple(r) for r in simhash.pairs_in_groups(dealt, known, 0.5, *roots).collect())
    assert made() == [(10, 20), (10, 30), (20, 30), (20, 40)]
    assert made(spark.createDataFrame([(20, 10), (10, 10)], "node long, root long")) == [(10, 30), (20, 30), (20, 40)]
    # Groups in common that are beyond the first 64 of both are still found.
    far = spark.createDataFrame([(g + (0 if g >= 900 else 100 * e), 1, e, False, 100, 70, False) for g in [*range(70), 900 + 10**6] for e in (10, 20)], dealt.schema)
    assert [tuple(r) for r in simhash.pairs_in_groups(far, known, 0.5).collect()] == [(10, 20)]


@pytest.mark.parametrize(("group_most", "rounds"), [(2, 3), (4, 1), (32, 6)])
def test_crowds_lose_no_link(spark, group_most, rounds):
    """All texts share every key, so the components must be those of all pairs at 0.8."""
    rng = random.Random(11)

    def changed(words, most):
        words = list(words)
        for at in rng.sample(range(len(words)), rng.randrange(most + 1)):
            words[at] = f"own{rng.randrange(10**6)}"
        return words

    base = [f"c{k}" for k in range(150)]
    other = base[:110] + [f"d{k}" for k in range(40)]  # as far from the base that neither links the other's copies
    crowd = [base, other]
    crowd += [changed(base, 6) for _ in range(25)] + [changed(other, 6) for _ in range(20)]
    crowd += [base[: rng.randrange(60, 150)] for _ in range(15)]  # cut copies: they only lack something
    crowd += [base[:90] + [f"e{i}x{k}" for k in range(60)] for i in range(15)]  # a passage in common, else nothing
    texts = sorted({" ".join(words) for words in crowd})
    sets = [simhash.shingle_set(t) for t in texts]
    names = [simhash.set_name(h) for h in sets]
    docs = frame(spark, [doc(i, t) for i, t in enumerate(texts)])
    entries = spark.createDataFrame(
        [(n, i, [0] * 8) for i, n in enumerate(names)], "entry long, first long, sketch array<long>"
    )
    links = simhash.similar_links(docs, entries, group_most=group_most, rounds=rounds).collect()

    def roots(pairs):
        root = {n: n for n in names}

        def find(n):
            while root[n] != n:
                n = root[n]
            return n

        for a, b in pairs:
            a, b = sorted((find(a), find(b)))
            root[b] = a
        return {n: find(n) for n in names}

    similar = [
        (names[i], names[j]) for i, j in itertools.combinations(range(len(sets)), 2)
        if len(both := set(sets[i]) & set(sets[j])) / (len(sets[i]) + len(sets[j]) - len(both)) >= 0.8
    ]
    assert {tuple(sorted(r)) for r in links} <= {tuple(sorted(p)) for p in similar}
    assert roots(links) == roots(similar)
    assert 5 < len(set(roots(similar).values())) < len(names) - 20


def test_near_duplicate_stage_shuffles_only_texts_that_meet(spark):
    rng = random.Random(5)
    texts = [" ".join(f"{rng.getrandbits(64):x}" for _ in range(6000)) for _ in range(40)]
    texts[39] = texts[38] + " and more"
    df = frame(spark, [doc(i, t) for i, t in enumerate(texts)] + [doc(7, texts[7]), doc(None, texts[0])])
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = written()
    kept = collect(simhash.drop_near_duplicates(df), "doc_id", "text")
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert sorted(kept, key=str) == sorted([*enumerate(texts[:39]), (None, texts[0])], key=str)
    assert written() - before < sum(map(len, texts)) / 4


def test_may_be_in_misses_no_row(spark):
    ids = spark.range(-50_000, 50_000).withColumnRenamed("id", "k")
    wanted = ids.where("k % 10 = 3")
    found = {r["may be in"]: r["n"] for r in simhash.may_be_in(ids, wanted, ["k"]).groupBy("may be in").agg(F.count("*").alias("n")).collect()}
    assert simhash.may_be_in(wanted, wanted, ["k"]).where("not `may be in`").isEmpty() and found[True] < 10_200
    assert found[True] + found[False] == 100_000


def test_near_duplicate_stage_misses_no_pair_by_chance(spark):
    """Pairs at 0.817 that share no key of eight lanes, by which candidates were found before."""
    rows = []
    for i, seed in enumerate((165, 430, 2983)):
        rng = random.Random(seed)
        words = [f"w{rng.randrange(3000)}" for _ in range(400)]
        changed = list(words)
        for at in rng.sample(range(0, 400, 5), 8):
            changed[at] = f"new{at}"
        rows += [doc(2 * i, " ".join(words)), doc(2 * i + 1, " ".join(changed))]
        assert five_word_similarity(rows[-2][1], rows[-1][1]) >= 0.8
    assert collect(simhash.drop_near_duplicates(frame(spark, rows)), "doc_id") == [(0,), (2,), (4,)]


def test_similar_sets_share_as_many_keys_as_they_count_on():
    rng = np.random.default_rng(2)
    for n in (1, 2, 4, 5, 19, 20, 21, 100, 400):
        for _ in range(60):
            one = rng.choice(1 << 16, n, replace=False).astype(np.uint64) << np.uint64(rng.choice([20, 48]))  # many equal upper halves, or none
            gone = rng.integers(0, n // 5 + 1)
            two = np.unique(np.append(one[gone:], rng.integers(0, 1 << 63, rng.integers(0, n // 4 + 1)).astype(np.uint64)))
            both = len(np.intersect1d(one, two))
            if both / (n + len(two) - both) >= 0.8:
                (a, least_a), (b, least_b) = (simhash.prefix(np.sort(x), 0.8) for x in (one, two))
                assert len(np.intersect1d(a, b)) >= max(least_a, least_b)


def test_blocks_of_a_crowd_connect_what_all_pairs_do(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_MEMBERS", 7)
    rng = random.Random(4)
    base = list(range(100))
    sets = [sorted({rng.randrange(100, 400) if rng.random() < most else x for x in base[: rng.randrange(50, 101)]}) for most in [0.05] * 40 + [0.15] * 40]
    entries = [(i, h) for i, h in enumerate(map(list, {tuple(s) for s in sets}))]
    alike = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.8
    members = spark.createDataFrame([(1000, i, alike(h, base), len(h)) for i, h in entries], "pivot long, entry long, linked boolean, size int")
    table = spark.createDataFrame(entries, "entry long, hashes array<long>")
    got = [tuple(r) for r in simhash.links_in_blocks(members, table, 0.8).collect()]
    hub = [(i, 1000) for i, h in entries if alike(h, base)]
    want = [(i, j) for (i, a), (j, b) in itertools.combinations(entries, 2) if alike(a, b)]
    assert set(got) <= {tuple(sorted(p)) for p in want} and 0 < len(got) < len(want)

    def roots(links):
        root = {n: n for n in [i for i, _ in entries] + [1000]}
        for _ in root:
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert roots(got + hub) == roots(want + hub)


def test_a_large_crowd_is_settled_by_one_round(spark, monkeypatch):
    """400 copies, half of them under 0.8 from the text they were made from: pairs aren't made as rows, nor pivots chosen again."""
    made, real = [], simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df, label: made.append(label) or real(df, label))
    rng = random.Random(9)
    rows = []
    for i in range(400):
        words = [f"c{k}" for k in range(200)]
        for at in rng.sample(range(200), rng.randrange(1, 9)):
            words[at] = f"own{rng.randrange(10**6)}"
        rows.append(doc(i, " ".join(words)))
    kept = sorted(i for (i,) in collect(simhash.drop_near_duplicates(frame(spark, rows)), "doc_id"))
    assert made.count("near-tried") == 1 and len(made) < 30
    sets = [set(simhash.shingle_set(r[1]).tolist()) for r in rows]
    near = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8
    root = list(range(400))
    for a, b in itertools.combinations(range(400), 2):
        if root[a] != root[b] and near(a, b):
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
    assert kept == sorted(set(root)) and 1 < len(kept) < 350
