"""Edge tables of structure: patterns, links, numbers, references, edits, packages."""

import pytest
from pyspark.sql import functions as F

from foliant.functions import patterns as P
from foliant.operators import detect as D
from foliant.operators import edits as E
from foliant.operators import monitoring as M
from foliant.operators import numbering as N
from foliant.sources import documents as S

BLOCKS = "doc_id long, pos int, block_id string, type string, text string, category string, original_number string, heading_level int"


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("v")).first().v


@pytest.mark.parametrize("text, want", [
    ("1.2.3.4 Deep", (4, "decimal")), ("1.2 Titre", (2, "decimal")), ("1. Titre", (1, "decimal")), ("1) Authentification", (1, "enumerated")),
    ("1) Le système affiche tout.", None), ("CHAPITRE IV suite", (1, "keyword")), ("INTRODUCTION", (1, "keyword")), ("INTRODUCTIONS", None),
    ("II. Titre", (1, "roman")), ("A. Abcd", (2, "alpha")), ("A. Abc", None), ("M. Dupont, directeur", None), ("", None), ("• 1.1 Puce", (2, "decimal")),
    ("1. " + "x" * 120, None), ("texte", None), (None, None),
])
def test_heading_number(spark, text, want):
    v = one(spark, P.heading_number, text)
    assert (v and (v.level, v.kind)) == want


@pytest.mark.parametrize("text, want", [
    ("Figure 3 : Vue", ("figure", "3", "Vue")), ("figure 3", ("figure", "3", "")), ("Annexe B - plan", ("annexe", "B", "plan")), ("annexe b : x", None),
    ("Figure 1er essai", None), ("Tableau II : x", None), ("Légende 2. mot", ("figure", "2", "mot")), ("figure ci-dessous", None), ("", None), (None, None),
])
def test_caption(spark, text, want):
    v = one(spark, P.caption, text)
    assert (v and (v.category, v.number, v.label)) == want


def test_cross_references(spark):
    v = one(spark, P.cross_references, "voir la figure 2 et Tableau 10, cf. Annexe B. TABLEAU D'AMORTISSEMENT, annexe b, figure ci-dessous")
    assert [(r.category, r.number) for r in v] == [("figure", "2"), ("table", "10"), ("annexe", "B")]


@pytest.mark.parametrize("text, want", [
    ("voir Figure 1 Figure 2 et Tableau 3", [("1", 5), ("2", 14), ("3", 26)]), ("Figure 1/Figure 2", [("1", 0), ("2", 9)]), ("Figure 1;Tableau 2", [("1", 0), ("2", 9)]),
    ("", []), (None, []), ("xFigure 1 Figure 2", [("2", 10)]), ("Figure 12a Figure 3", [("3", 11)]), ("é Annexe B\nfigure  7", [("B", 2), ("7", 11)]),
])
def test_cross_reference_positions(spark, text, want):
    v = one(spark, P.cross_references, text)
    assert (v and [(r.number, r.position) for r in v]) == want
    assert not v or all(text[r.position :].startswith(r.matched) for r in v)


def test_references_resolve_to_block_ids(spark):
    """With ids that say nothing of document or position; the text follows the new number."""
    rows = [
        (7, 0, "fig-a", "figure", "", "figure", None, None), (7, 1, "b-b", "caption", "Figure 3 : Vue", "figure", "3", None),
        (7, 2, "p-1", "paragraph", "voir Figure 3 et la suite", None, None, None), (7, 3, "p-2", "paragraph", "voir Figure 9", None, None, None),
        (8, 0, "q", "paragraph", "voir Tableau 1", None, None, None),
    ]
    df = spark.createDataFrame(rows, BLOCKS)
    numbered = N.numbering_pipeline(df, "numbered")
    got = {(r.doc_id, r.pos): (r.target_id, r.confidence) for r in N.resolve_refs(numbered).collect()}
    assert got == {(7, 2): ("b-b", 1.0), (7, 3): ("b-b", 0.55), (8, 0): (None, None)}
    texts = {r.pos: r.text for r in N.numbering_pipeline(df, "texts").collect()}
    assert texts == {2: "voir Figure 1 et la suite", 3: "voir Figure 1"}


def blocks(spark, *kinds):
    """'F' figure, 'T' table, 'f3' caption of a figure with number 3, 'p:text' paragraph, 'h:text' heading."""
    rows = []
    for i, k in enumerate(kinds):
        head, _, text = k.partition(":")
        kind = {"F": "figure", "T": "table", "f": "caption", "t": "caption", "p": "paragraph", "h": "heading"}[head[0]]
        category = {"f": "figure", "t": "table", "F": "figure", "T": "table"}.get(head[0])
        rows.append((1, i, f"1-{i}", kind, text, category, head[1:] or None, 1 if kind == "heading" else None))
    return spark.createDataFrame(rows, BLOCKS)


@pytest.mark.parametrize("kinds, want", [
    ("F f1", {1: (0, 0.9)}), ("f1 F", {0: (1, 1.0)}), ("F F f1 f2", {2: (0, 0.9), 3: (1, 0.9)}), ("F F f1", {2: (1, 0.9)}), ("F p f1", {2: (0, 0.8)}),
    ("F p p f1", {3: None}), ("T f1", {1: None}), ("F p f1 p F", {2: None}), ("p f1 p", {1: None}), ("F f1 F", {1: (0, 0.9)}), ("p F p f1 F", {3: (4, 0.9)}),
])
def test_link_captions(spark, kinds, want):
    got = N.link_captions(blocks(spark, *kinds.split())).collect()
    assert {r.pos: r.carrier_id and (int(r.carrier_id[2:]), r.confidence) for r in got} == want


def test_numbers_are_one_to_n(spark):
    df = blocks(spark, "F", "f7", "p", "F", "p", "p", "p", "f7", "p", "p", "F", "f")
    links = N.link_captions(df)
    got = N.renumber(df, links)
    counted = [r.final_number or r.original_number for r in got.where("counting = 'figure'").orderBy("pos").collect()]
    assert counted == ["1", "2", "3", "4"]
    shown = {r.pos: r.final_number for r in got.collect()}
    assert shown[0] == "1" and shown[10] == shown[11] == "4"
    (anomaly,) = N.number_anomalies(got).collect()
    assert (anomaly.duplicates, anomaly.gaps) == ("7", "1,2")


def test_references_and_rewriting(spark):
    df = blocks(spark, "F", "f2", "p:voir Figure 2 puis Figure 22 et figure 9", "p:la figure 2.", "p:Tableau 1")
    links = N.link_captions(df)
    numbered = N.renumber(df, links)
    resolved = N.resolve_refs(numbered)
    got = {(r.pos, r.ref_no): (r.target_id, r.confidence) for r in resolved.collect()}
    assert got == {(2, 0): ("1-1", 1.0), (3, 0): ("1-1", 1.0), (4, 0): (None, None)}
    texts = {r.pos: r.text for r in N.rewrite_refs(numbered, resolved).collect()}
    assert texts == {2: "voir Figure 1 puis Figure 22 et figure 9", 3: "la figure 1."}


def test_nearest_of_several_and_ties(spark):
    df = blocks(spark, "F", "f1", "p", "p:Figure 1", "p", "p", "f1", "F", "p", "p:Figure 5", "p")
    numbered = N.renumber(df, N.link_captions(df))
    got = {r.pos: (r.target_id, r.confidence) for r in N.resolve_refs(numbered).collect()}
    assert got[3][1] in (0.75, 0.55) and got[3][0] == "1-1"
    assert got[9] == ("1-7", 0.55)


def toc(spark, rows):
    data = [(1, p, f"1-{p}", "paragraph", t, lvl, False) for p, t, lvl in rows]
    return D.toc_runs(D.type_blocks(spark.createDataFrame(data, "doc_id long, pos int, block_id string, base string, text string, style_level int, is_bold boolean")))


@pytest.mark.parametrize("positions, listed", [((0, 1, 2), 0), ((0, 1, 2, 3), 4), ((0, 6, 12, 18), 4), ((0, 7, 8, 9), 0)])
def test_toc_runs(spark, positions, listed):
    rows = [(p, f"Titre numero {p}\t{p + 3}" if p in positions else "texte courant", 2 if p in positions else None) for p in range(20)]
    assert toc(spark, rows).where("type = 'toc_entry'").count() == listed


def test_assess_shields_and_contradictions(spark):
    rows = [(1, 0, "1-0", "paragraph", "1.2. Titre", 3, False), (1, 1, "1-1", "paragraph", "1.2. Titre", 2, False), (1, 2, "1-2", "paragraph", "Simple ligne", None, True),
            (1, 3, "1-3", "paragraph", "Table des matieres", None, False)]
    typed = D.type_blocks(spark.createDataFrame(rows, "doc_id long, pos int, block_id string, base string, text string, style_level int, is_bold boolean"))
    got = {r.pos: r for r in D.assess(typed).collect()}
    assert got[0].confidence == 0.65 and got[1].confidence == 0.98 and got[2].confidence == 0.82 and got[3].type == "toc_entry"
    assert {r.pos: r.type for r in D.assess(typed, shield_types=()).collect()}[3] == "heading"


def test_cover_page(spark):
    def cover(texts, kinds=None):
        rows = [(1, i, "paragraph" if not kinds else kinds[i], t) for i, t in enumerate(texts)]
        return D.cover_pages(spark.createDataFrame(rows, "doc_id long, pos int, type string, text string")).first()

    assert cover(["UNIVERSITÉ de X", "Mémoire de fin", "Sommaire", "texte"]).verdict == "remove"
    assert cover(["Université", "texte", "SOMMAIRE"]).verdict == "few_marks"
    assert cover(["Sommaire", "Université"]).verdict == "starts_with_front_matter"
    assert cover(["Université et mémoire"] + ["x"] * 40 + ["Introduction"]).verdict == "too_long"
    assert cover(["Université et mémoire"] + ["x"] * 39 + ["Introduction"]).blocks == 40


def test_rules_refuse_what_is_wrong():
    for bad in (("", "titles", {"type": "x"}), ("n", "nowhere", {"type": "x"}), ("n", "titles", {})):
        with pytest.raises(ValueError):
            D.rule_column((bad,))


def test_edits(spark):
    df = spark.createDataFrame([(1, i, f"1-{i}", f"t{i}") for i in range(5)], "doc_id long, pos int, block_id string, text string")
    schema = "edit_id long, doc_id long, tool string, pos int, end_pos int, text string"
    same = E.apply_edits(df, spark.createDataFrame([], schema))
    assert [(r.pos, r.block_id, r.text) for r in same.orderBy("pos").collect()] == [(i, f"1-{i}", f"t{i}") for i in range(5)]
    edits = [(1, 1, "rewrite", 0, None, "a"), (2, 1, "rewrite", 0, None, "b"), (3, 1, "insert", 0, None, "in"), (4, 1, "delete", 1, None, None), (5, 1, "replace_range", 2, 3, "r"), (6, 1, "insert", 99, None, "lost")]
    got = E.apply_edits(df, spark.createDataFrame(edits, schema)).orderBy("pos").collect()
    assert [r.text for r in got] == ["b", "in", "r", "t4", "lost"] and [r.pos for r in got] == [0, 1, 2, 3, 4]
    twice = [(1, 1, "insert", 0, None, "first"), (2, 1, "insert", 0, None, "second"), (3, 1, "insert", 50, None, "x"), (4, 1, "insert", 60, None, "y"), (5, 9, "insert", 0, None, "z")]
    got = E.apply_edits(df, spark.createDataFrame(twice, schema)).orderBy("pos").collect()
    assert [r.text for r in got] == ["t0", "second", "first", "t1", "t2", "t3", "t4", "x", "y"]


def test_table_edits(spark):
    tables = spark.createDataFrame([(i, [["a", "b"], ["c", "d"]]) for i in range(6)], "doc_id long, cells array<array<string>>")
    edits = [(0, "add_row", 1, 0, ["x"]), (1, "add_column", 0, 2, ["x", "y"]), (2, "remove_row", 0, 0, []), (3, "set_cell", 1, 1, ["z"]), (4, "set_cell", 2, 0, ["z"]), (5, "odd", 0, 0, [])]
    got = {r.doc_id: (r.ok, r.cells) for r in E.edit_table_cells(tables, spark.createDataFrame(edits, "doc_id long, tool string, row int, col int, values array<string>")).collect()}
    assert got == {0: (True, '[["a","b"],["x",""],["c","d"]]'), 1: (True, '[["a","b","x"],["c","d","y"]]'), 2: (True, '[["c","d"]]'), 3: (True, '[["a","b"],["c","z"]]'),
                   4: (False, '[["a","b"],["c","d"]]'), 5: (False, '[["a","b"],["c","d"]]')}


def test_answers(spark):
    for text, want in (("Titre niveau 2", "heading_2"), ("un TITRE", "heading_1"), ("figure ou tableau", "figure"), ("rien", None), (None, None)):
        assert one(spark, E.parse_answer, text) == want


def test_ages_at_the_thresholds(spark):
    now = "2024-01-31 00:00:00"
    rows = [(1, "2024-01-28 00:14:24"), (2, "2024-01-28 00:00:00"), (3, "2024-01-17 00:00:00"), (4, None)]
    df = spark.createDataFrame(rows, "id long, t string").select("id", F.lit("x").alias("status"), F.col("t").cast("timestamp_ntz").alias("updated_at"))
    r = M.documents_by_status(df, now).first()
    assert (r.total, r.attention, r.abandoned, r.max_age) == (4, 2, 1, 14)


def test_packages(spark):
    docs = spark.createDataFrame([(1, "Titre & suite\na | b\nligne\x01 <x>"), (2, "")], "doc_id long, text string")
    good = S.make_packages(docs)
    bad = spark.createDataFrame([("bad.docx", bytearray(b"no zip"))], "path string, content binary")
    rows = S.ingest_docx(good.unionByName(bad))
    got = [(r.pos, r.type, r.text, r.style_level, r.cells) for r in rows.where("path = 'doc-1.docx'").orderBy("pos").collect()]
    assert got == [(0, "paragraph", "Titre & suite", 1, None), (1, "table", "", None, [["a", "b"]]), (2, "paragraph", "ligne <x>", None, None)]
    assert [r.path for r in S.rejects(rows).collect()] == ["bad.docx"]
    assert S.rejects(S.ingest_docx(good, most_entries=0)).count() == 2


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"caf\xe9\r\nx\x00y\rz")
    (tmp_path / "b.txt").write_text(" \n ")
    (tmp_path / "c.bin").write_text("no")
    assert [r.text for r in S.ingest_text(spark, str(tmp_path)).collect()] == ["café\nxy\nz"]
