"""Edits, guards, merges, reports and verdicts on tables small enough to say what is right."""

import pytest
from pyspark.sql import functions as F

from foliant.operators import edits as E
from foliant.operators import monitoring as M
from foliant.operators import numbering as N
from foliant.operators import scoring
from foliant.plans import operations_plans
from foliant.plans import structure_plans as SP


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("given,want", [
    ("Paragraphe", "paragraph"), (" TITRE ", "heading"), ("légende", "caption"), ("legende", "caption"), ("en-tete", "header"), ("heading", "heading"), ("Figure", "figure"),
    ("renvoi", "cross_ref"), ("", None), ("odd", None), (None, None),
])
def test_types_have_other_names(spark, given, want):
    assert spark.createDataFrame([(given,)], "t string").select(E.normal_type(F.col("t"))).first()[0] == want


def test_ids_and_levels_are_made_normal(spark):
    df = spark.createDataFrame([(' "b_0042"\n', 7), ("''", 0), (None, None), ("`x`", 2)], "id string, level int")
    assert [tuple(r) for r in df.select(E.normal_block_id(F.col("id")), E.normal_level(F.col("level"))).collect()] == [("b_0042", 3), (None, 1), (None, None), ("x", 2)]


def test_faults_of_edits(spark):
    table = [(1, "insert", 1, None, "x", "Titre"), (2, "insert", 1, None, "x", "en_tete"), (3, "insert", 1, None, " ", "paragraph"), (4, "move", None, None, "x", None), (5, "replace_range", 1, None, "x", None)]
    got = E.validate_edits(spark.createDataFrame(table, "edit_id long, tool string, pos int, end_pos int, text string, type string"))
    assert rows(got, "edit_id", "fault") == [(2, "type_not_allowed"), (3, "text_missing"), (4, "position_missing"), (4, "unknown_tool"), (5, "end_missing")]


def test_guards(spark):
    edits = [(i, d, tool, p, e) for i, (d, tool, p, e) in enumerate([(1, "delete", 0, None), (1, "delete", 1, None), (1, "delete", 2, None), (1, "delete", 9, None), (1, "replace_range", 1, 0),
             (1, "replace_range", 0, 3), (1, "replace_range", 0, 2), (2, "delete", 0, None), (1, "rewrite", 0, None)])]
    blocks = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "z")], "doc_id long, pos int, block_id string")
    references = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "doc_id long, target_id string")
    links = spark.createDataFrame([(1, "b"), (1, None), (2, "a")], "doc_id long, carrier_id string")
    got = E.edit_guards(spark.createDataFrame(edits, "edit_id long, doc_id long, tool string, pos int, end_pos int"), blocks, references, links)
    assert rows(got, "edit_id", "refused") == sorted([(0, "referred_to"), (1, "described_by_caption"), (2, None), (3, "unknown_block"), (4, "invalid_range"), (5, "invalid_range"),
                                                     (6, None), (7, "last_block"), (8, None)], key=repr)


def test_captions_of_deleted_carriers_stand_alone(spark):
    links = spark.createDataFrame([(1, 3, "c1", "f1"), (1, 5, "c2", "f1"), (1, 7, "c3", "f2"), (2, 3, "c1", "f1"), (1, 9, "c4", None)], "doc_id long, pos int, caption_id string, carrier_id string")
    deleted = spark.createDataFrame([(1, "f1"), (1, "f1"), (1, "c3"), (3, "f1")], "doc_id long, block_id string")
    got = E.links_after_deletes(links, deleted)
    assert got.columns == links.columns
    assert rows(got, "doc_id", "caption_id", "carrier_id") == sorted([(1, "c1", None), (1, "c2", None), (2, "c1", "f1"), (1, "c4", None)], key=repr)


def test_the_second_detector_adds_what_is_new(spark):
    shape = "doc_id long, element_index long, parent string, type string"
    first = spark.createDataFrame([(1, 10, "body", "a"), (1, None, "body", "b")], shape)
    second = spark.createDataFrame([(1, 10, "body", "x"), (1, 10, "header", "y"), (2, 11, "body", "z"), (2, 11, "body", "z"), (1, None, "body", "n"), (1, None, "body", "n")], shape)
    got = E.merge_detections(first, second)
    assert rows(got, "element_index", "parent", "type", "detector") == sorted([(10, "body", "a", 1), (None, "body", "b", 1), (10, "header", "y", 2), (11, "body", "z", 2),
                                                                              (None, "body", "n", 2), (None, "body", "n", 2)], key=repr)


def test_tables_and_their_hashes(spark):
    ones = [[1, 1], [1, 1]]
    table = [
        (1, 2, 2, [["Name", "Age"], ["a", "1"]], ones), (1, 2, 2, [["", "Age"], ["a", "1"]], ones), (2, 2, 2, [["Title", ""], ["a", "1"]], [[2], [1, 1]]),
        (3, 1, 2, [["Name", "Age"]], [[1, 1]]), (4, 2, 2, [["Name", "Age"], ["a", "1"]], ones), (5, 2, 2, [["x" * 41, "b"], ["a", "1"]], ones),
    ]
    found = M.table_stats(spark.createDataFrame(table, "doc_id long, rows int, cols int, cells array<array<string>>, grid_span array<array<int>>")).collect()
    by = {r["doc_id"]: r for r in found}
    assert {k: (r["tables"], r["cells"], r["with_header"], r["with_merges"]) for k, r in by.items()} == {1: (2, 8, 1, 0), 2: (1, 4, 1, 1), 3: (1, 2, 0, 0), 4: (1, 4, 1, 0), 5: (1, 4, 0, 0)}
    assert len({r["content_hash"] for r in found}) == 5


def test_reports_and_their_warnings(spark):
    b = [("heading", 0.9, True, 3), ("heading", 0.5, False, 1), ("table", 0.9, False, 0), ("figure", 0.9, False, 0), ("image", 0.9, False, 0), ("caption", 0.9, False, 0), ("toc_entry", 0.9, False, 0), ("shape", 0.9, False, 0)]
    blocks = spark.createDataFrame([(1, *x) for x in b] + [(2, "paragraph", 0.9, False, 0)], "doc_id long, type string, confidence double, page_break_before boolean, empties int")
    changes = spark.createDataFrame([(1, "1"), (1, None), (1, "2")], "doc_id long, original_number string")
    references = spark.createDataFrame([(1, "x"), (1, None)], "doc_id long, target_id string")
    covers = spark.createDataFrame([(1, "remove", 4), (2, "few_marks", 9)], "doc_id long, verdict string, blocks long")
    report = M.document_report(blocks, changes, references, covers)
    names = ["headings", "headings_confirmed", "headings_to_validate", "tables", "figures", "captions", "toc_entries", "shapes", "empties_normalized", "renumbered", "refs_resolved", "cover_blocks"]
    assert rows(report, "doc_id", *names) == [(1, 2, 1, 1, 1, 2, 1, 1, 1, 3, 2, 1, 4), (2, *[0] * 12)]
    assert rows(M.report_warnings(report), "doc_id", "warning") == [(1, "figures_without_caption"), (1, "headings_to_validate"), (2, "no_heading")]


def test_a_report_types_blocks_and_looks_for_references_once(spark, sf, monkeypatch):
    typed, written = [], []
    monkeypatch.setattr(SP, "typed", lambda *a, f=SP.typed: typed.append(a) or f(*a))
    monkeypatch.setattr(N, "materialize", lambda df, label, f=N.materialize: written.append(label) or f(df, label))
    report = operations_plans.reports(spark, sf)
    assert len(typed) == 1 and written == ["references"]
    assert report.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_sums_over_the_corpus(spark):
    blocks = spark.createDataFrame([(1, "heading", 0.9), (1, "paragraph", 0.5), (2, "paragraph", 0.9), (2, "paragraph", None)], "doc_id long, type string, confidence double")
    waits = spark.createDataFrame([(1, None), (2, "2024-01-01"), (2, None)], "doc_id long, answered_at string")
    columns = ("documents", "without_heading", "blocks", "headings", "ambiguous", "pending", "auto_rate")
    assert rows(M.corpus_quality(blocks, waits), *columns) == [(2, 1, 4, 1, 1, 2, 75.0)]
    assert rows(M.corpus_quality(blocks.limit(0), waits.limit(0)), *columns) == [(0, 0, 0, 0, 0, 0, 0.0)]


def test_verdicts_say_all(spark):
    table = spark.createDataFrame([(1, 0, "a", True), (1, 1, "bb", True), (1, 2, "ccc", True), (1, 3, "a", False), (1, 4, "none", True)], "doc_id long, pos int, text string, needs_review boolean")

    def classifier(text):
        n = F.length(text)
        signals = F.when(n == 1, F.array(F.lit("one"), F.lit("short")))
        return F.when(n < 4, F.struct((n == 1).alias("is_heading"), F.when(n == 2, "caption").alias("type"), F.lit(2).alias("level"), (n - 0.5).alias("confidence"), signals.alias("signals")))

    got = rows(scoring.full_verdicts(table, classifier), "pos", "is_heading", "verdict_type", "verdict_level", F.col("verdict_confidence").cast("double"), "signals")
    assert got == [(0, True, "heading", 2, 0.5, "one,short"), (1, False, "caption", None, 1.0, ""), (2, False, "paragraph", None, 1.0, "")]
