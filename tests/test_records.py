"""Erased accounts, fields, page lookup, legends and curves on tables small enough to say what is right."""

import random

import pytest
from pyspark.sql import functions as F

from foliant.operators import detect as D
from foliant.operators import erasure as X
from foliant.operators import fields as L
from foliant.operators import monitoring as M
from foliant.operators import numbering as N


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_a_cascade_takes_what_hangs_on_erased_rows_once(spark):
    tables = {
        "notes": spark.createDataFrame([(1, 10, None), (2, None, 7), (3, 10, 7), (4, 20, None), (5, None, None)], "id long, session_id long, owner long"),
        "sessions": spark.createDataFrame([(10, 7), (20, 8), (30, None)], "id long, user_id long"),
        "users": spark.createDataFrame([(7,), (8,), (None,)], "id long"),
        "plans": spark.createDataFrame([(1,)], "id long"),
    }
    links = [X.Link("users", "id", "sessions", "user_id"), X.Link("sessions", "id", "notes", "session_id"), X.Link("users", "id", "notes", "owner")]
    found = X.erase_cascade(tables, "users", "id", spark.createDataFrame([(7,), (7,), (99,)], "id long"), links)
    assert {k: rows(v, "id") for k, v in found.gone.items()} == {"users": [(7,)], "sessions": [(10,)], "notes": [(1,), (2,), (3,)], "plans": []}
    assert {k: rows(v, "id") for k, v in found.kept.items()} == {"users": [(8,), (None,)], "sessions": [(20,), (30,)], "notes": [(4,), (5,)], "plans": [(1,)]}
    with pytest.raises(ValueError):
        X.ordered(["a", "b"], [X.Link("a", "id", "b", "x"), X.Link("b", "id", "a", "y")])


def test_paths_of_erased_rows(spark):
    messages = [
        (1, '{"generated_files": ["a/1.docx", "", "a/1.docx", "b\\\\2.pdf"], "attachments": [{"path": "c.png"}, {"name": "x"}, {"path": ""}]}'),
        (1, '{"generated_files": "no list", "attachments": {"path": "d.png"}}'), (2, None), (2, "no json"), (2, '{"attachments": [{"path": "a/1.docx"}]}'),
    ]
    gone = {
        "messages": spark.createDataFrame(messages, "session_id long, metadata string"), "sessions": spark.createDataFrame([(1,)], "id long"),
        "documents": spark.createDataFrame([("up\\x.docx",), (None,), ("",)], "path string"), "generated": spark.createDataFrame([("out/y.pdf",), ("",)], "output_path string"),
    }
    got = [p for (p,) in rows(X.erased_paths(gone), "path")]
    assert set(got) - {"d.png"} == {"a/1.docx", "b/2.pdf", "c.png", "chat/attachments/1", "up/x.docx", "out/y.pdf"} and len(got) == len(set(got))


def matched(kinds):
    """Fields by a stack: (begin, end or None) for each begin, and the stray ends."""
    stack, fields, stray = [], {}, []
    for at, kind in enumerate(kinds):
        if kind == "begin":
            stack.append(at)
            fields[at] = None
        elif kind == "end" and stack:
            fields[stack.pop()] = at
        elif kind == "end":
            stray.append(at)
    return fields, stray


@pytest.mark.parametrize("seed", range(6))
def test_marks_match_as_with_a_stack(spark, seed):
    rnd = random.Random(seed)
    kinds = [rnd.choice(["begin", "end", "end", "instr", "separate", "text"] if seed % 2 else ["begin", "begin", "end", "instr", "separate", "text"]) for _ in range(90)]
    table = spark.createDataFrame([(1, at // 7, at, k, "PAGE" if k == "instr" else "ab" if k == "text" else "") for at, k in enumerate(kinds)], "doc_id long, pos int, ord int, kind string, text string")
    fields, stray = matched(kinds)
    marked = {r["ord"]: r for r in L.marked(table).collect()}
    assert sorted(at for at, r in marked.items() if r["stray"]) == stray
    by_name = {(r["depth"], r["field"]): at for at, r in marked.items() if r["kind"] == "begin"}
    assert len(by_name) == len(fields)
    ends = {by_name[r["depth"], r["field"]]: at for at, r in marked.items() if r["kind"] == "end" and not r["stray"]}
    assert ends == {b: e for b, e in fields.items() if e is not None}
    marks = L.field_marks(table).first()
    assert (marks["begun"], marks["closed"], marks["stray_ends"], marks["open"]) == (len(fields), len(ends), len(stray), len(fields) - len(ends))
    spans = L.field_spans(table).collect()
    assert len(spans) == len(fields) and sum(s["closed"] for s in spans) == len(ends)


def test_a_nested_field_and_a_broken_one(spark):
    kinds = [
        ("begin", ""), ("instr", " SEQ  Fig"), ("instr", "ure "), ("begin", ""), ("instr", 'STYLEREF "Titre 1"'), ("separate", ""), ("text", "II"), ("end", ""), ("separate", ""),
        ("text", "12"), ("end", ""), ("text", "plain"), ("end", ""), ("simple", "ref _Toc9 \\h"), ("begin", ""), ("instr", "odd"), ("text", "code"),
    ]
    table = spark.createDataFrame([(1, at // 4, at, *k) for at, k in enumerate(kinds)], "doc_id long, pos int, ord int, kind string, text string")
    spans = rows(L.field_spans(table), "depth", "field", "code", "kind", "shown", "closed")
    assert spans == sorted([(1, 1, "SEQ Figure", "sequence", 2, True), (2, 1, 'STYLEREF "Titre 1"', "style_reference", 2, True), (1, 2, "odd", "unknown", 0, False)], key=repr)
    # Each instruction counts for itself, also the second half of one that is cut.
    assert rows(L.field_counts(table), "kind", "fields", "laid_out") == [("reference", 1, 0), ("sequence", 1, 0), ("style_reference", 1, 1), ("unknown", 2, 0)]
    marks = rows(L.field_marks(table), "begun", "closed", "nested", "stray_ends", "deepest", "open")
    assert marks == [(3, 2, 1, 1, 2, 1)]


@pytest.mark.parametrize("code,kind,identifier", [
    ("SEQ Figure \\* ARABIC", "sequence", "Figure"), ("  pageref   _Toc1 \\h ", "page_reference", "_Toc1"), ('TOC \\o "1-3" \\h', "table_of_contents", "1-3"),
    ("PAGE", "page_number", None), ("", "unknown", None), ('SEQ "a b"', "sequence", "b\""), ("EQ \\f(1;2)", "equation", None),
])
def test_instructions(spark, code, kind, identifier):
    df = spark.createDataFrame([(code,)], "t string").select(L.field_kind(F.col("t")), L.field_identifier(F.col("t")))
    assert tuple(df.first()) == (kind, identifier)


def test_pages_are_looked_up_by_pieces(spark):
    blocks = [(1, i, t) for i, t in enumerate(["Alpha beta", "  alpha\tBETA ", "beta gamma delta", "ta", "x", "", None, "not there at all", "gamma delta eps"])]
    spots = [(1, 0, 1, "alpha  beta"), (1, 1, 2, "the beta gamma delta epsilon"), (1, 2, 3, "beta gamma delta"), (1, 3, 4, ""), (1, 4, 5, None), (2, 0, 9, "not there at all")]
    found = N.page_lookup(spark.createDataFrame(blocks, "doc_id long, pos int, text string"), spark.createDataFrame(spots, "doc_id long, ord int, page int, text string"))
    assert rows(found, "pos", "page") == [(0, 1), (1, 1), (2, 3), (3, 1), (4, None), (7, None), (8, 2)]


def test_a_long_document_is_looked_up_in_linear_time(spark):
    n = 20_000
    blocks = spark.range(n).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("pos"), F.concat(F.lit("a common beginning of block "), F.col("id"), F.lit(" ends")).alias("text"))
    spots = blocks.select("doc_id", F.col("pos").alias("ord"), F.col("pos").alias("page"), F.concat(F.lit("in it: "), "text", F.lit(" so")).alias("text"))
    found = N.page_lookup(blocks, spots)
    assert found.where("page = pos").count() == n


def test_lookup_of_pages_shuffles_positions_as_they_are(spark):
    blocks = spark.range(40).select((F.col("id") % 4).alias("doc_id"), F.col("id").cast("int").alias("pos"), F.concat(F.lit("sought "), "id", F.lit("!")).alias("text"))
    spots = blocks.select("doc_id", F.col("pos").alias("ord"), F.when(F.col("pos") != 9, F.col("pos")).alias("page"), F.concat(F.lit("x" * 300), "text").alias("text"))
    found = N.page_lookup(blocks, spots.union(spots.selectExpr("doc_id", "ord + 100", "page + 100", "text")))
    assert set(rows(found.where("page is not null"), "pos", "page")) == {(i, i) for i in range(40) if i != 9}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan  # no row for each place of a text


def test_fields_of_legends_count_by_the_type_they_name(spark):
    texts = ["Tableau {SEQ Figure} : a", "Figure {SEQ Figure} : b", "Tableau {SEQ Tableau} : c", "Figure 7 : d", "Figure { SEQ figure \\* ARABIC } : e", "PARTIE 2", "Figure {SEQ Figure} : "]
    got = D.legends(spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id long, pos int, text string"))
    assert rows(got, "pos", "type", "number", "label") == [(0, "Tableau", "1", "a"), (1, "Figure", "2", "b"), (2, "Tableau", "1", "c"), (3, "Figure", "7", "d"), (4, "Figure", "3", "e")]


@pytest.mark.parametrize("end,kept", [("PARTIE 2", True), ("SECTION 1 : but", True), ("Section deux", False)])
def test_a_list_of_legends_ends_at_the_next_part(spark, end, kept):
    texts = ["LISTE DES FIGURES", "Figure 1 : a\t3", end, "Figure 2 : b"]
    got = D.legends(spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id long, pos int, text string"))
    assert rows(got, "pos") == ([(3,)] if kept else [])


def test_curve_by_confidence(spark):
    predicted = [(1, 0, 0.9), (1, 1, 0.9), (1, 2, 0.8501), (1, 3, 0.8502), (2, 0, 0.2), (2, 1, 1.0), (2, 2, 0.0)]
    truth = [(1, 0), (1, 0), (1, 2), (2, 1), (2, 2), (3, 3)]
    got = M.detection_curve(spark.createDataFrame(predicted, "doc_id long, pos int, confidence double"), spark.createDataFrame(truth, "doc_id long, pos int"))
    want, true = [], set(truth)
    for c in sorted({p[2] for p in predicted}):
        over = [p for p in predicted if p[2] >= c]
        right = sum((d, p) in true for d, p, _ in over)
        want.append((c, len(over), right, int(right * 1000 / len(over) + 0.5) / 10, int(right * 1000 / len(true) + 0.5) / 10))
    assert rows(got, "confidence", "found", "right", "precision", "recall") == want
