"""Packages with inherited styles, text boxes and nested fields; tables over JDBC."""

import io
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from foliant.operators import detect as D
from foliant.operators import fields as L
from foliant.sources import documents as S

SPACE = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"'


def package(body, styles=None):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {SPACE}><w:body>{body}</w:body></w:document>")
        if styles is not None:
            z.writestr("word/styles.xml", f"<w:styles {SPACE}>{styles}</w:styles>")
    return bytearray(out.getvalue())


def packages(spark, **named):
    return spark.createDataFrame(list(named.items()), "path string, content binary")


def style(name_id, name=None, based_on=None, run="", outline=None):
    parts = f'<w:name w:val="{name}"/>' if name else ""
    parts += f'<w:basedOn w:val="{based_on}"/>' if based_on else ""
    parts += f'<w:pPr><w:outlineLvl w:val="{outline}"/></w:pPr>' if outline is not None else ""
    return f'<w:style w:styleId="{name_id}">{parts}<w:rPr>{run}</w:rPr></w:style>'


def p(text, style_id=None, run=""):
    of = f'<w:pPr><w:pStyle w:val="{style_id}"/></w:pPr>' if style_id else ""
    return f"<w:p>{of}<w:r><w:rPr>{run}</w:rPr><w:t>{text}</w:t></w:r></w:p>"


def test_styles_take_over_what_they_do_not_say(spark):
    chain = "".join(style(f"c{i}", based_on=f"c{i + 1}", run='<w:sz w:val="30"/>' if i == 40 else "<w:b/>" if i == 70 else "") for i in range(70)) + style("c70", run="<w:b/>")
    styles = (
        style("a", "Heading 1", "b") + style("b", "plain", "c", '<w:b w:val="0"/>') + style("c", "Titre 4", None, "<w:b/><w:i/>") + style("d", "x", "d", "<w:i/>")
        + style("e", "y", "f") + style("f", "z", "g", "<w:b/>") + style("g", "z", "e", '<w:sz w:val="8"/>') + style("h", "w", "nowhere", outline=8) + style("i", "Heading 12") + chain
    )
    found = S.resolve_styles(S.ingest_styles(packages(spark, one=package("", styles), two=package("", style("a", "Normal", "c")), bad=bytearray(b"x"))))
    got = {(r["path"], r["style_id"]): (r["level"], r["bold"], r["italic"], r["size"]) for r in found.collect()}
    want = {"a": (1, False, True, None), "b": (None, False, True, None), "c": (4, True, True, None), "d": (None, None, True, None), "e": (None, True, None, 8),
            "f": (None, True, None, 8), "g": (None, True, None, 8), "h": (9, None, None, None), "i": (None, None, None, None), "c0": (None, True, None, 30), "c41": (None, True, None, None)}
    assert {k: got["one", k] for k in want} == want and got["two", "a"] == (None, None, None, None) and ("bad", "a") not in got
    empty = S.resolve_styles(S.ingest_styles(packages(spark, one=package(""))))
    assert empty.count() == 0


def test_blocks_of_styled_packages(spark):
    styles = style("T", "heading 3", "B") + style("B", "Base", None, "<w:b/>") + style("N", "Normal")
    box = f'<w:txbxContent>{p("In a box", "T")}{p(" ")}</w:txbxContent>'
    both = f"<mc:AlternateContent><mc:Choice>{box}</mc:Choice><mc:Fallback>{box}</mc:Fallback></mc:AlternateContent>"
    body = p("One", "T") + p("Two", "T", '<w:b w:val="off"/>') + p("Three", "N", "<w:b/>") + f"<w:p><w:r><w:t>Around</w:t>{both}</w:r></w:p>" + p("Four", "lost")
    rows = S.ingest_styled(packages(spark, a=package(body, styles), b=package(p("no styles", "Heading1")), c=bytearray(b"no zip"))).collect()
    got = sorted((r["path"], r["pos"] or 0, r["type"], r["text"], r["style_level"], r["is_bold"], r["error"] is None) for r in rows)
    assert got == [
        ("a", 0, "paragraph", "One", 3, True, True), ("a", 1, "paragraph", "Two", 3, False, True), ("a", 2, "paragraph", "Three", None, True, True),
        ("a", 3, "paragraph", "Around", None, False, True), ("a", 4, "shape", "In a box", 3, True, True), ("a", 5, "paragraph", "Four", None, False, True),
        ("b", 0, "paragraph", "no styles", None, False, True), ("c", 0, None, None, None, False, False),
    ]


def test_fields_of_packages(spark):
    mark = lambda k: f'<w:r><w:fldChar w:fldCharType="{k}"/></w:r>'
    code = lambda t: f"<w:r><w:instrText>{t}</w:instrText></w:r>"
    text = lambda t: f"<w:r><w:t>{t}</w:t></w:r>"
    nested = mark("begin") + code("SEQ Figure ") + mark("begin") + code("STYLEREF 1") + mark("separate") + text("2") + mark("end") + mark("separate") + text("7") + mark("end")
    body = f'<w:p>{text("Figure ")}{nested}</w:p><w:p><w:fldSimple w:instr="PAGE">{text("3")}</w:fldSimple>{mark("end")}</w:p><w:p>{mark("begin")}{code("TOC")}</w:p>'
    tokens = S.ingest_tokens(packages(spark, a=package(body))).withColumnRenamed("path", "doc_id")
    counts = sorted(tuple(r) for r in L.field_counts(tokens).select("kind", "fields").collect())
    assert counts == [("page_number", 1), ("sequence", 1), ("style_reference", 1), ("table_of_contents", 1)]
    assert tuple(L.field_marks(tokens).select("begun", "closed", "nested", "stray_ends", "deepest", "open").first()) == (3, 2, 1, 1, 2, 1)


@pytest.fixture(scope="module")
def derby(spark, tmp_path_factory):
    url = f"jdbc:derby:{tmp_path_factory.mktemp('derby')}/db;create=true"
    rows = spark.range(1000).select(F.when(F.col("id") != 500, F.col("id") * 7 - 300).alias("KEY_"), F.concat(F.lit("name "), F.col("id")).alias("NAME"), (F.col("id") % 5).cast("int").alias("KIND"))
    rows.write.format("jdbc").option("url", url).option("dbtable", "ITEMS").save()
    spark.createDataFrame([], "KEY_ long, NAME string, KIND int").write.format("jdbc").option("url", url).option("dbtable", "NOTHING").save()
    return url


def test_a_table_over_jdbc_in_parts(spark, derby):
    table = S.read_source(spark, "KEY_ bigint, NAME string", jdbc={"url": derby, "dbtable": "ITEMS"}, split_on="KEY_", parts=5)
    assert table.rdd.getNumPartitions() == 5 and table.columns == ["KEY_", "NAME"]
    assert table.count() == 1000 and table.where("KEY_ is null").count() == 1
    counts = [r[0] for r in table.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(counts) == 5 and max(counts) < 300
    some = table.where("KEY_ > 6000")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(KEY_), *GreaterThan(KEY_,6000)]" in plan and "KIND" not in plan
    assert some.count() == sum(7 * i - 300 > 6000 for i in range(1000))


def test_a_table_over_jdbc_without_parts(spark, derby):
    whole = S.read_source(spark, "KEY_ int, KIND long", jdbc={"url": derby, "dbtable": "ITEMS"})
    assert [t for _, t in whole.dtypes] == ["int", "bigint"] and whole.count() == 1000
    assert S.read_source(spark, "KEY_ bigint", jdbc={"url": derby, "dbtable": "NOTHING"}, split_on="KEY_").count() == 0


def test_signals_of_packages_are_typed(spark):
    more = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    more += ' xmlns:wps="http://schemas.microsoft.com/office/word/2010/wordprocessingShape" xmlns:wpg="http://schemas.microsoft.com/office/word/2010/wordprocessingGroup"'
    drawn = lambda inner: f"<w:r {more}><w:drawing>{inner}</w:drawing></w:r>"
    frame = drawn(f'<wps:wsp><w:txbxContent>{p("CADRE DE TEXTE")}</w:txbxContent></wps:wsp>')
    image = drawn('<a:blip r:embed="rId7"/>')
    styles = style("T1", "toc 2") + style("Liste", "Liste des figures") + style("H", "heading 1") + style("LP", "list paragraph")
    body = (
        f"<w:p>{drawn('<wpg:wgp/>')}</w:p><w:p>{drawn('<wps:wsp/><wps:wsp/>')}</w:p><w:p>{frame}</w:p><w:p>{image}</w:p><w:p>{image}<w:r><w:t>Figure 3 : plan</w:t></w:r></w:p>"
        f"<w:p>{image}<w:r><w:t>seen from above</w:t></w:r></w:p>" + p("CHAPITRE I : debut\t4".replace("\t", "</w:t><w:tab/><w:t>"), "T1") + p("Figure 4 : vue", "Liste") + p("Un titre", "H") + p("puce", "LP")
        + "<w:p>" + '<w:r><w:rPr><w:b/></w:rPr><w:t>ab </w:t></w:r>' * 4 + "</w:p><w:p>" + '<w:r><w:rPr><w:b/></w:rPr><w:t>ab </w:t></w:r>' * 3 + "</w:p>"
    )
    signals = S.ingest_signals(packages(spark, a=package(body, styles)))
    rows = signals.select(F.lit(1).alias("doc_id"), "pos", F.concat(F.lit("b"), "pos").alias("block_id"), F.when(F.col("type").isin("image", "shape"), "paragraph").otherwise(F.col("type")).alias("base"),
                          "text", "style_level", "is_bold", "has_shape", "images", "toc_level", "run_count")
    got = {r["pos"]: (r["type"], r["text"], r["heading_level"], r["confidence"], r["original_number"], r["image_ref"]) for r in D.type_signals(rows).collect()}
    assert [got[k] for k in sorted(got)] == [
        ("shape", "", None, 1.0, None, None), ("shape", "", None, 1.0, None, None), ("paragraph", "", None, 0.85, None, None), ("paragraph", "CADRE DE TEXTE", None, 0.85, None, None),
        ("image", "", None, 0.9, None, "rId7"), ("figure", "Figure 3 : plan", None, 0.95, "3", "rId7"), ("figure", "seen from above", None, 0.8, None, "rId7"),
        ("toc_entry", "CHAPITRE I : debut", 2, 0.95, None, None), ("caption", "Figure 4 : vue", None, 0.95, "4", None), ("heading", "Un titre", 1, 0.9, None, None), ("paragraph", "puce", None, 0.85, None, None),
        ("paragraph", "ab ab ab ab", None, 0.85, None, None), ("paragraph", "ab ab ab", None, 0.6, None, None),
    ]


@pytest.mark.parametrize("name,level", [("TOC 3", 3), ("sommaire2", 2), ("Table of contents", 1), ("table des matières 1", 1), ("toc 0", 1), ("list paragraph", None), ("toc heading", None), (None, None)])
def test_contents_styles(spark, name, level):
    assert spark.createDataFrame([(name,)], "n string").select(S.contents_level(F.col("n"))).first()[0] == level


def test_rows_of_many_packages_go_out_in_few_frames():
    class Given:
        def select(self, *_):
            return self

        def mapInPandas(self, run, _):  # noqa: N802
            return list(run(iter([pd.DataFrame({"path": [f"p{i}" for i in range(50)], "content": [bytes(package(p("x") + p("y")))] * 49 + [b"bad"]})])))

    (frame,) = S.ingest_docx(Given())
    assert len(frame) == 99 and frame["error"].notna().sum() == 1 and list(frame["pos"][:4]) == [0, 1, 0, 1]
