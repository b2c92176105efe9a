"""Document sources and sinks: text, packages, block JSON, category arrays, reports."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.session import materialize, shared_path

EXTENSIONS = ("txt", "md", "text")
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"


def read_source(
    spark: SparkSession, schema: T.StructType | str, path: str | None = None, jdbc: dict[str, str] | None = None, split_on: str | None = None, parts: int = 8
) -> DataFrame:
    """A relational table with its declared schema, from parquet files or over JDBC (options url, dbtable, …).

    Over JDBC a table is read in ``parts`` ranges of the whole numbers, dates or times in ``split_on``, between the least
    and the greatest there are (rows without one go with the first range); filters and columns are left to the database.
    """
    if not jdbc:
        return spark.read.schema(schema).parquet(path)
    fields = T._parse_datatype_string(schema).fields if isinstance(schema, str) else schema.fields
    options = dict(jdbc)
    if split_on:
        bounds = f"(select min({split_on}) as least, max({split_on}) as most from {jdbc['dbtable']}) bounds"
        least, most = spark.read.format("jdbc").options(**jdbc | {"dbtable": bounds}).load().first()
        if least is not None and least != most:
            options |= {"partitionColumn": split_on, "lowerBound": str(least), "upperBound": str(most), "numPartitions": str(parts)}
    found = spark.read.format("jdbc").options(**options).load()
    return found.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields])


def clean_text(text: Column) -> Column:
    """One line end, no control characters; null if nothing is left."""
    t = F.regexp_replace(F.regexp_replace(text, "\r\n|\r", "\n"), CONTROL, "")
    return F.when(F.btrim(t, F.lit(" \t\n\r")) != "", t)


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 where they are valid, else as ISO-8859-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def ingest_text(spark: SparkSession, path: str) -> DataFrame:
    """Path, text of the text files in a folder; empty ones and other extensions are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.where(kind.isin(*EXTENSIONS)).select("path", clean_text(decoded(F.col("content"))).alias("text")).where("text is not null")


W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
BLIP = "{http://schemas.openxmlformats.org/drawingml/2006/main}blip"
SHAPE = "{http://schemas.microsoft.com/office/word/2010/wordprocessingShape}wsp"
GROUP = "{http://schemas.microsoft.com/office/word/2010/wordprocessingGroup}wgp"
ALTERNATIVES = "{http://schemas.openxmlformats.org/markup-compatibility/2006}AlternateContent"
EMBED = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}embed"
MOST_BYTES, MOST_ENTRIES = 500 << 20, 5000
FRAME_ROWS = 5000
BLOCK_ROWS = (
    "path string, pos long, type string, text string, style_level int, is_bold boolean, numbering_level int, "
    "cells array<array<string>>, image_ref string, error string"
)


def paragraph_text(p: ElementTree.Element) -> str:
    return "".join("\t" if x.tag == W + "tab" else x.text or "" for x in p.iter() if x.tag in (W + "t", W + "tab"))


# Levels of headings by the names of their styles.
HEADING_NAMES = {f"heading {n}": n for n in range(1, 10)} | {f"titre {n}": n for n in range(1, 7)}
STYLE_ROWS = "path string, style_id string, name string, based_on string, outline_level int, bold boolean, italic boolean, size int"
SWITCHES = ("0", "false", "off")


def open_package(content: bytes, most_bytes: int, most_entries: int) -> zipfile.ZipFile:
    z = zipfile.ZipFile(io.BytesIO(content))
    entries = z.infolist()
    if len(entries) > most_entries or sum(e.file_size for e in entries) > most_bytes:
        raise ValueError("package beyond the limits")
    return z


def part_of(z: zipfile.ZipFile, name: str) -> ElementTree.Element:
    xml = z.read(name)
    if b"<!DOCTYPE" in xml or b"<!ENTITY" in xml:
        raise ValueError("document type declarations are refused")
    return ElementTree.fromstring(xml)


def switch(properties: ElementTree.Element | None, name: str) -> bool | None:
    """Whether a property is on; null where it isn't said."""
    found = properties.find(W + name) if properties is not None else None
    return None if found is None else found.get(W + "val", "1").lower() not in SWITCHES


def package_styles(content: bytes, most_bytes: int = MOST_BYTES, most_entries: int = MOST_ENTRIES) -> Iterator[dict]:
    """The styles of one package as they are declared, without what they inherit."""
    with open_package(content, most_bytes, most_entries) as z:
        if "word/styles.xml" not in z.namelist():
            return
        root = part_of(z, "word/styles.xml")
    for style in root.findall(W + "style"):
        value = lambda path, at=style: (at.find(path).get(W + "val") if at.find(path) is not None else None)
        whole = lambda text: int(text) if text and text.isdigit() else None
        run = style.find(W + "rPr")
        yield {
            "style_id": style.get(W + "styleId"), "name": value(W + "name"), "based_on": value(W + "basedOn"), "outline_level": whole(value(f"{W}pPr/{W}outlineLvl")),
            "bold": switch(run, "b"), "italic": switch(run, "i"), "size": whole(value(f"{W}rPr/{W}sz")),
        }


def package_tokens(content: bytes, most_bytes: int = MOST_BYTES, most_entries: int = MOST_ENTRIES) -> Iterator[dict]:
    """Marks, instructions and texts of the fields of one package, with the paragraph they stand in."""
    with open_package(content, most_bytes, most_entries) as z:
        root = part_of(z, "word/document.xml")
    for pos, paragraph in enumerate(root.iter(W + "p")):
        for at, x in enumerate(paragraph.iter()):
            if x.tag == W + "fldChar" and x.get(W + "fldCharType") in ("begin", "separate", "end"):
                yield {"pos": pos, "ord": at, "kind": x.get(W + "fldCharType"), "text": ""}
            elif x.tag == W + "fldSimple":
                yield {"pos": pos, "ord": at, "kind": "simple", "text": x.get(W + "instr", "")}
            elif x.tag in (W + "instrText", W + "t"):
                yield {"pos": pos, "ord": at, "kind": "instr" if x.tag == W + "instrText" else "text", "text": x.text or ""}


def package_blocks(content: bytes, most_bytes: int = MOST_BYTES, most_entries: int = MOST_ENTRIES) -> Iterator[dict]:
    """Blocks of one word-processing package; ValueError beyond the limits or for what isn't one.

    A paragraph in a text box is a ``shape`` of its own behind the paragraph that holds the box, once, whatever copies of
    the box there are for older readers.
    """
    with open_package(content, most_bytes, most_entries) as z:
        body = part_of(z, "word/document.xml").find(W + "body")
    for element in body if body is not None else ():
        if element.tag == W + "tbl":
            cells = [["\n".join(map(paragraph_text, c.iter(W + "p"))) for c in row.findall(W + "tc")] for row in element.findall(W + "tr")]
            yield {"type": "table", "text": "", "cells": cells}
        elif element.tag == W + "p":
            boxes = text_boxes(element)
            yield paragraph_block(element)
            for p in (p for box in boxes for p in box.iter(W + "p")):
                block = paragraph_block(p) | {"type": "shape"}
                if block["text"].strip():
                    yield block


def text_boxes(element: ElementTree.Element) -> list[ElementTree.Element]:
    """Text boxes below an element; of alternatives only the first that has any."""
    found = []
    for child in element:
        if child.tag == W + "txbxContent":
            found.append(child)
        elif child.tag == ALTERNATIVES:
            found += next((boxes for boxes in map(text_boxes, child) if boxes), [])
        else:
            found += text_boxes(child)
    return found


def paragraph_block(element: ElementTree.Element) -> dict:
    """A paragraph's block, without what its text boxes hold."""
    style = element.find(f"{W}pPr/{W}pStyle")
    style_id = style.get(W + "val", "") if style is not None else None
    level = re.fullmatch(r"(?:Heading|Titre)\s?(\d)", style_id) if style_id else None
    number = element.find(f"{W}pPr/{W}numPr/{W}ilvl")
    runs, blip = element.findall(W + "r"), element.find(f".//{BLIP}")
    said = [switch(r.find(W + "rPr"), "b") for r in runs]
    text = own_text(element)
    return {
        "type": "image" if blip is not None else "paragraph", "text": text, "style_level": int(level[1]) if level else None,
        "is_bold": bool(said) and all(said), "numbering_level": int(number.get(W + "val")) if number is not None else None,
        "image_ref": blip.get(EMBED) if blip is not None else None, "style_id": style_id, "runs_bold": [*said], "run_count": len(runs),
        "has_shape": has_diagram(element), "images": [b.get(EMBED) or "embedded-object" for b in element.iter(BLIP)],
    }


def has_diagram(element: ElementTree.Element) -> bool:
    """Whether drawn shapes make a diagram: a group, several in a drawing, or one that is no frame around text."""
    if next(element.iter(GROUP), None) is not None:
        return True
    shapes = [list(drawing.iter(SHAPE)) for drawing in element.iter(W + "drawing")]
    return any(len(found) > 1 or (found and next(found[0].iter(W + "txbxContent"), None) is None) for found in shapes)


def own_text(element: ElementTree.Element) -> str:
    """A paragraph's text without what its text boxes hold."""
    if element.tag == W + "txbxContent":
        return ""
    here = "\t" if element.tag == W + "tab" else (element.text or "") if element.tag == W + "t" else ""
    return here + "".join(map(own_text, element))


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """path, content of the packages in a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.docx").load(path)
    return files.select("path", "content")


def from_packages(packages: DataFrame, read: Callable[..., Iterator[dict]], schema: str, most_bytes: int, most_entries: int) -> DataFrame:
    """Rows that ``read`` makes of each package (path, content), numbered where the schema has ``pos`` and the row hasn't;
    one with an error for a bad package, where the schema has it."""
    columns = T._parse_datatype_string(schema).names

    def frame(rows: list[dict]) -> pd.DataFrame:
        return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in columns})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done: list[dict] = []  # rows of many packages go out as one frame
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows = [{"path": path, "pos": i} | b for i, b in enumerate(read(content, most_bytes, most_entries))]
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    rows = [{"path": path, "error": f"{type(e).__name__}: {e}"[:300]}] if "error" in columns else []
                done += rows
                if len(done) >= FRAME_ROWS:
                    yield frame(done)
                    done = []
            yield frame(done)

    return packages.select("path", "content").mapInPandas(run, schema)


def ingest_docx(packages: DataFrame, most_bytes: int = MOST_BYTES, most_entries: int = MOST_ENTRIES) -> DataFrame:
    """S3: packages (path, content) to block rows; a bad package gives one row with its error.

    Good rows are those without an error; ``rejects`` has the others. Levels go by the ids of styles and bold by what the
    runs say themselves; ``ingest_styled`` goes by the table of styles.
    """
    return from_packages(packages, package_blocks, BLOCK_ROWS, most_bytes, most_entries)


def ingest_tokens(packages: DataFrame, most_bytes: int = MOST_BYTES, most_entries: int = MOST_ENTRIES) -> DataFrame:
    """Tokens of fields (path, pos, ord, kind, text) of good packages."""
    return from_packages(packages, package_tokens, "path string, pos long, ord long, kind string, text string", most_bytes, most_entries)


def ingest_styles(packages: DataFrame, most_bytes: int = MOST_BYTES, most_entries: int = MOST_ENTRIES) -> DataFrame:
    """Styles of good packages as they are declared; of several of one id the first in the order of their properties."""
    rows = from_packages(packages, package_styles, STYLE_ROWS, most_bytes, most_entries).where("style_id is not null")
    others = [f.split()[0] for f in STYLE_ROWS.split(", ")[2:]]
    return rows.groupBy("path", "style_id").agg(F.min(F.struct(*others)).alias("s")).select("path", "style_id", "s.*")


# Names of styles of contents lists; others have their level behind the name.
CONTENTS_NAMES = (
    "table of contents", "table of figures", "tabledesillustrations", "table des matieres", "table des matières", "liste des figures", "liste des tableaux", "liste des annexes",
)
CONTENTS_LEVEL = r"^(?:toc|sommaire|table\s+of\s+contents|table\s+des\s+mati[eè]res)\s*(\d+)$"


def contents_level(name: Column) -> Column:
    """The level of the contents entries that a style of this name makes, null for other styles."""
    level = F.regexp_extract(F.lower(name), CONTENTS_LEVEL, 1)
    return F.when(F.lower(name).isin(*CONTENTS_NAMES), 1).when(level != "", F.greatest(F.lit(1), level.cast("int")))


INHERITED = ("bold", "italic", "size")


def resolve_styles(styles: DataFrame) -> DataFrame:
    """S3: styles (path, style_id, name, based_on, outline_level, bold, italic, size) with what they inherit, and the level
    of heading that they are (own outline level, else own name; it isn't inherited).

    Pointers are doubled: each round takes over what the ancestor pointed at has and points where that one points, so
    chains of 2^k styles take k rounds, and as many as a package's number of styles needs end any cycle: going round one
    meets only styles that were taken over before. A parent that isn't there ends a chain.
    """
    rows = materialize(styles.withColumn("above", F.when(F.col("based_on") != F.col("style_id"), F.col("based_on"))), "styles")
    longest = rows.groupBy("path").count().agg(F.max("count")).first()[0] or 1
    for _ in range(max(1, (longest - 1).bit_length())):
        up = rows.select("path", F.col("style_id").alias("above"), F.col("above").alias("next"), *[F.col(c).alias(f"{c}_up") for c in INHERITED])
        kept = [c for c in rows.columns if c not in (*INHERITED, "above", "path")]
        rows = rows.join(up, ["path", "above"], "left").select("path", *kept, *[F.coalesce(c, f"{c}_up").alias(c) for c in INHERITED], F.col("next").alias("above"))
        rows = materialize(rows, "styles")
    name = F.lower(F.coalesce("name", F.lit("")))
    known = F.element_at(F.create_map(*[F.lit(x) for pair in HEADING_NAMES.items() for x in pair]), name)
    number = F.regexp_extract(name, r"(?:heading|titre)\s*(\d+)", 1)
    numbered = F.when(F.length(number) == 1, F.when(number != "0", number.cast("int")))
    return rows.drop("above").withColumn("level", F.coalesce(F.col("outline_level") + 1, known, numbered))


SIGNALS = ", style_id string, runs_bold array<boolean>, run_count int, has_shape boolean, images array<string>"


def ingest_signals(packages: DataFrame, most_bytes: int = MOST_BYTES, most_entries: int = MOST_ENTRIES) -> DataFrame:
    """S3: block rows with all that typing reads: levels and bold from the package's styles, inherited or said by the
    runs, the level of contents styles, numbers of runs, shapes and images."""
    blocks = from_packages(packages, package_blocks, BLOCK_ROWS + SIGNALS, most_bytes, most_entries)
    styles = resolve_styles(ingest_styles(packages, most_bytes, most_entries)).select("path", "style_id", "level", F.col("bold").alias("style_bold"), contents_level(F.col("name")).alias("toc_level"))
    rows = blocks.join(styles, ["path", "style_id"], "left")
    runs = F.transform("runs_bold", lambda b: F.coalesce(b, "style_bold", F.lit(False)))
    bold = F.coalesce((F.size(runs) > 0) & F.forall(runs, lambda b: b), F.lit(False))
    names = [f.split()[0] for f in BLOCK_ROWS.split(", ")]
    return rows.withColumn("style_level", F.col("level")).withColumn("is_bold", bold).select(*names, "toc_level", "run_count", "has_shape", "images")


def ingest_styled(packages: DataFrame, most_bytes: int = MOST_BYTES, most_entries: int = MOST_ENTRIES) -> DataFrame:
    """S3: block rows whose heading levels and bold come from the package's styles, inherited or said by the runs."""
    return ingest_signals(packages, most_bytes, most_entries).select(*[f.split()[0] for f in BLOCK_ROWS.split(", ")])


def rejects(blocks: DataFrame) -> DataFrame:
    return blocks.where("error is not null").select("path", "error")


def make_packages(docs: DataFrame) -> DataFrame:
    """Packages made of documents (doc_id, text): a paragraph a line, '# ' lines as Heading1, '|' lines as table rows."""

    def package(text: str) -> bytes:
        escape = lambda x: re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", x).replace("&", "&amp;").replace("<", "&lt;")
        para = lambda x, head: f"<w:p>{'<w:pPr><w:pStyle w:val=\"Heading1\"/></w:pPr>' if head else ''}<w:r><w:t>{escape(x)}</w:t></w:r></w:p>"
        parts = []
        for i, line in enumerate(text.split("\n")):
            if " | " in line:
                parts.append("<w:tbl><w:tr>" + "".join(f"<w:tc>{para(c, False)}</w:tc>" for c in line.split(" | ")) + "</w:tr></w:tbl>")
            else:
                parts.append(para(line, i == 0))
        xml = f'<w:document xmlns:w="{W[1:-1]}"><w:body>{"".join(parts)}</w:body></w:document>'
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("word/document.xml", xml)
        return out.getvalue()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": [f"doc-{i}.docx" for i in batch["doc_id"]], "content": [package(t or "") for t in batch["text"]]})

    return docs.select("doc_id", "text").mapInPandas(run, "path string, content binary")


#: Styles of the packages below: a chain of three, a cycle of two, one whose parent is missing.
STYLES = """<w:styles xmlns:w="{w}"><w:style w:styleId="S1"><w:name w:val="Base"/><w:rPr><w:b/><w:sz w:val="22"/></w:rPr></w:style>
<w:style w:styleId="S2"><w:name w:val="Body"/><w:basedOn w:val="S1"/><w:rPr><w:i/></w:rPr></w:style>
<w:style w:styleId="Titre2"><w:name w:val="Heading 2"/><w:basedOn w:val="S2"/></w:style>
<w:style w:styleId="Loop1"><w:name w:val="one"/><w:basedOn w:val="Loop2"/></w:style>
<w:style w:styleId="Loop2"><w:name w:val="two"/><w:basedOn w:val="Loop1"/><w:rPr><w:i/></w:rPr></w:style>
<w:style w:styleId="Own"><w:name w:val="Custom"/><w:basedOn w:val="S1"/><w:pPr><w:outlineLvl w:val="0"/></w:pPr><w:rPr><w:b w:val="0"/></w:rPr></w:style>
<w:style w:styleId="Lost"><w:name w:val="Titre 3 Car"/><w:basedOn w:val="None"/></w:style></w:styles>"""
USED = ("Titre2", "Loop1", None, "Own", "S2", "Lost", "Unknown")


def make_styled_packages(docs: DataFrame) -> DataFrame:
    """Packages made of documents (doc_id, text): a paragraph a line in the styles above by turns, every sixth in a text
    box that stands twice in the file, as alternatives do."""

    def package(text: str) -> bytes:
        escape = lambda x: re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", x).replace("&", "&amp;").replace("<", "&lt;")

        def para(line: str, i: int, inner: str = "") -> str:
            style = USED[i % len(USED)]
            said = '<w:rPr><w:b w:val="false"/></w:rPr>' if i % 5 == 4 else ""
            return f"<w:p>{f'<w:pPr><w:pStyle w:val=\"{style}\"/></w:pPr>' if style else ''}<w:r>{said}<w:t>{escape(line)}</w:t>{inner}</w:r></w:p>"

        parts = []
        for i, line in enumerate(text.split("\n")):
            box = f"<w:txbxContent>{para(line, i)}</w:txbxContent>"
            both = f"<mc:AlternateContent><mc:Choice>{box}</mc:Choice><mc:Fallback>{box}</mc:Fallback></mc:AlternateContent>"
            parts.append(para("box", i, both) if i % 6 == 5 else para(line, i))
        space = f'xmlns:w="{W[1:-1]}" xmlns:mc="{ALTERNATIVES[1:].split("}")[0]}"'
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("word/document.xml", f"<w:document {space}><w:body>{''.join(parts)}</w:body></w:document>")
            z.writestr("word/styles.xml", STYLES.format(w=W[1:-1]))
        return out.getvalue()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": [f"doc-{i}.docx" for i in batch["doc_id"]], "content": [package(t or "") for t in batch["text"]]})

    return docs.select("doc_id", "text").mapInPandas(run, "path string, content binary")


VERSION = 1
BLOCK_JSON = (
    "struct<schema_version:int,document_id:bigint,blocks:array<struct<pos:int,block_id:string,type:string,text:string,"
    "heading_level:int,confidence:double,category:string,original_number:string>>>"
)
FIELDS = ("pos", "block_id", "type", "text", "heading_level", "confidence", "category", "original_number")


def blocks_to_json(blocks: DataFrame) -> DataFrame:
    """One JSON text a document: version, id and blocks in order."""
    ordered = F.array_sort(F.collect_list(F.struct(*FIELDS)))
    rows = blocks.groupBy("doc_id").agg(ordered.alias("blocks"))
    payload = F.struct(F.lit(VERSION).alias("schema_version"), F.col("doc_id").alias("document_id"), "blocks")
    return rows.select("doc_id", F.to_json(payload).alias("json"))


def blocks_from_json(texts: DataFrame) -> DataFrame:
    """Back to a row a block; texts of a later version are left out."""
    rows = texts.select(F.from_json("json", BLOCK_JSON).alias("d")).where(F.col("d.schema_version") <= VERSION)
    return rows.select(F.col("d.document_id").alias("doc_id"), F.explode("d.blocks").alias("b")).select("doc_id", "b.*")


# The category arrays in the order in which they become blocks, and their block type.
CATEGORIES = (
    ("titres", "heading"), ("sous_titres", "heading"), ("en_tetes", "header"), ("pieds_de_page", "footer"), ("tableaux", "table"), ("images", "image"),
    ("elements_flottants", "shape"), ("legends", "caption"),
)


def blocks_to_legacy(blocks: DataFrame) -> DataFrame:
    """Per document an array of (pos, text, level) for each category."""
    item = F.struct("pos", "text", F.col("heading_level").alias("level"))

    def test(name: str, kind: str) -> Column:
        level = F.coalesce("heading_level", F.lit(1))
        extra = {"titres": level == 1, "sous_titres": level > 1}.get(name, F.lit(True))
        return (F.col("type") == kind) & extra

    return blocks.groupBy("doc_id").agg(*[F.array_sort(F.collect_list(F.when(test(n, k), item))).alias(n) for n, k in CATEGORIES])


def legacy_to_blocks(legacy: DataFrame) -> DataFrame:
    """Headings of both lists in order of position, then the other categories, then captions: doc_id, ord, type, …"""
    parts = [
        legacy.select("doc_id", F.lit(0 if k == "heading" else i).alias("part"), F.lit(k).alias("type"), F.inline(n))
        for i, (n, k) in enumerate(CATEGORIES)
    ]
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("part", "pos")) - 1
    return rows.select("doc_id", order.cast("long").alias("ord"), "type", "pos", "text", F.when(F.col("type") == "heading", F.coalesce("level", F.lit(1))).alias("heading_level"))


def legacy_format(columns: list[str]) -> str:
    """Which form a structure has, by its keys."""
    names = set(columns)
    if "body_complet" in names:
        return "complet"
    if names & {n for n, _ in CATEGORIES}:
        return "structure"
    return "markdown" if "markdown" in names else "inconnu"


def restore_reading_order(blocks: DataFrame) -> DataFrame:
    """Stable order by position_y, then origin, in documents where any position is known; and legend_order_gap."""
    doc = Window.partitionBy("doc_id")
    known = F.max(F.col("position_y").isNotNull().cast("int")).over(doc)
    captions = F.sum((F.col("type") == "caption").cast("int")).over(doc)
    placed = F.max(((F.col("type") == "caption") & F.col("position_y").isNotNull()).cast("int")).over(doc)
    rows = blocks.withColumns({"known": known, "gap": (captions > 1) & (placed == 0)})
    order = doc.orderBy(F.when(F.col("known") == 1, F.coalesce("position_y", F.lit(0.0))).otherwise(F.lit(0.0)), "pos")
    return rows.select("doc_id", "block_id", (F.row_number().over(order) - 1).cast("long").alias("ord"), F.col("gap").alias("legend_order_gap"))


def write_report(report: DataFrame, path: str | None = None) -> str:
    """A report as JSON lines; returns the folder."""
    path = path or shared_path(report.sparkSession, "report")
    report.write.json(path)
    return path
