"""Structure detection: blocks in, typed and assessed blocks out. One plan over all documents, no loop.

Blocks: doc_id, pos, block_id, base (figure, table, image or paragraph as read), text, style_level, is_bold.
All windows are per document; a document's blocks sit in one window partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from foliant.functions import patterns as P

AUTO = 0.85
# Titles of generated lists.
LIST_TITLES = ("LISTE DES FIGURES", "LISTE DES TABLEAUX", "LISTE DES ANNEXES", "LISTE DES PLANCHES", "TABLE DES MATIERES", "TABLE DES ANNEXES")
# Front-matter titles that make an entry of a contents list explicit.
FRONT_TITLES = (
    "SOMMAIRE", "INTRODUCTION", "CONCLUSION", "BIBLIOGRAPHIE", "RESUME", "RÉSUMÉ", "ABSTRACT", "REMERCIEMENTS", "DEDICACE", "DÉDICACE",
    "AVANT-PROPOS", "TABLE DES MATIERES", "TABLE DES MATIÈRES", "LEXIQUE", "GLOSSAIRE", "LISTE DES FIGURES", "LISTE DES TABLEAUX",
    "LISTE DES ANNEXES", "SIGLES", "ABREVIATIONS", "ABRÉVIATIONS",
)
# What marks a cover page, and the titles that end it.
COVER_MARKS = (
    "republique", "republic of cameroon", "ministere", "universite", "institut", "ecole", "faculte", "presente par", "redige en vue",
    "sous l'encadrement", "annee academique", "filiere", "cursus", "rapport de stage", "memoire", "diplome",
)
COVER_ENDS = (
    "sommaire", "table des matieres", "tables des matieres", "dedicace", "remerciements", "avant-propos", "sigles", "abreviations",
    "liste des figures", "liste de figures", "liste des tableaux", "liste de tableaux", "liste des sigles", "liste des illustrations",
    "liste des annexes", "resume", "abstract", "introduction", "introduction generale",
)
# Titles that begin a page of their own, without accents.
PAGE_TITLES = (
    "SOMMAIRE", "TABLE DES MATIERES", "DEDICACE", "REMERCIEMENTS", "REMERCIMENTS", "AVANT-PROPOS", "AVANT PROPOS", "PREFACE",
    "LISTE DES FIGURES", "LISTE DES TABLEAUX", "LISTE DES ANNEXES", "LISTE DES PLANCHES", "LISTE DES ABREVIATIONS", "LISTE DES SIGLES",
    "SIGLES ET ABREVIATIONS", "TABLE DES ABREVIATIONS", "RESUME", "ABSTRACT", "EXECUTIVE SUMMARY", "INTRODUCTION", "BIBLIOGRAPHIE",
    "REFERENCES BIBLIOGRAPHIQUES", "WEBOGRAPHIE", "ANNEXE",
)
UP_ACCENTS, UP_PLAIN = "ÉÈÊËÀÂÄÎÏÔÖÙÛÜÇ", "EEEEAAAIIOOUUUC"


def by_doc() -> WindowSpec:
    return Window.partitionBy("doc_id")


def in_order() -> WindowSpec:
    return by_doc().orderBy("pos")


def any_of(conditions: list[Column]) -> Column:
    found = F.lit(False)
    for c in conditions:
        found = found | c
    return found


def numbered(blocks: DataFrame) -> DataFrame:
    """Blocks with the readings of their text: num (T8), cap (T10) and list_entry."""
    t = F.col("text")
    return blocks.select("*", P.heading_number(t).alias("num"), P.caption(t).alias("cap"), P.is_list_entry(t).alias("list_entry"))


def is_list_title(text: Column) -> Column:
    folded = F.translate(F.upper(P.trimmed(text)), UP_ACCENTS, UP_PLAIN)
    return P.let(folded, lambda t: any_of([(t == x) | t.startswith(x + " ") for x in LIST_TITLES]))


# Fixed value: what an image without a file of its own is called.
EMBEDDED = "embedded-object"
MARKER = r"\[image:[^\]]*\]"
MOST_BOLD_RUNS = 3


def type_signals(blocks: DataFrame) -> DataFrame:
    """T28 with all signals of a paragraph: has_shape (a drawn shape), images (names of its images), toc_level (of its
    contents style) and run_count, beside those of ``type_blocks``; any may be null.

    A shape without text, or whose only image is the shape itself, is a ``shape`` and keeps no text. A paragraph with
    images is an image without text, else a figure, numbered if its text is a caption; its text is read without the
    marks of images. A contents style makes an entry before any heading does; a bold line of many runs is no candidate.
    """
    t = P.trimmed(F.regexp_replace(F.col("text"), MARKER, ""))
    rows = blocks.withColumn("around", t).withColumn("marked", F.col("text")).withColumn("text", t)
    images = F.coalesce("images", F.array().cast("array<string>"))
    c, pictured = F.col("cap"), F.size(images) > 0
    shape = F.coalesce("has_shape", F.lit(False)) & ((F.col("around") == "") | (images == F.array(F.lit(EMBEDDED))))
    many = F.coalesce("run_count", F.lit(1)) > MOST_BOLD_RUNS
    typed = type_blocks(rows.withColumn("is_bold", F.col("is_bold") & ~many), ("around", "marked", "images", "has_shape", "toc_level", "run_count")).withColumn(
        "cap", P.caption(F.col("around"))
    )
    plain = F.col("base") == "paragraph"
    entry = c.isNull() & F.col("toc_level").isNotNull()
    kind = F.when(plain & shape, "shape").when(plain & pictured, F.when(c.isNull() & (F.col("around") == ""), "image").otherwise("figure")).when(plain & entry, "toc_entry")
    sure = F.when(kind == "shape", 1.0).when(kind == "image", 0.9).when(kind == "figure", F.when(c.isNotNull(), 0.95).otherwise(0.8)).when(kind == "toc_entry", 0.95)
    text = F.when(kind == "shape", "").when(kind == "toc_entry", P.without_page(F.col("around"))).when(kind.isNotNull(), F.col("marked")).otherwise(F.col("text"))
    figure = kind == "figure"
    return typed.withColumn("kind", kind).select(
        "doc_id", "pos", "block_id", text.alias("text"), F.coalesce("kind", "type").alias("type"),
        F.when(F.col("kind") == "toc_entry", F.col("toc_level")).when(F.col("kind").isNull(), F.col("heading_level")).cast("int").alias("heading_level"),
        F.coalesce(sure, "confidence").alias("confidence"), F.when(figure, F.coalesce(c["category"], F.lit("figure"))).when(F.col("kind").isNull(), F.col("category")).alias("category"),
        F.when(figure, c["number"]).when(F.col("kind").isNull(), F.col("original_number")).alias("original_number"), F.when(figure | (kind == "image"), F.get(images, F.lit(0))).alias("image_ref"),
    )


def type_blocks(blocks: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """The first typing: type, heading_level, confidence, category, original_number; columns in ``more`` stay."""
    n, c = F.col("num"), F.col("cap")
    style, level = F.col("style_level"), F.col("num")["level"]
    kind = F.when(n["kind"] == "keyword", 0.88).when(n["reliable"], 0.8).otherwise(0.7)
    carrier = F.col("base").isin("figure", "table")
    listed = c.isNotNull() & F.col("list_entry")
    verdict = lambda kind_, confidence, heading: F.struct(
        F.lit(kind_).alias("type"), confidence.alias("confidence"), heading.cast("int").alias("heading_level")
    )
    null = F.lit(None)
    v = (
        F.when(carrier, F.struct(F.col("base").alias("type"), F.lit(0.98).alias("confidence"), null.cast("int").alias("heading_level")))
        .when(F.col("base") == "image", verdict("image", F.lit(0.9), null))
        .when(listed, verdict("toc_entry", F.lit(0.95), F.lit(1)))
        .when(c.isNotNull(), verdict("caption", F.lit(0.95), null))
        .when(is_list_title(F.col("text")), verdict("toc_entry", F.lit(0.95), F.lit(1)))
        .when(style.isNotNull() & n.isNotNull(), verdict("heading", F.when(style == level, 0.98).otherwise(0.65), level))
        .when(style.isNotNull(), verdict("heading", F.lit(0.9), style))
        .when(n.isNotNull(), verdict("heading", kind, level))
        .when(F.col("is_bold") & (F.col("text") != "") & (F.length("text") <= 80), verdict("paragraph", F.lit(0.6), null))
        .otherwise(verdict("paragraph", F.lit(0.85), null))
    )
    is_caption = F.col("v.type") == "caption"
    own = F.when(carrier, F.col("base"))
    return numbered(blocks).withColumn("v", v).select(
        "doc_id", "pos", "block_id", "base", F.when(listed & (F.col("v.type") == "toc_entry"), P.without_page(F.col("text"))).otherwise(F.col("text")).alias("text"),
        "style_level", "is_bold", "v.type", "v.heading_level", "v.confidence", F.when(is_caption, c["category"]).otherwise(own).alias("category"),
        F.when(is_caption, c["number"]).alias("original_number"), *more,
    )


def toc_runs(typed: DataFrame, gap: int = 6, least: int = 4) -> DataFrame:
    """Headings that end in a page number, at most ``gap`` blocks apart and at least ``least`` of them, make every
    heading in their range an entry of a contents list; explicit titles are entries always."""
    member = (F.col("type") == "heading") & P.ends_with_page(F.col("text"))
    before = F.last(F.when(member, F.col("pos")), True).over(in_order().rowsBetween(Window.unboundedPreceding, -1))
    new = member & (before.isNull() | (F.col("pos") - before > gap))
    rows = typed.withColumn("member", member).withColumn("zone", F.sum(new.cast("int")).over(in_order()))
    zone = Window.partitionBy("doc_id", "zone")
    title = F.upper(P.without_page(F.col("text")))
    explicit = F.col("member") & any_of([title.startswith(x) for x in FRONT_TITLES])
    last = F.max(F.when(F.col("member"), F.col("pos"))).over(zone)
    dense = (F.sum(F.col("member").cast("int")).over(zone) >= least) & (F.col("pos") <= last) & (F.col("zone") > 0)
    listed = (F.col("type") == "heading") & (dense | explicit)
    return rows.withColumn("listed", listed).select(
        "doc_id", "pos", "block_id", "base", F.when(F.col("listed"), P.without_page(F.col("text"))).otherwise(F.col("text")).alias("text"),
        "style_level", "is_bold", F.when(F.col("listed"), "toc_entry").otherwise(F.col("type")).alias("type"), "heading_level",
        F.when(F.col("listed"), 0.9).otherwise(F.col("confidence")).alias("confidence"), "category", "original_number",
    )


def all_caps(text: Column) -> Column:
    return P.let(P.trimmed(text), caps_of)


def caps_of(t: Column) -> Column:
    return (F.length(t) >= 3) & (F.length(t) <= 80) & ~t.rlike(r"[.,;]$") & t.rlike(r"\p{Lu}") & (F.upper(t) == t)


def promote_all_caps(typed: DataFrame) -> DataFrame:
    """Paragraphs in capitals become headings of level 1."""
    up = (F.col("type") == "paragraph") & all_caps(F.col("text"))
    return typed.withColumn("up", up).withColumns(
        {"type": F.when(F.col("up"), "heading").otherwise(F.col("type")), "heading_level": F.when(F.col("up"), 1).otherwise(F.col("heading_level")),
         "confidence": F.when(F.col("up"), 0.75).otherwise(F.col("confidence"))}
    ).drop("up")


def empty_run_breaks(typed: DataFrame, least: int = 3) -> DataFrame:
    """Empties (empty paragraphs right before) and page_break_before of headings after at least three."""
    full = ~((F.col("type") == "paragraph") & (P.trimmed(F.col("text")) == ""))
    before = F.last(F.when(full, F.col("pos")), True).over(in_order().rowsBetween(Window.unboundedPreceding, -1))
    empties = F.col("pos") - F.coalesce(before, F.lit(-1)) - 1
    rows = typed.withColumn("empties", empties.cast("long"))
    return rows.withColumn("page_break_before", (F.col("type") == "heading") & (F.col("empties") >= least))


def has_mark(folded: Column) -> Column:
    return any_of([folded.contains(m) for m in COVER_MARKS])


def cover_pages(typed: DataFrame, most: int = 40, least: int = 2) -> DataFrame:
    """Per document: blocks of the cover candidate, distinct marks in it, the verdict and an excerpt.

    The candidate ends at the first front-matter title, else at the first heading without a mark, else it is all.
    """
    f = P.folded(F.col("text"))
    ends = (f != "") & (F.length(f) <= 80) & any_of([(f == x) | f.rlike("^" + x + "[ :\t]") for x in COVER_ENDS])
    rows = typed.select("doc_id", "pos", "type", "text", f.alias("f"), ends.alias("ends"))
    first = lambda c: F.min(F.when(c, F.col("pos"))).over(by_doc())
    total = F.count("*").over(by_doc())
    end = F.coalesce(first(F.col("ends")), first((F.col("type") == "heading") & ~has_mark(F.col("f"))))
    rows = rows.withColumn("end", end).withColumn("n", F.coalesce(F.col("end"), total).cast("long"))
    inside = F.col("pos") < F.col("n")
    marks = sum((F.max(F.when(inside & F.col("f").contains(m), 1).otherwise(0)) for m in COVER_MARKS[1:]),
                F.max(F.when(inside & F.col("f").contains(COVER_MARKS[0]), 1).otherwise(0)))
    text = F.when(inside & (P.trimmed(F.col("text")) != "") & (F.col("pos") < 20), F.struct("pos", P.trimmed(F.substring("text", 1, 100)).alias("t")))
    parts = F.transform(F.array_sort(F.collect_list(text)), lambda x: x["t"])
    rows = rows.groupBy("doc_id").agg(F.first("n").alias("blocks"), F.first("end").isNotNull().alias("ended"), marks.cast("long").alias("marks"),
                                      F.substring(F.array_join(parts, " · "), 1, 100).alias("excerpt"))
    verdict = (
        F.when(F.col("blocks") == 0, "starts_with_front_matter").when(F.col("blocks") > most, F.when(F.col("ended"), "too_long").otherwise("too_long_open"))
        .when(F.col("marks") < least, "few_marks").otherwise("remove")
    )
    return rows.select("doc_id", "blocks", "marks", verdict.alias("verdict"), "excerpt")


def without_covers(typed: DataFrame) -> DataFrame:
    """T21 applied: blocks of cover pages are cut."""
    gone = cover_pages(typed).where("verdict = 'remove'").select("doc_id", "blocks")
    kept = typed.join(gone, "doc_id", "left").where("blocks is null or pos >= blocks")
    return kept.drop("blocks")


def assess(typed: DataFrame, shield_types: tuple[str, ...] = ("toc_entry", "shape"), keep_parsed: bool = True) -> DataFrame:
    """New type, confidence, signal, level and category of each block, and whether it needs review.

    ``shield_types`` stay as they are; with ``keep_parsed`` a heading whose text is numbered keeps level and confidence.
    """
    n, c, t = F.col("num"), F.col("cap"), F.col("text")
    level = F.col("heading_level")

    def v(kind, confidence, signal, lev=None, category=None) -> Column:
        as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(
            as_col(kind).alias("type"), as_col(confidence).cast("double").alias("confidence"), as_col(signal).alias("signal"),
            as_col(lev).cast("int").alias("level"), as_col(category).cast("string").alias("category"),
        )

    kind, category = F.col("type"), F.col("category")
    choice = (
        F.when(kind.isin(*shield_types), v(kind, F.col("confidence"), "shielded", level, category))
        .when(kind == "table", v("table", 0.98, "table", None, category))
        .when(kind.isin("header", "footer"), v(kind, 0.98, "page_part"))
        .when(kind.isin("annexe", "planche"), v(kind, 0.95, "explicit_type", None, F.coalesce(category, kind)))
        .when(kind == "cross_ref", v("cross_ref", 0.98, "explicit_type", None, category))
        .when((kind == "figure") & (c.isNotNull() | F.col("original_number").isNotNull()),
              v("figure", 0.95, "image_with_caption", None, F.coalesce(c["category"], category, F.lit("figure"))))
        .when(kind == "figure", v("image", 0.9, "image_without_caption"))
        .when(c.isNotNull() & ~F.col("list_entry"), v("caption", 0.95, "caption", None, c["category"]))
        .when(F.lit(keep_parsed) & level.isNotNull() & n.isNotNull() & (kind == "heading"), v("heading", F.col("confidence"), "parsed_level", level))
        .when(level.isNotNull() & n.isNotNull(), F.when(level == n["level"], v("heading", 0.98, "style_and_number", n["level"])).otherwise(
            v("heading", 0.65, "contradiction", n["level"])))
        .when(level.isNotNull(), v("heading", 0.92, "style", level))
        .when(n.isNotNull(), v("heading", F.when(n["reliable"], 0.85).otherwise(0.6), "number", n["level"]))
        .when(kind == "image", v("image", 0.9, "image"))
        .when(F.col("is_bold"), F.when(P.isolated_heading(t), v("heading", 0.82, "bold_line")).otherwise(v("paragraph", 0.7, "bold_but_long")))
        .when(P.sentence_shape(t), v("paragraph", 0.9, "sentence"))
        .when(P.isolated_heading(t), v("paragraph", 0.7, "short_line"))
        .otherwise(v("paragraph", 0.85, "default"))
    )
    return numbered(typed).withColumn("v", choice).select(
        *[F.col(x) for x in ("doc_id", "pos", "block_id", "text", "is_bold", "original_number")], F.col("v.type").alias("type"),
        "v.confidence", "v.signal", F.col("v.level").alias("heading_level"), "v.category", (F.col("v.confidence") < AUTO).alias("needs_review"),
    )


def partition_confidence(assessed: DataFrame, threshold: float = AUTO) -> DataFrame:
    """One row: blocks, confident, ambiguous and the share decided without review."""
    sure = F.count(F.when(F.col("confidence") >= threshold, 1))
    n = F.count("*")
    return assessed.agg(n.alias("total"), sure.alias("confident"), (n - sure).alias("ambiguous"), F.coalesce(F.try_divide(sure, n), F.lit(0.0)).alias("free_ratio"))


def classify(assessed: DataFrame, verdicts: DataFrame, threshold: float = AUTO) -> DataFrame:
    """Outside verdicts (doc_id, pos, verdict_type, verdict_level, verdict_confidence) replace the assessment of
    blocks that need review, where they are surer."""
    rows = assessed.join(verdicts, ["doc_id", "pos"], "left")
    used = F.col("needs_review") & F.coalesce(F.col("verdict_confidence") > F.col("confidence"), F.lit(False))
    rows = rows.withColumn("used", used)
    pick = lambda a, b: F.when(F.col("used"), F.col(a)).otherwise(F.col(b))
    return rows.select(
        "doc_id", "pos", "block_id", "text", "is_bold", "original_number", pick("verdict_type", "type").alias("type"),
        pick("verdict_level", "heading_level").cast("int").alias("heading_level"), pick("verdict_confidence", "confidence").alias("confidence"),
        "category", F.col("used").alias("by_verdict"),
    ).withColumn("auto", F.col("confidence") >= threshold)


def classification_report(classified: DataFrame) -> DataFrame:
    """One row of counts."""
    n, auto = F.count("*"), F.count(F.when(F.col("auto"), 1))
    return classified.agg(
        n.alias("blocks"), auto.alias("auto_applied"), F.count(F.when(F.col("by_verdict"), 1)).alias("by_verdict"),
        F.count(F.when(~F.col("auto"), 1)).alias("needs_user"), F.round(F.try_divide(auto, n), 3).alias("auto_ratio"),
    )


def promote_root(classified: DataFrame) -> DataFrame:
    """In a document without headings the first paragraph with text becomes one, if it looks like a title."""
    any_heading = F.max((F.col("type") == "heading").cast("int")).over(by_doc())
    filled = (F.col("type") == "paragraph") & (P.trimmed(F.col("text")) != "")
    first = F.min(F.when(filled, F.col("pos"))).over(by_doc())
    t = P.trimmed(F.col("text"))
    title = (F.length(t) <= 80) & ~t.rlike(P.SENTENCE_END) & ~t.rlike(P.words_of(P.AGAINST_WORDS.replace("|nous avons", "")))
    rows = classified.withColumn("root", F.coalesce((any_heading == 0) & (F.col("pos") == first) & title, F.lit(False)))
    return rows.withColumns(
        {"type": F.when(F.col("root"), "heading").otherwise(F.col("type")), "heading_level": F.when(F.col("root"), 1).otherwise(F.col("heading_level")),
         "confidence": F.when(F.col("root"), 0.75).otherwise(F.col("confidence"))}
    )


def detect_structure(blocks: DataFrame, verdicts: DataFrame) -> DataFrame:
    """All passes in order, as one plan: T28, T19, T18, T20, T21, T13, T16, T17."""
    typed = empty_run_breaks(promote_all_caps(toc_runs(type_blocks(blocks))))
    return promote_root(classify(assess(without_covers(typed)), verdicts))


def page_break_required(rows: DataFrame) -> DataFrame:
    """Does a block begin a new page?"""
    t = F.translate(F.upper(P.trimmed(F.col("text"))), UP_ACCENTS, UP_PLAIN)
    t = F.btrim(F.regexp_replace(t, r"\s+", " "), F.lit(P.BLANKS + ":;.,-–—"))
    front = (t != "") & any_of([t.startswith(x) for x in PAGE_TITLES])
    top = (F.col("type") == "heading") & (F.coalesce("heading_level", F.lit(1)) <= 1)
    need = (F.col("type") != "toc_entry") & (F.col("page_break_before") | front | top)
    return rows.select("doc_id", "pos", need.alias("new_page"))


def heading_levels(rows: DataFrame) -> DataFrame:
    """Per document the distinct heading levels, held between 1 and 3, in order."""
    level = F.least(F.greatest(F.coalesce("heading_level", F.lit(1)), F.lit(1)), F.lit(3))
    levels = F.array_join(F.array_sort(F.collect_set(level)), ",")
    return rows.where("type = 'heading'").groupBy("doc_id").agg(levels.alias("levels"), F.count("*").alias("headings"))


# Words that make a line a title of level 1.
TITLE_WORDS = (
    r"CHAPITRE\s+\d+|INTRODUCTION|CONCLUSION|RÉSUMÉ|RESUME|ABSTRACT|SOMMAIRE|TABLE\s+DES\s+MATIÈRES|BIBLIOGRAPHIE|ANNEXE|ANNEXES|REMERCIEMENTS|"
    r"DÉDICACE|DEDICACE|AVANT\s*-?\s*PROPOS|LISTE\s+DES\s+(?:FIGURES|TABLEAUX)|SIGLES\s+ET\s+ABRÉVIATIONS|GLOSSAIRE"
)
TITLE_WORD = rf"(?i)^(?:{TITLE_WORDS})(?:\s|[:.\-—]|$)"
TITLE_NUMBER = r"^\d{1,2}(?:\.\d{1,2}){0,3}\.?\s+\p{Lu}"
TITLE_CAPS = r"^\p{Lu}[\p{Lu}\p{N}\s'’—\-:.,()°&+%]{2,58}[\p{Lu}\p{N}]$"
LEGEND_START = r"(?i)^(?:figure|tableau|image|schéma|schema|graphique)\s*\d+"


def regex_titles(blocks: DataFrame) -> DataFrame:
    """Level of lines that are titles by keyword, number or capitals."""
    t = P.trimmed(F.col("text"))
    prefix = F.rtrim(F.regexp_extract(t, r"^(\S+)\s", 1), F.lit("."))
    dots = F.length(prefix) - F.length(F.replace(prefix, F.lit("."), F.lit("")))
    level = (
        F.when((F.length(t) < 3) | t.rlike(LEGEND_START), F.lit(None)).when(t.rlike(TITLE_WORD), 1)
        .when(t.rlike(TITLE_NUMBER), F.least(dots + 1, F.lit(3))).when(t.rlike(TITLE_CAPS), 1)
    )
    return blocks.select("doc_id", "pos", t.alias("title"), level.cast("int").alias("level")).where("level is not null")


def suggested_level(text: Column) -> Column:
    token = F.regexp_extract(text, r"^(\d+(?:\.\d+)+)\s+", 1)
    dots = F.length(token) - F.length(F.replace(token, F.lit("."), F.lit("")))
    return F.when(text.rlike(r"^[IVXLC]+\.\s+"), 1).when(token != "", dots + 1)


def numbering_ambiguities(titles: DataFrame) -> DataFrame:
    """Titles whose number suggests another level than theirs."""
    rows = titles.select("doc_id", "pos", "title", "level", suggested_level(F.col("title")).cast("int").alias("suggested"))
    return rows.where("suggested is not null and suggested <> level")


def apply_level_corrections(titles: DataFrame, corrections: DataFrame) -> DataFrame:
    """T4: corrections (doc_id, pos, remove, new_level): titles removed or with the new level; list title or subtitle."""
    rows = titles.join(corrections, ["doc_id", "pos"], "left").where("not coalesce(remove, false)")
    level = F.coalesce("new_level", "level").cast("int")
    return rows.select("doc_id", "pos", "title", level.alias("level")).withColumn("list", F.when(F.col("level") == 1, "titles").otherwise("subtitles"))


RULES = (
    ("heading1_style", "titles", {"type": "heading", "style": 1}), ("heading2_style", "subtitles", {"type": "heading", "style": 2}),
    ("heading3_style", "subtitles", {"type": "heading", "style": 3}), ("title_caps", "titles", {"type": "paragraph", "parent": "body", "regex": TITLE_CAPS}),
    ("bold_line", "subtitles", {"bold": True}), ("header", "headers", {"parent": "header"}), ("footer", "footers", {"parent": "footer"}),
    ("table", "tables", {"type": "table"}), ("figure", "images", {"type": "figure"}), ("mention", "other", {"contains": "voir Figure"}),
)
CATEGORIES = ("titles", "subtitles", "headers", "footers", "tables", "images", "floating", "other")


def rule_column(rules=RULES, categories=CATEGORIES) -> Column:
    """An ordered table of rules (name, category, conditions) as one expression; the first that matches wins.

    Conditions: type, parent ('*' is any), style, size (least font size), bold, contains, regex. A rule with an unknown
    condition never matches. Rules without a name, category or condition are refused.
    """
    found = F.lit(None).cast("struct<rule:string,category:string>")
    for name, category, when in reversed(rules):
        if not name or category not in categories or not when:
            raise ValueError(f"rule {name!r}: a name, a known category and conditions are needed")
        fits = F.lit(True)
        for key, value in when.items():
            test = {
                "type": lambda v: F.col("type") == v, "parent": lambda v: F.lit(True) if v == "*" else F.col("parent") == v,
                "style": lambda v: F.col("style_level") == v, "size": lambda v: F.col("font_size") >= v, "bold": lambda v: F.col("is_bold") == v,
                "contains": lambda v: F.col("text").contains(v), "regex": lambda v: F.col("text").rlike(v),
            }.get(key)
            fits = fits & (F.coalesce(test(value), F.lit(False)) if test else F.lit(False))
        found = F.when(fits, F.struct(F.lit(name).alias("rule"), F.lit(category).alias("category"))).otherwise(found)
    return found


def rule_detect(typed: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, pos, rule, category of the blocks that a rule matches."""
    rows = typed.withColumn("v", rule_column(rules)).where("v is not null")
    return rows.select("doc_id", "pos", "v.rule", "v.category")


LEGEND = r"(?i)^(figure|tableau|image|schéma|graphique|carte|photo)\s*(?:(\d+(?:\.\d+)*)|\{\s*SEQ\s+(figure|tableau|image|schéma|graphique|carte|photo)[^}]*\})\s*:\s*(.+)$"
LEGEND_ZONE = r"(?i)^LISTE\s+DES\s+(?:figure|tableau|image|schéma|graphique|carte|photo)s?$"
ZONE_END = r"(?i)^(?:SOMMAIRE|INTRODUCTION|LISTE\s+DES|RESUME|ABSTRACT|DEDICACE|REMERCIEMENTS|SIGLE|CHAPITRE|SECTION\s*\d|PARTIE\s*\d)"


def legends(blocks: DataFrame) -> DataFrame:
    """T5: captions of the form ``Type n : label``, outside the lists at the front, the first of equal ones.

    A list zone goes from its title to the next section title or a gap of over two blank lines; {SEQ Type} fields are
    counted by the type that they name, whatever word stands before them.
    """
    t = P.trimmed(F.col("text"))
    rows = blocks.select("doc_id", "pos", t.alias("t"))
    blank = F.col("t") == ""
    full_before = F.last(F.when(~blank, F.col("pos")), True).over(in_order().rowsBetween(Window.unboundedPreceding, -1))
    starts = F.col("t").rlike(LEGEND_ZONE)
    stops = (F.col("t").rlike(ZONE_END) & ~starts) | (~blank & (F.col("pos") - F.coalesce(full_before, F.lit(-1)) - 1 > 2))
    mark = F.when(starts, 1).when(stops, 0)
    in_zone = F.coalesce(F.last(mark, True).over(in_order()), F.lit(0)) == 1
    rows = rows.withColumn("in_zone", in_zone).where(~F.col("in_zone") & F.col("t").rlike(LEGEND))
    kind = F.initcap(F.regexp_extract("t", LEGEND, 1))
    label = F.regexp_replace(F.regexp_replace(P.trimmed(F.regexp_extract("t", LEGEND, 4)), r"\t+\s*\d+\s*$", ""), r"[.…]{3,}\s*\d+\s*$", "")
    counter = F.initcap(F.regexp_extract("t", LEGEND, 3))
    rows = rows.select(
        "doc_id", "pos", kind.alias("type"), F.regexp_extract("t", LEGEND, 2).alias("written"), counter.alias("counter"), P.trimmed(label).alias("label")
    )
    seq = Window.partitionBy("doc_id", "counter").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    counted = F.sum((F.col("written") == "").cast("int")).over(seq).cast("string")
    rows = rows.where("label <> ''").withColumn("number", F.when(F.col("written") != "", F.col("written")).otherwise(counted))
    key = F.regexp_replace(P.folded(F.concat_ws("|", "type", "number", "label")), r"['’`\s]+", "")
    key = F.when(key.endswith("s") & (F.length(key) > 5), F.substring(key, F.lit(1), F.length(key) - 1)).otherwise(key)
    once = F.row_number().over(Window.partitionBy("doc_id", key).orderBy("pos"))
    return rows.withColumn("once", once).where("once = 1").select("doc_id", "pos", "type", "number", "label")


LIST_MARK = r"^\s*(?:[-–—•*·◦▪‣]|\d{1,2}[.)]|[a-zA-Z][.)])\s+"


def review_candidates(typed: DataFrame, ambiguous: DataFrame, most: int = 60) -> DataFrame:
    """Blocks to review: ambiguous ones first, then list markers and what follows a title closely; at most ``most``
    a document (the report is a top list), with two lines of context on either side."""
    around = F.array_join(F.collect_list(F.substring("text", 1, 40)).over(in_order().rowsBetween(-2, 2)), " / ")
    title = F.last(F.when(F.col("type") == "heading", F.col("pos")), True).over(in_order())
    rows = typed.withColumn("context", around).withColumn("distance", F.col("pos") - title)
    rows = rows.join(ambiguous.select("doc_id", "pos", F.lit(True).alias("ambiguous")), ["doc_id", "pos"], "left")
    plain = (F.col("type") == "paragraph") & (P.trimmed(F.col("text")) != "")
    reason = (
        F.when(F.col("ambiguous"), "ambiguous").when(plain & F.col("text").rlike(LIST_MARK), "list_marker")
        .when(plain & (F.col("distance") <= 5), "near_title")
    )
    rank = F.row_number().over(by_doc().orderBy(F.col("reason") != "ambiguous", "pos"))
    return (
        rows.withColumn("reason", reason).where("reason is not null").withColumn("rank", rank).where(F.col("rank") <= most)
        .select("doc_id", "pos", "reason", F.col("rank").cast("long").alias("rank"), "context")
    )


def apply_kind_corrections(typed: DataFrame, corrections: DataFrame) -> DataFrame:
    """Corrections (doc_id, pos, at, kind, new_level): pos above 0 only, the last of each block wins."""
    last = corrections.where("pos > 0").groupBy("doc_id", "pos").agg(
        F.max_by("kind", "at").alias("kind"), F.max_by("new_level", "at").alias("new_level")
    )
    rows = typed.join(last, ["doc_id", "pos"], "left")
    kind = F.coalesce("kind", "type")
    return rows.select("doc_id", "pos", kind.alias("type"), F.when(kind == "heading", F.coalesce("new_level", "heading_level")).cast("int").alias("heading_level"))


def cover_candidates(blocks: DataFrame) -> DataFrame:
    """Per document the blocks before the first recognised title (all, if there is none) and how many have text."""
    titles = regex_titles(blocks).groupBy("doc_id").agg(F.min("pos").alias("end"))
    rows = blocks.join(titles, "doc_id", "left")
    inside = F.col("end").isNull() | (F.col("pos") < F.col("end"))
    return rows.groupBy("doc_id").agg(F.count(F.when(inside, 1)).alias("blocks"), F.count(F.when(inside & (P.trimmed(F.col("text")) != ""), 1)).alias("with_text"))


def title_candidates(typed: DataFrame) -> DataFrame:
    """How a block may be a title: by style, by pattern, or to be verified (bold, short, no final dot)."""
    t = P.trimmed(F.col("text"))
    verify = F.col("is_bold") & (t != "") & (F.length(t) < 120) & ~t.endswith(".")
    why = F.when(F.col("style_level").isNotNull(), "style").when(P.heading_number(t).isNotNull(), "pattern").when(verify, "verify")
    return typed.where("type <> 'caption'").select("doc_id", "pos", why.alias("why")).where("why is not null")


def caption_candidates(typed: DataFrame) -> DataFrame:
    """Why a block may be a caption: a SEQ field, else the pattern, else a bare keyword."""
    t = F.col("text")
    why = F.when(t.rlike(r"(?i)\{\s*SEQ\s"), "field").when(P.caption(t).isNotNull(), "pattern").when(P.caption_without_number(t).isNotNull(), "keyword")
    return typed.select("doc_id", "pos", why.alias("why")).where("why is not null")


def strip_field_codes(text: Column) -> Column:
    """A text without {FIELD …} codes, for comparing: single spaces, lower case."""
    bare = F.regexp_replace(text, r"\{[^}]*\}", "")
    return F.lower(P.trimmed(F.regexp_replace(bare, r"\s+", " ")))


def resolve_seq_fields(blocks: DataFrame) -> DataFrame:
    """{SEQ Type} fields replaced by their running number per document and type; one field a block."""
    field = r"(?i)\{\s*SEQ\s+(\p{L}+)[^}]*\}"
    kind = F.lower(F.regexp_extract("text", field, 1))
    rows = blocks.withColumn("kind", kind)
    number = F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("pos")).cast("string")
    has = F.col("kind") != ""
    return rows.withColumn("n", number).select(
        "doc_id", "pos", F.when(has, F.regexp_replace(F.col("text"), F.lit(field), F.col("n"))).otherwise(F.col("text")).alias("text")
    )


def heading_contradiction(blocks: DataFrame) -> DataFrame:
    """Numbered blocks: level by number, level by style, contradiction, top level."""
    n = P.heading_number(F.col("text"))["level"]
    rows = blocks.select("doc_id", "pos", n.alias("pattern_level"), "style_level").where("pattern_level is not null")
    return rows.select("*", F.coalesce(F.col("pattern_level") != F.col("style_level"), F.lit(False)).alias("contradicts"), (F.col("pattern_level") == 1).alias("top_level"))
