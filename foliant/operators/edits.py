"""Edit logs, guards, tables, clarifications: one batch of edits for all documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import patterns as P
from foliant.operators.numbering import CARRIERS, is_carrier

TYPES = (
    "heading", "paragraph", "table", "figure", "image", "caption", "annexe", "planche", "header", "footer", "cross_ref", "toc_entry", "shape",
)
INSERTABLE = ("heading", "paragraph", "table", "figure", "image", "caption", "annexe", "planche")
TOOLS = ("rewrite", "insert", "delete", "replace_range")
CONFIRM_OVER = 5


def apply_edits(blocks: DataFrame, edits: DataFrame) -> DataFrame:
    """doc_id, pos (new), block_id, text. Edits: edit_id, doc_id, tool, pos, end_pos, text.

    The last rewrite of a block wins; deleted blocks and replaced ranges go; a range is replaced by one block at its
    start. Each insert goes right after its block, so of several the last stands first; inserts after an unknown block
    go to the end, in the order of edit_id. Edits of other tools do nothing, nor do rewrites and ranges of unknown blocks.
    """
    rewrites = edits.where("tool = 'rewrite'").groupBy("doc_id", "pos").agg(F.max_by("text", "edit_id").alias("new_text"))
    ranges = edits.where("tool = 'replace_range' and end_pos >= pos")
    gone = (
        edits.where("tool = 'delete'").select("doc_id", "pos")
        .unionByName(ranges.select("doc_id", F.explode(F.sequence("pos", "end_pos")).alias("pos"))).distinct()
    )
    none = F.lit(0).cast("long")
    kept = blocks.join(gone, ["doc_id", "pos"], "left_anti").join(rewrites, ["doc_id", "pos"], "left").select(
        "doc_id", F.lit(0).alias("part"), F.col("pos").alias("anchor"), F.lit(0).alias("added"), none.alias("seq"), "block_id", F.coalesce("new_text", "text").alias("text")
    )
    known = blocks.select("doc_id", "pos", F.lit(True).alias("known"))
    fresh = edits.where("tool = 'insert'").unionByName(ranges).join(known, ["doc_id", "pos"], "left").where("known or tool = 'insert'")
    documents = blocks.select("doc_id").distinct()
    insert = F.col("tool") == "insert"
    fresh = fresh.join(documents, "doc_id", "left_semi").select(
        "doc_id", F.when(F.col("known"), 0).otherwise(1).alias("part"), F.when(F.col("known"), F.col("pos")).alias("anchor"), F.lit(1).alias("added"),
        F.when(F.col("known") & insert, -F.col("edit_id")).when(F.col("known"), F.lit(-(1 << 62))).otherwise(F.col("edit_id")).alias("seq"),
        F.concat(F.lit("new-"), "edit_id").alias("block_id"), "text",
    )
    order = Window.partitionBy("doc_id").orderBy("part", "anchor", "added", "seq")
    return kept.unionByName(fresh).select("doc_id", (F.row_number().over(order) - 1).cast("long").alias("pos"), "block_id", "text")


def edit_guards(edits: DataFrame, blocks: DataFrame, references: DataFrame, links: DataFrame) -> DataFrame:
    """edit_id and why it is refused (null: it isn't): unknown block, invalid range, target of a reference,
    described by a caption, last block."""
    sizes = blocks.groupBy("doc_id").agg(F.count("*").alias("n"))
    rows = (
        edits.join(blocks.select("doc_id", "pos", "block_id"), ["doc_id", "pos"], "left").join(sizes, "doc_id", "left")
        .join(references.select("doc_id", F.col("target_id").alias("block_id"), F.lit(True).alias("referred")).distinct(), ["doc_id", "block_id"], "left")
        .join(links.select("doc_id", F.col("carrier_id").alias("block_id"), F.lit(True).alias("described")).distinct(), ["doc_id", "block_id"], "left")
    )
    delete = F.col("tool") == "delete"
    reason = (
        F.when(F.col("block_id").isNull(), "unknown_block").when((F.col("tool") == "replace_range") & ((F.col("end_pos") < F.col("pos")) | (F.col("end_pos") >= F.col("n"))), "invalid_range")
        .when(delete & F.col("referred"), "referred_to").when(delete & F.col("described"), "described_by_caption").when(delete & (F.col("n") <= 1), "last_block")
    )
    return rows.select("edit_id", reason.alias("refused"))


def confirmation_required(edits: DataFrame) -> DataFrame:
    """Per document: do deletes and replacements touch over five blocks?"""
    touched = F.when(F.col("tool") == "delete", 1).when(F.col("tool") == "replace_range", F.greatest(F.lit(0), F.col("end_pos") - F.col("pos") + 1)).otherwise(0)
    return edits.groupBy("doc_id").agg(F.sum(touched).cast("long").alias("touched")).withColumn("confirm", F.col("touched") > CONFIRM_OVER)


def edit_table_cells(tables: DataFrame, edits: DataFrame) -> DataFrame:
    """Tables (doc_id, cells array<array<string>>) after one edit each: add_row, add_column, remove_row, set_cell.

    ``edits``: doc_id, tool, row, col, values. Out of bounds, or removing the last row: the table stays and ok is false.
    """
    rows = tables.join(edits, "doc_id")
    cells, r, c, v = F.col("cells"), F.col("row"), F.col("col"), F.col("values")
    n = F.size("cells")
    width = F.size(F.get("cells", F.lit(0)))
    fitted = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.coalesce(F.get(v, i), F.lit("")))
    value = F.coalesce(F.get(v, F.lit(0)), F.lit(""))
    ok = (
        F.when(F.col("tool") == "add_row", (r >= 0) & (r <= n)).when(F.col("tool") == "add_column", (c >= 0) & (c <= width))
        .when(F.col("tool") == "remove_row", (r >= 0) & (r < n) & (n > 1)).when(F.col("tool") == "set_cell", (r >= 0) & (r < n) & (c >= 0) & (c < width))
        .otherwise(F.lit(False))
    )
    after = (
        F.when(~ok, cells).when(F.col("tool") == "add_row", F.concat(F.slice(cells, F.lit(1), r), F.array(fitted), F.slice(cells, r + 1, n)))
        .when(F.col("tool") == "add_column", F.transform(cells, lambda x, i: F.concat(
            F.slice(x, F.lit(1), c), F.array(F.coalesce(F.get(v, i), F.lit(""))), F.slice(x, c + 1, width))))
        .when(F.col("tool") == "remove_row", F.filter(cells, lambda x, i: i != r))
        .otherwise(F.transform(cells, lambda x, i: F.when(i == r, F.transform(x, lambda y, j: F.when(j == c, value).otherwise(y))).otherwise(x)))
    )
    return rows.select("doc_id", "tool", ok.alias("ok"), F.to_json(after).alias("cells"))


def needs_renumbering(before: DataFrame, after: DataFrame, edits: DataFrame) -> DataFrame:
    """E5: per edited document: an edit other than a rewrite, and another number of carriers or captions."""
    counts = lambda df, name: df.groupBy("doc_id").agg(
        F.count(F.when(is_carrier(), 1)).alias(f"{name}_carriers"), F.count(F.when(F.col("type") == "caption", 1)).alias(f"{name}_captions")
    )
    tools = edits.groupBy("doc_id").agg(F.max((F.col("tool") != "rewrite").cast("int")).alias("structural"))
    rows = tools.join(counts(before, "b"), "doc_id", "left").join(counts(after, "a"), "doc_id", "left")
    changed = ~F.col("b_carriers").eqNullSafe(F.col("a_carriers")) | ~F.col("b_captions").eqNullSafe(F.col("a_captions"))
    return rows.select("doc_id", ((F.col("structural") == 1) & changed).alias("renumber"))


def links_after_deletes(links: DataFrame, deleted: DataFrame) -> DataFrame:
    """Links of captions (doc_id, caption_id, carrier_id, …) after blocks (doc_id, block_id) are deleted: a caption of a deleted
    carrier stands alone, links of deleted captions go."""
    gone = deleted.select("doc_id", F.col("block_id").alias("gone id")).distinct()
    kept = links.join(gone, (links["doc_id"] == gone["doc_id"]) & (links["caption_id"] == gone["gone id"]), "left_anti")
    carriers = gone.select("doc_id", F.col("gone id").alias("carrier_id"), F.lit(True).alias("gone carrier"))
    rows = kept.join(carriers, ["doc_id", "carrier_id"], "left")
    return rows.withColumn("carrier_id", F.when(F.col("gone carrier").isNull(), F.col("carrier_id"))).select(*links.columns)


# Other names of types that edits may give.
TYPE_ALIASES = {
    "paragraphe": "paragraph", "titre": "heading", "tableau": "table", "legende": "caption", "légende": "caption", "renvoi": "cross_ref",
    "en_tete": "header", "en-tete": "header", "pied": "footer",
}
MOST_LEVEL = 3


def normal_type(kind: Column) -> Column:
    """The type that an edit names, by its own name or another, whatever its case; null if there is none."""
    name = F.lower(P.trimmed(kind))
    found = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in TYPE_ALIASES.items() for x in pair]), name), name)
    return F.when(found.isin(*TYPES), found)


def normal_block_id(block_id: Column) -> Column:
    """An id without blanks and quotes around it; null if nothing is left."""
    bare = P.trimmed(block_id, P.BLANKS + "\"'`")
    return F.when(bare != "", bare)


def normal_level(level: Column) -> Column:
    """A heading's level within those there are."""
    return F.when(level.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(MOST_LEVEL), level)))


def validate_edits(edits: DataFrame) -> DataFrame:
    """A row for each fault of an edit: tool, position, text or type (by any of its names)."""
    text = F.coalesce(P.trimmed(F.col("text")), F.lit(""))
    faults = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("tool").isin(*TOOLS), F.lit(False)), "unknown_tool"), F.when(F.col("pos").isNull(), "position_missing"),
        F.when(F.col("tool").isin("rewrite", "insert", "replace_range") & (text == ""), "text_missing"),
        F.when((F.col("tool") == "insert") & ~F.coalesce(normal_type(F.col("type")).isin(*INSERTABLE), F.lit(False)), "type_not_allowed"),
        F.when((F.col("tool") == "replace_range") & F.col("end_pos").isNull(), "end_missing"),
    ))
    return edits.select("edit_id", F.explode(faults).alias("fault"))


def structural_violations(blocks: DataFrame) -> DataFrame:
    """A row for each fault of a block (doc_id, pos, block_id, type, confidence, fidelity, heading_level, category,
    has_table, has_ref, has_image)."""
    twice = F.row_number().over(Window.partitionBy("doc_id", "block_id").orderBy("pos")) > 1
    no_id = F.coalesce("block_id", F.lit("")) == ""
    known = F.coalesce(F.col("type").isin(*TYPES), F.lit(False))
    category = F.coalesce(F.col("category").isin(*CARRIERS), F.lit(False))
    none = F.lit(False)
    faults = F.array_compact(F.array(
        F.when(no_id, "block_id_missing").when(F.col("twice"), "block_id_twice"), F.when(~known, "unknown_type"),
        F.when(known & ~F.coalesce(F.col("confidence").between(0, 1), F.lit(True)), "confidence_out_of_range"),
        F.when(known & ~F.coalesce(F.col("fidelity").isin("exact", "reconstructed"), F.lit(True)), "bad_fidelity"),
        F.when((F.col("type") == "table") & ~F.coalesce("has_table", none), "table_without_data"),
        F.when((F.col("type") == "heading") & ~F.coalesce(F.col("heading_level") >= 1, none), "heading_without_level"),
        F.when(F.col("type").isin("caption", "annexe", "planche") & ~category, "category_missing"),
        F.when((F.col("type") == "cross_ref") & ~F.coalesce("has_ref", none), "reference_without_payload"),
        F.when((F.col("type") == "figure") & ~F.coalesce("has_image", none), "figure_without_image"),
    ))
    return blocks.withColumn("twice", twice).select("doc_id", "pos", F.explode(faults).alias("fault"))


def clarification_questions(assessed: DataFrame, existing: DataFrame, threshold: float = 0.85) -> DataFrame:
    """A question for each block below the threshold that has none yet: context and an excerpt of 60 characters."""
    low = assessed.where(F.col("confidence") < threshold).join(existing.select("doc_id", "block_id").distinct(), ["doc_id", "block_id"], "left_anti")
    context = F.when(F.col("type").isin("caption", "figure", "table", "heading"), F.col("type")).otherwise("paragraph")
    return low.select("doc_id", "block_id", context.alias("context"), F.substring(P.trimmed(F.col("text")), 1, 60).alias("excerpt"), "confidence")


# What an answer holds and the type it stands for; the first found decides.
ANSWERS = (
    ("titre niveau 1", "heading_1"), ("titre niveau 2", "heading_2"), ("titre niveau 3", "heading_3"), ("titre", "heading_1"), ("paragraphe", "paragraph"),
    ("figure", "figure"), ("tableau", "table"), ("annexe", "annexe"), ("planche", "planche"), ("image", "image"),
)


def parse_answer(answer: Column) -> Column:
    """The type that an answer names, else null."""
    t, found = F.lower(P.trimmed(answer)), F.lit(None).cast("string")
    for words, kind in reversed(ANSWERS):
        found = F.when(t.contains(words), kind).otherwise(found)
    return found


def apply_answers(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """Blocks with the type (and level) that their answer names, at confidence 1.0; other answers do nothing."""
    given = answers.select("doc_id", "block_id", parse_answer(F.col("answer")).alias("kind")).where("kind is not null")
    rows = blocks.join(given, ["doc_id", "block_id"], "left")
    level = F.expr("try_cast(regexp_extract(kind, '^heading_(.)$', 1) as int)")
    is_heading = F.col("kind").startswith("heading_")
    has = F.col("kind").isNotNull()
    return rows.select(
        "doc_id", "pos", "block_id", F.when(is_heading, "heading").when(has, F.col("kind")).otherwise(F.col("type")).alias("type"),
        F.when(is_heading, level).when(has, F.lit(None)).otherwise(F.col("heading_level")).cast("int").alias("heading_level"),
        F.when(has, 1.0).otherwise(F.col("confidence")).alias("confidence"),
    )


def merge_detections(first: DataFrame, second: DataFrame, keys: tuple[str, ...] = ("element_index", "parent")) -> DataFrame:
    """All of the first detector's rows, then the second's whose key is new; the second's own repeats shrink to one.

    The key leaves the section out, as the merge it stands for does. Rows with a null in the key always stay.
    """
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    once = second.where(whole).dropDuplicates(list(keys)).join(first.where(whole).select(*keys).distinct(), list(keys), "left_anti")
    return first.withColumn("detector", F.lit(1)).unionByName(once.unionByName(second.where(~whole)).withColumn("detector", F.lit(2)))
