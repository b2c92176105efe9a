"""Fields of word-processing documents: marks matched by running depth, and counts by kind of field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The kind of each field by the first word of its instruction.
FIELD_KINDS = {
    "SEQ": "sequence", "REF": "reference", "PAGEREF": "page_reference", "PAGE": "page_number", "NUMPAGES": "page_count",
    "TOC": "table_of_contents", "STYLEREF": "style_reference", "DATE": "date", "TIME": "time", "AUTHOR": "author",
    "FILENAME": "filename", "HYPERLINK": "hyperlink", "NOTEREF": "note_reference", "EQ": "equation",
}
# Fields whose shown text is made anew with each layout.
LAID_OUT = ("TOC", "PAGE", "NUMPAGES", "STYLEREF", "PAGEREF", "DATE", "TIME", "FILENAME")


def instruction(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"\s+", " "))


def first_word(text: Column) -> Column:
    return F.upper(F.split_part(instruction(text), F.lit(" "), F.lit(1)))


def field_kind(text: Column) -> Column:
    """The kind of the field that an instruction makes; ``unknown`` for any other."""
    kinds = F.create_map(*[F.lit(x) for pair in FIELD_KINDS.items() for x in pair])
    return F.coalesce(F.element_at(kinds, first_word(text)), F.lit("unknown"))


def field_identifier(text: Column) -> Column:
    """Its first argument that is neither a switch nor quoted, else the first quoted one."""
    words = F.slice(F.split(instruction(text), " "), 2, 1 << 20)
    bare = F.get(F.filter(words, lambda w: ~w.startswith("\\") & ~w.startswith('"')), F.lit(0))
    quoted = F.regexp_extract(instruction(text), '"([^"]+)"', 1)
    return F.coalesce(bare, F.when(quoted != "", quoted))


def marked(tokens: DataFrame) -> DataFrame:
    """Tokens (doc_id, pos, ord, kind, text) with the depth of open fields and the number of the field they are of.

    Begin and end marks count up and down along the document; ends with nothing to close (``stray``) do not count. A
    field is named by its depth and how many of that depth have begun: an end closes the last that began at its depth.
    """
    order = Window.partitionBy("doc_id").orderBy("pos", "ord").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("kind") == "begin", 1).when(F.col("kind") == "end", -1).otherwise(0)
    rows = tokens.withColumn("sum", F.sum(step).over(order)).withColumn("least", F.least(F.lit(0), F.min("sum").over(order)))
    rows = rows.withColumn("after", F.col("sum") - F.col("least"))
    before = F.coalesce(F.lag("least").over(Window.partitionBy("doc_id").orderBy("pos", "ord")), F.lit(0))
    rows = rows.withColumn("stray", (F.col("kind") == "end") & (F.col("least") < before))
    rows = rows.withColumn("depth", F.when((F.col("kind") == "end") & ~F.col("stray"), F.col("after") + 1).otherwise(F.col("after")))
    of_depth = Window.partitionBy("doc_id", "depth").orderBy("pos", "ord").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("field", F.count(F.when(F.col("kind") == "begin", 1)).over(of_depth)).drop("sum", "least", "after")


def field_spans(tokens: DataFrame) -> DataFrame:
    """Fields by mark: doc_id, depth, field, start and end (pos), code (its instructions joined), shown (length of the
    text between its separator and its end), closed."""
    rows = marked(tokens).where("depth > 0 and not stray")
    parted = Window.partitionBy("doc_id", "depth", "field").orderBy("pos", "ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("shown", F.coalesce(F.max((F.col("kind") == "separate").cast("int")).over(parted), F.lit(0)) == 1)
    of = lambda k: F.col("kind") == k
    code = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(of("instr") & ~F.col("shown"), F.struct("pos", "ord", "text")))), lambda x: x["text"]), "")
    return rows.groupBy("doc_id", "depth", "field").agg(
        F.min(F.when(of("begin"), F.col("pos"))).alias("start"), F.max(F.when(of("end"), F.col("pos"))).alias("end"), code.alias("code"),
        F.coalesce(F.sum(F.when(of("text") & F.col("shown"), F.length("text"))), F.lit(0)).cast("long").alias("shown"), (F.count(F.when(of("end"), 1)) > 0).alias("closed"),
    ).select("doc_id", "depth", "field", "start", "end", instruction(F.col("code")).alias("code"), field_kind(F.col("code")).alias("kind"), "shown", "closed")


def field_marks(tokens: DataFrame) -> DataFrame:
    """Per document the fields begun and closed, those nested and left open, stray ends, and the greatest depth."""
    rows = marked(tokens)
    of = lambda k: F.col("kind") == k
    closed = F.count(F.when(of("end") & ~F.col("stray"), 1))
    per = rows.groupBy("doc_id").agg(
        F.count(F.when(of("begin"), 1)).alias("begun"), closed.alias("closed"), F.count(F.when(of("begin") & (F.col("depth") > 1), 1)).alias("nested"),
        F.count(F.when(F.col("stray"), 1)).alias("stray_ends"), F.max("depth").cast("long").alias("deepest"),
    )
    return per.withColumn("open", F.col("begun") - F.col("closed"))


def field_counts(tokens: DataFrame) -> DataFrame:
    """Per document and kind the fields there are: one for each instruction that isn't empty, whatever its marks
    (``simple`` fields hold theirs themselves), and how many are laid out anew."""
    coded = tokens.where(F.col("kind").isin("instr", "simple") & (instruction(F.col("text")) != ""))
    fresh = first_word(F.col("text")).isin(*LAID_OUT)
    return coded.groupBy("doc_id", field_kind(F.col("text")).alias("kind")).agg(F.count("*").alias("fields"), F.count(F.when(fresh, 1)).alias("laid_out"))
