"""Linking captions, numbering, references and lists, for all documents at once.

Blocks here: doc_id, pos, block_id, type, text, category (of captions and carriers), original_number, heading_level.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import patterns as P
from foliant.session import materialize

CARRIERS = ("figure", "table", "annexe", "planche")
# Keyword of each category.
KEYWORDS = (("figure", "Figure"), ("table", "Tableau"), ("annexe", "Annexe"), ("planche", "Planche"))
NEAR = 2


def is_carrier() -> Column:
    return F.col("type").isin(*CARRIERS)


def islands(blocks: DataFrame) -> DataFrame:
    """Runs of blocks of one kind and category that follow each other: run start, length and rank within."""
    kind = F.when(F.col("type") == "caption", "caption").when(is_carrier(), "carrier").otherwise("other")
    group = F.when(F.col("type") == "caption", F.col("category")).otherwise(F.col("type"))
    rows = blocks.withColumn("kind", kind).withColumn("grp", F.when(F.col("kind") == "other", "-").otherwise(F.coalesce(group, F.lit("?"))))
    order = Window.partitionBy("doc_id").orderBy("pos")
    new = ~(F.lag("kind").over(order).eqNullSafe(F.col("kind")) & F.lag("grp").over(order).eqNullSafe(F.col("grp")))
    rows = rows.withColumn("run", F.sum(new.cast("int")).over(order))
    inside = Window.partitionBy("doc_id", "run")
    return rows.withColumns({
        "run_start": F.min("pos").over(inside), "run_length": F.count("*").over(inside).cast("int"),
        "run_rank": (F.col("pos") - F.min("pos").over(inside)).cast("int"),
    })


def link_captions(blocks: DataFrame) -> DataFrame:
    """doc_id, pos, caption_id, carrier_id (null: orphan), confidence.

    First a run of captions right after a run of as many carriers of the category, rank to rank (.9); then the only
    adjacent carrier (1.0 if none else is within two, else .9); then the only carrier within two (.8).
    """
    rows = islands(blocks)
    captions = rows.where("kind = 'caption' and category is not null")
    carriers = rows.where("kind = 'carrier'").select(
        "doc_id", F.col("type").alias("category"), F.col("pos").alias("carrier_pos"), F.col("block_id").alias("carrier_id"),
        F.col("run_start").alias("c_start"), F.col("run_length").alias("c_length"), F.col("run_rank").alias("c_rank"),
    )
    aligned = (
        captions.join(carriers, ["doc_id", "category"])
        .where("run_start = c_start + c_length and run_length = c_length and run_rank = c_rank")
        .select("doc_id", "pos", F.col("carrier_id").alias("aligned_id"))
    )
    # Within two blocks: each carrier offers itself to five positions, so that the band is an equality join.
    offers = carriers.select("doc_id", "category", "carrier_id", "carrier_pos", F.explode(F.sequence(F.col("carrier_pos") - NEAR, F.col("carrier_pos") + NEAR)).alias("pos"))
    distance = F.abs(F.col("carrier_pos") - F.col("pos"))
    near = captions.select("doc_id", "pos", "category").join(offers, ["doc_id", "category", "pos"]).groupBy("doc_id", "pos").agg(
        F.count("*").alias("near"), F.count(F.when(distance <= 1, 1)).alias("adjacent"),
        F.max(F.when(distance <= 1, F.col("carrier_id"))).alias("adjacent_id"), F.max("carrier_id").alias("near_id"),
    )
    found = (
        F.when(F.col("aligned_id").isNotNull(), F.struct(F.col("aligned_id").alias("id"), F.lit(0.9).alias("c")))
        .when(F.col("adjacent") == 1, F.struct(F.col("adjacent_id").alias("id"), F.when(F.col("near") == 1, 1.0).otherwise(0.9).alias("c")))
        .when(F.col("near") == 1, F.struct(F.col("near_id").alias("id"), F.lit(0.8).alias("c")))
    )
    all_captions = blocks.where("type = 'caption'").select("doc_id", "pos", F.col("block_id").alias("caption_id"))
    return (
        all_captions.join(aligned, ["doc_id", "pos"], "left").join(near, ["doc_id", "pos"], "left")
        .select("doc_id", "pos", "caption_id", found.alias("f")).select("doc_id", "pos", "caption_id", F.col("f.id").alias("carrier_id"), F.col("f.c").alias("confidence"))
    )


def link_summary(links: DataFrame) -> DataFrame:
    """Per document captions linked, orphans and links of low confidence."""
    return links.groupBy("doc_id").agg(
        F.count("carrier_id").alias("linked"), F.count(F.when(F.col("carrier_id").isNull(), 1)).alias("orphans"),
        F.count(F.when(F.col("confidence") < 1.0, 1)).alias("low_confidence"),
    )


def renumber(blocks: DataFrame, links: DataFrame) -> DataFrame:
    """Blocks with final_number (null where it equals the original): captions and carriers without a caption are
    counted in order per document and category; a carrier takes the number of its first caption."""
    linked = links.where("carrier_id is not null")
    represented = linked.select("doc_id", F.col("carrier_id").alias("block_id")).distinct().withColumn("represented", F.lit(True))
    rows = blocks.join(represented, ["doc_id", "block_id"], "left")
    counting = F.when(F.col("type") == "caption", F.col("category")).when(is_carrier() & F.col("represented").isNull(), F.col("type"))
    rows = rows.withColumn("counting", counting)
    order = Window.partitionBy("doc_id", "counting").orderBy("pos")
    number = F.when(F.col("counting").isNotNull(), F.row_number().over(order).cast("string"))
    rows = rows.withColumn("number", number).withColumn(
        "final_number", F.when(~F.col("number").eqNullSafe(F.col("original_number")), F.col("number"))
    )
    shown = rows.where("type = 'caption'").select("doc_id", "pos", F.coalesce("final_number", "original_number").alias("shown"))
    taken = (
        linked.join(shown, ["doc_id", "pos"]).where("shown is not null").groupBy("doc_id", F.col("carrier_id").alias("block_id"))
        .agg(F.min_by("shown", "pos").alias("caption_number"))
    )
    return rows.join(taken, ["doc_id", "block_id"], "left").select(
        "doc_id", "pos", "block_id", "type", "text", "category", "heading_level", "original_number", "counting",
        F.when(is_carrier(), F.coalesce("caption_number", "final_number")).otherwise(F.col("final_number")).alias("final_number"),
    )


def number_changes(numbered: DataFrame) -> DataFrame:
    """The changes: counted blocks whose number is not the written one."""
    changed = numbered.where("counting is not null and final_number is not null")
    return changed.select("doc_id", "block_id", "counting", "original_number", "final_number")


def number_anomalies(numbered: DataFrame) -> DataFrame:
    """Per document and category: written numbers used twice, and those of 1..n that are missing (joined by commas)."""
    rows = numbered.where("counting is not null and original_number is not null")
    once = rows.groupBy("doc_id", "counting", "original_number").agg(F.count("*").alias("n"))
    value = F.expr("try_cast(original_number as int)")
    per = once.withColumn("v", value).groupBy("doc_id", "counting").agg(
        F.array_sort(F.collect_list(F.when(F.col("n") > 1, F.col("original_number")))).alias("twice"),
        F.collect_set(F.when(F.col("v") > 0, F.col("v"))).alias("values"), F.sum(F.when(F.col("v") > 0, F.col("n"))).cast("int").alias("n"),
    )
    full = F.when(F.col("n") > 0, F.sequence(F.lit(1), F.col("n"))).otherwise(F.array().cast("array<int>"))
    gaps = F.array_join(F.array_except(full, "values"), ",")
    return per.select("doc_id", "counting", F.array_join("twice", ",").alias("duplicates"), gaps.alias("gaps")).where("duplicates <> '' or gaps <> ''")


def references(blocks: DataFrame) -> DataFrame:
    """T12 over blocks that may refer: doc_id, pos, ref_no, category, number, matched, position."""
    rows = blocks.where(F.col("type").isin("paragraph", "heading", "cross_ref"))
    refs = rows.select("doc_id", "pos", F.posexplode(P.cross_references(F.col("text"))).alias("ref_no", "r"))
    return refs.select("doc_id", "pos", "ref_no", "r.category", "r.number", "r.matched", "r.position")


def resolve_refs(numbered: DataFrame) -> DataFrame:
    """References with their target: the only block of that written number (1.0); of several the nearest (.75, in a
    tie .55); else the nearest numbered block of the category (.55); else none. At most one resolved a block: references
    after the first resolved one are left out.

    Nearest blocks come from the last before and the first after, so no reference is paired with all blocks. References
    are written, since they are read three times and cost a pattern over all texts.
    """
    refs = materialize(references(numbered), "references").withColumn("is_ref", F.lit(True))
    targets = numbered.where("counting is not null or final_number is not null").withColumn("cat", F.coalesce("counting", "type", "category"))
    numbers = F.col("original_number")

    def nearest(keys: list[str], candidates: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
        both = candidates.select(*keys, "pos", "block_id", F.lit(0).alias("ref_no"), F.lit(False).alias("is_ref")).unionByName(
            wanted.select(*keys, "pos", F.lit(None).cast("string").alias("block_id"), "ref_no", "is_ref")
        )
        order = Window.partitionBy(*keys).orderBy("pos", F.col("is_ref"))
        spot = F.when(~F.col("is_ref"), F.struct("pos", "block_id"))
        before = F.last(spot, True).over(order.rowsBetween(Window.unboundedPreceding, 0))
        after = F.first(spot, True).over(order.rowsBetween(0, Window.unboundedFollowing))
        n = F.sum((~F.col("is_ref")).cast("int")).over(Window.partitionBy(*keys))
        rows = both.withColumns({"before": before, "after": after, "n": n}).where("is_ref")
        a, b = F.col("pos") - F.col("before.pos"), F.col("after.pos") - F.col("pos")
        target = F.when(F.col("after").isNull() | (a <= b), F.col("before.block_id")).otherwise(F.col("after.block_id"))
        tie = F.coalesce(a == b, F.lit(False)) & (F.col("before.pos") != F.col("after.pos"))
        return rows.select("doc_id", "pos", "ref_no", target.alias(f"{name}_id"), tie.alias(f"{name}_tie"), F.col("n").alias(f"{name}_n"))

    exact = targets.where(numbers.isNotNull()).select("doc_id", F.col("cat").alias("category"), numbers.alias("number"), "pos", "block_id")
    shown = targets.where("final_number is not null or original_number is not null").select("doc_id", F.col("cat").alias("category"), "pos", "block_id")
    keys = ["doc_id", "pos", "ref_no"]
    rows = refs.join(nearest(["doc_id", "category", "number"], exact, refs, "exact"), keys).join(nearest(["doc_id", "category"], shown, refs, "any"), keys)
    found = (
        F.when(F.col("exact_n") == 1, F.struct(F.col("exact_id").alias("id"), F.lit(1.0).alias("c")))
        .when(F.col("exact_n") > 1, F.struct(F.col("exact_id").alias("id"), F.when(F.col("exact_tie"), 0.55).otherwise(0.75).alias("c")))
        .when(F.col("any_n") > 0, F.struct(F.col("any_id").alias("id"), F.lit(0.55).alias("c")))
    )
    rows = rows.withColumn("f", found)
    first = F.min(F.when(F.col("f").isNotNull(), F.col("ref_no"))).over(Window.partitionBy("doc_id", "pos"))
    return rows.withColumn("first", first).where("first is null or ref_no <= first").select(
        "doc_id", "pos", "ref_no", "category", "number", "matched", F.col("f.id").alias("target_id"), F.col("f.c").alias("confidence")
    )


def rewrite_refs(numbered: DataFrame, resolved: DataFrame) -> DataFrame:
    """Texts with ``keyword old`` replaced by ``keyword new`` where the target has another number now."""
    numbers = numbered.select(F.col("doc_id"), F.col("block_id").alias("target_id"), F.coalesce("final_number", "original_number").alias("new_number"))
    changed = resolved.where("target_id is not null").join(numbers, ["doc_id", "target_id"]).where("new_number <> number")
    changed = changed.select("doc_id", "pos", F.regexp_extract("matched", r"^(\S+)\s", 1).alias("word"), "number", "new_number")
    rows = numbered.join(changed, ["doc_id", "pos"]).select(
        "doc_id", "pos", "text", "new_number",
        F.concat(F.lit(r"(?i)(?<![\p{L}\p{N}_])("), F.col("word"), F.lit(r"\s+)"), F.col("number"), F.lit(r"(?![\p{L}\p{N}'’])")).alias("pattern"),
    )
    # The new number follows a group in the replacement: its first digit is escaped to end the group's name.
    return rows.select("doc_id", "pos", F.expr("regexp_replace(text, pattern, concat('$1', char(92), new_number))").alias("text"))


def low_confidence_report(resolved: DataFrame, below: float = 0.7, shown: int = 5) -> DataFrame:
    """Per document: references resolved with low confidence, the first of them, whether more follow, unresolved."""
    low = F.coalesce(F.col("confidence") < below, F.lit(False))
    counts = resolved.groupBy("doc_id").agg(
        F.count("*").alias("references"), F.count(F.when(low, 1)).alias("low"), F.count(F.when(F.col("target_id").isNull(), 1)).alias("unresolved"),
    )
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "ref_no"))
    shown_rows = resolved.where(low).withColumn("rank", rank).where(F.col("rank") <= shown)  # no more of a document are collected
    first = shown_rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("rank", "matched"))).alias("first"))
    return counts.join(first, "doc_id", "left").select(
        "doc_id", "references", "low", "unresolved", F.coalesce(F.array_join(F.transform("first", lambda x: x["matched"]), "; "), F.lit("")).alias("examples"),
        (F.col("low") > shown).alias("truncated"),
    )


def numbering_pipeline(blocks: DataFrame, wanted: str = "texts") -> DataFrame:
    """Link, renumber, resolve, rewrite and report, in this order; ``wanted`` names the step whose table is returned.

    Only the numbered blocks are written in between: links lead to them alone, and references are read twice at most.
    """
    links = link_captions(blocks)
    if wanted == "links":
        return links
    numbered = materialize(renumber(blocks, materialize(links, "links")), "numbered")
    if wanted == "numbered":
        return numbered
    if wanted == "anomalies":
        return number_anomalies(numbered)
    resolved = resolve_refs(numbered)
    return {"references": lambda: resolved, "texts": lambda: rewrite_refs(numbered, resolved), "report": lambda: low_confidence_report(resolved)}[wanted]()


# Headings that a table of contents leaves out.
NOT_LISTED = (
    "SOMMAIRE", "TABLE DES MATIERES", "TABLE DES MATIÈRES", "LISTE DES FIGURES", "LISTE DES TABLEAUX", "LISTE DES ANNEXES",
    "LISTE DES PLANCHES", "TABLE DES ANNEXES",
)


def table_of_contents(blocks: DataFrame, pages: DataFrame, deepest: int = 3) -> DataFrame:
    """Headings with text that aren't left out: level, page (null where unknown), truncated (deeper than listed)."""
    t = F.upper(P.trimmed(F.col("text")))
    bare = F.rtrim(t, F.lit(" :.\t\n\r"))
    rows = blocks.where("type = 'heading'").where((t != "") & ~bare.isin(*NOT_LISTED))
    level = F.greatest(F.lit(1), F.coalesce("heading_level", F.lit(1)))
    return rows.join(pages, ["doc_id", "block_id"], "left").select(
        "doc_id", "pos", "block_id", level.alias("level"), "page", F.col("page").isNotNull().alias("has_page"), (level > deepest).alias("truncated")
    )


def category_lists(numbered: DataFrame, links: DataFrame, pages: DataFrame) -> DataFrame:
    """Per category captions, then carriers without one: number, label without the keyword, page (own or carrier's)."""
    own = pages.select("doc_id", "block_id", "page")
    other = pages.select("doc_id", F.col("block_id").alias("carrier_id"), F.col("page").alias("carrier_page"))
    keyword = r"(?i)^(légende|legende|figure|tableau|annexe|planche|table)\s+[0-9A-Z]+(?:\.[0-9]+)*\s*[-–—:.]?\s*"
    label = P.trimmed(F.regexp_replace(P.trimmed(F.col("text")), keyword, ""))
    captions = (
        numbered.where("type = 'caption'").join(links.select("doc_id", "pos", "carrier_id"), ["doc_id", "pos"], "left")
        .join(own, ["doc_id", "block_id"], "left").join(other, ["doc_id", "carrier_id"], "left")
        .select("doc_id", "category", F.lit(0).alias("part"), "pos", F.coalesce("final_number", "original_number").alias("number"), label.alias("label"),
                F.coalesce("page", "carrier_page").alias("page"))
    )
    with_caption = links.where("carrier_id is not null").select("doc_id", F.col("carrier_id").alias("block_id")).distinct()
    bare = (
        numbered.where(is_carrier()).join(with_caption, ["doc_id", "block_id"], "left_anti").join(own, ["doc_id", "block_id"], "left")
        .select("doc_id", F.col("type").alias("category"), F.lit(1).alias("part"), "pos", F.coalesce("final_number", "original_number").alias("number"),
                F.lit("").alias("label"), "page")
    )
    return captions.unionByName(bare)


def list_quality(entries: DataFrame) -> DataFrame:
    """Per document and category: entries, missing pages, without label, whether all have pages, and a message."""
    n, missing = F.count("*"), F.count(F.when(F.col("page").isNull(), 1))
    unlabelled = F.count(F.when(F.col("label") == "", 1))
    rows = entries.groupBy("doc_id", "category").agg(n.alias("entries"), missing.alias("missing_pages"), unlabelled.alias("unlabelled"))
    note = F.concat_ws("; ", F.when(F.col("missing_pages") > 0, F.concat("missing_pages", F.lit(" without page"))),
                       F.when(F.col("unlabelled") > 0, F.concat("unlabelled", F.lit(" without label"))))
    return rows.select("*", ((F.col("entries") > 0) & (F.col("missing_pages") == 0)).alias("has_pages"), note.alias("message"))


def figure_plan(blocks: DataFrame, links: DataFrame) -> DataFrame:
    """Per document figures, those with a caption (kept with the next block), those without, orphan captions."""
    linked = links.where("carrier_id is not null").select("doc_id", F.col("carrier_id").alias("block_id")).distinct()
    figures = blocks.where("type = 'figure'").select("doc_id", "block_id")
    with_caption = figures.join(linked, ["doc_id", "block_id"], "left_semi").groupBy("doc_id").agg(F.count("*").alias("captioned"))
    orphans = links.where("carrier_id is null").groupBy("doc_id").agg(F.count("*").alias("orphan_captions"))
    total = figures.groupBy("doc_id").agg(F.count("*").alias("figures"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return total.join(with_caption, "doc_id", "left").join(orphans, "doc_id", "full").select(
        "doc_id", zero("figures").alias("figures"), zero("captioned").alias("captioned"), (zero("figures") - zero("captioned")).alias("uncaptioned"),
        zero("orphan_captions").alias("orphan_captions"),
    )


#: Characters of the pieces by which texts are looked up.
GRAM = 8


def pieces_of(text: str, size: int) -> set[str]:
    return {text[i : i + size] for i in range(len(text) - size + 1)}


def cuts_of(text: str) -> tuple[int, set[str]]:
    """The size of a text's pieces, and those that stand side by side in it, with its last one."""
    size = min(GRAM, len(text))
    return size, {text[i : i + size] for i in (*range(0, len(text) - size + 1, size), len(text) - size)}


def sought(keys: Iterable[str]) -> dict[int, dict[str, list[str]]]:
    """For each size of pieces the texts by their rarest piece among these texts (all of a text, if it is shorter)."""
    counts: dict[str, int] = {}
    for key in keys:
        for piece in cuts_of(key)[1]:
            counts[piece] = counts.get(piece, 0) + 1
    found: dict[int, dict[str, list[str]]] = {}
    for key in keys:
        size, pieces = cuts_of(key)
        rarest = min(pieces, key=lambda piece: (counts[piece], piece))
        found.setdefault(size, {}).setdefault(rarest, []).append(key)
    return found


def found_inside(holder: str, wanted: dict[int, dict[str, list[str]]]) -> list[str]:
    """The texts that ``holder`` contains, taken out of ``wanted``."""
    found = []
    for size, by_piece in wanted.items():
        for piece in by_piece.keys() & pieces_of(holder, size):
            inside = {key for key in by_piece[piece] if key in holder}
            if inside:
                found += inside
                by_piece[piece] = [key for key in by_piece[piece] if key not in inside]
                if not by_piece[piece]:
                    del by_piece[piece]
    return found


def pages_of_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (doc_id, at, page, key, is_spot) sorted by document, blocks (at: pos) before positions (at: ord): the page of
    each block."""
    doc, places, wanted, same, inside = object(), {}, None, {}, {}

    def pages() -> list[tuple]:
        of = {key: inside.get(key) if same.get(key) is None else same[key] for key in places}
        return [(doc, pos, of[key]) for key, at in places.items() for pos in at]

    for batch in batches:
        out = []
        for d, at, page, key, is_spot in zip(*[batch[c].tolist() for c in ("doc_id", "at", "page", "key", "is_spot")]):
            if d != doc:
                out += pages()
                doc, places, wanted, same, inside = d, {}, None, {}, {}
            if not is_spot:
                places.setdefault(key, []).append(at)
            elif places:
                wanted = sought(places) if wanted is None else wanted
                page = None if page != page else page
                if key in places:
                    same.setdefault(key, page)
                inside |= dict.fromkeys(found_inside(key, wanted), page)
        yield pd.DataFrame(out, columns=["doc_id", "pos", "page"])
    yield pd.DataFrame(pages(), columns=["doc_id", "pos", "page"])


def page_lookup(blocks: DataFrame, positions: DataFrame) -> DataFrame:
    """Page of each block with text: of the first position (doc_id, ord, page, text) with the same normalised text,
    else of the first that contains it.

    A document's blocks come before its positions in one sorted stream, and are looked for by their rarest piece of eight
    characters: a position costs its length, and a text as many comparisons as there are positions with that piece, not
    all of its document. Blocks and positions are shuffled once, as they are, and nothing is written; of a document only
    the blocks have to fit in memory.
    """
    norm = lambda c: F.lower(P.trimmed(F.regexp_replace(c, r"\s+", " ")))
    rows = blocks.select("doc_id", "pos", norm(F.col("text")).alias("key")).where("key <> ''")
    spots = positions.select("doc_id", "ord", "page", norm(F.col("text")).alias("key")).where("key <> ''")
    both = rows.select("doc_id", F.col("pos").alias("at"), F.lit(None).cast(spots.schema["page"].dataType).alias("page"), "key", F.lit(False).alias("is_spot")).unionByName(
        spots.select("doc_id", F.col("ord").alias("at"), "page", "key", F.lit(True).alias("is_spot")).where("at is not null")
    )
    ordered = both.repartition("doc_id").sortWithinPartitions("doc_id", "is_spot", "at")
    kinds = [t.schema[c].dataType.simpleString() for t, c in ((rows, "doc_id"), (rows, "pos"), (spots, "page"))]
    return ordered.mapInPandas(pages_of_blocks, "doc_id {}, pos {}, page {}".format(*kinds))
