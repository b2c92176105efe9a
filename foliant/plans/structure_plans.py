"""Registered queries over blocks: detection, numbering and lists, with SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import patterns as P
from foliant.operators import detect as D
from foliant.operators import numbering as N
from foliant.session import materialize, read_table
from foliant.sources import blocks as B
from foliant.sources.fixtures import NEEDS, VIEWS, with_views

BLOCKS = B.decorated
T = "text"


def typed(s, d):
    return D.type_blocks(BLOCKS(s, d))


def passes(s, d):
    """Typed blocks after all passes before the cover is cut; written, since several queries build on it."""
    return passes_over(typed(s, d))


def passes_over(rows):
    return materialize(D.empty_run_breaks(D.promote_all_caps(D.toc_runs(rows))), "typed")


def verdicts(s, d):
    return BLOCKS(s, d).where("(doc_id + pos) % 4 = 0").selectExpr(
        "doc_id", "pos", "'heading' as verdict_type", "2 as verdict_level", "cast(0.9 as double) as verdict_confidence"
    )


def assessed(s, d):
    return materialize(D.assess(passes(s, d)), "assessed")


NUMBERING = ("doc_id", "pos", "block_id", "type", "text", "category", "original_number", "heading_level")


def numbering_blocks(s, d):
    """Blocks as the numbering reads them; written, since links and numbers are joined back to them."""
    return materialize(typed(s, d).select(*NUMBERING), "blocks")


def linked(s, d):
    rows = numbering_blocks(s, d)
    return rows, materialize(N.link_captions(rows), "links")


def numbered(s, d):
    rows, links = linked(s, d)
    return materialize(N.renumber(rows, links), "numbered"), links


def pages(s, d):
    return BLOCKS(s, d).where("pos % 5 <> 0").selectExpr("doc_id", "block_id", "cast(1 + pos div 10 as int) as page")


def positions(s, d):
    return BLOCKS(s, d).where("pos % 3 <> 1").selectExpr("doc_id", "pos as ord", "cast(1 + pos div 10 as int) as page", "upper(text) as text")


def corrections(s, d):
    return BLOCKS(s, d).where("pos % 7 = 0").selectExpr("doc_id", "pos", "pos % 14 = 0 as remove", "cast(1 + pos % 3 as int) as new_level")


#: Numbers put before lines, by position (fixed values).
LINE_NUMBERS = ("IV. ", "1.2 ", "2.3.4 ", "II. ", "", "3. ", "1.1.1.1 ")


def numbered_lines(s, d):
    """Lines with numbers before them as titles of alternating levels."""
    number = F.element_at(F.array(*[F.lit(x) for x in LINE_NUMBERS]), (F.col("pos") % 7 + 1).cast("int"))
    return BLOCKS(s, d).select("doc_id", "pos", F.concat(number, "text").alias("title"), (1 + F.col("pos") % 2).alias("level"))


def signalled(s, d):
    """Blocks with signals by position: shapes, images with and without a mark in the text, contents styles, runs."""
    image = F.when(F.col("pos") % 11 == 3, F.array(F.lit("rId1.img"))).when(F.col("pos") % 11 == 5, F.array(F.lit("embedded-object")))
    text = F.when(F.col("pos") % 22 == 3, "[image:rId1.img]").when(F.col("pos") % 11 == 3, F.concat(F.lit("[image:rId1.img] "), "text")).otherwise(F.col("text"))
    return BLOCKS(s, d).select(
        "doc_id", "pos", "block_id", "base", text.alias("text"), "style_level", (F.col("is_bold") | (F.col("pos") % 6 == 1)).alias("is_bold"), ((F.col("doc_id") + F.col("pos")) % 5 == 0).alias("has_shape"),
        image.alias("images"), F.when(F.col("pos") % 9 == 4, 1 + F.col("pos") % 3).alias("toc_level"), (1 + F.col("pos") % 5).alias("run_count"),
    )


def kinds(s, d):
    rows = BLOCKS(s, d).where("pos % 4 = 0")
    return rows.selectExpr("doc_id", "pos", "explode(array(1, 2)) as at").selectExpr(
        "doc_id", "pos", "at", "if(at = 2, 'heading', 'paragraph') as kind", "cast(at as int) as new_level")


def detailed(s, d):
    return typed(s, d).withColumn("parent", F.when(F.col("pos") == 0, "header").otherwise("body")).withColumn("font_size", F.lit(11.0))


def bare_thirds(rows):
    """Every third document has no headings: they are entries of a contents list there."""
    return rows.withColumn("type", F.when((F.col("doc_id") % 3 == 0) & (F.col("type") == "heading"), "toc_entry").otherwise(F.col("type")))


def reports(name):
    return lambda s, d: N.numbering_pipeline(numbering_blocks(s, d), name)


QUERIES = {
    "S4_text_to_blocks": lambda s, d: B.text_to_blocks(read_table(s, d, "documents")),
    "T1_rule_detect": lambda s, d: D.rule_detect(detailed(s, d)),
    "T2_regex_titles": lambda s, d: D.regex_titles(BLOCKS(s, d)),
    "T3_numbering_ambiguities": lambda s, d: D.numbering_ambiguities(D.regex_titles(BLOCKS(s, d)).selectExpr("doc_id", "pos", "title", "1 + pos % 2 as level")),
    "T3_ambiguities_of_numbered_lines": lambda s, d: D.numbering_ambiguities(numbered_lines(s, d)),
    "T4_apply_level_corrections": lambda s, d: D.apply_level_corrections(D.regex_titles(BLOCKS(s, d)), corrections(s, d)),
    "T5_legends": lambda s, d: D.legends(BLOCKS(s, d)),
    "T6_review_candidates": lambda s, d: D.review_candidates(passes(s, d), D.numbering_ambiguities(
        D.regex_titles(BLOCKS(s, d)).selectExpr("doc_id", "pos", "title", "1 + pos % 2 as level"))),
    "T7_apply_kind_corrections": lambda s, d: D.apply_kind_corrections(passes(s, d), kinds(s, d)),
    "T8_heading_number": lambda s, d: BLOCKS(s, d).select("doc_id", "pos", P.heading_number(F.col(T)).alias("v")).where("v is not null").select("doc_id", "pos", "v.*"),
    "T9_heading_contradiction": lambda s, d: D.heading_contradiction(BLOCKS(s, d)),
    "T10_caption": lambda s, d: BLOCKS(s, d).select("doc_id", "pos", P.caption(F.col(T)).alias("v")).where("v is not null").select("doc_id", "pos", "v.*"),
    "T11_caption_without_number": lambda s, d: BLOCKS(s, d).select(
        "doc_id", "pos", P.caption_without_number(F.col(T)).alias("category"), P.is_list_entry(F.col(T)).alias("list_entry")),
    "T12_cross_refs": lambda s, d: N.references(BLOCKS(s, d).withColumnRenamed("base", "type")),
    "T13_assess": assessed,
    "T14_sentence_shape": lambda s, d: BLOCKS(s, d).select(
        "doc_id", "pos", P.sentence_shape(F.col(T)).alias("sentence"), P.isolated_heading(F.col(T)).alias("isolated")),
    "T15_partition_confidence": lambda s, d: D.partition_confidence(assessed(s, d)),
    "T16_classify": lambda s, d: D.classify(assessed(s, d), verdicts(s, d)).drop("text"),
    "T16_classification_report": lambda s, d: D.classification_report(D.classify(assessed(s, d), verdicts(s, d))),
    "T17_promote_root": lambda s, d: D.promote_root(D.classify(bare_thirds(assessed(s, d)), verdicts(s, d).where("doc_id % 3 <> 0"))).where(
        "root").select("doc_id", "pos", "heading_level", "confidence"),
    "T18_promote_all_caps": lambda s, d: D.promote_all_caps(typed(s, d)).select("doc_id", "pos", "type", "heading_level", "confidence"),
    "T19_toc_runs": lambda s, d: D.toc_runs(typed(s, d)).select("doc_id", "pos", "text", "type", "confidence"),
    "T20_empty_run_breaks": lambda s, d: D.empty_run_breaks(typed(s, d)).select("doc_id", "pos", "type", "empties", "page_break_before"),
    "T21_cover_page": lambda s, d: D.cover_pages(passes(s, d)),
    "T22_cover_candidate": lambda s, d: D.cover_candidates(BLOCKS(s, d)),
    "T23_title_candidates": lambda s, d: D.title_candidates(passes(s, d)),
    "T24_caption_candidates": lambda s, d: D.caption_candidates(BLOCKS(s, d)),
    "T25_page_break_required": lambda s, d: D.page_break_required(passes(s, d)),
    "T26_heading_levels": lambda s, d: D.heading_levels(passes(s, d)),
    "T27_strip_field_codes": lambda s, d: BLOCKS(s, d).select("doc_id", "pos", D.strip_field_codes(F.col(T)).alias("plain")),
    "T27_resolve_seq_fields": lambda s, d: D.resolve_seq_fields(BLOCKS(s, d).withColumn("text", F.regexp_replace("text", r"^(Figure|Tableau) \d+", "$1 {SEQ $1}"))),
    "T28_type_blocks": lambda s, d: typed(s, d).drop("base", "is_bold", "style_level"),
    "T28_type_signals": lambda s, d: D.type_signals(signalled(s, d)),
    "D_detect_structure": lambda s, d: D.detect_structure(BLOCKS(s, d), verdicts(s, d)).select("doc_id", "pos", "type", "heading_level", "confidence", "root"),
    "J10_page_lookup": lambda s, d: N.page_lookup(BLOCKS(s, d), positions(s, d)),
    "N1_link_captions": lambda s, d: linked(s, d)[1],
    "N1_link_summary": lambda s, d: N.link_summary(linked(s, d)[1]),
    "N2_renumber": lambda s, d: numbered(s, d)[0].drop("text"),
    "N2_number_changes": lambda s, d: N.number_changes(numbered(s, d)[0]),
    "N3_number_anomalies": lambda s, d: N.number_anomalies(numbered(s, d)[0]),
    "N4_resolve_refs": lambda s, d: N.resolve_refs(numbered(s, d)[0]),
    "N5_rewrite_refs": reports("texts"),
    "N6_low_confidence_report": reports("report"),
    "N7_numbering_pipeline": reports("numbered"),
    "N8_table_of_contents": lambda s, d: N.table_of_contents(passes(s, d), pages(s, d)),
    "N9_category_lists": lambda s, d: N.category_lists(*numbered(s, d), pages(s, d)),
    "N10_list_quality": lambda s, d: N.list_quality(N.category_lists(*numbered(s, d), pages(s, d))),
    "N11_figure_plan": lambda s, d: N.figure_plan(*linked(s, d)),
}

# Views that the detection oracles share.
NUMBERED = f"""select b.*, {P.heading_number_sql('text', 'level')} as num_level, {P.heading_number_sql('text', 'kind')} as num_kind,
  {P.heading_number_sql('text', 'reliable')} as num_reliable, {P.caption_sql('text', 'category')} as cap_category, {P.caption_sql('text', 'number')} as cap_number,
  {P.list_entry_sql('text')} as list_entry from blocks b"""
PAGELESS = lambda t: f"trim(regexp_replace(trim({t}, {P.quoted(P.BLANKS)}), {P.quoted(P.PAGE_STRIP)}, ''), {P.quoted(P.BLANKS)})"
LIST_TITLE = "(" + " or ".join(
    f"up = '{x}' or starts_with(up, '{x} ')" for x in D.LIST_TITLES) + ")"
TYPED = f"""select doc_id, pos, block_id, style_level, is_bold,
  case when type = 'toc_entry' and cap_category is not null then {PAGELESS('text')} else text end as text, type,
  (case type when 'heading' then coalesce(num_level, style_level) when 'toc_entry' then 1 end)::int as heading_level,
  case type when 'figure' then 0.98 when 'table' then 0.98 when 'toc_entry' then 0.95 when 'caption' then 0.95
    when 'heading' then case when style_level is not null and num_level is not null then case when style_level = num_level then 0.98 else 0.65 end
      when style_level is not null then 0.9 when num_kind = 'keyword' then 0.88 when num_reliable then 0.8 else 0.7 end
    else case when is_bold and text <> '' and length(text) <= 80 then 0.6 else 0.85 end end::double as confidence,
  case when type = 'caption' then cap_category when base <> 'paragraph' then base end as category, case when type = 'caption' then cap_number end as original_number
  from (select *, case when base <> 'paragraph' then base when cap_category is not null and list_entry then 'toc_entry' when cap_category is not null then 'caption'
    when {LIST_TITLE} then 'toc_entry' when style_level is not null or num_level is not null then 'heading' else 'paragraph' end as type
    from (select *, translate(upper(trim(text, {P.quoted(P.BLANKS)})), '{D.UP_ACCENTS}', '{D.UP_PLAIN}') as up from numbered))"""
VIEWS["numbered"], VIEWS["typed"] = NUMBERED, TYPED
TRIM = f"trim(text, {P.quoted(P.BLANKS)})"
CAPS = f"(length({TRIM}) between 3 and 80 and not regexp_matches({TRIM}, '[.,;]$') and regexp_matches({TRIM}, '\\p{{Lu}}') and upper({TRIM}) = {TRIM})"
PREFIX = f"rtrim(regexp_extract({TRIM}, '^(\\S+)\\s', 1), '.')"
TITLES = f"""(select * from (select doc_id, pos, {TRIM} as title, (case when length({TRIM}) < 3 or regexp_matches({TRIM}, {P.quoted(D.LEGEND_START)}) then null
  when regexp_matches({TRIM}, {P.quoted(D.TITLE_WORD)}) then 1 when regexp_matches({TRIM}, {P.quoted(D.TITLE_NUMBER)}) then least(3, length({PREFIX}) - length(replace({PREFIX}, '.', '')) + 1)
  when regexp_matches({TRIM}, {P.quoted(D.TITLE_CAPS)}) then 1 end)::int as level from blocks) where level is not null)"""
# The passes after typing, as views: contents lists (T19), capitals (T18), empty runs.
LISTED_TITLE = " or ".join(f"starts_with(upper({PAGELESS('text')}), '{x}')" for x in D.FRONT_TITLES)
VIEWS["listed"] = f"""with m as (select *, type = 'heading' and {P.ends_with_page_sql('text')} as member from typed),
  l as (select *, max(case when member then pos end) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding) as before from m),
  z as (select *, sum((member and (before is null or pos - before > 6))::int) over (partition by doc_id order by pos) as zone from l),
  d as (select *, sum(member::int) over (partition by doc_id, zone) as members, max(case when member then pos end) over (partition by doc_id, zone) as last from z),
  e as (select *, type = 'heading' and ((zone > 0 and members >= 4 and pos <= last) or (member and ({LISTED_TITLE}))) as entry from d)
  select doc_id, pos, block_id, case when entry then {PAGELESS('text')} else text end as text, style_level, is_bold, case when entry then 'toc_entry' else type end as type,
    heading_level, case when entry then 0.9 else confidence end as confidence, category, original_number from e"""
VIEWS["capped"] = f"""select doc_id, pos, block_id, text, style_level, is_bold, case when up then 'heading' else type end as type, case when up then 1 else heading_level end as heading_level,
  case when up then 0.75 else confidence end as confidence, category, original_number from (select *, type = 'paragraph' and {CAPS} as up from listed)"""
VIEWS["passes"] = f"""select *, type = 'heading' and empties >= 3 as page_break_before from (select *, pos - coalesce(max(case when not (type = 'paragraph' and {TRIM} = '') then pos end)
  over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), -1) - 1 as empties from capped)"""
FOLDED = P.folded_sql("text")
HAS_MARK = "(" + " or ".join(f"contains(f, {P.quoted(m)})" for m in D.COVER_MARKS) + ")"
COVER_END = "(" + " or ".join(f"f = '{x}' or regexp_matches(f, '^{x}[ :\t]')" for x in D.COVER_ENDS) + ")"
MARKS = " + ".join(f"max((inside and contains(f, {P.quoted(m)}))::int)" for m in D.COVER_MARKS)
VIEWS["covers"] = f"""with a as (select doc_id, pos, type, text, {FOLDED} as f from passes),
  b as (select *, f <> '' and length(f) <= 80 and {COVER_END} as ends from a),
  c as (select *, coalesce(min(pos) filter (where ends) over w, min(pos) filter (where type = 'heading' and not {HAS_MARK}) over w) as stop, count(*) over w as total
    from b window w as (partition by doc_id)),
  d as (select *, coalesce(stop, total) as n, pos < coalesce(stop, total) as inside from c),
  e as (select doc_id, any_value(n)::bigint as blocks, any_value(stop) is not null as ended, ({MARKS})::bigint as marks,
    substr(coalesce(string_agg(trim(substr(text, 1, 100), {P.quoted(P.BLANKS)}), ' · ' order by pos) filter (where inside and {TRIM} <> '' and pos < 20), ''), 1, 100) as excerpt
    from d group by 1)
  select doc_id, blocks, marks, case when blocks = 0 then 'starts_with_front_matter' when blocks > 40 then case when ended then 'too_long' else 'too_long_open' end
    when marks < 2 then 'few_marks' else 'remove' end as verdict, excerpt from e"""


def assessed_sql(source: str) -> str:
    """T13 as SQL over a table of typed blocks."""
    return f"""with n as (select *, {P.heading_number_sql('text', 'level')} as num_level, {P.heading_number_sql('text', 'reliable')} as num_reliable,
    {P.caption_sql('text', 'category')} as cap_category, {P.list_entry_sql('text')} as list_entry, {P.isolated_heading_sql('text')} as isolated, {P.sentence_shape_sql('text')} as sentence from {source}),
  k as (select *, case when type in ('toc_entry', 'shape') then 'shielded' when type = 'table' then 'table'
    when type = 'figure' and (cap_category is not null or original_number is not null) then 'image_with_caption' when type = 'figure' then 'image_without_caption'
    when cap_category is not null and not list_entry then 'caption' when heading_level is not null and num_level is not null and type = 'heading' then 'parsed_level'
    when heading_level is not null and num_level is not null then case when heading_level = num_level then 'style_and_number' else 'contradiction' end
    when heading_level is not null then 'style' when num_level is not null then 'number' when type = 'image' then 'image'
    when is_bold then case when isolated then 'bold_line' else 'bold_but_long' end when sentence then 'sentence' when isolated then 'short_line' else 'default' end as signal from n),
  v as (select doc_id, pos, block_id, text, is_bold, original_number,
    case when signal = 'shielded' then type when signal = 'table' then 'table' when signal = 'image_with_caption' then 'figure' when signal in ('image_without_caption', 'image') then 'image'
      when signal = 'caption' then 'caption' when signal in ('parsed_level', 'style_and_number', 'contradiction', 'style', 'number', 'bold_line') then 'heading' else 'paragraph' end as type,
    case signal when 'shielded' then confidence when 'table' then 0.98 when 'image_with_caption' then 0.95 when 'image_without_caption' then 0.9 when 'image' then 0.9 when 'caption' then 0.95
      when 'parsed_level' then confidence when 'style_and_number' then 0.98 when 'contradiction' then 0.65 when 'style' then 0.92 when 'number' then case when num_reliable then 0.85 else 0.6 end
      when 'bold_line' then 0.82 when 'bold_but_long' then 0.7 when 'sentence' then 0.9 when 'short_line' then 0.7 else 0.85 end::double as confidence, signal,
    (case when signal in ('shielded', 'parsed_level', 'style') then heading_level when signal in ('style_and_number', 'contradiction', 'number') then num_level end)::int as heading_level,
    case when signal in ('shielded', 'table') then category when signal = 'image_with_caption' then coalesce(cap_category, category, 'figure') when signal = 'caption' then cap_category end as category from k)
  select *, confidence < 0.85 as needs_review from v"""


VIEWS["assessed"] = assessed_sql("passes")


def classified_sql(source: str, verdicts: str) -> str:
    """T16 as SQL: where ``verdicts`` holds, the outside verdict is a heading of level 2 at 0.9."""
    return f"""select doc_id, pos, block_id, text, is_bold, original_number, case when used then 'heading' else type end as type, case when used then 2 else heading_level end as heading_level,
  case when used then 0.9 else confidence end as confidence, category, used as by_verdict, case when used then 0.9 else confidence end >= 0.85 as auto
  from (select *, needs_review and {verdicts} and 0.9 > confidence as used from {source})"""


def rooted_sql(source: str) -> str:
    """T17 as SQL."""
    against = P.quoted(P.words_of(P.AGAINST_WORDS.replace("|nous avons", "")))
    return f"""select doc_id, pos, case when root then 'heading' else type end as type, case when root then 1 else heading_level end as heading_level,
  case when root then 0.75 else confidence end as confidence, root
  from (select *, coalesce(any_heading = 0 and pos = first and length({TRIM}) <= 80 and not regexp_matches({TRIM}, {P.quoted(P.SENTENCE_END)}) and not regexp_matches({TRIM}, {against}), false) as root
    from (select *, max((type = 'heading')::int) over (partition by doc_id) as any_heading,
      min(case when type = 'paragraph' and {TRIM} <> '' then pos end) over (partition by doc_id) as first from {source}))"""


# Captions, numbers and references, as views.
VIEWS["linked"] = """with k as (select *, case when type = 'caption' then 'c' when type in ('figure', 'table') then 'p' else 'o' end as kind,
    case when type = 'caption' then category when type in ('figure', 'table') then type else '-' end as grp from typed),
  n as (select *, (kind is distinct from lag(kind) over w or grp is distinct from lag(grp) over w)::int as fresh from k window w as (partition by doc_id order by pos)),
  r as (select *, sum(fresh) over (partition by doc_id order by pos) as run from n),
  i as (select *, min(pos) over (partition by doc_id, run) as s, count(*) over (partition by doc_id, run) as len from r),
  a as (select c.doc_id, c.pos, p.block_id as aligned_id from i c join i p on p.doc_id = c.doc_id and p.kind = 'p' and c.kind = 'c' and p.grp = c.grp and c.s = p.s + p.len and c.len = p.len
    and c.pos - c.s = p.pos - p.s),
  b as (select c.doc_id, c.pos, count(*) as near, count(*) filter (where abs(p.pos - c.pos) <= 1) as adjacent, max(p.block_id) filter (where abs(p.pos - c.pos) <= 1) as adjacent_id,
    max(p.block_id) as near_id from i c join i p on p.doc_id = c.doc_id and p.kind = 'p' and c.kind = 'c' and p.grp = c.grp and abs(p.pos - c.pos) <= 2 group by 1, 2)
  select c.doc_id, c.pos, c.block_id as caption_id, case when aligned_id is not null then aligned_id when adjacent = 1 then adjacent_id when near = 1 then near_id end as carrier_id,
    case when aligned_id is not null then 0.9 when adjacent = 1 then case when near = 1 then 1.0 else 0.9 end when near = 1 then 0.8 end::double as confidence
    from i c left join a on a.doc_id = c.doc_id and a.pos = c.pos left join b on b.doc_id = c.doc_id and b.pos = c.pos where c.kind = 'c'"""
VIEWS["renumbered"] = """with c as (select t.*, case when t.type = 'caption' then t.category when t.type in ('figure', 'table') and not exists
    (select 1 from linked l where l.doc_id = t.doc_id and l.carrier_id = t.block_id) then t.type end as counting from typed t),
  n as (select *, case when counting is not null then (row_number() over (partition by doc_id, counting order by pos))::varchar end as number from c),
  f as (select *, case when number is distinct from original_number then number end as final from n),
  s as (select l.doc_id, l.carrier_id as block_id, min_by(coalesce(f.final, f.original_number), l.pos) as shown from linked l join f on f.doc_id = l.doc_id and f.pos = l.pos
    where l.carrier_id is not null and coalesce(f.final, f.original_number) is not null group by 1, 2)
  select f.doc_id, f.pos, f.block_id, f.type, f.text, f.category, f.heading_level, f.original_number, f.counting,
    case when f.type in ('figure', 'table') then coalesce(s.shown, f.final) else f.final end as final_number from f left join s on s.doc_id = f.doc_id and s.block_id = f.block_id"""
VIEWS["referring"] = P.references_sql("(select * from renumbered where type in ('paragraph', 'heading', 'cross_ref'))")
VIEWS["resolved"] = """with t as (select *, coalesce(counting, type, category) as cat from renumbered where counting is not null or final_number is not null),
  p as (select r.doc_id, r.pos, r.ref_no, t.pos as spot, t.block_id, coalesce(t.original_number = r.number, false) as same from referring r join t on t.doc_id = r.doc_id and t.cat = r.category),
  g as (select doc_id, pos, ref_no, count(*) filter (where same) as en, max_by(block_id, spot) filter (where same and spot <= pos) as eb, max(spot) filter (where same and spot <= pos) as ebp,
    min_by(block_id, spot) filter (where same and spot > pos) as ea, min(spot) filter (where same and spot > pos) as eap,
    count(*) as n, max_by(block_id, spot) filter (where spot <= pos) as b, max(spot) filter (where spot <= pos) as bp, min_by(block_id, spot) filter (where spot > pos) as a, min(spot) filter (where spot > pos) as ap
    from p group by 1, 2, 3),
  f as (select r.*, case when en > 0 then case when eap is null or pos - ebp <= eap - pos then eb else ea end when n > 0 then case when ap is null or pos - bp <= ap - pos then b else a end end as target_id,
    case when en = 1 then 1.0 when en > 1 then case when coalesce(pos - ebp = eap - pos, false) then 0.55 else 0.75 end when n > 0 then 0.55 end::double as confidence
    from referring r left join g using (doc_id, pos, ref_no)),
  o as (select *, min(case when target_id is not null then ref_no end) over (partition by doc_id, pos) as first from f)
  select doc_id, pos, ref_no, category, number, matched, target_id, confidence from o where first is null or ref_no <= first"""
VIEWS["paged"] = "select doc_id, block_id, (1 + pos // 10)::int as page from blocks where pos % 5 <> 0"
KEYWORD = P.quoted(r"(?i)^(légende|legende|figure|tableau|annexe|planche|table)\s+[0-9A-Z]+(?:\.[0-9]+)*\s*[-–—:.]?\s*")
VIEWS["entries"] = f"""select r.doc_id, r.category, 0 as part, r.pos, coalesce(final_number, original_number) as number, trim(regexp_replace({TRIM.replace('text', 'r.text')}, {KEYWORD}, ''), {P.quoted(P.BLANKS)}) as label,
    coalesce(own.page, other.page) as page from renumbered r left join linked l on l.doc_id = r.doc_id and l.pos = r.pos
    left join paged own on own.doc_id = r.doc_id and own.block_id = r.block_id left join paged other on other.doc_id = r.doc_id and other.block_id = l.carrier_id where r.type = 'caption'
  union all select r.doc_id, r.type, 1, r.pos, coalesce(final_number, original_number), '', own.page from renumbered r left join paged own on own.doc_id = r.doc_id and own.block_id = r.block_id
    where r.type in ('figure', 'table') and not exists (select 1 from linked l where l.doc_id = r.doc_id and l.carrier_id = r.block_id)"""
NEEDS.update({
    "numbered": ("blocks",), "typed": ("numbered",), "listed": ("typed",), "capped": ("listed",), "passes": ("capped",), "covers": ("passes",), "assessed": ("passes",),
    "linked": ("typed",), "renumbered": ("linked",), "referring": ("renumbered",), "resolved": ("referring",), "paged": ("blocks",), "entries": ("renumbered", "paged"),
})
VERDICT = "(doc_id + pos) % 4 = 0"
PAGE_TOP = f"trim(regexp_replace(translate(upper({TRIM}), '{D.UP_ACCENTS}', '{D.UP_PLAIN}'), '\\s+', ' ', 'g'), {P.quoted(P.BLANKS + ':;.,-–—')})"
NUMBER_SQL = P.heading_number_sql("t", "level")
ORACLE_SQL = {
    "S4_text_to_blocks": """with l as (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents),
      p as (select doc_id, len(parts) as n, generate_subscripts(parts, 1) - 1 as pos, unnest(parts) as text from l)
      select doc_id, pos, case when starts_with(text, '#') and pos = 0 then 'header' when starts_with(text, '#') and pos = n - 1 then 'footer' else 'body' end as parent, text from p""",
    "T2_regex_titles": with_views("blocks", f"select * from {TITLES} t"),
    "T1_rule_detect": with_views("blocks numbered typed", f"""select doc_id, pos, rule, case rule when 'heading1_style' then 'titles' when 'title_caps' then 'titles' when 'header' then 'headers' when 'table' then 'tables'
        when 'figure' then 'images' when 'mention' then 'other' else 'subtitles' end as category from (select doc_id, pos, case when type = 'heading' and style_level = 1 then 'heading1_style'
        when type = 'heading' and style_level = 2 then 'heading2_style' when type = 'heading' and style_level = 3 then 'heading3_style'
        when type = 'paragraph' and pos <> 0 and regexp_matches(text, {P.quoted(D.TITLE_CAPS)}) then 'title_caps' when is_bold then 'bold_line' when pos = 0 then 'header'
        when type = 'table' then 'table' when type = 'figure' then 'figure' when contains(text, 'voir Figure') then 'mention' end as rule from typed) where rule is not null"""),
    "T3_ambiguities_of_numbered_lines": with_views("blocks", """select doc_id, pos, title, level, suggested from (select doc_id, pos, 1 + pos % 2 as level, pos % 7 as k,
        case pos % 7 when 0 then 'IV. ' when 1 then '1.2 ' when 2 then '2.3.4 ' when 3 then 'II. ' when 4 then '' when 5 then '3. ' else '1.1.1.1 ' end || text as title,
        (case when pos % 7 in (0, 3) then 1 when pos % 7 = 1 then 2 when pos % 7 = 2 then 3 when pos % 7 = 6 then 4 when regexp_matches(text, '^[IVXLC]+\\.\\s+') and pos % 7 = 4 then 1
          when pos % 7 = 4 and regexp_matches(text, '^\\d+(?:\\.\\d+)+\\s+') then len(string_split(regexp_extract(text, '^(\\d+(?:\\.\\d+)+)\\s+', 1), '.')) end)::int as suggested from blocks)
      where suggested is not null and suggested <> level"""),
    "T6_review_candidates": with_views("blocks numbered typed listed capped passes", f"""with a as (select doc_id, pos from (select doc_id, pos, title, 1 + pos % 2 as level, (case when regexp_matches(title, '^[IVXLC]+\\.\\s+') then 1
        when regexp_matches(title, '^\\d+(?:\\.\\d+)+\\s+') then len(string_split(regexp_extract(title, '^(\\d+(?:\\.\\d+)+)\\s+', 1), '.')) end)::int as suggested from {TITLES} t) where suggested is not null and suggested <> level),
      w as (select *, string_agg(substr(text, 1, 40), ' / ') over (partition by doc_id order by pos rows between 2 preceding and 2 following) as context,
        pos - max(case when type = 'heading' then pos end) over (partition by doc_id order by pos) as distance, type = 'paragraph' and {TRIM} <> '' as plain from passes),
      r as (select w.doc_id, w.pos, context, case when a.pos is not null then 'ambiguous' when plain and regexp_matches(text, {P.quoted(D.LIST_MARK)}) then 'list_marker' when plain and distance <= 5 then 'near_title' end as reason
        from w left join a on a.doc_id = w.doc_id and a.pos = w.pos)
      select * from (select doc_id, pos, reason, row_number() over (partition by doc_id order by reason <> 'ambiguous', pos) as rank, context from r where reason is not null) where rank <= 60"""),
    "T7_apply_kind_corrections": with_views("blocks numbered typed listed capped passes", """select doc_id, pos, case when pos > 0 and pos % 4 = 0 then 'heading' else type end as type,
      (case when pos > 0 and pos % 4 = 0 then 2 when type = 'heading' then heading_level end)::int as heading_level from passes"""),
    "T28_type_signals": with_views("blocks", f"""with s as (select doc_id, pos, block_id, base, style_level, is_bold or pos % 6 = 1 as is_bold, (doc_id + pos) % 5 = 0 as has_shape,
        case when pos % 11 = 3 then 'rId1.img' when pos % 11 = 5 then 'embedded-object' end as image, case when pos % 9 = 4 then 1 + pos % 3 end as toc_level, 1 + pos % 5 as run_count,
        case when pos % 22 = 3 then '[image:rId1.img]' when pos % 11 = 3 then '[image:rId1.img] ' || text else text end as marked from blocks),
      n as (select *, trim(regexp_replace(marked, '\\[image:[^\\]]*\\]', '', 'g'), {P.quoted(P.BLANKS)}) as text from s),
      c as (select *, {P.heading_number_sql('text', 'level')} as num_level, {P.heading_number_sql('text', 'kind')} as num_kind, {P.heading_number_sql('text', 'reliable')} as num_reliable,
        {P.caption_sql('text', 'category')} as cap_category, {P.caption_sql('text', 'number')} as cap_number, {P.list_entry_sql('text')} as list_entry,
        translate(upper(trim(text, {P.quoted(P.BLANKS)})), '{D.UP_ACCENTS}', '{D.UP_PLAIN}') as up from n),
      k as (select *, case when base <> 'paragraph' then base when has_shape and (text = '' or image = 'embedded-object') then 'shape' when image is not null and cap_category is null and text = '' then 'image'
        when image is not null then 'picture' when cap_category is not null and list_entry then 'list' when cap_category is not null then 'caption' when toc_level is not null then 'contents'
        when {LIST_TITLE} then 'title' when style_level is not null or num_level is not null then 'heading' else 'paragraph' end as k from c)
      select doc_id, pos, block_id, case k when 'shape' then '' when 'image' then marked when 'picture' then marked when 'contents' then {PAGELESS('text')} when 'list' then {PAGELESS('text')} else text end as text,
        case k when 'picture' then 'figure' when 'list' then 'toc_entry' when 'contents' then 'toc_entry' when 'title' then 'toc_entry' else k end as type,
        (case k when 'heading' then coalesce(num_level, style_level) when 'contents' then toc_level when 'list' then 1 when 'title' then 1 end)::int as heading_level,
        case k when 'figure' then 0.98 when 'table' then 0.98 when 'shape' then 1.0 when 'image' then 0.9 when 'picture' then case when cap_category is null then 0.8 else 0.95 end
          when 'paragraph' then case when is_bold and run_count <= 3 and text <> '' and length(text) <= 80 then 0.6 else 0.85 end
          when 'heading' then case when style_level is not null and num_level is not null then case when style_level = num_level then 0.98 else 0.65 end
            when style_level is not null then 0.9 when num_kind = 'keyword' then 0.88 when num_reliable then 0.8 else 0.7 end else 0.95 end::double as confidence,
        case k when 'picture' then coalesce(cap_category, 'figure') when 'caption' then cap_category when 'figure' then base when 'table' then base end as category,
        case when k in ('picture', 'caption') then cap_number end as original_number, case when k in ('picture', 'image') then image end as image_ref from k"""),
    "J10_page_lookup": with_views("blocks", """with k as (select doc_id, pos, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as key from blocks where trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''),
      h as (select doc_id, pos as ord, 1 + pos // 10 as page, lower(trim(regexp_replace(upper(replace(text, 'ß', 'ss')), '\\s+', ' ', 'g'))) as holder from blocks where pos % 3 <> 1 and trim(regexp_replace(text, '\\s+', ' ', 'g')) <> ''),
      s as (select doc_id, holder, min_by(page, ord) as page from h group by 1, 2), m as (select k.* from k where not exists (select 1 from s where s.doc_id = k.doc_id and s.holder = k.key)),
      i as (select m.doc_id, m.pos, min_by(h.page, h.ord) as page from m join h on h.doc_id = m.doc_id and contains(h.holder, m.key) group by 1, 2)
      select k.doc_id, k.pos, coalesce(s.page, i.page)::int as page from k left join s on s.doc_id = k.doc_id and s.holder = k.key left join i on i.doc_id = k.doc_id and i.pos = k.pos"""),
    "T3_numbering_ambiguities": with_views("blocks", f"""select * from (select doc_id, pos, title, 1 + pos % 2 as level, (case when regexp_matches(title, '^[IVXLC]+\\.\\s+') then 1
      when regexp_matches(title, '^\\d+(?:\\.\\d+)+\\s+') then length(regexp_extract(title, '^(\\d+(?:\\.\\d+)+)\\s+', 1)) - length(replace(regexp_extract(title, '^(\\d+(?:\\.\\d+)+)\\s+', 1), '.', '')) + 1 end)::int as suggested
      from {TITLES} t) where suggested is not null and suggested <> level"""),
    "T4_apply_level_corrections": with_views("blocks", f"""select doc_id, pos, title, level, case when level = 1 then 'titles' else 'subtitles' end as list from
      (select doc_id, pos, title, (case when pos % 7 = 0 then 1 + pos % 3 else level end)::int as level from {TITLES} t where pos % 14 <> 0)"""),
    "T8_heading_number": with_views("blocks", f"""select * from (select doc_id, pos, {P.heading_number_sql('text', 'level')} as level, {P.heading_number_sql('text', 'kind')} as kind,
      {P.heading_number_sql('text', 'reliable')} as reliable, {P.heading_number_sql('text', 'matched')} as matched from blocks) where level is not null"""),
    "T9_heading_contradiction": with_views("numbered", """select doc_id, pos, num_level as pattern_level, style_level, coalesce(num_level <> style_level, false) as contradicts,
      num_level = 1 as top_level from numbered where num_level is not null""").replace("with numbered as", f"with blocks as ({VIEWS['blocks']}),\nnumbered as", 1),
    "T10_caption": with_views("blocks", f"""select * from (select doc_id, pos, {P.caption_sql('text', 'category')} as category, {P.caption_sql('text', 'number')} as number,
      {P.caption_sql('text', 'source')} as source, {P.caption_sql('text', 'label')} as label from blocks) where category is not null"""),
    "T14_sentence_shape": with_views("blocks", f"select doc_id, pos, {P.sentence_shape_sql('text')} as sentence, {P.isolated_heading_sql('text')} as isolated from blocks"),
    "T18_promote_all_caps": with_views("blocks numbered typed", f"""select doc_id, pos, case when type = 'paragraph' and {CAPS} then 'heading' else type end as type,
      case when type = 'paragraph' and {CAPS} then 1 else heading_level end as heading_level, case when type = 'paragraph' and {CAPS} then 0.75 else confidence end as confidence from typed"""),
    "T19_toc_runs": with_views("blocks numbered typed", f"""with m as (select *, type = 'heading' and {P.ends_with_page_sql('text')} as member from typed),
      l as (select *, max(case when member then pos end) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding) as before from m),
      z as (select *, sum((member and (before is null or pos - before > 6))::int) over (partition by doc_id order by pos) as zone from l),
      d as (select *, sum(member::int) over (partition by doc_id, zone) as members, max(case when member then pos end) over (partition by doc_id, zone) as last from z),
      e as (select *, type = 'heading' and ((zone > 0 and members >= 4 and pos <= last) or (member and ({" or ".join(f"starts_with(upper({PAGELESS('text')}), '{x}')" for x in D.FRONT_TITLES)}))) as listed from d)
      select doc_id, pos, case when listed then {PAGELESS('text')} else text end as text, case when listed then 'toc_entry' else type end as type,
      case when listed then 0.9 else confidence end as confidence from e"""),
    "T20_empty_run_breaks": with_views("blocks numbered typed", f"""with e as (select *, pos - coalesce(max(case when not (type = 'paragraph' and {TRIM} = '') then pos end) over
      (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), -1) - 1 as empties from typed)
      select doc_id, pos, type, empties, type = 'heading' and empties >= 3 as page_break_before from e"""),
    "T22_cover_candidate": with_views("blocks", f"""with e as (select doc_id, min(pos) as last from {TITLES} t group by 1)
      select b.doc_id, count(*) filter (where last is null or pos < last) as blocks, count(*) filter (where (last is null or pos < last) and {TRIM} <> '') as with_text
      from blocks b left join e on e.doc_id = b.doc_id group by 1"""),
    "T28_type_blocks": with_views("blocks numbered typed", "select doc_id, pos, block_id, text, type, heading_level, confidence, category, original_number from typed"),
    "N1_link_summary": with_views("blocks numbered typed", """with k as (select *, case when type = 'caption' then 'c' when type in ('figure', 'table') then 'p' else 'o' end as kind,
        case when type = 'caption' then category when type in ('figure', 'table') then type else '-' end as grp from typed),
      n as (select *, (kind is distinct from lag(kind) over w or grp is distinct from lag(grp) over w)::int as fresh from k window w as (partition by doc_id order by pos)),
      r as (select *, sum(fresh) over (partition by doc_id order by pos) as run from n),
      i as (select *, min(pos) over (partition by doc_id, run) as s, count(*) over (partition by doc_id, run) as len from r),
      a as (select c.doc_id, c.pos from i c join i p on p.doc_id = c.doc_id and p.kind = 'p' and c.kind = 'c' and p.grp = c.grp and c.s = p.s + p.len and c.len = p.len and c.pos - c.s = p.pos - p.s),
      b as (select c.doc_id, c.pos, count(*) as near, count(*) filter (where abs(p.pos - c.pos) <= 1) as adjacent from i c join i p on p.doc_id = c.doc_id and p.kind = 'p' and c.kind = 'c'
        and p.grp = c.grp and abs(p.pos - c.pos) <= 2 group by 1, 2),
      f as (select c.doc_id, c.pos, case when a.pos is not null then 0.9 when adjacent = 1 then case when near = 1 then 1.0 else 0.9 end when near = 1 then 0.8 end as conf
        from i c left join a using (doc_id, pos) left join b using (doc_id, pos) where c.kind = 'c')
      select doc_id, count(conf) as linked, count(*) filter (where conf is null) as orphans, count(*) filter (where conf < 1.0) as low_confidence from f group by 1"""),
    "T11_caption_without_number": with_views("blocks", f"""select doc_id, pos, case when regexp_matches(ltrim(text, {P.quoted(P.BLANKS)}), {P.quoted(P.CAPTION_BARE)}) then
      case lower(regexp_extract(ltrim(text, {P.quoted(P.BLANKS)}), {P.quoted(P.CAPTION_BARE)}, 1)) {' '.join(f"when '{w}' then '{c}'" for w, c in P.CAPTION_WORDS)} end end as category,
      {P.list_entry_sql('text')} as list_entry from blocks"""),
    "T12_cross_refs": with_views("blocks", P.references_sql("(select * from blocks where base = 'paragraph')")),
    "T13_assess": with_views("assessed", "select * from assessed"),
    "T15_partition_confidence": with_views("assessed", """select count(*) as total, count(*) filter (where confidence >= 0.85) as confident, count(*) filter (where confidence < 0.85) as ambiguous,
      coalesce(count(*) filter (where confidence >= 0.85) / nullif(count(*), 0)::double, 0) as free_ratio from assessed"""),
    "T16_classify": with_views("assessed", f"select * exclude (text) from ({classified_sql('assessed', VERDICT)})"),
    "T16_classification_report": with_views("assessed", f"""select count(*) as blocks, count(*) filter (where auto) as auto_applied, count(*) filter (where by_verdict) as by_verdict,
      count(*) filter (where not auto) as needs_user, round(count(*) filter (where auto) / nullif(count(*), 0)::double, 3) as auto_ratio from ({classified_sql('assessed', VERDICT)})"""),
    "T17_promote_root": with_views("assessed", f"""with s as (select * replace (case when doc_id % 3 = 0 and type = 'heading' then 'toc_entry' else type end as type) from assessed),
      c as ({classified_sql('s', f'{VERDICT} and doc_id % 3 <> 0')}), r as ({rooted_sql('c')}) select doc_id, pos, heading_level, confidence from r where root"""),
    "T21_cover_page": with_views("covers", "select * from covers"),
    "T23_title_candidates": with_views("passes", f"""select * from (select doc_id, pos, case when style_level is not null then 'style' when {NUMBER_SQL} is not null then 'pattern'
      when is_bold and t <> '' and length(t) < 120 and not ends_with(t, '.') then 'verify' end as why from (select *, {TRIM} as t from passes where type <> 'caption')) where why is not null"""),
    "T24_caption_candidates": with_views("blocks", f"""select * from (select doc_id, pos, case when regexp_matches(text, '(?i)\\{{\\s*SEQ\\s') then 'field' when {P.caption_sql('text', 'category')} is not null then 'pattern'
      when regexp_matches(ltrim(text, {P.quoted(P.BLANKS)}), {P.quoted(P.CAPTION_BARE)}) then 'keyword' end as why from blocks) where why is not null"""),
    "T25_page_break_required": with_views("passes", f"""select doc_id, pos, type <> 'toc_entry' and (page_break_before or (t <> '' and ({' or '.join(f"starts_with(t, '{x}')" for x in D.PAGE_TITLES)}))
      or (type = 'heading' and coalesce(heading_level, 1) <= 1)) as new_page from (select *, {PAGE_TOP} as t from passes)"""),
    "T26_heading_levels": with_views("passes", """select doc_id, string_agg(distinct level, ',' order by level) as levels, count(*) as headings from
      (select doc_id, greatest(least(coalesce(heading_level, 1), 3), 1)::varchar as level from passes where type = 'heading') group by 1"""),
    "T27_strip_field_codes": with_views("blocks", f"""select doc_id, pos, lower(trim(regexp_replace(regexp_replace(text, '\\{{[^}}]*\\}}', '', 'g'), '\\s+', ' ', 'g'), {P.quoted(P.BLANKS)})) as plain from blocks"""),
    "T27_resolve_seq_fields": with_views("blocks", """select doc_id, pos, case when kind <> '' then regexp_replace(text, '^(Figure|Tableau) \\d+', row_number() over (partition by doc_id, kind order by pos)::varchar)
      else text end as text from (select *, lower(regexp_extract(text, '^(Figure|Tableau) \\d+', 1)) as kind from blocks)""").replace("regexp_replace(text, '^(Figure|Tableau) \\d+', row", "regexp_replace(text, '^(Figure|Tableau) \\d+', regexp_extract(text, '^(Figure|Tableau)', 1) || ' ' || row"),
    "D_detect_structure": with_views("covers", f"""with kept as (select p.* from passes p left join covers c on c.doc_id = p.doc_id and c.verdict = 'remove' where c.doc_id is null or p.pos >= c.blocks),
      a as ({assessed_sql('kept')}), c as ({classified_sql('a', VERDICT)}) {rooted_sql('c')}"""),
    "N1_link_captions": with_views("linked", "select * from linked"),
    "N2_renumber": with_views("renumbered", "select * exclude (text) from renumbered"),
    "N2_number_changes": with_views("renumbered", "select doc_id, block_id, counting, original_number, final_number from renumbered where counting is not null and final_number is not null"),
    "N3_number_anomalies": with_views("renumbered", """with o as (select doc_id, counting, original_number, count(*) as n, try_cast(original_number as int) as v from renumbered
        where counting is not null and original_number is not null group by 1, 2, 3),
      p as (select doc_id, counting, coalesce(string_agg(original_number, ',' order by original_number) filter (where n > 1), '') as duplicates,
        coalesce(list(v) filter (where v > 0), []) as seen, coalesce(sum(n) filter (where v > 0), 0)::int as n from o group by 1, 2)
      select * from (select doc_id, counting, duplicates, coalesce(array_to_string(list_filter(range(1, n + 1), lambda x: not list_contains(seen, x)), ','), '') as gaps from p) where duplicates <> '' or gaps <> ''"""),
    "N4_resolve_refs": with_views("resolved", "select * from resolved"),
    "N6_low_confidence_report": with_views("resolved", """with r as (select *, coalesce(confidence < 0.7, false) as low from resolved),
      k as (select *, row_number() over (partition by doc_id, low order by pos, ref_no) as rank from r)
      select doc_id, count(*) as "references", count(*) filter (where low) as low, count(*) filter (where target_id is null) as unresolved,
      coalesce(string_agg(matched, '; ' order by pos, ref_no) filter (where low and rank <= 5), '') as examples, count(*) filter (where low) > 5 as truncated from k group by 1"""),
    "N7_numbering_pipeline": with_views("renumbered", "select * from renumbered"),
    "N8_table_of_contents": with_views("passes paged", f"""select t.doc_id, t.pos, t.block_id, greatest(1, coalesce(heading_level, 1)) as level, page, page is not null as has_page,
      greatest(1, coalesce(heading_level, 1)) > 3 as truncated from (select *, upper({TRIM}) as t from passes where type = 'heading') t left join paged g on g.doc_id = t.doc_id and g.block_id = t.block_id
      where t <> '' and rtrim(t, ' :.' || chr(9) || chr(10) || chr(13)) not in ({', '.join(f"'{x}'" for x in N.NOT_LISTED)})"""),
    "N9_category_lists": with_views("entries", "select * from entries"),
    "N10_list_quality": with_views("entries", """select *, entries > 0 and missing_pages = 0 as has_pages, concat_ws('; ', case when missing_pages > 0 then missing_pages || ' without page' end,
      case when unlabelled > 0 then unlabelled || ' without label' end) as message from (select doc_id, category, count(*) as entries, count(*) filter (where page is null) as missing_pages,
      count(*) filter (where label = '') as unlabelled from entries group by 1, 2)"""),
    "N11_figure_plan": with_views("linked", """with f as (select t.doc_id, count(*) as figures, count(*) filter (where exists (select 1 from linked l where l.doc_id = t.doc_id and l.carrier_id = t.block_id)) as captioned
        from typed t where type = 'figure' group by 1), o as (select doc_id, count(*) as orphans from linked where carrier_id is null group by 1)
      select coalesce(f.doc_id, o.doc_id) as doc_id, coalesce(figures, 0) as figures, coalesce(captioned, 0) as captioned, coalesce(figures, 0) - coalesce(captioned, 0) as uncaptioned,
      coalesce(orphans, 0) as orphan_captions from f full join o on o.doc_id = f.doc_id"""),
}
