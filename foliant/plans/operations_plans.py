"""Registered queries over operations, edits, chat and clarifications, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import edits as E
from foliant.operators import monitoring as M
from foliant.operators import numbering as N
from foliant.plans import structure_plans as SP
from foliant.session import materialize, read_table
from foliant.sources import fixtures as fx
from foliant.sources.fixtures import with_views

NOW = fx.NOW_EVENTS


def raw_blocks(s, d):
    """The typed blocks as the monitoring and edit queries read them."""
    return SP.typed(s, d)


def clarifications(s, d):
    rows = raw_blocks(s, d).where("confidence < 0.85")
    return rows.selectExpr("doc_id", "pos", "block_id", f"if((doc_id + pos) % 3 = 0, timestamp_ntz'{NOW}', null) as answered_at")


CLAR = f"(select doc_id, pos, block_id, case when (doc_id + pos) % 3 = 0 then timestamp '{NOW}' end as answered_at from typed where confidence < 0.85)"


def jobs(s, d):
    e = read_table(s, d, "events").where("event_type in ('error', 'signup')")
    return e.select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "error", F.col("ts")).alias("failed_at"))


def edits(s, d):
    b = SP.BLOCKS(s, d).where("(doc_id + pos) % 6 = 0")
    return b.selectExpr(
        "doc_id * 100000 + pos as edit_id", "doc_id", "cast(if(pos % 11 = 10, pos + 100000, pos) as int) as pos",
        "element_at(array('rewrite', 'insert', 'delete', 'replace_range', 'odd'), cast((doc_id + 2 * pos) % 5 + 1 as int)) as tool",
        "cast(if(pos % 4 = 0, null, pos + pos % 3) as int) as end_pos", "if(pos % 9 = 8, '', concat('new text ', pos)) as text",
        "if(pos % 5 = 0, 'toc_entry', 'paragraph') as type",
    )


EDITS = """(select doc_id * 100000 + pos as edit_id, doc_id, case when pos % 11 = 10 then pos + 100000 else pos end as pos,
  case (doc_id + 2 * pos) % 5 when 0 then 'rewrite' when 1 then 'insert' when 2 then 'delete' when 3 then 'replace_range' else 'odd' end as tool,
  case when pos % 4 = 0 then null else pos + pos % 3 end as end_pos, case when pos % 9 = 8 then '' else 'new text ' || pos end as text,
  case when pos % 5 = 0 then 'toc_entry' else 'paragraph' end as type from blocks where (doc_id + pos) % 6 = 0)"""


def simple_blocks(s, d):
    return SP.BLOCKS(s, d).select("doc_id", "pos", "block_id", "text")


def guards(s, d):
    numbered, links = SP.numbered(s, d)
    return E.edit_guards(edits(s, d), simple_blocks(s, d), N.resolve_refs(numbered), links)


def after_edits(s, d):
    """Typed blocks after the batch: a deleted or replaced block is gone."""
    typed = raw_blocks(s, d)
    kept = E.apply_edits(typed.select("doc_id", "pos", "block_id", "text"), edits(s, d)).select("doc_id", "block_id")
    return typed.join(kept, ["doc_id", "block_id"], "left_semi")


def tables(s, d):
    """A table for each document with at least two lines: a row a line; its first word, its second, and the rest."""
    rows = read_table(s, d, "documents").select("doc_id", F.filter(F.split("text", "\n"), lambda x: F.length(x) > 0).alias("l")).where("size(l) >= 2")
    rest = lambda x: F.regexp_replace(x, "^[^ ]*( [^ ]*)? ?", "")
    cells = F.transform("l", lambda x: F.array(F.split_part(x, F.lit(" "), F.lit(1)), F.split_part(x, F.lit(" "), F.lit(2)), rest(x)))
    span = F.transform(cells, lambda r, i: F.when((i == 0) & (F.col("doc_id") % 4 == 0), F.array(F.lit(3))).otherwise(F.array(F.lit(1), F.lit(1), F.lit(1))))
    return rows.select("doc_id", cells.alias("cells"), F.size(cells).alias("rows"), F.lit(3).alias("cols"), span.alias("grid_span"))


TABLES = """(select doc_id, list_transform(l, lambda x: [split_part(x, ' ', 1), split_part(x, ' ', 2), regexp_replace(x, '^[^ ]*( [^ ]*)? ?', '')]) as cells from
  (select doc_id, list_filter(string_split(text, chr(10)), lambda x: length(x) > 0) as l from documents) where len(l) >= 2)"""


def table_edits(s, d):
    return tables(s, d).selectExpr(
        "doc_id", "element_at(array('add_row', 'add_column', 'remove_row', 'set_cell', 'set_header'), cast(doc_id % 5 + 1 as int)) as tool",
        "cast(doc_id % 7 as int) as row", "cast(doc_id % 4 as int) as col", "array('a', 'b') as values")


def deleted(s, d):
    return SP.BLOCKS(s, d).where("(doc_id + 5 * pos) % 7 = 0").select("doc_id", "block_id")


def violations_input(s, d):
    return raw_blocks(s, d).selectExpr(
        "doc_id", "pos", "if(pos % 17 = 0, '', if(pos % 19 = 1, concat('b0x', doc_id), block_id)) as block_id", "if(pos % 23 = 0, 'odd', type) as type",
        "confidence + if(pos % 29 = 0, 1, 0) as confidence", "if(pos % 31 = 0, 'guess', 'exact') as fidelity", "heading_level", "category",
        "pos % 2 = 0 as has_table", "false as has_ref", "pos % 3 = 0 as has_image")


def truth(s, d):
    return read_table(s, d, "labels").where("quality = 1").selectExpr("doc_id", "explode(array(0, 4, 9)) as pos").select("doc_id", "pos")


def predicted(s, d):
    return SP.detailed(s, d).withColumn("rule", F.when(F.col("type") == "heading", F.when(F.col("style_level").isNotNull(), "style").otherwise("number"))).where(
        "rule is not null").select("doc_id", "pos", "rule")


def reports(s, d):
    """Numbering and passes read the same typed blocks, which are written: their patterns are the most work."""
    typed = materialize(SP.typed(s, d), "typed")
    rows = typed.select(*SP.NUMBERING)
    numbered = materialize(N.renumber(rows, materialize(N.link_captions(rows), "links")), "numbered")
    blocks = SP.passes_over(typed)
    return M.document_report(blocks, N.number_changes(numbered), N.resolve_refs(numbered), M_covers(blocks))


def M_covers(blocks):
    from foliant.operators.detect import cover_pages

    return cover_pages(blocks)


def legacy_elements(s, d):
    rows = SP.detailed(s, d).selectExpr("doc_id", "if(pos % 13 = 0, null, doc_id * 1000 + pos % 40) as element_index", "parent", "type")
    return rows


def answers(s, d):
    rows = SP.detailed(s, d).where("pos % 3 = 0")
    words = "element_at(array('Titre niveau 2', 'un TITRE', 'paragraphe', 'c''est une figure', 'tableau', 'je ne sais pas'), cast(pos % 6 + 1 as int))"
    return rows.selectExpr("doc_id", "block_id", f"{words} as answer")


def snapshots(s, d):
    return fx.usage_ledger(s, d).selectExpr("document_id % 25 as doc_id", "id", "created_at")


def locks(s, d):
    return fx.usage_ledger(s, d).groupBy("document_id").agg(F.max("created_at").alias("acquired_at"), F.max_by("user_id", "id").alias("user_id")).select(
        F.col("document_id").alias("doc_id"), "acquired_at", "user_id")


def erased(s, d):
    ids = fx.users(s, d).where("id % 10 = 0").select(F.col("id").alias("user_id"))
    tables_ = {n: df.select("user_id") for n, df in (("ledger", fx.usage_ledger(s, d)), ("invoices", fx.invoices(s, d)), ("payments", fx.payments(s, d)),
                                                    ("subscriptions", fx.subscriptions(s, d)))}
    parts = [df.groupBy("user_id").agg(F.count("*").alias("n")).withColumn("name", F.lit(n)) for n, df in M.erase_users(tables_, ids).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


QUERIES = {
    "G17_documents_by_status": lambda s, d: M.documents_by_status(fx.documents_ops(s, d), NOW),
    "G18_status_histogram": lambda s, d: M.status_histogram(fx.documents_ops(s, d)),
    "G19_pending_clarifications": lambda s, d: M.pending_clarifications(clarifications(s, d)),
    "G20_documents_with_pending": lambda s, d: M.clarification_totals(clarifications(s, d)),
    "G21_pipeline_share": lambda s, d: M.pipeline_share(fx.documents_ops(s, d)),
    "G22_queue_health": lambda s, d: M.queue_health(jobs(s, d)),
    "G23_classification_quality": lambda s, d: M.classification_quality(raw_blocks(s, d), clarifications(s, d)),
    "G23_corpus_quality": lambda s, d: M.corpus_quality(raw_blocks(s, d), clarifications(s, d)),
    "G25_user_totals": lambda s, d: M.user_totals(fx.users(s, d)),
    "G26_document_diagnostics": lambda s, d: M.document_diagnostics(raw_blocks(s, d)),
    "G27_detection_compare": lambda s, d: M.detection_compare(raw_blocks(s, d)),
    "G28_detection_eval": lambda s, d: M.detection_eval(predicted(s, d), truth(s, d)),
    "G29_document_report": reports,
    "G29_report_warnings": lambda s, d: M.report_warnings(reports(s, d)),
    "G30_table_stats": lambda s, d: M.table_stats(tables(s, d)),
    "G31_content_integrity": lambda s, d: M.content_integrity(simple_blocks(s, d), simple_blocks(s, d).withColumn(
        "text", F.when(F.col("pos") % 8 == 5, F.concat("text", F.lit("!"))).otherwise(F.col("text")))),
    "W1_stuck_documents": lambda s, d: M.stuck_documents(fx.documents_ops(s, d), NOW),
    "W2_recent_n_per_user": lambda s, d: M.recent_n(fx.usage_ledger(s, d).select("id", "user_id", "created_at"), "user_id", "created_at", 8),
    "W3_attention_points": lambda s, d: M.attention_points(fx.documents_ops(s, d), clarifications(s, d), jobs(s, d), NOW),
    "W4_snapshot_retention": lambda s, d: M.snapshot_ranks(snapshots(s, d)),
    "W5_lock_state": lambda s, d: M.lock_state(locks(s, d), "2024-01-29 12:00:00", 7),
    "W6_chat_context": lambda s, d: M.chat_context(fx.chat_messages(s, d), budget=2500),
    "W7_attachment_budget": lambda s, d: M.attachment_budget(fx.chat_messages(s, d), 1500),
    "W8_retention_expired": lambda s, d: M.retention_expired(fx.documents_ops(s, d).selectExpr("id", "updated_at as modified_at"), NOW),
    "W9_erase_user": erased,
    "P7_structural_violations": lambda s, d: E.structural_violations(violations_input(s, d)),
    "J9_merge_detections": lambda s, d: E.merge_detections(legacy_elements(s, d).where("element_index % 3 = 0 or element_index is null"), legacy_elements(s, d)),
    "E1_apply_edits": lambda s, d: E.apply_edits(simple_blocks(s, d), edits(s, d)),
    "E2_edit_guards": guards,
    "E2_links_after_deletes": lambda s, d: E.links_after_deletes(SP.linked(s, d)[1], deleted(s, d)),
    "E3_confirmation_required": lambda s, d: E.confirmation_required(edits(s, d)),
    "E4_edit_table_cells": lambda s, d: E.edit_table_cells(tables(s, d).select("doc_id", "cells"), table_edits(s, d)),
    "E5_needs_renumbering": lambda s, d: E.needs_renumbering(raw_blocks(s, d), after_edits(s, d), edits(s, d)),
    "E6_validate_edits": lambda s, d: E.validate_edits(edits(s, d)),
    "E7_clarification_questions": lambda s, d: E.clarification_questions(raw_blocks(s, d), SP.BLOCKS(s, d).where("pos % 2 = 0")),
    "E8_apply_answers": lambda s, d: E.apply_answers(raw_blocks(s, d), answers(s, d)),
}

TYPED_VIEWS = "blocks numbered typed"
AGE = f"coalesce(floor(epoch(timestamp '{NOW}' - updated_at) / 86400)::bigint, 0)"
JOBS = "(select event_id as id, case when event_type = 'error' then ts end as failed_at from events where event_type in ('error', 'signup'))"
KEPT = f"""gone as (select doc_id, pos from {EDITS} e where tool = 'delete' union select doc_id, unnest(range(pos, end_pos + 1)) from {EDITS} e where tool = 'replace_range' and end_pos >= pos)"""
ORACLE_SQL = {
    "G17_documents_by_status": with_views("documents_ops", f"""with a as (select status, {AGE} as age from documents_ops)
      select status, count(*) as total, floor((sum(age) * 20 + count(*))::double / (count(*) * 2)) / 10 as mean_age, max(age) as max_age,
      count(*) filter (where age >= 3) as attention, count(*) filter (where age >= 14) as abandoned from a group by 1"""),
    "G18_status_histogram": with_views("documents_ops", "select status, count(*) as n, (sum(count(*)) over ())::bigint as total from documents_ops group by 1"),
    "G19_pending_clarifications": with_views(TYPED_VIEWS, f"select doc_id, count(*) as pending, count(*) >= 30 as excessive from {CLAR} c where answered_at is null group by 1"),
    "G20_documents_with_pending": with_views(TYPED_VIEWS, f"""with p as (select doc_id, count(*) as pending from {CLAR} c where answered_at is null group by 1)
      select coalesce(sum(pending), 0)::bigint as pending, count(*) as documents, max_by(doc_id, (pending, -doc_id)) as heaviest, max(pending) as heaviest_pending from p"""),
    "G21_pipeline_share": with_views("documents_ops", """with c as (select count(*) filter (where pipeline = 'native') as native, count(*) filter (where pipeline is null) as old from documents_ops)
      select native, old, case when native + old > 0 then floor((native * 2000 + native + old)::double / ((native + old) * 2)::double) / 10 else 0.0 end as share from c"""),
    "G22_queue_health": f"select count(*) filter (where failed_at is null) as backlog, count(failed_at) as failed, min(failed_at) as oldest_failure from {JOBS} j",
    "G23_classification_quality": with_views(TYPED_VIEWS, f"""with p as (select doc_id, count(*) as pending from {CLAR} c where answered_at is null group by 1),
      q as (select doc_id, count(*) as blocks, count(*) filter (where type = 'heading') as headings, count(*) filter (where confidence < 0.85) as ambiguous from typed group by 1
        order by doc_id desc limit 100)
      select q.doc_id, blocks, headings, ambiguous, floor(((blocks - ambiguous) * 2000 + blocks)::double / (blocks * 2)::double) / 10 as auto_rate, headings = 0 as no_heading,
      coalesce(pending, 0) as pending from q left join p on p.doc_id = q.doc_id"""),
    "G25_user_totals": with_views("users", """select count(*) as users, count(*) filter (where is_admin) as admins, count(*) filter (where is_suspended) as suspended,
      coalesce(sum(credits_balance), 0)::bigint as credits from users"""),
    "G23_corpus_quality": with_views(TYPED_VIEWS, f"""with p as (select doc_id, count(*) as blocks, count(*) filter (where type = 'heading') as headings, count(*) filter (where confidence < 0.85) as ambiguous from typed group by 1)
      select count(*) as documents, count(*) filter (where headings = 0) as without_heading, sum(blocks)::bigint as blocks, sum(headings)::bigint as headings, sum(ambiguous)::bigint as ambiguous,
      (select count(*) from {CLAR} c where answered_at is null) as pending, floor(((sum(blocks) - sum(ambiguous)) * 2000 + sum(blocks))::double / (sum(blocks) * 2)::double) / 10 as auto_rate from p"""),
    "G26_document_diagnostics": with_views(TYPED_VIEWS, f"""with e as (select *, type = 'paragraph' and {SP.TRIM} = '' as empty from typed),
      r as (select *, case when empty then pos - coalesce(max(case when not empty then pos end) over (partition by doc_id order by pos), -1) else 0 end as run from e),
      g as (select doc_id, count(*) filter (where type = 'paragraph') as paragraphs, count(*) filter (where type = 'paragraph' and not empty) as filled, count(*) filter (where empty) as empty,
        max(run)::bigint as longest_empty_run, count(*) filter (where type = 'table') as tables, count(*) filter (where style_level is not null) as styled,
        count(*) filter (where type = 'toc_entry') as toc_entries, count(*) filter (where type = 'caption' and style_level is not null) as s from r group by 1)
      select * exclude (s), concat_ws(',', case when longest_empty_run >= 3 then 'empty_run' end, case when s > 0 then 'styled_caption' end) as warnings from g"""),
    "G27_detection_compare": with_views(TYPED_VIEWS, """select doc_id, count(*) filter (where type = 'heading') as headings, count(*) filter (where type = 'caption') as captions,
      count(*) filter (where type = 'table') as tables, count(*) filter (where type = 'figure') as figures from typed group by 1"""),
    "G28_detection_eval": with_views(TYPED_VIEWS, """with p as (select doc_id, pos, case when style_level is not null then 'style' else 'number' end as rule from typed where type = 'heading'),
      t as (select doc_id, unnest([0, 4, 9]) as pos from labels where quality = 1),
      n as (select count(*) as truth from t),
      g as (select rule, count(*) as found, count(t.doc_id) as right from p left join t on t.doc_id = p.doc_id and t.pos = p.pos group by 1)
      select rule, found, "right", floor(("right" * 2000 + found)::double / (found * 2)::double) / 10 as precision,
      floor(("right" * 2000 + truth)::double / (truth * 2)::double) / 10 as recall from g, n"""),
    "G31_content_integrity": with_views("blocks", """select doc_id, count(*) as checked, coalesce(string_agg(case when pos % 8 = 5 then block_id end, ',' order by block_id), '') as corrupted
      from blocks group by 1"""),
    "W1_stuck_documents": with_views("documents_ops", f"select id, filename, status, {AGE} as age from documents_ops where status not in ('ready', 'generated') order by updated_at nulls first, id limit 15"),
    "W2_recent_n_per_user": with_views("usage_ledger", """select * from (select id, user_id, created_at, row_number() over (partition by user_id order by created_at desc, id desc) as rank from usage_ledger) where rank <= 8"""),
    "W3_attention_points": with_views(f"documents_ops {TYPED_VIEWS}", f"""select * from (select 'info' as level, 'abandoned' as point, count(*) filter (where {AGE} >= 14) as n from documents_ops
      union all select 'warning', 'unfinished', count(*) filter (where {AGE} >= 3 and {AGE} < 14) from documents_ops
      union all select 'warning', 'clarifications', count(*) from (select doc_id from {CLAR} c where answered_at is null group by 1 having count(*) >= 30)
      union all select 'warning', 'native_never_used', case when count(*) filter (where pipeline = 'native') = 0 then count(*) filter (where pipeline is null) else 0 end from documents_ops
      union all select 'danger', 'failed_jobs', count(failed_at) from {JOBS} j) where n > 0"""),
    "W4_snapshot_retention": with_views("usage_ledger", """select *, rank = 1 as latest, rank > 30 as expired from
      (select document_id % 25 as doc_id, id, row_number() over (partition by document_id % 25 order by created_at desc, id desc) as rank from usage_ledger)"""),
    "W5_lock_state": with_views("usage_ledger", """with l as (select document_id as doc_id, max(created_at) as acquired_at, max_by(user_id, id) as user_id from usage_ledger group by 1)
      select doc_id, epoch(timestamp '2024-01-29 12:00:00') - floor(epoch(acquired_at)) > 180 as stale,
      epoch(timestamp '2024-01-29 12:00:00') - floor(epoch(acquired_at)) <= 180 and user_id <> 7 as held_by_other from l"""),
    "W6_chat_context": with_views("chat_messages", """with r as (select *, row_number() over (partition by session_id order by turn desc) as rank from chat_messages),
      u as (select *, (sum(strlen(content)) over (partition by session_id order by turn desc))::bigint as used from r where rank <= 10),
      o as (select *, max((used > 2500)::int) over (partition by session_id order by turn desc) as over from u)
      select session_id, turn, role, used as bytes_from_newest from o where rank = 1 or over = 0"""),
    "W7_attachment_budget": with_views("chat_messages", """with b as (select *, coalesce(sum(length(content)) over (partition by session_id order by turn rows between unbounded preceding and 1 preceding), 0) as before from chat_messages)
      select session_id, turn, case when 1500 - before > 0 then substr(content, 1, (1500 - before)::int) end as kept from b"""),
    "W8_retention_expired": with_views("documents_ops", f"select id from documents_ops where updated_at < timestamp '{NOW}' - interval 72 hour"),
    "W9_erase_user": with_views("usage_ledger invoices payments subscriptions", " union all ".join(
      f"select user_id, count(*) as n, '{n}' as name from {t} where user_id not in (select c_custkey from customer where c_custkey % 10 = 0) group by 1"
      for n, t in (("ledger", "usage_ledger"), ("invoices", "invoices"), ("payments", "payments"), ("subscriptions", "subscriptions")))),
    "E1_apply_edits": with_views("blocks", f"""with {KEPT}, rw as (select doc_id, pos, max_by(text, edit_id) as new_text from {EDITS} e where tool = 'rewrite' group by 1, 2),
      k as (select b.doc_id, 0 as part, b.pos as anchor, 0 as added, 0 as seq, b.block_id, coalesce(new_text, text) as text from blocks b left join rw on rw.doc_id = b.doc_id and rw.pos = b.pos
        where not exists (select 1 from gone g where g.doc_id = b.doc_id and g.pos = b.pos)),
      f as (select e.doc_id, case when b.pos is null then 1 else 0 end as part, b.pos as anchor, 1 as added, case when b.pos is null then edit_id when tool = 'insert' then -edit_id else -4611686018427387904 end as seq,
        'new-' || edit_id as block_id, e.text from {EDITS} e left join blocks b on b.doc_id = e.doc_id and b.pos = e.pos
        where tool = 'insert' or (tool = 'replace_range' and end_pos >= e.pos and b.pos is not null))
      select doc_id, row_number() over (partition by doc_id order by part, anchor, added, seq) - 1 as pos, block_id, text from (select * from k union all select * from f)"""),
    "E3_confirmation_required": with_views("blocks", f"""select doc_id, touched, touched > 5 as confirm from (select doc_id,
      sum(case when tool = 'delete' then 1 when tool = 'replace_range' then greatest(0, end_pos - pos + 1) else 0 end)::bigint as touched from {EDITS} e group by 1)"""),
    "E2_edit_guards": with_views("blocks resolved linked", f"""with z as (select doc_id, count(*) as n from blocks group by 1)
      select edit_id, case when b.block_id is null then 'unknown_block' when tool = 'replace_range' and (e.end_pos < e.pos or e.end_pos >= n) then 'invalid_range'
        when tool = 'delete' and exists (select 1 from resolved r where r.doc_id = e.doc_id and r.target_id = b.block_id) then 'referred_to'
        when tool = 'delete' and exists (select 1 from linked l where l.doc_id = e.doc_id and l.carrier_id = b.block_id) then 'described_by_caption'
        when tool = 'delete' and n <= 1 then 'last_block' end as refused from {EDITS} e left join blocks b on b.doc_id = e.doc_id and b.pos = e.pos left join z on z.doc_id = e.doc_id"""),
    "E2_links_after_deletes": with_views("blocks numbered typed linked", """with g as (select doc_id, block_id from blocks where (doc_id + 5 * pos) % 7 = 0)
      select l.* replace (case when exists (select 1 from g where g.doc_id = l.doc_id and g.block_id = l.carrier_id) then null else carrier_id end as carrier_id) from linked l
      where not exists (select 1 from g where g.doc_id = l.doc_id and g.block_id = l.caption_id)"""),
    "E4_edit_table_cells": f"""with t as (select doc_id, cells, len(cells) as n, (doc_id % 7)::int as r, (doc_id % 4)::int as c, doc_id % 5 as k from {TABLES} t),
      o as (select *, case k when 0 then r <= n when 1 then c <= 3 when 2 then r < n and n > 1 when 3 then r < n and c < 3 else false end as ok from t)
      select doc_id, case k when 0 then 'add_row' when 1 then 'add_column' when 2 then 'remove_row' when 3 then 'set_cell' else 'set_header' end as tool, ok,
      to_json(case when not ok then cells when k = 0 then list_concat(list_concat(cells[1:r], [['a', 'b', '']]), cells[r + 1:])
        when k = 1 then list_transform(cells, lambda x, i: list_concat(list_concat(x[1:c], [case i when 1 then 'a' when 2 then 'b' else '' end]), x[c + 1:]))
        when k = 2 then list_filter(cells, lambda x, i: i <> r + 1) else list_transform(cells, lambda x, i: list_transform(x, lambda y, j: case when i = r + 1 and j = c + 1 then 'a' else y end)) end)::varchar as cells from o""",
    "E5_needs_renumbering": with_views(TYPED_VIEWS, f"""with {KEPT}, b as (select doc_id, count(*) filter (where type in ('figure', 'table', 'annexe', 'planche')) as x, count(*) filter (where type = 'caption') as y from typed group by 1),
      a as (select doc_id, count(*) filter (where type in ('figure', 'table', 'annexe', 'planche')) as x, count(*) filter (where type = 'caption') as y from typed t
        where not exists (select 1 from gone g where g.doc_id = t.doc_id and g.pos = t.pos) group by 1), e as (select doc_id, bool_or(tool <> 'rewrite') as s from {EDITS} e group by 1)
      select e.doc_id, s and (b.x is distinct from a.x or b.y is distinct from a.y) as renumber from e left join b using (doc_id) left join a using (doc_id)"""),
    "P7_structural_violations": with_views(TYPED_VIEWS, """with v as (select doc_id, pos, case when pos % 17 = 0 then '' when pos % 19 = 1 then 'b0x' || doc_id else block_id end as block_id,
        case when pos % 23 = 0 then 'odd' else type end as type, confidence + case when pos % 29 = 0 then 1 else 0 end as confidence, case when pos % 31 = 0 then 'guess' else 'exact' end as fidelity,
        heading_level, category, pos % 2 = 0 as has_table, pos % 3 = 0 as has_image from typed),
      k as (select *, type <> 'odd' as known, row_number() over (partition by doc_id, block_id order by pos) > 1 as twice, coalesce(category in ('figure', 'table', 'annexe', 'planche'), false) as cat from v)
      select doc_id, pos, fault from (select doc_id, pos, unnest([case when block_id = '' then 'block_id_missing' when twice then 'block_id_twice' end, case when not known then 'unknown_type' end,
        case when known and (confidence < 0 or confidence > 1) then 'confidence_out_of_range' end, case when known and fidelity = 'guess' then 'bad_fidelity' end,
        case when type = 'table' and not has_table then 'table_without_data' end, case when type = 'heading' and not coalesce(heading_level >= 1, false) then 'heading_without_level' end,
        case when type in ('caption', 'annexe', 'planche') and not cat then 'category_missing' end, case when type = 'cross_ref' then 'reference_without_payload' end,
        case when type = 'figure' and not has_image then 'figure_without_image' end]) as fault from k) where fault is not null"""),
    "E6_validate_edits": with_views("blocks", f"""select edit_id, 'unknown_tool' as fault from {EDITS} e where tool = 'odd'
      union all select edit_id, 'text_missing' from {EDITS} e where tool in ('rewrite', 'insert', 'replace_range') and text = ''
      union all select edit_id, 'type_not_allowed' from {EDITS} e where tool = 'insert' and type = 'toc_entry'
      union all select edit_id, 'end_missing' from {EDITS} e where tool = 'replace_range' and end_pos is null"""),
    "E7_clarification_questions": with_views(TYPED_VIEWS, """select doc_id, block_id, case when type in ('caption', 'figure', 'table', 'heading') then type else 'paragraph' end as context,
      substr(trim(text, chr(32) || chr(9) || chr(10) || chr(13) || chr(11)), 1, 60) as excerpt, confidence from typed where confidence < 0.85 and pos % 2 = 1"""),
    "E8_apply_answers": with_views(TYPED_VIEWS, """with a as (select *, case when pos % 3 = 0 then case pos % 6 when 0 then 'heading_2' when 3 then 'figure' end end as kind from typed)
      select doc_id, pos, block_id, case when kind like 'heading%' then 'heading' when kind is not null then kind else type end as type,
      (case when kind like 'heading%' then 2 when kind is not null then null else heading_level end)::int as heading_level, case when kind is not null then 1.0 else confidence end as confidence from a"""),
}
