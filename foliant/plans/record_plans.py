"""Registered queries over accounts that are erased, fields of documents and measures of detection, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import erasure as X
from foliant.operators import fields as L
from foliant.operators import monitoring as M
from foliant.plans import operations_plans as OP
from foliant.plans import structure_plans as SP
from foliant.session import read_table
from foliant.sources import fixtures as fx
from foliant.sources.fixtures import VIEWS, with_views

LINKS = [
    X.Link("users", "id", "sessions", "user_id"), X.Link("sessions", "id", "messages", "session_id"), X.Link("users", "id", "transactions", "user_id"),
    X.Link("users", "id", "invoices", "user_id"), X.Link("users", "id", "subscriptions", "user_id"), X.Link("users", "id", "payments", "user_id"),
    X.Link("users", "id", "documents", "user_id"), X.Link("documents", "id", "structures", "document_id"), X.Link("documents", "id", "generated", "document_id"),
]


def account_tables(s, d):
    """The tables of accounts: ids, what they hang on, and the columns that name files."""
    c = read_table(s, d, "conversations")
    files = F.format_string('{"generated_files": ["chat/generated/%d-%d.docx", ""]}', "conv_id", F.col("turn") % 2)
    attached = F.format_string('{"attachments": [{"path": "chat/attachments/%d/%d.png"}, {"name": "x"}]}', "conv_id", "turn")
    metadata = F.when(F.col("role") == "assistant", files).when((F.col("conv_id") + F.col("turn")) % 3 == 0, attached).when(F.col("turn") % 2 == 0, F.lit("{}"))
    docs = fx.documents_ops(s, d).select(
        "id", F.get_json_object("metadata", "$.user_id").cast("long").alias("user_id"), F.when(F.col("id") % 19 != 0, F.concat(F.lit("uploads\\document-"), "id", F.lit(".docx"))).alias("path")
    )
    two = docs.where("id % 2 = 0").selectExpr("id as document_id", "explode(array(0, 1)) as k").selectExpr("document_id * 10 + k as id", "document_id", "k")
    output = F.when((F.col("k") == 1) & (F.col("document_id") % 5 == 0), F.lit("")).otherwise(F.concat(F.lit("test_scripts/out-"), F.col("document_id") % 40, F.lit(".pdf")))
    return {
        "users": fx.users(s, d).select("id"),
        "sessions": c.select(F.col("conv_id").alias("id"), (F.col("conv_id") % 151).alias("user_id")).distinct(),
        "messages": c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("session_id"), metadata.alias("metadata")),
        "transactions": fx.usage_ledger(s, d).select("id", "user_id"), "invoices": fx.invoices(s, d).select("id", "user_id"),
        "subscriptions": fx.subscriptions(s, d).select("id", "user_id"), "payments": fx.payments(s, d).select(F.col("external_id").alias("id"), "user_id"),
        "documents": docs, "structures": docs.where("id % 3 <> 0").selectExpr("id + 7 as id", "id as document_id"),
        "generated": two.select("id", "document_id", output.alias("output_path")),
    }


def erased(s, d):
    return X.erase_cascade(account_tables(s, d), "users", "id", fx.users(s, d).where("id % 10 = 0").select("id"), LINKS)


def erase_cascade(s, d):
    """Every row of all tables, and whether it goes."""
    found = erased(s, d)
    parts = [df.select(F.lit(name).alias("name"), "id", F.lit(goes).alias("erased")) for goes, tables in ((False, found.kept), (True, found.gone)) for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


ACCOUNTS = """users_ as (select id, id % 10 = 0 as gone from users), sessions_ as (select distinct conv_id as id, conv_id % 151 as user_id from conversations),
  gone as (select id from users_ where gone), lost as (select id from sessions_ where user_id in (select id from gone)),
  messages_ as (select conv_id * 1000 + turn as id, conv_id as session_id, case when role = 'assistant' then '{"generated_files": ["chat/generated/' || conv_id || '-' || turn % 2 || '.docx", ""]}'
    when (conv_id + turn) % 3 = 0 then '{"attachments": [{"path": "chat/attachments/' || conv_id || '/' || turn || '.png"}, {"name": "x"}]}' when turn % 2 = 0 then '{}' end as metadata from conversations),
  docs_ as (select doc_id as id, doc_id % 150 as user_id, case when doc_id % 19 <> 0 then 'uploads/document-' || doc_id || '.docx' end as path from documents),
  out_ as (select id from docs_ where user_id in (select id from gone)),
  generated_ as (select id * 10 + k as id, id as document_id, case when k = 1 and id % 5 = 0 then '' else 'test_scripts/out-' || id % 40 || '.pdf' end as output_path from docs_, (values (0), (1)) v(k) where id % 2 = 0)"""


def with_accounts(views: str, body: str) -> str:
    head = with_views(views, "")
    return f"{head.rstrip()},\n{ACCOUNTS}\n{body}"


#: Kinds of tokens and instructions that documents' words stand for (fixed values), by place and length.
TOKENS = ("begin", "instr", "text", "separate", "text", "end", "simple", "begin", "end")
CODES = ("SEQ Figure \\* ARABIC", " REF  _Toc12 \\h ", "PAGE", 'STYLEREF "Titre 1"', "odd \\x", "", 'TOC \\o "1-3"', "seq Tableau")


def tokens(s, d):
    """A token for each word; words at some places lose their mark, so that fields break."""
    lines = read_table(s, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    words = lines.select("doc_id", "pos", F.posexplode(F.split("line", " ")).alias("ord", "word"))
    at = F.col("doc_id") + F.col("pos") + F.col("ord")
    broken = (F.col("doc_id") + 3 * F.col("pos") + F.col("ord") * F.col("ord")) % 7 == 0
    rows = words.withColumn("kind", F.when(broken, "text").otherwise(fx.pick(TOKENS, at % 9)))
    code = fx.pick(CODES, F.length("word") % 8)
    return rows.select("doc_id", "pos", "ord", "kind", F.when(F.col("kind").isin("instr", "simple"), code).when(F.col("kind") == "text", F.col("word")).otherwise("").alias("text"))


def tokens_sql() -> str:
    kind = fx.pick_sql(TOKENS, "(doc_id + pos + ord) % 9")
    return f"""select doc_id, pos, ord, kind, case when kind in ('instr', 'simple') then {fx.pick_sql(CODES, 'length(word) % 8')} when kind = 'text' then word else '' end as text
      from (select *, case when (doc_id + 3 * pos + ord * ord) % 7 = 0 then 'text' else {kind} end as kind from
      (select doc_id, pos, unnest(words) as word, generate_subscripts(words, 1) - 1 as ord from (select doc_id, pos, string_split(line, ' ') as words from
      (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) - 1 as pos from (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents)))))"""


CODE = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
KIND = "(case upper(split_part({}, ' ', 1)) " + " ".join(f"when '{k}' then '{v}'" for k, v in L.FIELD_KINDS.items()) + " else 'unknown' end)"
VIEWS["tokens"] = tokens_sql()
ORDER = "partition by doc_id order by pos, ord"
VIEWS["marked"] = f"""with s as (select *, sum(case kind when 'begin' then 1 when 'end' then -1 else 0 end) over ({ORDER}) as s from tokens),
  m as (select *, least(0, min(s) over ({ORDER})) as l from s), b as (select *, coalesce(lag(l) over ({ORDER}), 0) as before from m),
  d as (select doc_id, pos, ord, kind, text, kind = 'end' and l < before as stray, s - l + case when kind = 'end' and l >= before then 1 else 0 end as depth from b)
  select *, count(*) filter (where kind = 'begin') over (partition by doc_id, depth order by pos, ord) as field from d"""


def scored(s, d):
    """Headings with confidences that differ a little from each other."""
    return SP.detailed(s, d).where("type = 'heading'").selectExpr("doc_id", "pos", "confidence - (doc_id + pos) % 37 / 5000 as confidence")


QUERIES = {
    "W9_erase_cascade": erase_cascade,
    "W9_erased_paths": lambda s, d: X.erased_paths(erased(s, d).gone),
    "G26_field_counts": lambda s, d: L.field_counts(tokens(s, d)),
    "G26_field_marks": lambda s, d: L.field_marks(tokens(s, d)),
    "G26_field_spans": lambda s, d: L.field_spans(tokens(s, d)),
    "G28_detection_curve": lambda s, d: M.detection_curve(scored(s, d), OP.truth(s, d)),
}

TABLES = "users usage_ledger invoices subscriptions payments"
IN_GONE = "user_id in (select id from gone)"
PERCENT = "case when {w} > 0 then floor(({p} * 2000 + {w})::double / ({w} * 2)::double) / 10 else 0.0 end"
ORACLE_SQL = {
    "W9_erase_cascade": with_accounts(TABLES, f"""select 'users' as name, id, gone as erased from users_ union all select 'sessions', id, {IN_GONE} from sessions_
      union all select 'messages', id, session_id in (select id from lost) from messages_ union all select 'transactions', id, {IN_GONE} from usage_ledger
      union all select 'invoices', id, {IN_GONE} from invoices union all select 'subscriptions', id, {IN_GONE} from subscriptions
      union all select 'payments', external_id, {IN_GONE} from payments union all select 'documents', id, {IN_GONE} from docs_
      union all select 'structures', id + 7, id in (select id from out_) from docs_ where id % 3 <> 0
      union all select 'generated', id, document_id in (select id from out_) from generated_"""),
    "W9_erased_paths": with_accounts("users", """select distinct path from (
      select unnest(json_extract_string(metadata, '$.generated_files[*]')) as path from messages_ where session_id in (select id from lost)
      union all select unnest(json_extract_string(metadata, '$.attachments[*].path')) from messages_ where session_id in (select id from lost)
      union all select 'chat/attachments/' || id from lost union all select path from docs_ where id in (select id from out_)
      union all select output_path from generated_ where document_id in (select id from out_)) where path <> ''"""),
    "G26_field_counts": with_views("tokens", f"""select doc_id, {KIND.format('code')} as kind, count(*) as fields, count(*) filter (where upper(split_part(code, ' ', 1)) in {L.LAID_OUT}) as laid_out
      from (select doc_id, {CODE.format('text')} as code from tokens where kind in ('instr', 'simple')) where code <> '' group by 1, 2"""),
    "G26_field_marks": with_views("tokens marked", """select doc_id, count(*) filter (where kind = 'begin') as begun, count(*) filter (where kind = 'end' and not stray) as closed,
      count(*) filter (where kind = 'begin' and depth > 1) as nested, count(*) filter (where stray) as stray_ends, max(depth)::bigint as deepest,
      count(*) filter (where kind = 'begin') - count(*) filter (where kind = 'end' and not stray) as open from marked group by 1"""),
    "G26_field_spans": with_views("tokens marked", f"""with p as (select *, coalesce(max((kind = 'separate')::int) over (partition by doc_id, depth, field order by pos, ord), 0) = 1 as shown
      from marked where depth > 0 and not stray), g as (select doc_id, depth, field, min(pos) filter (where kind = 'begin') as start, max(pos) filter (where kind = 'end') as "end",
      {CODE.format("coalesce(string_agg(text, '' order by pos, ord) filter (where kind = 'instr' and not shown), '')")} as code,
      coalesce(sum(length(text)) filter (where kind = 'text' and shown), 0)::bigint as shown, count(*) filter (where kind = 'end') > 0 as closed from p group by 1, 2, 3)
      select *, {KIND.format('code')} as kind from g"""),
    "G28_detection_curve": with_views(OP.TYPED_VIEWS, f"""with t as (select distinct doc_id, unnest([0, 4, 9]) as pos from labels where quality = 1),
      p as (select y.doc_id, y.pos, confidence - (y.doc_id + y.pos) % 37 / 5000.0::double as confidence, t.doc_id is not null as ok from typed y left join t on t.doc_id = y.doc_id and t.pos = y.pos where type = 'heading'),
      b as (select confidence, count(*) as n, count(*) filter (where ok) as r from p group by 1), w as (select (select count(*) from t) as whole),
      c as (select confidence, (sum(n) over (order by confidence desc))::bigint as found, (sum(r) over (order by confidence desc))::bigint as right_ from b)
      select confidence, found, right_ as right, {PERCENT.format(p='right_', w='found')} as precision, {PERCENT.format(p='right_', w='whole')} as recall from c, w"""),
}
