"""Registered queries over sources, hooks and streams, with their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from foliant.operators import ledger, monitoring, scoring
from foliant.plans import billing_plans as BP
from foliant.plans import structure_plans as SP
from foliant.session import read_table
from foliant.sources import documents as S
from foliant.sources import fixtures as fx
from foliant.sources.fixtures import with_views
from foliant.streaming import credits as C
from foliant.streaming import ordered as O
from foliant.streaming import streams as R
from foliant.streaming import windows as W

CUSTOMER = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


def stream_of(s, d, name):
    return R.read_stream(s, f"{d}/{name}.parquet")


def payment_stream(s, d):
    status = F.create_map(*[F.lit(x) for kv in fx.PAYMENT_STATUS.items() for x in kv])
    o = stream_of(s, d, "orders")
    return o.select(
        F.col("o_orderdate").cast("timestamp").alias("created_at"), (F.col("o_orderkey") - F.col("o_orderkey") % 2).alias("payment_id"),
        F.element_at(status, F.col("o_orderpriority")).alias("status"),
    )


def webhooks(s, d):
    """At most one row a payment; the payments that got one don't depend on which event came first."""
    rows = R.run_to_table(R.webhook_stream(payment_stream(s, d), "4000 days"))
    return rows.groupBy("payment_id").agg(F.count("*").alias("events"))


def stale(s, d):
    e = stream_of(s, d, "events")
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    epochs = e.select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 2 == 0, seconds * 1000 + 999).otherwise(seconds).alias("epoch"))
    return R.run_to_table(R.stale_split(epochs, 1705000000, 36000)[1]).select("id", "seconds")


def rates(s, d):
    """Calls of a user in an hour, over two of them."""
    e = stream_of(s, d, "events").select(F.col("ts").cast("timestamp").alias("created_at"), F.lit("any").alias("kind"), F.col("user_id").alias("who"))
    rule = s.createDataFrame([("any", 2, 3600)], "kind string, allowed bigint, seconds bigint")
    found = W.rate_limit_violations(W.grow_windows(e, W.rate_counts(rule), W.RATE_KEYS).counts)
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("who").alias("user_id"), "calls")


def requests_of(e):
    """Requests of all kinds; a day's are moved together into its first minute, so that limits are passed."""
    second = F.unix_seconds(F.col("ts").cast("timestamp"))
    user = lambda n: F.concat(F.lit("user-"), F.col("user_id") % n)
    address = F.concat(F.lit("10.0.0."), F.col("user_id") % 3)
    mail = F.concat(user(5), F.lit("@example.org|"), address)
    kind = fx.pick([k for k, _, _ in W.LIMITS], F.col("event_id") % 6)
    who = F.when(kind.isin("login", "register", "reset"), mail).when(kind == "feedback", address).otherwise(user(2))
    at = (second - second % 86400 + F.expr("cast(unix_seconds(cast(ts as timestamp)) % 86400 div 1440 as bigint)")).cast("timestamp")
    return e.select("event_id", at.alias("created_at"), kind.alias("kind"), who.alias("who"))


def rate_limits(s, d):
    """Windows over the limit of their kind, and under the kind ``refused`` the number of late rows."""
    run = W.grow_windows(requests_of(stream_of(s, d, "events")), W.rate_counts(W.limits(s)), W.RATE_KEYS, delay_seconds=100 * 86400)
    found = W.rate_limit_violations(run.counts).select("kind", "who", F.col("start").cast("timestamp_ntz").alias("start"), "calls", "allowed")
    refused = run.refused.agg(F.count("*").alias("calls")).select(
        F.lit("refused").alias("kind"), F.lit(None).cast("string").alias("who"), F.lit(None).cast("timestamp_ntz").alias("start"), "calls", F.lit(0).cast("bigint").alias("allowed")
    )
    return found.unionByName(refused)


def live_daily(s, d):
    e = stream_of(s, d, "events")
    rows = e.select(F.col("ts").cast("timestamp").alias("created_at"), F.floor("value").cast("long").alias("cost_credits"), (F.col("event_type") != "error").alias("succeeded"))
    return W.grow_windows(rows, W.usage_of_days, ["day"]).counts


def credit_hooks(o):
    """Payment events of orders, of which eight may share a payment."""
    rows = BP.hooks_of(fx.payments_of(o), "amount", F.col("created_at").cast("timestamp").alias("created_at"))
    return rows.withColumn("payment_id", F.col("external_id") - F.col("external_id") % 8)


def credits(s, d):
    """By payment: rows of the ledger, repeated credits, other outcomes."""
    users, links = fx.users(s, d).where("id % 5 <> 0"), BP.links(s, d).where("id % 6 <> 0")
    return credit_report(C.credit_stream(credit_hooks(stream_of(s, d, "orders")), users, links, BP.transactions(s, d)))


def credit_report(run):
    written = run.ledger.groupBy(F.col("reference").cast("bigint").alias("payment_id")).agg(F.count("*").alias("credited"))
    again = F.col("outcome") == "already_processed"
    events = run.outcomes.groupBy("payment_id").agg(F.count(F.when(again, 1)).alias("repeated"), F.count(F.when(~again & (F.col("outcome") != "credited"), 1)).alias("other"))
    return events.join(written, "payment_id", "left").select("payment_id", F.coalesce("credited", F.lit(0)).alias("credited"), "repeated", "other")


def quota_events(s, d, e=None):
    e = stream_of(s, d, "events") if e is None else e
    uses = e.select(
        F.col("event_id").alias("id"), "user_id", F.col("ts").cast("timestamp").alias("created_at"), F.when(F.col("event_id") % 2 == 0, "deterministic").otherwise("ai").alias("kind"),
        F.when(F.col("event_id") % 10 == 3, "refund").otherwise("use").alias("event"), F.date_format("ts", "yyyy-MM").alias("month"),
    )
    return uses.join(ledger.quotas(BP.user_plans(s, d)), ["user_id", "kind"])


def quotas_in_order(s, d):
    clock = O.Clock(s)
    return R.run_to_table(O.quota_stream(quota_events(s, d), "4000 days", clock), clock=clock).drop("batch")


def balances_in_order(s, d):
    clock = O.Clock(s)
    return R.run_to_table(O.balance_stream(balance_requests(s, d), "4000 days", clock), clock=clock).drop("batch")


def balances_handed_over(s, d):
    """Requests before a day by the batch replay, the others by a stream that starts from the balances it left."""
    day = F.col("created_at") < F.lit("2024-01-16").cast("timestamp")
    first = ledger.replay_requests(balance_requests(s, d, read_table(s, d, "events")).where(day))
    clock = O.Clock(s)
    rest = O.balance_stream(balance_requests(s, d).where(~day), "4000 days", clock, ledger.balances_after(first))
    return first.unionByName(R.run_to_table(rest, clock=clock).drop("batch").select(first.columns))


def balance_requests(s, d, e=None):
    e = (stream_of(s, d, "events") if e is None else e).where("event_type <> 'error'")
    credit = F.col("event_type").isin("purchase", "signup")
    return e.select(
        F.col("event_id").alias("id"), "user_id", F.when(credit, "credit").otherwise("debit").alias("kind"), F.floor("value").cast("long").alias("amount"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


def shouted(text):
    """A classifier for the hooks: short lines are headings of level 2."""
    v = F.struct(F.lit("heading").alias("type"), F.lit(2).alias("level"), F.lit(0.9).alias("confidence"))
    return F.when(F.length(text) < 60, v)


def judged(text):
    """A classifier that says all there is to say: short lines are headings, the shorter the surer."""
    short = F.length(text) < 60
    signals = F.array_compact(F.array(F.when(short, "short"), F.when(text.rlike(r"\d"), "digit")))
    v = F.struct(
        short.alias("is_heading"), F.when(text.startswith("Figure"), "caption").alias("type"), F.lit(2).alias("level"), (1.25 - F.length(text) / 64).alias("confidence"), signals.alias("signals")
    )
    return F.when(F.length(text) > 0, v)


def by_length(rows: pd.DataFrame) -> pd.DataFrame:
    short = rows["text"].str.len() < 60
    return pd.DataFrame({"type": short.map({True: "heading", False: "paragraph"}), "level": short.map({True: 2, False: 0}), "confidence": 0.9})


def raw_texts(s, d):
    odd = F.concat(F.lit("\x01"), F.replace("text", F.lit("\n"), F.lit("\r\n")), F.lit("\x0b"))
    return read_table(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 9 == 0, " \r\n\x02").otherwise(odd).alias("text"))


def placed(s, d):
    return SP.typed(s, d).withColumn("position_y", F.when(F.col("doc_id") % 3 != 0, F.when(F.col("pos") % 4 != 0, (F.col("pos") * 7 % 11).cast("double"))))


def json_blocks(s, d):
    return SP.typed(s, d).select("doc_id", *S.FIELDS)


QUERIES = {
    "S1_read_table": lambda s, d: S.read_source(s, CUSTOMER, f"{d}/customer.parquet"),
    "S2_clean_text": lambda s, d: raw_texts(s, d).select("doc_id", S.clean_text(F.col("text")).alias("text")).where("text is not null"),
    "S3_ingest_docx": lambda s, d: S.ingest_docx(S.make_packages(read_table(s, d, "documents"))).select("path", "pos", "type", "text", "style_level", F.to_json("cells").alias("cells"), "error"),
    "S3_ingest_styled": lambda s, d: S.ingest_styled(S.make_styled_packages(read_table(s, d, "documents"))).select("path", "pos", "type", "text", "style_level", "is_bold", "error"),
    "S5_blocks_round_trip": lambda s, d: S.blocks_from_json(S.blocks_to_json(json_blocks(s, d))),
    "S6_legacy_round_trip": lambda s, d: S.legacy_to_blocks(S.blocks_to_legacy(json_blocks(s, d))),
    "S7_restore_reading_order": lambda s, d: S.restore_reading_order(placed(s, d)),
    "S8_report_sink": lambda s, d: s.read.schema("status string, n bigint, total bigint").json(S.write_report(monitoring.status_histogram(fx.documents_ops(s, d)))),
    "U1_verdicts_by_column": lambda s, d: scoring.verdicts_by_column(SP.assessed(s, d), shouted),
    "U1_full_verdicts": lambda s, d: scoring.full_verdicts(SP.assessed(s, d), judged),
    "U2_rule_table": lambda s, d: SP.D.rule_detect(SP.detailed(s, d), SP.D.RULES[:4]),
    "U3_score_in_batches": lambda s, d: scoring.score_in_batches(SP.assessed(s, d), by_length),
    "R1_webhook_stream": webhooks,
    "R1_credit_stream": credits,
    "R2_stale_events": stale,
    "R3_rate_limit_violations": rates,
    "R3_rate_limits": rate_limits,
    "R4_live_usage_daily": live_daily,
    "R5_quota_stream": quotas_in_order,
    "R6_balance_stream": balances_in_order,
    "R6_balance_handover": balances_handed_over,
}

ASSESSED = "blocks numbered typed listed capped passes assessed"
ORACLE_SQL = {
    "S1_read_table": "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer",
    "S2_clean_text": "select doc_id, text from documents where doc_id % 9 <> 0",
    "S3_ingest_styled": """with l as (select doc_id, unnest(parts) as line, generate_subscripts(parts, 1) - 1 as i from (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents)),
      b as (select doc_id, i, 0 as k, 'paragraph' as type, case when i % 6 = 5 then 'box' else line end as text from l union all
        select doc_id, i, 1, 'shape', line from l where i % 6 = 5 and trim(line, ' ' || chr(9) || chr(13)) <> '')
      select 'doc-' || doc_id || '.docx' as path, row_number() over (partition by doc_id order by i, k) - 1 as pos, type, text, case i % 7 when 0 then 2 when 3 then 1 when 5 then 3 end as style_level,
        i % 5 <> 4 and i % 7 in (0, 4) as is_bold, null::varchar as error from b""",
    "S5_blocks_round_trip": with_views("blocks numbered typed", "select doc_id, pos, block_id, type, text, heading_level, confidence, category, original_number from typed"),
    "S6_legacy_round_trip": with_views("blocks numbered typed", """with p as (select *, case type when 'heading' then 0 when 'table' then 4 when 'caption' then 7 end as part from typed
      where type in ('heading', 'table', 'caption'))
      select doc_id, row_number() over (partition by doc_id order by part, pos) - 1 as ord, type, pos, text, case when type = 'heading' then coalesce(heading_level, 1) end as heading_level from p"""),
    "S7_restore_reading_order": with_views("blocks numbered typed", """with y as (select *, case when doc_id % 3 <> 0 and pos % 4 <> 0 then (pos * 7 % 11)::double end as y from typed),
      k as (select *, max((y is not null)::int) over (partition by doc_id) as known, sum((type = 'caption')::int) over (partition by doc_id) as captions,
        max((type = 'caption' and y is not null)::int) over (partition by doc_id) as placed from y)
      select doc_id, block_id, row_number() over (partition by doc_id order by case when known = 1 then coalesce(y, 0) else 0 end, pos) - 1 as ord,
      captions > 1 and placed = 0 as legend_order_gap from k"""),
    "S8_report_sink": with_views("documents_ops", "select status, count(*) as n, (sum(count(*)) over ())::bigint as total from documents_ops group by 1"),
    "U1_verdicts_by_column": with_views(ASSESSED, "select doc_id, pos, 'heading' as verdict_type, 2 as verdict_level, 0.9::double as verdict_confidence from assessed where needs_review and length(text) < 60"),
    "U1_full_verdicts": with_views(ASSESSED, """select doc_id, pos, length(text) < 60 as is_heading, case when length(text) < 60 then 'heading' when starts_with(text, 'Figure') then 'caption' else 'paragraph' end as verdict_type,
      case when length(text) < 60 then 2 end as verdict_level, greatest(0.0::double, least(1.0::double, 1.25::double - length(text) / 64.0::double)) as verdict_confidence,
      concat_ws(',', case when length(text) < 60 then 'short' end, case when regexp_matches(text, '\\d') then 'digit' end) as signals from assessed where needs_review and length(text) > 0"""),
    "U3_score_in_batches": with_views(ASSESSED, """select doc_id, pos, case when length(text) < 60 then 'heading' else 'paragraph' end as verdict_type,
      case when length(text) < 60 then 2 else 0 end as verdict_level, 0.9::double as verdict_confidence from assessed where needs_review"""),
    "U2_rule_table": with_views("blocks numbered typed", f"""select doc_id, pos, rule, case when rule in ('heading1_style', 'title_caps') then 'titles' else 'subtitles' end as category
      from (select doc_id, pos, case when type = 'heading' and style_level = 1 then 'heading1_style' when type = 'heading' and style_level = 2 then 'heading2_style'
        when type = 'heading' and style_level = 3 then 'heading3_style' when type = 'paragraph' and pos <> 0 and regexp_matches(text, {SP.P.quoted(SP.D.TITLE_CAPS)}) then 'title_caps' end as rule from typed) where rule is not null"""),
    "R1_webhook_stream": with_views("payments", "select payment_id, 1::bigint as events from payments where status in ('COMPLETED', 'FAILED', 'CANCELLED') group by 1"),
    "R2_stale_events": """with e as (select event_id as id, floor(epoch(ts))::bigint as seconds from events) select id, seconds from e where abs(1705000000 - seconds) > 36000""",
    "R3_rate_limit_violations": """select date_trunc('hour', ts) as start, user_id, count(*) as calls from events group by 1, 2 having count(*) > 2""",
    "R4_live_usage_daily": """select ts::date as day, sum(floor(value)::bigint)::bigint as credits, count(*) as calls, count(*) filter (where event_type = 'error') as failures from events group by 1""",
    "R1_credit_stream": with_views("payments users", f"""with r as (select h.*, h.external_id - h.external_id % 8 as payment, l.id is not null as has_link, coalesce(h.user_id, l.user_id) as payer
      from {BP.HOOKS} h left join {BP.LINKS} l on l.id = h.link_id and l.id % 6 <> 0), p as (select r.*, u.id is not null as has_user, t.known from r
      left join users u on u.id = payer and u.id % 5 <> 0 left join {BP.TX} t on t.known = r.payment::varchar),
      o as (select payment, lower(status) = 'completed' and (has_user or purpose = 'link' and link_id is not null) and purpose = 'credits' as pays, known is not null as before from p),
      g as (select payment as payment_id, count(*) filter (where pays and not before) as fresh, count(*) filter (where pays and before) as old, count(*) filter (where not pays) as other from o group by 1)
      select payment_id, least(fresh, 1) as credited, old + greatest(fresh - 1, 0) as repeated, other from g"""),
    "R3_rate_limits": """with l(i, kind, allowed, seconds) as (values (0, 'chat', 20, 60), (1, 'login', 5, 60), (2, 'register', 3, 60), (3, 'purchase', 5, 60), (4, 'reset', 3, 60), (5, 'feedback', 3, 3600)),
      q as (select event_id % 6 as i, user_id, floor(epoch(ts))::bigint as s from events),
      r as (select l.*, s - s % 86400 + (s % 86400) // 1440 as sec, case when kind in ('login', 'register', 'reset') then 'user-' || user_id % 5 || '@example.org|10.0.0.' || user_id % 3
        when kind = 'feedback' then '10.0.0.' || user_id % 3 else 'user-' || user_id % 2 end as who from q join l using (i))
      select kind, who, make_timestamp((sec - sec % seconds) * 1000000) as start, count(*) as calls, allowed::bigint as allowed from r group by 1, 2, 3, 5 having count(*) > allowed
      union all select 'refused', null, null, 0, 0""",
}

# Replays in batch and as streams have one result.
ORACLE_SQL |= {name: BP.ORACLE_SQL["L2_replay_requests"] for name in ("R6_balance_stream", "R6_balance_handover")}
ORACLE_SQL["R5_quota_stream"] = BP.QUOTAS_SQL
