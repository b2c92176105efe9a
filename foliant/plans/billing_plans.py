"""Registered queries over subscriptions, payments, ledgers and quotas, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import billing, ledger
from foliant.session import read_table
from foliant.sources import fixtures as fx
from foliant.sources.fixtures import with_views

NOW = fx.NOW_ORDERS
#: Three days before subscriptions end.
BUSY = "1995-03-11 12:00:00"


def uses(s, d):
    e = read_table(s, d, "events")
    return e.select(
        F.col("event_id").alias("id"), "user_id", F.col("ts").alias("created_at"),
        F.when(F.col("event_id") % 2 == 0, "deterministic").otherwise("ai").alias("kind"),
        F.when(F.col("event_id") % 10 == 3, "refund").otherwise("use").alias("event"),
    )


USES_SQL = """(select event_id as id, user_id, ts as created_at, case when event_id % 2 = 0 then 'deterministic' else 'ai' end as kind from events)"""


def user_plans(s, d):
    return ledger.active_plan_per_user(fx.users(s, d), fx.subscriptions(s, d), fx.plans(s), "2001-07-15 00:00:00")


PLANS_OF_USERS = """(with live as (select * from subscriptions where status = 'active' and starts_at <= timestamp '2001-07-15'
  and (ends_at is null or ends_at >= timestamp '2001-07-15')), latest as (select user_id, max_by(plan_id, (starts_at, id)) as plan_id from live group by 1)
  select u.id as user_id, coalesce(p.slug, 'default') as plan, case when l.user_id is null then 5 else quota_deterministic end as quota_deterministic,
  case when l.user_id is null then 0 else quota_ai end as quota_ai from users u left join latest l on l.user_id = u.id left join plans p using (plan_id))"""
QUOTAS = f"""(select user_id, 'deterministic' as kind, quota_deterministic as quota from {PLANS_OF_USERS} a
  union all select user_id, 'ai', quota_ai from {PLANS_OF_USERS} b)"""


def links(s, d):
    k = F.col("c_custkey")
    return read_table(s, d, "customer").select(
        k.alias("id"), F.when(k % 4 != 0, k + F.when(k % 9 == 0, 1_000_000).otherwise(0)).alias("user_id"),
        fx.pick(("pending", "paid", "cancelled", "pending", "pending"), k % 5).alias("status"),
        F.floor(F.greatest(F.col("c_acctbal"), F.lit(0.0))).cast("long").alias("amount"),
        F.expr(f"if(c_custkey % 7 = 0, null, timestamp_ntz'{NOW}' + make_dt_interval(cast(c_custkey % 21 - 10 as int)))").alias("expires_at"),
    )


LINKS = f"""(select c_custkey as id, case when c_custkey % 4 <> 0 then c_custkey + case when c_custkey % 9 = 0 then 1000000 else 0 end end as user_id,
  case c_custkey % 5 when 1 then 'paid' when 2 then 'cancelled' else 'pending' end as status, floor(greatest(c_acctbal, 0))::bigint as amount,
  case when c_custkey % 7 <> 0 then timestamp '{NOW}' + to_days((c_custkey % 21 - 10)::int) end as expires_at from customer)"""


def transactions(s, d):
    p = fx.payments(s, d).where("external_id % 3 = 0")
    return p.select(F.lit("purchase").alias("type"), F.col("payment_id").cast("string").alias("reference"))


TX = "(select distinct payment_id::varchar as known from payments where external_id % 3 = 0)"


def hooks(s, d):
    return hooks_of(fx.payments(s, d))


def hooks_of(rows, *more):
    return rows.select(
        *more,
        "external_id", "payment_id", "status", "purpose", F.get_json_object("metadata", "$.user_id").cast("long").alias("user_id"),
        F.get_json_object("metadata", "$.payment_link_id").cast("long").alias("link_id"),
    )


HOOKS = """(select external_id, payment_id, status, purpose, json_extract_string(metadata, '$.user_id')::bigint as user_id,
  json_extract_string(metadata, '$.payment_link_id')::bigint as link_id from payments)"""


def provider(s, d):
    status = fx.pick(("completed", "Pending", "failed", "COMPLETED", ""), F.col("external_id") % 5)
    return fx.payments(s, d).where("external_id % 11 <> 0").select("external_id", status.alias("provider_status"))


PROVIDER = """(select external_id, upper(case external_id % 5 when 0 then 'completed' when 1 then 'Pending' when 2 then 'failed'
  when 3 then 'COMPLETED' else '' end) as now_status from payments where external_id % 11 <> 0)"""


def raw_statuses(s, d):
    k = F.col("event_id")
    return read_table(s, d, "events").select(
        k.alias("id"), fx.pick(("M", "G", "K"), k % 3).alias("provider"),
        fx.pick(("1", "7", "-1", "9", "COMPLETED", " failed ", "Processing", "odd"), k % 8).alias("raw"),
    )


def epochs(s, d):
    k = F.col("event_id")
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return read_table(s, d, "events").select(k.alias("id"), F.when(k % 2 == 0, seconds * 1000 + 999).otherwise(seconds).alias("epoch"))


def attachments(s, d):
    m = fx.chat_messages(s, d)
    return m.select(F.col("id"), (F.col("session_id") * 3).alias("session_id"))


QUERIES = {
    "P2_search_users": lambda s, d: billing.search_users(fx.users(s, d), q="00012", with_credits=True, sort="credits"),
    "P3_documents_by_bucket": lambda s, d: billing.documents_by_bucket(fx.documents_ops(s, d), "processing", "1"),
    "P4_point_in_time_active": lambda s, d: billing.point_in_time_active(fx.subscriptions(s, d), "2001-07-15 00:00:00"),
    "P5_signature_freshness": lambda s, d: billing.signature_freshness(epochs(s, d), 1705000000, 600 * 60),
    "P6_status_normalize": lambda s, d: billing.status_normalize(raw_statuses(s, d)),
    "J1_child_counts": lambda s, d: billing.child_counts(
        fx.documents_ops(s, d).select("id"), fx.usage_ledger(s, d).select("document_id"), "document_id"),
    "J2_with_owner": lambda s, d: billing.with_owner(fx.documents_ops(s, d), fx.users(s, d).where("id % 3 <> 0")),
    "J3_documents_with_structure": lambda s, d: fx.documents_ops(s, d).join(
        read_table(s, d, "labels").select(F.col("doc_id").alias("id")), "id", "left_semi").select("id", "filename"),
    "J4_not_yet_credited": lambda s, d: billing.not_yet_credited(fx.payments(s, d), transactions(s, d)),
    "J5_orphan_attachments": lambda s, d: attachments(s, d).join(
        fx.chat_messages(s, d).select("session_id").distinct(), "session_id", "left_anti").select("id", "session_id"),
    "J6_latest_payment_per_link": lambda s, d: billing.latest_payment_per_link(fx.payments(s, d)),
    "J7_active_plan_per_user": user_plans,
    "L1_running_balance": lambda s, d: ledger.running_balance(fx.credit_requests(s, d)),
    "L1_balance_audit": lambda s, d: ledger.balance_audit(
        fx.credit_requests(s, d), F.col("balance") + F.when(F.col("id") % 41 == 0, 1).otherwise(0)),
    "L2_replay_requests": lambda s, d: ledger.replay_requests(fx.credit_requests(s, d)),
    "L3_idempotent_credits": lambda s, d: ledger.idempotent_credits(fx.credit_requests(s, d)),
    "L5_monthly_usage_status": lambda s, d: ledger.monthly_usage_status(uses(s, d), user_plans(s, d), "2024-01"),
    "L6_quota_admission": lambda s, d: ledger.quota_admission(uses(s, d), user_plans(s, d)),
    "L7_quota_with_refunds": lambda s, d: ledger.quota_with_refunds(uses(s, d), user_plans(s, d)),
    "L8_due_for_renewal": lambda s, d: billing.due_for_renewal(fx.subscriptions(s, d), fx.users(s, d), fx.plans(s), "2001-07-15 00:00:00"),
    "L9_renewal_decision": lambda s, d: billing.renewal_decision(fx.subscriptions(s, d), fx.plans(s)),
    "L10_expired_past_grace": lambda s, d: billing.expired_past_grace(fx.subscriptions(s, d), NOW),
    "L11_reminders_of_a_busy_day": lambda s, d: billing.renewal_reminders(fx.subscriptions(s, d), fx.users(s, d), fx.plans(s), BUSY),
    "L11_renewal_reminders": lambda s, d: billing.renewal_reminders(fx.subscriptions(s, d), fx.users(s, d), fx.plans(s), "2001-07-15 12:00:00"),
    "L12_cancel_prorata": lambda s, d: billing.cancel_prorata(fx.subscriptions(s, d), fx.plans(s), "2001-07-15 12:00:00"),
    "L13_activation_dedupe": lambda s, d: billing.activation_dedupe(fx.subscriptions(s, d)),
    "L14_failed_payment_state": lambda s, d: billing.failed_payment_state(fx.subscriptions(s, d), NOW),
    "L15_webhook_outcome": lambda s, d: billing.webhook_outcome(hooks(s, d), fx.users(s, d).where("id % 5 <> 0"), links(s, d).where("id % 6 <> 0"), transactions(s, d)),
    "L16_payments_to_sync": lambda s, d: billing.payments_to_sync(fx.payments(s, d)),
    "L17_reconcile_payments": lambda s, d: billing.reconcile_payments(fx.payments(s, d), provider(s, d), fx.users(s, d).where("id % 5 <> 0"), transactions(s, d)),
    "L18_settle_link_decision": lambda s, d: billing.settle_link_decision(links(s, d), fx.users(s, d), NOW),
    "L20_invoice_numbers": lambda s, d: billing.invoice_numbers(fx.invoices(s, d)),
    "G24_payment_link_summary": lambda s, d: billing.payment_link_summary(links(s, d), NOW),
}

STATUS_ROWS = fx.values_sql(billing.PROVIDER_STATUS, "provider, raw_key, common")
#: Uses and refunds one after the other; streams that take them in order have the same result.
QUOTAS_SQL = with_views("users subscriptions plans", f"""with q as (select e.event_id as id, e.user_id, z.kind, case when event_id % 10 = 3 then 'refund' else 'use' end as event,
      strftime(ts, '%Y-%m') as month, quota, row_number() over (partition by e.user_id, z.kind order by ts, event_id) as n from events e
      join {QUOTAS} z on z.user_id = e.user_id and z.kind = case when event_id % 2 = 0 then 'deterministic' else 'ai' end),
    f as (select *, case when event = 'refund' then 'refunded' when quota <= 0 then 'quota_exhausted' else 'accepted' end as outcome,
      (case when event = 'refund' or quota <= 0 then 0 else 1 end)::bigint as used from q where n = 1
      union all select q.*, case when q.event = 'refund' then 'refunded' when case when q.month = f.month then f.used else 0 end >= q.quota then 'quota_exhausted' else 'accepted' end,
      case when q.event = 'refund' then greatest(0, case when q.month = f.month then f.used else 0 end - 1)
        when case when q.month = f.month then f.used else 0 end >= q.quota then case when q.month = f.month then f.used else 0 end
        else case when q.month = f.month then f.used else 0 end + 1 end from f join q on q.user_id = f.user_id and q.kind = f.kind and q.n = f.n + 1)
    select id, user_id, kind, event, month, outcome, used from f""")
QUOTAS_SQL = QUOTAS_SQL.replace("with ", "with recursive ", 1)
ORACLE_SQL = {
    "P2_search_users": with_views("users", "select * from users where (name ilike '%00012%' or id::varchar = '00012') and credits_balance > 0 order by credits_balance desc, id"),
    "P3_documents_by_bucket": with_views("documents_ops", """select id, filename, status from documents_ops
      where status in ('pending', 'processing', 'detected', 'validated', 'generated') and contains(filename, '1')"""),
    "P4_point_in_time_active": with_views("subscriptions", """select id, user_id, plan_id from subscriptions where status = 'active'
      and coalesce(starts_at <= timestamp '2001-07-15', true) and coalesce(ends_at >= timestamp '2001-07-15', true)"""),
    "P5_signature_freshness": """with e as (select event_id as id, case when event_id % 2 = 0 then epoch(date_trunc('second', ts))::bigint * 1000 + 999
      else epoch(date_trunc('second', ts))::bigint end as epoch from events), n as (select id, case when epoch > 9999999999 then epoch // 1000 else epoch end as seconds from e)
      select * from n where abs(1705000000 - seconds) <= 36000""",
    "P6_status_normalize": f"""with t as ({STATUS_ROWS}), e as (select event_id as id, case event_id % 3 when 0 then 'M' when 1 then 'G' else 'K' end as provider,
      {fx.pick_sql(("1", "7", "-1", "9", "COMPLETED", " failed ", "Processing", "odd"), 'event_id % 8')} as raw from events)
      select id, e.provider, raw, coalesce(common, 'unknown') as status from e left join t on t.provider = e.provider and t.raw_key = lower(trim(raw))""",
    "J1_child_counts": with_views("documents_ops usage_ledger", """select d.id, count(l.document_id) as children from documents_ops d
      left join usage_ledger l on l.document_id = d.id group by 1"""),
    "J2_with_owner": with_views("documents_ops users", """with o as (select id, json_extract_string(metadata, '$.user_id')::bigint as owner_id from documents_ops)
      select o.id, owner_id, u.name as owner from o left join users u on u.id = owner_id and u.id % 3 <> 0"""),
    "J3_documents_with_structure": with_views("documents_ops", "select id, filename from documents_ops where id in (select doc_id from labels)"),
    "J4_not_yet_credited": with_views("payments", f"select external_id, payment_id from payments where status = 'COMPLETED' and payment_id::varchar not in (select known from {TX} t)"),
    "J5_orphan_attachments": with_views("chat_messages", """select id, session_id * 3 as session_id from chat_messages
      where session_id * 3 not in (select session_id from chat_messages)"""),
    "J6_latest_payment_per_link": with_views("payments", f"""select link_id, max(external_id) as external_id, max_by(status, external_id) as status
      from {HOOKS} h where link_id is not null group by 1"""),
    "J7_active_plan_per_user": with_views("users subscriptions plans", f"select * from {PLANS_OF_USERS} t"),
    "L1_running_balance": with_views("credit_requests", """select id, user_id, signed, (sum(signed) over (partition by user_id order by created_at, id
      rows unbounded preceding))::bigint as balance from credit_requests"""),
    "L1_balance_audit": with_views("credit_requests", """select user_id, count(*) as rows, count(*) filter (where id % 41 = 0) as wrong,
      min(id) filter (where id % 41 = 0) as first_wrong from credit_requests group by 1"""),
    "L2_replay_requests": """with recursive q as (select event_id as id, user_id, case when event_type in ('purchase', 'signup') then 'credit' else 'debit' end as kind, floor(value)::bigint as amount,
        row_number() over (partition by user_id order by ts, event_id) as n from events where event_type <> 'error'),
      f as (select q.*, case when amount <= 0 then 'invalid_amount' when kind = 'debit' then 'insufficient_balance' else 'applied' end as outcome,
        case when amount > 0 and kind = 'credit' then amount else 0 end as balance_after from q where n = 1
        union all select q.*, case when q.amount <= 0 then 'invalid_amount' when q.kind = 'debit' and q.amount > f.balance_after then 'insufficient_balance' else 'applied' end,
        case when q.amount <= 0 or q.kind = 'debit' and q.amount > f.balance_after then f.balance_after when q.kind = 'credit' then f.balance_after + q.amount else f.balance_after - q.amount end
        from f join q on q.user_id = f.user_id and q.n = f.n + 1)
      select id, user_id, kind, amount, outcome, balance_after from f""",
    "L7_quota_with_refunds": QUOTAS_SQL,
    "L3_idempotent_credits": with_views("credit_requests", """with c as (select *, reference <> '' and amount > 0 as valid from credit_requests where kind = 'credit')
      select id, user_id, reference, amount, case when not valid then 'refused' when row_number() over (partition by user_id, reference, valid order by created_at, id) = 1
      then 'credited' else 'already_processed' end as outcome from c"""),
    "L5_monthly_usage_status": with_views("users subscriptions plans", f"""with u as (select user_id, kind, count(*) as used from {USES_SQL} x
      where strftime(created_at, '%Y-%m') = '2024-01' group by 1, 2)
      select q.user_id, q.kind, coalesce(used, 0) as used, quota, case when quota is not null then greatest(0, quota - coalesce(used, 0)) end as remaining,
      quota is null as unlimited from {QUOTAS} q left join u on u.user_id = q.user_id and u.kind = q.kind"""),
    "L6_quota_admission": with_views("users subscriptions plans", f"""with n as (select id, user_id, kind, row_number() over (partition by user_id, kind,
      strftime(created_at, '%Y-%m') order by created_at, id) as number from {USES_SQL} x)
      select n.id, n.user_id, n.kind, number, case when quota is null or number <= quota then 'accepted' else 'quota_exhausted' end as outcome
      from n join {QUOTAS} q on q.user_id = n.user_id and q.kind = n.kind"""),
    "L8_due_for_renewal": with_views("subscriptions users plans", """select s.id, s.user_id, u.name, p.slug, s.ends_at from subscriptions s
      left join users u on u.id = s.user_id left join plans p on p.plan_id = s.plan_id
      where s.status = 'active' and auto_renew and ends_at <= timestamp '2001-07-18'"""),
    "L9_renewal_decision": with_views("subscriptions plans", """select s.id, case when status <> 'active' then 'not_active' when not auto_renew then 'auto_renew_disabled'
      when ends_at is null then 'no_end_date' when coalesce(price_fcfa, 0) <= 0 then 'free_plan' else 'eligible' end as decision
      from subscriptions s left join plans p using (plan_id)"""),
    "L10_expired_past_grace": with_views("subscriptions", f"""select id, 'expired' as status, false as auto_renew from subscriptions
      where status in ('active', 'past_due') and ends_at < timestamp '{NOW}' - interval 5 day"""),
    "L11_reminders_of_a_busy_day": with_views("subscriptions users plans", """select s.id, s.user_id, u.name, p.name as plan from subscriptions s
      join users u on u.id = s.user_id join plans p on p.plan_id = s.plan_id where s.status = 'active' and not reminded and ends_at::date = date '1995-03-14'"""),
    "L11_renewal_reminders": with_views("subscriptions users plans", """select s.id, s.user_id, u.name, p.name as plan from subscriptions s
      join users u on u.id = s.user_id join plans p on p.plan_id = s.plan_id where s.status = 'active' and not reminded and ends_at::date = date '2001-07-18'"""),
    "L12_cancel_prorata": with_views("subscriptions plans", """with d as (select s.id, price_fcfa, greatest(1, coalesce(floor(epoch(ends_at - starts_at) / 86400), 30))::bigint as total_days,
      floor(epoch(ends_at - timestamp '2001-07-15 12:00:00') / 86400)::bigint as remaining_days from subscriptions s join plans p on p.plan_id = s.plan_id
      where ends_at > timestamp '2001-07-15 12:00:00')
      select id, total_days, remaining_days, (2 * price_fcfa * remaining_days + total_days) // (2 * total_days) as refund from d"""),
    "L13_activation_dedupe": with_views("subscriptions", """with o as (select * from subscriptions qualify row_number() over (partition by external_id order by starts_at, id) = 1),
      n as (select id, user_id, external_id, starts_at, case when plan_id <> 3 then starts_at + interval 1 month end as ends_at,
        lead(starts_at) over (partition by user_id order by starts_at, id) as next_start from o)
      select id, user_id, external_id, starts_at, case when next_start is not null and (ends_at is null or next_start < ends_at) then next_start else ends_at end as ends_at,
      case when next_start is not null then 'cancelled' else 'active' end as status from n"""),
    "L14_failed_payment_state": with_views("subscriptions", f"""select id, 'past_due' as status, true as auto_renew, 'failed' as last_payment_status,
      timestamp '{NOW}' + interval 5 day as grace_until from subscriptions where status = 'active'"""),
    "L15_webhook_outcome": with_views("payments users", f"""with r as (select h.*, l.id is not null as has_link, coalesce(h.user_id, l.user_id) as payer from {HOOKS} h
      left join {LINKS} l on l.id = h.link_id and l.id % 6 <> 0), p as (select r.*, u.id is not null as has_user, t.known from r
      left join users u on u.id = payer and u.id % 5 <> 0 left join {TX} t on t.known = r.payment_id::varchar)
      select external_id, payment_id, case when lower(status) not in ('completed', 'failed', 'cancelled') then 'ignored_non_terminal'
        when not has_user and not (purpose = 'link' and link_id is not null) then 'user_not_found' when lower(status) <> 'completed' then 'recorded'
        when purpose = 'link' then case when has_link then 'link_settled' else 'link_not_found' end when purpose = 'subscription' then 'subscription_activated'
        when known is not null then 'already_processed' else 'credited' end as outcome from p"""),
    "L16_payments_to_sync": with_views("payments", """select external_id, payment_id, status, sync_attempts from payments
      where status in ('PENDING', 'PROCESSING') and (last_synced_at is null or sync_attempts < 5)"""),
    "L17_reconcile_payments": with_views("payments users", f"""with r as (select p.*, now_status, u.id as found, known from payments p
      left join {PROVIDER} s on s.external_id = p.external_id left join users u on u.id = p.user_id and u.id % 5 <> 0 left join {TX} t on t.known = p.payment_id::varchar
      where p.status in ('PENDING', 'PROCESSING')), a as (select *, case when now_status is null then 'api_failed' when now_status in ('PENDING', 'PROCESSING', '') then 'still_pending'
      when known is not null then 'already_credited' when found is null then 'user_missing' when now_status <> 'COMPLETED' then 'status_only'
      when purpose = 'subscription' then 'activate' else 'credit' end as action from r)
      select external_id, action, case when action in ('api_failed', 'user_missing') then status when now_status = '' then 'PENDING' else now_status end as status,
      sync_attempts + (action in ('api_failed', 'still_pending', 'already_credited'))::int as sync_attempts from a"""),
    "L18_settle_link_decision": with_views("users", f"""select l.id, case when status = 'paid' then 'already_paid' when status = 'cancelled' then 'cancelled'
      when expires_at < timestamp '{NOW}' then 'expired' when l.user_id is not null and u.id is null then 'recipient_missing'
      when l.user_id is null then 'pay_without_credit' else 'pay' end as decision from {LINKS} l left join users u on u.id = l.user_id"""),
    "L20_invoice_numbers": with_views("invoices", """select id, 'INV-' || year(created_at) || '-' || lpad(n::varchar, greatest(6, length(n::varchar))::int, '0') as number
      from (select id, created_at, row_number() over (partition by year(created_at) order by created_at, id) as n from invoices)"""),
    "G24_payment_link_summary": f"""select count(*) filter (where status = 'pending' and coalesce(expires_at >= timestamp '{NOW}', true)) as usable,
      count(*) filter (where status = 'paid') as paid, coalesce(sum(amount) filter (where status = 'paid'), 0)::bigint as paid_amount,
      count(*) filter (where status = 'pending' and expires_at < timestamp '{NOW}') as expired from {LINKS} l""",
}
