"""Registered queries over usage and prices, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import pricing, usage
from foliant.sources import fixtures as fx
from foliant.sources.fixtures import CREDITS_SQL, MICRO_SQL, units_sql, with_views

TODAY = "2024-01-30"
SPAN = ("2024-01-05 00:00:00", "2024-01-20 12:00:00")
TOTALS = """coalesce(sum(cost_micro), 0) / 1000000 as usd, coalesce(sum(cost_credits), 0)::bigint as credits, count(*) as attempts,
  count(*) filter (where not succeeded) as failures, count(*) filter (where is_fallback) as fallbacks,
  coalesce(sum(input_tokens + output_tokens), 0)::bigint as tokens"""
WHERE = f"created_at >= timestamp '{SPAN[0]}' and created_at <= timestamp '{SPAN[1]}'"


def pct(a: str, b: str) -> str:
    return f"case when {b} > 0 then floor(({a} * 2000 + {b})::double / ({b} * 2)::double) / 10 else 0.0 end"


def ledger(spark, sf):
    return fx.usage_ledger(spark, sf)


def daily_sql(source: str, column: str, measures: str, names: str, days: int = 30) -> str:
    shown = ", ".join(f"coalesce({n}, 0)::bigint as {n}" for n in names.split())
    return f"""with spine as (select (date '{TODAY}' - {days - 1} + i::int)::date as day from range({days}) as r(i)),
      d as (select {column}::date as day, {measures} from {source} where {column} >= date '{TODAY}' - {days - 1} group by 1)
      select spine.day, {shown} from spine left join d on spine.day = d.day"""


def raw_calls(spark, sf):
    k = F.col("id")
    rows = ledger(spark, sf)
    null = lambda every, c: F.when(k % every != 0, F.col(c))
    return rows.select(
        "id", null(3, "provider").alias("provider"), null(4, "model").alias("model"), null(5, "task_type").alias("task_type"),
        null(6, "input_tokens").alias("input_tokens"), null(7, "output_tokens").alias("output_tokens"), (k % 4 - 1).alias("attempt"),
        null(8, "succeeded").alias("succeeded"), (F.col("cost_credits") - 2).alias("cost_credits"),
        F.when(k % 10 == 0, "failure").when(k % 11 == 0, "fallback").otherwise("call").alias("kind"),
        F.col("model").alias("fallback_from"), F.when(k % 10 == 0, F.repeat(F.lit("error "), 100)).alias("error"),
    )


RAW_SQL = """(select id, case when id % 3 <> 0 then provider end as provider, case when id % 4 <> 0 then model end as model,
  case when id % 5 <> 0 then task_type end as task_type, case when id % 6 <> 0 then input_tokens end as input_tokens,
  case when id % 7 <> 0 then output_tokens end as output_tokens, id % 4 - 1 as attempt, case when id % 8 <> 0 then succeeded end as succeeded,
  cost_credits - 2 as cost_credits, case when id % 10 = 0 then 'failure' when id % 11 = 0 then 'fallback' else 'call' end as kind,
  model as fallback_from, case when id % 10 = 0 then repeat('error ', 100) end as error from usage_ledger)"""

U, CU = units_sql(), f"coalesce({units_sql()}, 0)"
def sessions_of_ten(s, d):
    """The ledger with a session for every ten calls: there are more of them as it grows."""
    return ledger(s, d).withColumn("session_id", F.expr("id div 10"))


QUERIES = {
    "S9_normalize_usage_row": lambda s, d: usage.normalize_usage_row(raw_calls(s, d)),
    "P1_usage_log": lambda s, d: usage.usage_log(ledger(s, d), model="gpt-4o", failures=True, page=2),
    "J8_price_lookup": lambda s, d: pricing.priced(ledger(s, d), fx.prices(s)).select("id", "model", "p_in", "p_out", "p_img"),
    "G1_usage_totals": lambda s, d: usage.usage_totals(ledger(s, d), *SPAN),
    "G2_usage_totals_by_reference": lambda s, d: usage.usage_totals_by(ledger(s, d), "reference"),
    "G2_usage_totals_by_user": lambda s, d: usage.usage_totals_by(ledger(s, d), "user_id", *SPAN),
    "G2_usage_totals_by_document": lambda s, d: usage.usage_totals_by(ledger(s, d), "document_id"),
    "G2_usage_totals_by_session": lambda s, d: usage.usage_totals_by(ledger(s, d), "session_id"),
    "G3_waste_by_user": lambda s, d: usage.waste_by_user(ledger(s, d), *SPAN),
    "G4_breakdown_by_model": lambda s, d: usage.breakdown_by_model(ledger(s, d)),
    "G5_daily_ai_cost": lambda s, d: usage.daily_ai_cost(ledger(s, d), TODAY),
    "G6_daily_signups": lambda s, d: usage.daily_signups(fx.users(s, d), TODAY),
    "G7_daily_documents": lambda s, d: usage.daily_documents(fx.documents_ops(s, d), TODAY),
    "G8_series_empty_flag": lambda s, d: usage.series_empty_flag(usage.daily_ai_cost(ledger(s, d), TODAY)),
    "G9_consumption_by_provider": lambda s, d: usage.consumption_by_provider(ledger(s, d)),
    "G10_consumption_by_task": lambda s, d: usage.consumption_by_task(ledger(s, d)),
    "G11_profitability": lambda s, d: usage.profitability(fx.invoices(s, d), ledger(s, d), "2001-08-01", 365),
    "G12_lifetime_totals": lambda s, d: usage.lifetime_totals(fx.invoices(s, d), ledger(s, d), fx.users(s, d), fx.documents_ops(s, d)),
    "G13_billing_report": lambda s, d: usage.billing_report(ledger(s, d), *SPAN),
    "G14_cost_audit": lambda s, d: usage.cost_audit(ledger(s, d), fx.prices(s)),
    "G14_cost_audit_all": lambda s, d: usage.cost_audit(ledger(s, d), fx.prices(s)),
    "G14_cost_audit_all_examples": lambda s, d: usage.cost_audit_examples(ledger(s, d), fx.prices(s)),
    "G14_cost_audit_examples": lambda s, d: usage.cost_audit_examples(ledger(s, d), fx.prices(s)),
    "G15_cost_per_million_tokens": lambda s, d: usage.cost_per_million_tokens(ledger(s, d)),
    "G16_multi_turn_cost": lambda s, d: usage.multi_turn_cost(ledger(s, d)),
    "G16_turn_costs": lambda s, d: usage.turn_costs(sessions_of_ten(s, d)),
    "G16_session_totals": lambda s, d: usage.session_totals(sessions_of_ten(s, d)),
    "G32_session_cost": lambda s, d: usage.session_cost(fx.chat_messages(s, d)),
    "G32_message_precharge": lambda s, d: usage.message_precharge(fx.chat_messages(s, d)),
    "M1_cost_usd": lambda s, d: pricing.cost_usd(ledger(s, d), fx.prices(s)),
    "M2_usd_to_credits": lambda s, d: pricing.usd_to_credits(ledger(s, d), fx.prices(s)),
    "M3_mode_estimate": lambda s, d: pricing.mode_estimate(fx.documents_ops(s, d), "pro", pricing.routes(s), fx.prices(s)),
    "M4_route_model": lambda s, d: pricing.route_model(route_requests(s, d), pricing.routes(s)),
    "M5_candidate_models": lambda s, d: pricing.candidate_models(pricing.routes(s)).join(
        ledger(s, d).select(F.col("task_type").alias("task")).distinct(), "task", "left_semi"),
    "M6_price_in_currency": lambda s, d: pricing.price_in_currency(fx.invoices(s, d), fx.pick(("XAF", "XOF", "EUR", "USD"), F.col("id") % 4)),
    "M7_skill_cost": lambda s, d: pricing.skill_cost(ledger(s, d), fx.pick(("pdf", "pptx", "xlsx", "docx", "odt"), F.col("id") % 5), F.col("user_id") % 2 == 0),
    "M8_failed_call_tokens": lambda s, d: pricing.failed_call_tokens(fx.documents_ops(s, d)),
    "M9_reconcile_estimate": lambda s, d: pricing.reconcile_estimate(estimates(s, d), ledger(s, d).where("id % 9 <> 0")),
    "M10_proportional_refund": lambda s, d: fx.documents_ops(s, d).select("id", pricing.proportional_refund(
        F.col("n_chars"), F.col("id") % 9 - 1, F.col("id") % 7).alias("refund")),
    "M11_to_xof": lambda s, d: fx.invoices(s, d).select("id", pricing.to_xof(F.col("amount")).alias("xof")),
    "M13_invoice_label": lambda s, d: pricing.price_in_currency(fx.invoices(s, d), F.lit("EUR")).select("id", "label"),
}


def route_requests(spark, sf):
    return ledger(spark, sf).select(
        "id", F.col("task_type").alias("task"), fx.pick((*pricing.PLAN_SLUGS[1:], "unknown"), F.col("id") % 5).alias("slug")
    ).where("task <> ''")


def estimates(spark, sf):
    by = ledger(spark, sf).groupBy("reference").agg((F.max("cost_credits") * 8 + F.min("id")).alias("estimated"))
    return by


ROUTE_ROWS = [
    (task, slug, models[0], "|".join(models[1:])) for task, lists in pricing.ROUTES.items() for slug, models in zip(pricing.PLAN_SLUGS, lists)
]
ROUTES_SQL = fx.values_sql(ROUTE_ROWS, "task, slug, model, fallbacks")
CEIL = lambda a, b: f"(({a} + {b - 1}) // {b})"
SKILL_UNITS = "((input_tokens * 3 + output_tokens * 15) * 1200 + (case id % 5 when 0 then 8 when 1 then 7 when 2 then 6 else 5 end) * 1000000)"
SKILL_BASE = f"greatest(1, {CEIL(SKILL_UNITS + ' * 1240', 1_200_000_000)})"
CUR = "(case id % 4 when 0 then 'XAF' when 1 then 'XOF' when 2 then 'EUR' else 'USD' end)"


def label_sql(cur: str) -> str:
    rate = f"(case {cur} when 'EUR' then 655957 when 'USD' then 620000 else 1000 end)"
    minor = f"(case when {cur} in ('XAF', 'XOF') then amount else (amount * 200000 + {rate}) // (2 * {rate}) end)"
    label = f"""case when {cur} in ('XAF', 'XOF') then amount || ' ' || {cur}
      else ({minor} // 100) || '.' || lpad(({minor} % 100)::varchar, 2, '0') || ' ' || {cur} end"""
    return f"select id, {cur} as currency, {minor}::bigint as minor, {label} as label from invoices"


ORACLE_SQL = {
    "S9_normalize_usage_row": with_views("usage_ledger", f"""select id,
      case when kind = 'fallback' then 'deepseek_fallback' else coalesce(provider, 'openrouter') end as provider, coalesce(model, 'inconnu') as model,
      coalesce(task_type, '') as task_type, coalesce(input_tokens, 0) as input_tokens,
      case when kind = 'failure' then 0 else coalesce(output_tokens, 0) end as output_tokens, greatest(1, coalesce(attempt, 0)) as attempt,
      case kind when 'failure' then false when 'fallback' then true else coalesce(succeeded, false) end as succeeded, kind = 'fallback' as is_fallback,
      case when kind = 'fallback' then fallback_from end as fallback_from, greatest(0, coalesce(cost_credits, 0)) as cost_credits,
      substr(error, 1, 500) as error from {RAW_SQL} r"""),
    "P1_usage_log": with_views("usage_ledger", """select id, user_id, model, provider, succeeded, is_fallback, cost_credits from usage_ledger
      where contains(model, 'gpt-4o') and not succeeded order by id desc limit 50 offset 50"""),
    "J8_price_lookup": with_views("usage_ledger", "select id, model, p_in, p_out, p_img from usage_ledger left join prices using (model)"),
    "G1_usage_totals": with_views("usage_ledger", f"select {TOTALS} from usage_ledger where {WHERE}"),
    "G2_usage_totals_by_reference": with_views("usage_ledger", f"select reference, {TOTALS} from usage_ledger group by 1"),
    "G2_usage_totals_by_user": with_views("usage_ledger", f"select user_id, {TOTALS} from usage_ledger where {WHERE} group by 1"),
    "G2_usage_totals_by_document": with_views("usage_ledger", f"select document_id, {TOTALS} from usage_ledger group by 1"),
    "G2_usage_totals_by_session": with_views("usage_ledger", f"select session_id, {TOTALS} from usage_ledger group by 1"),
    "G3_waste_by_user": with_views("usage_ledger", f"select user_id, {TOTALS} from usage_ledger where not succeeded and {WHERE} group by 1"),
    "G4_breakdown_by_model": with_views("usage_ledger", f"select * exclude (fallbacks) from (select model, provider, {TOTALS} from usage_ledger group by 1, 2) order by usd desc"),
    "G5_daily_ai_cost": with_views("usage_ledger", daily_sql("usage_ledger", "created_at",
      "sum(cost_credits) as credits, count(*) as calls, count(*) filter (where not succeeded) as failures", "credits calls failures")),
    "G6_daily_signups": with_views("users", daily_sql("users", "created_at", "count(*) as signups", "signups")),
    "G7_daily_documents": with_views("documents_ops", daily_sql("documents_ops", "updated_at",
      "count(*) as total, count(*) filter (where status = 'failed') as failed", "total failed")),
    "G8_series_empty_flag": with_views("usage_ledger", f"""select coalesce(sum(cost_credits), 0) + count(*) + count(*) filter (where not succeeded) = 0 as empty
      from usage_ledger where created_at >= date '{TODAY}' - 29 and created_at < date '{TODAY}' + 1"""),
    "G9_consumption_by_provider": with_views("usage_ledger", f"""with g as (select provider, model, count(*) as calls,
      count(*) filter (where not succeeded) as failures, sum(input_tokens + output_tokens)::bigint as tokens, sum(cost_credits)::bigint as credits
      from usage_ledger group by 1, 2), t as (select sum(credits)::bigint as everything from g)
      select g.*, {pct('failures', 'calls')} as failure_rate, {pct('credits', 'everything')} as share from g, t"""),
    "G10_consumption_by_task": with_views("usage_ledger", f"""with g as (select case when task_type = '' then 'non précisé' else task_type end as task_type,
      count(*) as calls, count(*) filter (where not succeeded) as failures, sum(cost_credits)::bigint as credits from usage_ledger group by 1),
      t as (select sum(credits)::bigint as everything from g) select g.*, {pct('credits', 'everything')} as share from g, t"""),
    "G11_profitability": with_views("usage_ledger invoices", f"""with i as (select coalesce(sum(amount), 0)::bigint as revenue, count(*) as paid_invoices from invoices
      where status = 'paid' and paid_at >= date '2001-08-01' - 364), c as (select coalesce(sum(cost_credits), 0)::bigint as ai_credits, count(*) as calls,
      count(*) filter (where not succeeded) as failures, coalesce(sum(cost_credits) filter (where not succeeded), 0)::bigint as failure_credits
      from usage_ledger where created_at >= date '2001-08-01' - 364)
      select *, revenue - ai_credits as gap, {pct('failures', 'calls')} as failure_rate from i, c"""),
    "G12_lifetime_totals": with_views("usage_ledger invoices users documents_ops", """select
      (select coalesce(sum(amount), 0)::bigint from invoices where status = 'paid') as revenue, (select count(*) from invoices where status = 'paid') as paid_invoices,
      (select sum(cost_credits)::bigint from usage_ledger) as ai_credits, (select count(*) from usage_ledger) as calls,
      (select count(*) from usage_ledger where not succeeded) as failures, (select sum(credits_balance)::bigint from users) as credits_in_circulation,
      (select count(*) from users) as users, (select count(*) from documents_ops) as documents"""),
    "G13_billing_report": with_views("usage_ledger", f"""with g as (select count(*) as attempts, count(*) filter (where not succeeded) as failures,
      count(*) filter (where is_fallback) as fallbacks, count(*) filter (where estimated) as estimated, sum(input_tokens + output_tokens)::bigint as tokens,
      sum(cost_micro)::bigint as micro, sum(cost_credits)::bigint as credits,
      coalesce(sum(cost_credits) filter (where not succeeded), 0)::bigint as leak_credits from usage_ledger where {WHERE})
      select attempts, failures, {pct('failures', 'attempts')} as failure_rate, fallbacks, estimated, tokens, micro / 1000000 as usd, credits, leak_credits,
      {pct('leak_credits', 'credits')} as leak_rate, {CREDITS_SQL.format(u='(micro * 10000)')}::bigint as theoretical_credits, 1.84::double as coefficient from g"""),
    "G14_cost_audit_all": with_views("usage_ledger", f"""with n as (select l.*, {CREDITS_SQL.format(u=CU)} as expected from
      usage_ledger l left join prices using (model)),
      s as (select count(*) filter (where not estimated) as checked, count(*) filter (where not estimated and expected = cost_credits) as consistent,
      count(*) filter (where not estimated and expected <> cost_credits) as mismatches, count(*) filter (where estimated) as estimated from n)
      select *, case when checked > 0 then floor((consistent * 20000 + checked)::double / (checked * 2)) / 10000 else 1.0 end as rate from s"""),
    "G14_cost_audit_all_examples": with_views("usage_ledger", f"""select id, model, cost_credits as stored, ({CREDITS_SQL.format(u=CU)})::bigint as expected from
      usage_ledger l left join prices using (model)
      where not estimated and {CREDITS_SQL.format(u=CU)} <> cost_credits order by id desc limit 5"""),
    "G15_cost_per_million_tokens": with_views("usage_ledger", """select id, case when input_tokens + output_tokens > 0 then
      floor((cost_micro * 20000 + input_tokens + output_tokens)::double / ((input_tokens + output_tokens) * 2)::double) / 10000 end as usd_per_million from usage_ledger"""),
    "G16_multi_turn_cost": with_views("usage_ledger", """select session_id, count(*) as turns, sum(cost_micro) / 1000000 as usd,
      string_agg(cost_micro::varchar, ',' order by id) as turn_micro from usage_ledger group by 1"""),
    "G16_turn_costs": with_views("usage_ledger", """select id // 10 as session_id, id, row_number() over (partition by id // 10 order by created_at, id) as turn, cost_micro,
      (sum(cost_micro) over (partition by id // 10 order by created_at, id rows unbounded preceding))::bigint as micro_so_far from usage_ledger"""),
    "G16_session_totals": with_views("usage_ledger", "select id // 10 as session_id, count(*) as turns, sum(cost_micro) / 1000000 as usd from usage_ledger group by 1"),
    "G32_session_cost": with_views("chat_messages", """select session_id, (sum(cost_credits) + sum(attachments))::bigint as credits, count(*) as messages,
      max_by(model_used, turn) as last_model from chat_messages group by 1"""),
    "G32_message_precharge": with_views("chat_messages", "select session_id, turn, greatest(1, cost_credits) + attachments as precharge from chat_messages"),
    "M1_cost_usd": with_views("usage_ledger", f"select id, model, {MICRO_SQL.format(u=U)} / 1000000 as usd from usage_ledger left join prices using (model)"),
    "M2_usd_to_credits": with_views("usage_ledger", f"select id, ({CREDITS_SQL.format(u=CU)})::bigint as credits from usage_ledger left join prices using (model)"),
    "M3_mode_estimate": with_views("documents_ops", f"""with m as (select id, n_chars, unnest(['regex', 'assisted', 'precision']) as mode from documents_ops),
      t as (select *, case when mode = 'regex' then 0 else greatest(1, {CEIL("(case when mode = 'assisted' then n_chars // 5 else n_chars end)", 3)}) end as input_tokens,
        case when mode = 'regex' then 0 else least(16384, greatest(200, {CEIL("(n_chars * case when mode = 'precision' then 8 else 12 end)", 300)})) end as output_tokens,
        greatest(500, {CEIL('n_chars', 4)}, {CEIL('n_chars', 3)}) as format_tokens from m)
      select id, mode, input_tokens::bigint as input_tokens, output_tokens::bigint as output_tokens, (case mode when 'regex' then 0
        when 'assisted' then greatest(1, {CREDITS_SQL.format(u='(input_tokens * 2574 + output_tokens * 10290)')})
        else greatest(1, {CREDITS_SQL.format(u='(input_tokens * 30000 + output_tokens * 150000)')})
          + greatest(1, {CREDITS_SQL.format(u='(format_tokens * 150000 + 1500 * 750000)')}) end)::bigint as credits from t"""),
    "M4_route_model": with_views("usage_ledger", f"""with routes as ({ROUTES_SQL}), r as (select id, task_type as task,
      case id % 5 when 0 then 'standard' when 1 then 'premium' when 2 then 'pro' when 3 then 'enterprise' else 'unknown' end as slug from usage_ledger where task_type <> '')
      select r.id, r.task, r.slug, coalesce(o.model, b.model) as model, coalesce(o.fallbacks, b.fallbacks) as fallbacks
      from r left join routes o on o.task = r.task and o.slug = r.slug left join routes b on b.task = r.task and b.slug = 'default'"""),
    "M5_candidate_models": with_views("usage_ledger", f"""with routes as ({ROUTES_SQL}),
      x as (select task, unnest(string_split(case when fallbacks = '' then model else model || '|' || fallbacks end, '|')) as model from routes)
      select distinct task, model from x where task in (select task_type from usage_ledger)"""),
    "M6_price_in_currency": with_views("invoices", label_sql(CUR)),
    "M7_skill_cost": with_views("usage_ledger", f"""select id, case id % 5 when 0 then 'pdf' when 1 then 'pptx' when 2 then 'xlsx' when 3 then 'docx' else 'odt' end as kind,
      (case when user_id % 2 = 0 then {SKILL_BASE} else ({SKILL_BASE} * 3 + 1) // 2 end)::bigint as credits from usage_ledger"""),
    "M8_failed_call_tokens": with_views("documents_ops", f"select id, {CEIL('n_chars', 4)} as tokens from documents_ops"),
    "M9_reconcile_estimate": with_views("usage_ledger", """with e as (select reference, max(cost_credits) * 8 + min(id) as estimated from usage_ledger group by 1),
      a as (select reference, sum(cost_credits)::bigint as actual from usage_ledger where id % 9 <> 0 group by 1)
      select reference, estimated, coalesce(actual, 0) as actual, greatest(estimated - coalesce(actual, 0), 0) as refund,
      greatest(coalesce(actual, 0) - estimated, 0) as absorbed from e left join a using (reference)"""),
    "M10_proportional_refund": with_views("documents_ops", """select id, case when n_chars <= 0 or id % 9 - 1 <= 0 or id % 7 <= 0 then 0
      when id % 9 - 1 >= id % 7 then n_chars else (n_chars * (id % 9 - 1)) // (id % 7) end as refund from documents_ops"""),
    "M11_to_xof": with_views("invoices", "select id, (amount * 655957 + 500) // 1000 as xof from invoices"),
    "M13_invoice_label": with_views("invoices", "select id, label from (" + label_sql("'EUR'") + ")"),
}

# The audit of all rows under both names.
ORACLE_SQL |= {name: ORACLE_SQL[f"{name.replace('audit', 'audit_all')}"] for name in ("G14_cost_audit", "G14_cost_audit_examples")}
