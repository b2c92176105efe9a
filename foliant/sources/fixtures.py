"""Views of the driver tables in the shapes the operators take, and the same views as SQL for the oracles.

Each view exists twice with the same arithmetic: a DataFrame function and a SQL body. ``with_views`` puts the bodies a
query needs in front of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.session import read_table
from foliant.sources.blocks import BLOCKS_SQL

NOW_EVENTS = "2024-01-31 00:00:00"
NOW_ORDERS = "2001-08-02 00:00:00"

# Model, price of a million input and output tokens and of an image, in ten-thousandths of a dollar.
PRICES = (
    ("deepseek/deepseek-chat", 2574, 10290, None),
    ("meta-llama/llama-3.1-8b-instruct", 200, 400, None),
    ("openai/gpt-4o", 25000, 100000, None),
    ("openai/gpt-4o-mini", 1500, 6000, None),
    ("anthropic/claude-3.5-sonnet", 30000, 150000, None),
    ("anthropic/claude-3-opus", 150000, 750000, None),
    ("openai/gpt-image-1-mini", None, None, 350),
    ("openai/gpt-image-1", None, None, 800),
    ("perplexity/llama-3.1-sonar-huge", 10000, 10000, None),
)
# The models of the ledger view, by event_id % 7; the last has no price.
MODELS = (
    "deepseek/deepseek-chat", "meta-llama/llama-3.1-8b-instruct", "openai/gpt-4o", "openai/gpt-4o-mini",
    "anthropic/claude-3.5-sonnet", "perplexity/llama-3.1-sonar-huge", "unlisted/model",
)
TASKS = ("chat_text", "document_analysis", "image_analysis", "web_search", "")
# Slug, name, price, monthly quotas (null: unlimited), by o_orderkey % 4.
PLANS = (
    (0, "standard", "Standard", 3000, 10, 5),
    (1, "premium", "Premium", 5000, 30, 15),
    (2, "pro", "Pro", 13500, None, 90),
    (3, "enterprise", "Entreprises", 0, None, None),
)
PAYMENT_STATUS = {
    "1-URGENT": "PENDING", "2-HIGH": "PROCESSING", "3-MEDIUM": "COMPLETED", "4-NOT SPECIFIED": "FAILED", "5-LOW": "CANCELLED",
}
DOC_STATUS = ("pending", "detected", "validated", "generated", "ready", "failed", "processing")


def values_sql(rows, names: str) -> str:
    show = lambda x: "null" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    return f"select * from (values {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) as t({names})"


def pick_sql(items, index: str) -> str:
    return "(case " + index + " ".join(f" when {i} then '{x}'" for i, x in enumerate(items)) + " end)"


def pick(items, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in items]), index.cast("int") + 1)


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PRICES), "model string, p_in long, p_out long, p_img long")


def plans(spark: SparkSession) -> DataFrame:
    schema = "plan_id long, slug string, name string, price_fcfa long, quota_deterministic long, quota_ai long"
    return spark.createDataFrame(list(PLANS), schema)


def usage_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.operators.pricing import cost_units, credits_of_units, micro_of_units

    e = read_table(spark, sf_dir, "events")
    failed = F.col("event_type") == "error"
    rows = e.select(
        F.col("event_id").alias("id"), "user_id", F.col("ts").alias("created_at"),
        pick(MODELS, F.col("event_id") % 7).alias("model"),
        F.when(F.col("event_id") % 11 == 0, "deepseek_fallback").otherwise("openrouter").alias("provider"),
        (F.col("event_id") % 11 == 0).alias("is_fallback"), pick(TASKS, F.col("event_id") % 5).alias("task_type"),
        (~failed).alias("succeeded"), failed.alias("estimated"),
        (F.get_json_object("props", "$.k").cast("long") * 100).alias("input_tokens"),
        F.when(failed, F.lit(0).cast("long")).otherwise(F.floor(F.col("value") * 10).cast("long")).alias("output_tokens"),
        (F.col("event_id") % 1000).alias("document_id"), (F.col("event_id") % 100).alias("session_id"),
        F.concat(F.lit("ref-"), F.col("event_id") % 500).alias("reference"),
    )
    units = F.coalesce(cost_units(), F.lit(0).cast("long"))
    extra = F.when(F.col("id") % 97 == 0, 1).otherwise(0)
    return (
        rows.join(F.broadcast(prices(spark)), "model", "left")
        .withColumn("cost_micro", micro_of_units(units))
        .withColumn("cost_credits", credits_of_units(units) + extra)
        .drop("p_in", "p_out", "p_img")
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    return c.select(
        key.alias("id"), F.col("c_name").alias("name"),
        F.greatest(F.lit(0).cast("long"), F.floor("c_acctbal").cast("long")).alias("credits_balance"),
        (key % 50 == 0).alias("is_admin"), (key % 37 == 0).alias("is_suspended"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(c_custkey % 45 as int))").alias("created_at"),
    )


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "F", "expired").otherwise("past_due")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), (F.col("o_orderkey") % 4).alias("plan_id"),
        F.col("o_orderdate").alias("starts_at"),
        F.expr("if(o_orderkey % 4 = 3, null, o_orderdate + make_dt_interval(30))").alias("ends_at"),
        status.alias("status"), (F.col("o_orderkey") % 3 != 0).alias("auto_renew"),
        F.concat(F.lit("ext-"), F.col("o_orderkey") - F.col("o_orderkey") % 2).alias("external_id"),
        (F.col("o_orderkey") % 5 == 0).alias("reminded"),
    )


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "paid").when(F.col("o_orderstatus") == "O", "pending").otherwise("failed")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"),
        F.floor(F.col("o_totalprice") + 0.5).cast("long").alias("amount"), status.alias("status"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("paid_at"), F.col("o_orderdate").alias("created_at"),
    )


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payments_of(read_table(spark, sf_dir, "orders"))


def payments_of(o: DataFrame) -> DataFrame:
    """Payments of orders, which may be a stream."""
    status = F.create_map(*[F.lit(x) for kv in PAYMENT_STATUS.items() for x in kv])
    key = F.col("o_orderkey")
    return o.select(
        (key - key % 2).alias("payment_id"), key.alias("external_id"), F.col("o_custkey").alias("user_id"),
        F.element_at(status, F.col("o_orderpriority")).alias("status"), (key % 7).alias("sync_attempts"),
        F.when(key % 4 != 0, F.col("o_orderdate")).alias("last_synced_at"),
        F.floor(F.col("o_totalprice") + 0.5).cast("long").alias("amount"),
        pick(("credits", "subscription", "link"), key % 3).alias("purpose"), F.col("o_orderdate").alias("created_at"),
        F.when(key % 13 != 0, F.concat(F.lit('{"user_id": '), F.col("o_custkey"), F.lit(', "payment_link_id": '), key % 50, F.lit("}"))).alias("metadata"),
    )


def credit_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").where("event_type <> 'error'")
    credit = F.col("event_type").isin("purchase", "signup")
    amount = F.floor("value").cast("long")
    return e.select(
        F.col("event_id").alias("id"), "user_id", F.col("ts").alias("created_at"),
        F.when(credit, "credit").otherwise("debit").alias("kind"), amount.alias("amount"),
        F.when(credit, amount).otherwise(-amount).alias("signed"),
        F.when(F.col("event_id") % 17 != 0, F.concat(F.lit("pay-"), F.col("event_id") % 400)).otherwise("").alias("reference"),
    )


def documents_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    key = F.col("doc_id")
    return d.select(
        key.alias("id"), F.concat(F.lit("document-"), key, F.lit(".docx")).alias("filename"), pick(DOC_STATUS, key % 7).alias("status"),
        F.expr(f"if(doc_id % 101 = 0, null, timestamp_ntz'{NOW_EVENTS}' - make_dt_interval(cast(doc_id % 40 as int), cast(doc_id % 24 as int)))").alias("updated_at"),
        F.concat(F.lit('{"user_id": '), key % 150, F.lit("}")).alias("metadata"), "n_chars",
        F.when(key % 3 == 0, "native").when(key % 3 == 1, F.lit(None)).otherwise("other").alias("pipeline"),
    )


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), pick(MODELS, (F.col("conv_id") + F.col("turn")) % 7).alias("model_used"),
        F.when(F.col("role") == "assistant", 1 + (F.col("conv_id") + F.col("turn")) % 9).otherwise(0).alias("cost_credits"),
        ((F.col("conv_id") + F.col("turn")) % 3).alias("attachments"),
    )


def units_sql(inp: str = "input_tokens", out: str = "output_tokens") -> str:
    return (
        f"(case when p_img is not null then p_img * greatest(1, {out}) * 1000000"
        f" when p_in is not null then {inp} * p_in + {out} * p_out end)"
    )


MICRO_SQL = "(({u} + 5000) // 10000)"
CREDITS_SQL = "(({u} * 11408 + 99999999999) // 100000000000)"
_U = f"coalesce({units_sql()}, 0)"

VIEWS = {
    "prices": values_sql(PRICES, "model, p_in, p_out, p_img"),
    "plans": values_sql(PLANS, "plan_id, slug, name, price_fcfa, quota_deterministic, quota_ai"),
    "usage_ledger": f"""select l.* exclude (p_in, p_out, p_img), {MICRO_SQL.format(u=_U)}::bigint as cost_micro,
      ({CREDITS_SQL.format(u=_U)} + case when id % 97 = 0 then 1 else 0 end)::bigint as cost_credits from (
      select e.*, p.p_in, p.p_out, p.p_img from (select event_id as id, user_id, ts as created_at,
        {pick_sql(MODELS, 'event_id % 7')} as model,
        case when event_id % 11 = 0 then 'deepseek_fallback' else 'openrouter' end as provider, event_id % 11 = 0 as is_fallback,
        {pick_sql(TASKS, 'event_id % 5')} as task_type, event_type <> 'error' as succeeded, event_type = 'error' as estimated,
        json_extract_string(props, '$.k')::bigint * 100 as input_tokens,
        case when event_type = 'error' then 0 else floor(value * 10)::bigint end as output_tokens,
        event_id % 1000 as document_id, event_id % 100 as session_id, 'ref-' || (event_id % 500) as reference from events) e
      left join prices p using (model)) l""",
    "users": """select c_custkey as id, c_name as name, greatest(0, floor(c_acctbal))::bigint as credits_balance,
      c_custkey % 50 = 0 as is_admin, c_custkey % 37 = 0 as is_suspended,
      timestamp '2024-01-01 00:00:00' + to_days((c_custkey % 45)::int) as created_at from customer""",
    "subscriptions": """select o_orderkey as id, o_custkey as user_id, o_orderkey % 4 as plan_id, o_orderdate as starts_at,
      case when o_orderkey % 4 = 3 then null else o_orderdate + to_days(30) end as ends_at,
      case o_orderstatus when 'O' then 'active' when 'F' then 'expired' else 'past_due' end as status,
      o_orderkey % 3 <> 0 as auto_renew, 'ext-' || (o_orderkey - o_orderkey % 2) as external_id, o_orderkey % 5 = 0 as reminded
      from orders""",
    "invoices": """select o_orderkey as id, o_custkey as user_id, floor(o_totalprice + 0.5::double)::bigint as amount,
      case o_orderstatus when 'F' then 'paid' when 'O' then 'pending' else 'failed' end as status,
      case when o_orderstatus = 'F' then o_orderdate end as paid_at, o_orderdate as created_at from orders""",
    "payments": f"""select o_orderkey - o_orderkey % 2 as payment_id, o_orderkey as external_id, o_custkey as user_id,
      case o_orderpriority {' '.join(f"when '{k}' then '{v}'" for k, v in PAYMENT_STATUS.items())} end as status,
      o_orderkey % 7 as sync_attempts, case when o_orderkey % 4 <> 0 then o_orderdate end as last_synced_at,
      floor(o_totalprice + 0.5::double)::bigint as amount, {pick_sql(("credits", "subscription", "link"), 'o_orderkey % 3')} as purpose,
      o_orderdate as created_at, case when o_orderkey % 13 <> 0 then
        '{{"user_id": ' || o_custkey || ', "payment_link_id": ' || (o_orderkey % 50) || '}}' end as metadata from orders""",
    "credit_requests": """select event_id as id, user_id, ts as created_at,
      case when event_type in ('purchase', 'signup') then 'credit' else 'debit' end as kind, floor(value)::bigint as amount,
      (case when event_type in ('purchase', 'signup') then 1 else -1 end * floor(value))::bigint as signed,
      case when event_id % 17 <> 0 then 'pay-' || (event_id % 400) else '' end as reference
      from events where event_type <> 'error'""",
    "documents_ops": f"""select doc_id as id, 'document-' || doc_id || '.docx' as filename, {pick_sql(DOC_STATUS, 'doc_id % 7')} as status,
      case when doc_id % 101 = 0 then null else timestamp '{NOW_EVENTS}' - to_days((doc_id % 40)::int) - to_hours((doc_id % 24)::int) end as updated_at,
      '{{"user_id": ' || (doc_id % 150) || '}}' as metadata, n_chars,
      case doc_id % 3 when 0 then 'native' when 2 then 'other' end as pipeline from documents""",
    "chat_messages": f"""select conv_id as session_id, turn, role, text as content, conv_id * 1000 + turn as id,
      {pick_sql(MODELS, '(conv_id + turn) % 7')} as model_used,
      case when role = 'assistant' then 1 + (conv_id + turn) % 9 else 0 end as cost_credits, (conv_id + turn) % 3 as attachments
      from conversations""",
}


VIEWS["blocks"] = BLOCKS_SQL
NEEDS = {"usage_ledger": ("prices",)}


def with_views(names: str, body: str) -> str:
    """``body`` after the SQL views it names (and those they need)."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for other in NEEDS.get(name, ()):
            add(other)
        if name not in wanted:
            wanted.append(name)

    for name in names.split():
        add(name)
    heads = ",\n".join(f"{n} as ({VIEWS[n]})" for n in wanted)
    body = body.strip()
    if body.lower().startswith("with "):
        return f"with {heads},\n{body[5:]}"
    return f"with {heads}\n{body}"
