"""Prices and money, in whole numbers.

Costs are counted in units of 1e-10 dollars (tokens times ten-thousandths of a dollar a million), so that no rounding
differs between engines; they leave as micro-dollars (``cost_micro``), dollars or credits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Credits of a dollar: (1 + 0.15) * (1 + 0.60) * 620 = 1140.8.
CREDIT_TENTHS = 11408


def cost_units(inp: str = "input_tokens", out: str = "output_tokens") -> Column:
    """From p_in, p_out, p_img of the price table; null where the model has no price."""
    image = F.col("p_img") * F.greatest(F.lit(1).cast("long"), F.col(out)) * 1_000_000
    return F.when(F.col("p_img").isNotNull(), image).when(
        F.col("p_in").isNotNull(), F.col(inp) * F.col("p_in") + F.col(out) * F.col("p_out")
    )


def div(a: Column, b: int) -> Column:
    """Quotient of a non-negative long by a whole number, without its fraction; exact."""
    return (a - a % F.lit(b).cast("long")).cast("decimal(38,0)") / F.lit(b)


def whole(a: Column, b: int) -> Column:
    return div(a, b).cast("long")


def micro_of_units(units: Column) -> Column:
    return whole(units + 5000, 10_000)


def credits_of_units(units: Column) -> Column:
    """Rounded up to whole credits; never below 0."""
    return whole(F.greatest(units, F.lit(0).cast("long")) * CREDIT_TENTHS + 99_999_999_999, 100_000_000_000)


def priced(calls: DataFrame, price_table: DataFrame) -> DataFrame:
    """Calls with the prices of their model (null where it has none); the price table is a few rows."""
    return calls.join(price_table, "model", "left")


def cost_usd(calls: DataFrame, price_table: DataFrame) -> DataFrame:
    """M1: id, model, usd; null for models without a price."""
    usd = micro_of_units(cost_units()) / 1_000_000
    return priced(calls, price_table).select("id", "model", usd.alias("usd"))


def usd_to_credits(calls: DataFrame, price_table: DataFrame) -> DataFrame:
    """M2: id, credits (0 without a price)."""
    return priced(calls, price_table).select(
        "id", credits_of_units(F.coalesce(cost_units(), F.lit(0).cast("long"))).alias("credits")
    )


# Per task, the models by plan; the first is used, the others are fallbacks.
DEEP, LLAMA, MINI, FOUR, SONNET, OPUS = (
    "deepseek/deepseek-chat", "meta-llama/llama-3.1-8b-instruct", "openai/gpt-4o-mini", "openai/gpt-4o",
    "anthropic/claude-3.5-sonnet", "anthropic/claude-3-opus",
)
IMAGE_MINI, IMAGE, SONAR = "openai/gpt-image-1-mini", "openai/gpt-image-1", "perplexity/llama-3.1-sonar-huge"
PLAN_SLUGS = ("default", "standard", "premium", "pro", "enterprise")
ROUTES = {
    "chat_text": ((DEEP, LLAMA), (DEEP, LLAMA), (DEEP, SONNET), (SONNET, DEEP), (SONNET, DEEP)),
    "document_analysis": ((DEEP, LLAMA), (SONNET, DEEP), (SONNET, DEEP), (SONNET, DEEP), (SONNET, DEEP)),
    "document_full_format": ((DEEP,), (SONNET, DEEP), (SONNET, DEEP), (OPUS, SONNET), (OPUS, SONNET)),
    "image_generation": ((IMAGE_MINI,), (IMAGE_MINI,), (IMAGE,), (IMAGE,), (IMAGE,)),
    "image_analysis": ((MINI, SONNET), (MINI, SONNET), (FOUR, SONNET), (FOUR, SONNET), (FOUR, SONNET)),
    "web_search": ((MINI, SONAR),) * 5,
}


def routes(spark) -> DataFrame:
    rows = [(task, slug, list(models)) for task, lists in ROUTES.items() for slug, models in zip(PLAN_SLUGS, lists)]
    return spark.createDataFrame(rows, "task string, slug string, models array<string>")


def route_model(requests: DataFrame, route_table: DataFrame) -> DataFrame:
    """M4: requests (id, task, slug) with model and fallbacks (joined by ``|``): the plan's list, else the default's."""
    own = route_table.select("task", "slug", F.col("models").alias("own"))
    base = route_table.where("slug = 'default'").select("task", F.col("models").alias("base"))
    models = F.coalesce("own", "base")
    return (
        requests.join(own, ["task", "slug"], "left")
        .join(base, "task", "left")
        .select("id", "task", "slug", F.get(models, F.lit(0)).alias("model"),
                F.array_join(F.slice(models, 2, 99), "|").alias("fallbacks"))
    )


def candidate_models(route_table: DataFrame) -> DataFrame:
    """M5: the distinct models of a task over all plans."""
    return route_table.select("task", F.explode("models").alias("model")).distinct()


def ceil_div(a: Column, b: int) -> Column:
    return whole(a + (b - 1), b)


def mode_estimate(docs: DataFrame, plan_slug: str, route_table: DataFrame, price_table: DataFrame) -> DataFrame:
    """M3: id, mode, input_tokens, output_tokens, credits of the three modes for documents with n_chars.

    regex is free; assisted sends a fifth of the text at the direct price; precision sends all of it to the plan's
    analysis model and adds the cost of formatting.
    """
    modes = F.explode(F.array(F.lit("regex"), F.lit("assisted"), F.lit("precision"))).alias("mode")
    assisted = F.col("mode") == "assisted"
    sent = F.when(assisted, whole(F.col("n_chars"), 5)).otherwise(F.col("n_chars"))
    hundredths = F.when(F.col("mode") == "precision", 8).otherwise(12)
    out = F.least(F.lit(16384), F.greatest(F.lit(200), ceil_div(F.col("n_chars") * hundredths, 300)))
    free = F.col("mode") == "regex"
    zero = F.lit(0).cast("long")
    rows = docs.select("id", "n_chars", modes).select(
        "id", "n_chars", "mode",
        F.when(free, zero).otherwise(F.greatest(F.lit(1), ceil_div(sent, 3))).alias("input_tokens"),
        F.when(free, zero).otherwise(out).cast("long").alias("output_tokens"),
        F.greatest(F.lit(500), ceil_div(F.col("n_chars"), 4), ceil_div(F.col("n_chars"), 3)).alias("format_tokens"),
    )
    model = lambda task: route_table.where((F.col("task") == task) & (F.col("slug") == plan_slug)).select(
        F.get("models", F.lit(0)).alias("model")
    )
    price = lambda task, a, b: F.broadcast(
        model(task).join(price_table, "model").select(F.col("p_in").alias(a), F.col("p_out").alias(b))
    )
    # Two rows of one line each: the prices of the plan's models.
    rows = rows.crossJoin(price("document_analysis", "a_in", "a_out")).crossJoin(price("document_full_format", "f_in", "f_out"))
    direct_in, direct_out = 2574, 10290  # Fixed values: the direct price, in ten-thousandths of a dollar a million.
    units = F.when(assisted, F.col("input_tokens") * direct_in + F.col("output_tokens") * direct_out).otherwise(
        F.col("input_tokens") * F.col("a_in") + F.col("output_tokens") * F.col("a_out")
    )
    formatting = F.when(
        F.col("mode") == "precision",
        F.greatest(F.lit(1), credits_of_units(F.col("format_tokens") * F.col("f_in") + 1500 * F.col("f_out"))),
    ).otherwise(zero)
    credits_ = F.when(free, zero).otherwise(F.greatest(F.lit(1), credits_of_units(units)) + formatting)
    return rows.select("id", "mode", "input_tokens", "output_tokens", credits_.cast("long").alias("credits"))


# Per currency, thousandths of a credit (FCFA) for one unit, and decimals.
CURRENCIES = (("XAF", 1000, 0), ("XOF", 1000, 0), ("EUR", 655957, 2), ("USD", 620000, 2))


def price_in_currency(invoices: DataFrame, currency: Column) -> DataFrame:
    """Id, currency, minor (amount in the minor unit, rounded half up), label."""
    rows = invoices.select("id", "amount", currency.alias("currency"))
    table = invoices.sparkSession.createDataFrame(list(CURRENCIES), "currency string, rate long, decimals int")
    minor = F.when(F.col("decimals") == 0, F.col("amount")).otherwise(
        F.expr("(amount * 200000 + rate) div (2 * rate)")
    )
    minor_part = F.lpad((F.col("minor") % 100).cast("string"), 2, "0")
    label = F.when(F.col("decimals") == 0, F.concat(F.col("minor"), F.lit(" "), F.col("currency"))).otherwise(
        F.concat(whole(F.col("minor"), 100), F.lit("."), minor_part, F.lit(" "), F.col("currency"))
    )
    return (
        rows.join(table, "currency")
        .withColumn("minor", minor)
        .select("id", "currency", "minor", label.alias("label"))
    )


# Minutes of a document skill by kind, at least 5.
SKILL_MINUTES = (("pdf", 8), ("pptx", 7), ("xlsx", 6), ("docx", 5))


def skill_cost(calls: DataFrame, kind: Column, paid: Column) -> DataFrame:
    """M7: credits of a skill call: tokens at 3 and 15 dollars a million and minutes at 0.05 dollars an hour; twice that
    at 620 credits, rounded up, at least 1; half as much again without a paid plan."""
    minutes = F.lit(5)
    for name, m in SKILL_MINUTES:
        minutes = F.when(F.col("kind") == name, m).otherwise(minutes)
    # in 1e-6 dollars times 1200: a minute costs 0.05 / 60 dollars = 1e6 / 1200 millionths
    cost = (F.col("input_tokens") * 3 + F.col("output_tokens") * 15) * 1200 + minutes * 1_000_000
    base = F.greatest(F.lit(1).cast("long"), ceil_div(cost * 2 * 620, 1_200_000_000))
    rows = calls.select("id", "input_tokens", "output_tokens", kind.alias("kind"), paid.alias("paid"))
    return rows.withColumn("base", base).select(
        "id", "kind", F.when(F.col("paid"), F.col("base")).otherwise(ceil_div(F.col("base") * 3, 2)).alias("credits")
    )


def failed_call_tokens(texts: DataFrame) -> DataFrame:
    """M8: tokens of a call that failed: a quarter of its characters, rounded up."""
    return texts.select("id", ceil_div(F.col("n_chars"), 4).alias("tokens"))


def reconcile_estimate(estimates: DataFrame, calls: DataFrame) -> DataFrame:
    """M9: estimates (reference, estimated) against what the ledger says: refund, absorbed overshoot.

    A reference without calls is refunded in full.
    """
    actual = calls.groupBy("reference").agg(F.sum("cost_credits").alias("actual"))
    diff = F.col("estimated") - F.coalesce("actual", F.lit(0))
    return estimates.join(actual, "reference", "left").select(
        "reference", "estimated", F.coalesce("actual", F.lit(0)).alias("actual"),
        F.greatest(diff, F.lit(0)).alias("refund"), F.greatest(-diff, F.lit(0)).alias("absorbed"),
    )


def proportional_refund(debited: Column, failed: Column, total: Column) -> Column:
    """0 if any is not positive, all if all failed, else the whole part of the share."""
    share = ((debited * failed) - (debited * failed) % total).cast("decimal(38,0)") / total
    zero = F.lit(0).cast("long")
    return (
        F.when((debited <= 0) | (failed <= 0) | (total <= 0), zero)
        .when(failed >= total, debited)
        .otherwise(share.cast("long"))
    )


def to_xof(amount: Column, rate_thousandths: int = 655957) -> Column:
    """An amount in whole units at a rate, rounded half up."""
    return whole(amount * rate_thousandths + 500, 1000)

