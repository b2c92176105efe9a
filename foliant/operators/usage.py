"""Usage and profitability: aggregates over the ledger of model calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def zero() -> Column:
    return F.lit(0).cast("long")


def total(col: str | Column) -> Column:
    return F.coalesce(F.sum(col), zero())


def count_where(condition: Column | str) -> Column:
    condition = F.expr(condition) if isinstance(condition, str) else condition
    return F.count(F.when(condition, 1))


def in_window(ledger: DataFrame, start: str | None, end: str | None, column: str = "created_at") -> DataFrame:
    """Rows from ``start`` to ``end``, both included; None is open."""
    if start is not None:
        ledger = ledger.where(F.col(column) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        ledger = ledger.where(F.col(column) <= F.lit(end).cast("timestamp_ntz"))
    return ledger


def usage_columns() -> list[Column]:
    return [
        (total("cost_micro") / 1_000_000).alias("usd"), total("cost_credits").alias("credits"), F.count("*").alias("attempts"),
        count_where("not succeeded").alias("failures"), count_where("is_fallback").alias("fallbacks"),
        total(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"),
    ]


def percent(part: Column, whole: Column) -> Column:
    """Share in percent, rounded half up to one decimal; 0 if the whole is 0. From whole numbers."""
    tenths = F.floor((part * 2000 + whole).cast("double") / (whole * 2).cast("double"))
    return F.when(whole > 0, tenths / 10).otherwise(F.lit(0.0))


def usage_totals(ledger: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """G1: one row."""
    return in_window(ledger, start, end).agg(*usage_columns())


def usage_totals_by(ledger: DataFrame, key: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """For each reference, session, document or user."""
    return in_window(ledger, start, end).groupBy(key).agg(*usage_columns())


def waste_by_user(ledger: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """The same over failed calls only."""
    return usage_totals_by(ledger.where(~F.col("succeeded")), "user_id", start, end)


def breakdown_by_model(ledger: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """By model and provider, the dearest first."""
    return (
        in_window(ledger, start, end)
        .groupBy("model", "provider")
        .agg(*usage_columns())
        .drop("fallbacks")
        .orderBy(F.desc("usd"), "model", "provider")
    )


def day_spine(spark, today: str, days: int) -> DataFrame:
    """``days`` days that end with ``today``."""
    last = F.lit(today).cast("date")
    return spark.range(0, days, 1, 1).select(F.date_sub(last, (F.lit(days - 1) - F.col("id")).cast("int")).alias("day"))


def daily(rows: DataFrame, measures: list[Column], today: str, days: int, column: str = "created_at") -> DataFrame:
    """One row for each of the ``days`` days up to ``today``; days without rows count 0."""
    first = F.date_sub(F.lit(today).cast("date"), days - 1)
    by_day = rows.where(F.col(column) >= first.cast("timestamp_ntz")).groupBy(F.to_date(column).alias("day")).agg(*measures)
    names = [c for c in by_day.columns if c != "day"]
    joined = day_spine(rows.sparkSession, today, days).join(by_day, "day", "left")
    return joined.select("day", *[F.coalesce(c, zero()).alias(c) for c in names])


def daily_ai_cost(ledger: DataFrame, today: str, days: int = 30) -> DataFrame:
    """G5."""
    measures = [total("cost_credits").alias("credits"), F.count("*").alias("calls"), count_where("not succeeded").alias("failures")]
    return daily(ledger, measures, today, days)


def daily_signups(users: DataFrame, today: str, days: int = 30) -> DataFrame:
    """G6."""
    return daily(users, [F.count("*").alias("signups")], today, days)


def daily_documents(docs: DataFrame, today: str, days: int = 30) -> DataFrame:
    """G7."""
    return daily(docs, [F.count("*").alias("total"), count_where("status = 'failed'").alias("failed")], today, days, "updated_at")


def series_empty_flag(series: DataFrame) -> DataFrame:
    """One row: is the grand total over all series 0?"""
    names = [c for c in series.columns if c != "day"]
    grand = sum((F.coalesce(F.sum(c), zero()) for c in names[1:]), F.coalesce(F.sum(names[0]), zero()))
    return series.agg((grand == 0).alias("empty"))


def consumption(ledger: DataFrame, *keys: Column | str) -> DataFrame:
    """Calls, failures, tokens and credits by key with failure rate and share of all credits, in percent."""
    grouped = ledger.groupBy(*keys).agg(
        F.count("*").alias("calls"), count_where("not succeeded").alias("failures"),
        total(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), total("cost_credits").alias("credits"),
    )
    # One row for each key, so the window over all of them is small.
    everything = F.sum("credits").over(Window.partitionBy())
    return grouped.withColumn("failure_rate", percent(F.col("failures"), F.col("calls"))).withColumn(
        "share", percent(F.col("credits"), everything)
    )


def consumption_by_provider(ledger: DataFrame) -> DataFrame:
    """G9."""
    return consumption(ledger, "provider", "model")


def consumption_by_task(ledger: DataFrame) -> DataFrame:
    """A blank task is shown as 'non précisé'."""
    task = F.when(F.coalesce("task_type", F.lit("")) == "", "non précisé").otherwise(F.col("task_type"))
    return consumption(ledger, task.alias("task_type")).drop("tokens", "failure_rate")


def profitability(invoices: DataFrame, ledger: DataFrame, today: str, days: int = 30) -> DataFrame:
    """Paid invoices by the day they were paid against the cost of the calls of the same days."""
    first = F.date_sub(F.lit(today).cast("date"), days - 1).cast("timestamp_ntz")
    income = invoices.where((F.col("status") == "paid") & (F.col("paid_at") >= first)).agg(
        total("amount").alias("revenue"), F.count("*").alias("paid_invoices")
    )
    cost = ledger.where(F.col("created_at") >= first).agg(
        total("cost_credits").alias("ai_credits"), F.count("*").alias("calls"), count_where("not succeeded").alias("failures"),
        total(F.when(~F.col("succeeded"), F.col("cost_credits"))).alias("failure_credits"),
    )
    # Two rows of totals, one each.
    return income.crossJoin(cost).select(
        "*", (F.col("revenue") - F.col("ai_credits")).alias("gap"), percent(F.col("failures"), F.col("calls")).alias("failure_rate")
    )


def lifetime_totals(invoices: DataFrame, ledger: DataFrame, users: DataFrame, docs: DataFrame) -> DataFrame:
    """One row over four tables."""
    paid = invoices.where("status = 'paid'").agg(total("amount").alias("revenue"), F.count("*").alias("paid_invoices"))
    calls = ledger.agg(
        total("cost_credits").alias("ai_credits"), F.count("*").alias("calls"), count_where("not succeeded").alias("failures")
    )
    people = users.agg(total("credits_balance").alias("credits_in_circulation"), F.count("*").alias("users"))
    return paid.crossJoin(calls).crossJoin(people).crossJoin(docs.agg(F.count("*").alias("documents")))


def billing_report(
    ledger: DataFrame, start: str | None = None, end: str | None = None, user_id: int | None = None, document_id: int | None = None
) -> DataFrame:
    """One aggregate row for a window, a user or a document."""
    from foliant.operators.pricing import credits_of_units

    rows = in_window(ledger, start, end)
    if user_id is not None:
        rows = rows.where(F.col("user_id") == user_id)
    if document_id is not None:
        rows = rows.where(F.col("document_id") == document_id)
    sums = rows.agg(
        F.count("*").alias("attempts"), count_where("not succeeded").alias("failures"), count_where("is_fallback").alias("fallbacks"),
        count_where("estimated").alias("estimated"), total(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"),
        total("cost_micro").alias("micro"), total("cost_credits").alias("credits"),
        total(F.when(~F.col("succeeded"), F.col("cost_credits"))).alias("leak_credits"),
    )
    return sums.select(
        "attempts", "failures", percent(F.col("failures"), F.col("attempts")).alias("failure_rate"), "fallbacks", "estimated", "tokens",
        (F.col("micro") / 1_000_000).alias("usd"), "credits", "leak_credits",
        percent(F.col("leak_credits"), F.col("credits")).alias("leak_rate"),
        credits_of_units(F.col("micro") * 10_000).alias("theoretical_credits"), F.lit(1.84).alias("coefficient"),
    )


def audited(ledger: DataFrame, price_table: DataFrame, limit: int | None) -> DataFrame:
    from foliant.operators.pricing import cost_units, credits_of_units, priced

    newest = ledger if limit is None else ledger.orderBy(F.desc("id")).limit(limit)
    expected = credits_of_units(F.coalesce(cost_units(), zero()))
    return priced(newest, price_table).withColumn("expected", expected).withColumn(
        "wrong", ~F.col("estimated") & (F.col("expected") != F.col("cost_credits"))
    )


def cost_audit(ledger: DataFrame, price_table: DataFrame, limit: int | None = None) -> DataFrame:
    """All calls, or the newest ``limit``: stored credits against those computed anew; estimated calls apart."""
    sums = audited(ledger, price_table, limit).agg(
        count_where("not estimated").alias("checked"), count_where("not estimated and not wrong").alias("consistent"),
        count_where("wrong").alias("mismatches"), count_where("estimated").alias("estimated"),
    )
    rate = F.floor((F.col("consistent") * 20000 + F.col("checked")).cast("double") / (F.col("checked") * 2)) / 10000
    return sums.withColumn("rate", F.when(F.col("checked") > 0, rate).otherwise(F.lit(1.0)))


def cost_audit_examples(ledger: DataFrame, price_table: DataFrame, limit: int | None = None, examples: int = 5) -> DataFrame:
    """The newest mismatches."""
    return (
        audited(ledger, price_table, limit).where("wrong").orderBy(F.desc("id")).limit(examples)
        .select("id", "model", F.col("cost_credits").alias("stored"), "expected")
    )


def cost_per_million_tokens(ledger: DataFrame) -> DataFrame:
    """Dollars for a million tokens of each call, to 4 decimals; null without tokens."""
    tokens = F.col("input_tokens") + F.col("output_tokens")
    tenths = F.floor((F.col("cost_micro") * 20000 + tokens).cast("double") / (tokens * 2).cast("double"))
    return ledger.select("id", F.when(tokens > 0, tenths / 10000).alias("usd_per_million"))


def multi_turn_cost(ledger: DataFrame) -> DataFrame:
    """Calls of a session as turns: total and the turns' costs in order."""
    turns = F.sort_array(F.collect_list(F.struct("id", "cost_micro")))
    return ledger.groupBy("session_id").agg(
        F.count("*").alias("turns"), (total("cost_micro") / 1_000_000).alias("usd"),
        F.array_join(F.transform(turns, lambda t: t["cost_micro"].cast("string")), ",").alias("turn_micro"),
    )


def turn_costs(ledger: DataFrame) -> DataFrame:
    """G16 by rows: each call of a session with its turn and what the session has cost up to it.

    Days of a session are added up first and its rows are ordered within a day, so that a session of any length is
    spread over tasks. A call without a time belongs to a day before all.
    """
    day = F.coalesce(F.to_date("created_at"), F.lit("0001-01-01").cast("date"))
    rows = ledger.select("session_id", "id", "created_at", "cost_micro", day.alias("day"))
    days = rows.groupBy("session_id", "day").agg(F.count("*").alias("n"), total("cost_micro").alias("micro"))
    earlier = Window.partitionBy("session_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    before = days.select("session_id", "day", F.coalesce(F.sum("n").over(earlier), zero()).alias("n_before"), F.coalesce(F.sum("micro").over(earlier), zero()).alias("micro_before"))
    in_day = Window.partitionBy("session_id", "day").orderBy("created_at", "id")
    so_far = F.sum(F.coalesce("cost_micro", zero())).over(in_day.rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(before, ["session_id", "day"]).select(
        "session_id", "id", (F.col("n_before") + F.row_number().over(in_day)).alias("turn"), "cost_micro", (F.col("micro_before") + so_far).alias("micro_so_far")
    )


def session_totals(ledger: DataFrame) -> DataFrame:
    """Turns and dollars of each session."""
    return ledger.groupBy("session_id").agg(F.count("*").alias("turns"), (total("cost_micro") / 1_000_000).alias("usd"))


def session_cost(messages: DataFrame) -> DataFrame:
    """Credits of a session's messages and one for each attachment, and the model last used."""
    return messages.groupBy("session_id").agg(
        (total("cost_credits") + total("attachments")).alias("credits"), F.count("*").alias("messages"),
        F.max_by("model_used", "turn").alias("last_model"),
    )


def message_precharge(messages: DataFrame) -> DataFrame:
    """What a message is charged beforehand: at least 1 credit, and one for each attachment."""
    estimate = F.greatest(F.lit(1).cast("long"), F.col("cost_credits"))
    return messages.select("session_id", "turn", (estimate + F.col("attachments")).alias("precharge"))


def usage_log(
    ledger: DataFrame, model: str | None = None, user_id: int | None = None, failures: bool = False, fallbacks: bool = False,
    page: int = 1, size: int = 50,
) -> DataFrame:
    """Newest first, by page."""
    if model:
        ledger = ledger.where(F.col("model").contains(model))
    if user_id is not None:
        ledger = ledger.where(F.col("user_id") == user_id)
    if failures:
        ledger = ledger.where(~F.col("succeeded"))
    if fallbacks:
        ledger = ledger.where("is_fallback")
    columns = ["id", "user_id", "model", "provider", "succeeded", "is_fallback", "cost_credits"]
    return ledger.select(columns).orderBy(F.desc("id")).offset((page - 1) * size).limit(size)


def normalize_usage_row(raw: DataFrame) -> DataFrame:
    """Defaults and bounds of a raw call; kind 'failure' has no output, kind 'fallback' is a fallback's."""
    fallback = F.col("kind") == "fallback"
    failure = F.col("kind") == "failure"
    return raw.select(
        "id", F.when(fallback, "deepseek_fallback").otherwise(F.coalesce("provider", F.lit("openrouter"))).alias("provider"),
        F.coalesce("model", F.lit("inconnu")).alias("model"), F.coalesce("task_type", F.lit("")).alias("task_type"),
        F.coalesce("input_tokens", zero()).alias("input_tokens"),
        F.when(failure, zero()).otherwise(F.coalesce("output_tokens", zero())).alias("output_tokens"),
        F.greatest(F.lit(1).cast("long"), F.coalesce("attempt", zero())).alias("attempt"),
        F.when(failure, False).when(fallback, True).otherwise(F.coalesce("succeeded", F.lit(False))).alias("succeeded"),
        fallback.alias("is_fallback"), F.when(fallback, F.col("fallback_from")).alias("fallback_from"),
        F.greatest(zero(), F.coalesce("cost_credits", zero())).alias("cost_credits"), F.substring("error", 1, 500).alias("error"),
    )
