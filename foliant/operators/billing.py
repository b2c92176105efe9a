"""Subscriptions, payments, links and invoices; ``now`` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRACE_DAYS, RENEW_DAYS, REMIND_DAYS = 5, 3, 3


def at(now: str) -> Column:
    return F.lit(now).cast("timestamp_ntz")


def days_later(now: str, days: int) -> Column:
    return F.expr(f"timestamp_ntz'{now}' + make_dt_interval({days})")


def elapsed_days(start: Column, end: Column) -> Column:
    """Whole days between two times (not calendar boundaries)."""
    seconds = F.unix_timestamp(end.cast("timestamp")) - F.unix_timestamp(start.cast("timestamp"))
    return F.floor(seconds / 86400).cast("long")


def point_in_time_active(subscriptions: DataFrame, now: str) -> DataFrame:
    """Active subscriptions whose span holds ``now``; null bounds are open."""
    started = F.col("starts_at").isNull() | (F.col("starts_at") <= at(now))
    running = F.col("ends_at").isNull() | (F.col("ends_at") >= at(now))
    return subscriptions.where((F.col("status") == "active") & started & running).select("id", "user_id", "plan_id")


def due_for_renewal(subscriptions: DataFrame, users: DataFrame, plans: DataFrame, now: str) -> DataFrame:
    """Active and renewing subscriptions that end within three days, with their user and plan."""
    due = subscriptions.where("status = 'active' and auto_renew and ends_at is not null").where(
        F.col("ends_at") <= days_later(now, RENEW_DAYS)
    )
    return (
        due.join(users.select(F.col("id").alias("user_id"), "name"), "user_id", "left")
        .join(plans.select("plan_id", "slug"), "plan_id", "left")
        .select("id", "user_id", "name", "slug", "ends_at")
    )


def renewal_decision(subscriptions: DataFrame, plans: DataFrame) -> DataFrame:
    """The first reason against a renewal, or ``eligible``."""
    reason = (
        F.when(F.col("status") != "active", "not_active")
        .when(~F.col("auto_renew"), "auto_renew_disabled")
        .when(F.col("ends_at").isNull(), "no_end_date")
        .when(F.coalesce("price_fcfa", F.lit(0)) <= 0, "free_plan")
        .otherwise("eligible")
    )
    priced = plans.select("plan_id", "price_fcfa")
    return subscriptions.join(priced, "plan_id", "left").select("id", reason.alias("decision"))


def expired_past_grace(subscriptions: DataFrame, now: str) -> DataFrame:
    """Active or past-due subscriptions that ended over five days ago, as expired."""
    late = F.col("status").isin("active", "past_due") & (F.col("ends_at") < days_later(now, -GRACE_DAYS))
    return subscriptions.where(late).select("id", F.lit("expired").alias("status"), F.lit(False).alias("auto_renew"))


def renewal_reminders(subscriptions: DataFrame, users: DataFrame, plans: DataFrame, now: str) -> DataFrame:
    """Active subscriptions that end on the calendar day three days on and have no reminder yet."""
    day = F.to_date(days_later(now, REMIND_DAYS))
    due = subscriptions.where("status = 'active' and not reminded").where(F.to_date("ends_at") == day)
    return (
        due.join(users.select(F.col("id").alias("user_id"), "name"), "user_id")
        .join(plans.select("plan_id", F.col("name").alias("plan")), "plan_id")
        .select("id", "user_id", "name", "plan")
    )


def cancel_prorata(subscriptions: DataFrame, plans: DataFrame, now: str) -> DataFrame:
    """Refund of the remaining whole days, rounded; only for ends in the future; 30 days without a start."""
    total = F.greatest(F.lit(1).cast("long"), F.coalesce(elapsed_days(F.col("starts_at"), F.col("ends_at")), F.lit(30).cast("long")))
    left = elapsed_days(at(now), F.col("ends_at"))
    rows = subscriptions.where(F.col("ends_at") > at(now)).join(plans.select("plan_id", "price_fcfa"), "plan_id")
    rows = rows.select("id", "price_fcfa", total.alias("total_days"), left.alias("remaining_days"))
    return rows.select("id", "total_days", "remaining_days", F.expr("(2 * price_fcfa * remaining_days + total_days) div (2 * total_days)").alias("refund"))


def activation_dedupe(subscriptions: DataFrame) -> DataFrame:
    """One activation for each external_id; each ends a month on, or when the user's next one cancels it.

    Plan 3 (enterprise) is open-ended.
    """
    first = Window.partitionBy("external_id").orderBy("starts_at", "id")
    one = subscriptions.withColumn("number", F.row_number().over(first)).where("number = 1")
    after = F.lead("starts_at").over(Window.partitionBy("user_id").orderBy("starts_at", "id"))
    month = F.when(F.col("plan_id") != 3, F.expr("starts_at + make_ym_interval(0, 1)"))
    rows = one.select("id", "user_id", "external_id", "starts_at", month.alias("ends_at"), after.alias("next_start"))
    cancelled = F.col("next_start").isNotNull() & (F.col("ends_at").isNull() | (F.col("next_start") < F.col("ends_at")))
    return rows.select(
        "id", "user_id", "external_id", "starts_at", F.when(cancelled, F.col("next_start")).otherwise(F.col("ends_at")).alias("ends_at"),
        F.when(F.col("next_start").isNotNull(), "cancelled").otherwise("active").alias("status"),
    )


def failed_payment_state(subscriptions: DataFrame, now: str) -> DataFrame:
    """What a failed payment makes of active subscriptions."""
    return subscriptions.where("status = 'active'").select(
        "id", F.lit("past_due").alias("status"), F.lit(True).alias("auto_renew"), F.lit("failed").alias("last_payment_status"),
        days_later(now, GRACE_DAYS).alias("grace_until"),
    )


def payments_to_sync(payments: DataFrame, force: bool = False) -> DataFrame:
    """Pending payments never synchronised or tried fewer than five times; all pending ones with ``force``."""
    pending = payments.where(F.col("status").isin("PENDING", "PROCESSING"))
    if not force:
        pending = pending.where("last_synced_at is null or sync_attempts < 5")
    return pending.select("external_id", "payment_id", "status", "sync_attempts")


def purchase_references(transactions: DataFrame) -> DataFrame:
    return transactions.where("type = 'purchase'").select(F.col("reference").alias("known_reference")).distinct()


def with_outcome(events: DataFrame, users: DataFrame, links: DataFrame, transactions: DataFrame) -> DataFrame:
    """Payment events (external_id, payment_id, status, purpose, user_id, link_id) with ``payer`` and ``outcome``."""
    status = F.lower("status")
    rows = (
        events.join(links.select(F.col("id").alias("link_id"), F.col("user_id").alias("link_user"), F.lit(True).alias("has_link")), "link_id", "left")
        .withColumn("payer", F.coalesce("user_id", "link_user"))
        .join(users.select(F.col("id").alias("payer"), F.lit(True).alias("has_user")), "payer", "left")
        .join(purchase_references(transactions), F.col("payment_id").cast("string") == F.col("known_reference"), "left")
    )
    known = F.coalesce("has_user", F.lit(False))
    link_only = (F.col("purpose") == "link") & F.col("link_id").isNotNull()
    outcome = (
        F.when(~status.isin("completed", "failed", "cancelled"), "ignored_non_terminal")
        .when(~known & ~link_only, "user_not_found")
        .when(status != "completed", "recorded")
        .when(F.col("purpose") == "link", F.when(F.col("has_link"), "link_settled").otherwise("link_not_found"))
        .when(F.col("purpose") == "subscription", "subscription_activated")
        .when(F.col("known_reference").isNotNull(), "already_processed")
        .otherwise("credited")
    )
    return rows.select(*events.columns, "payer", outcome.alias("outcome"))


def webhook_outcome(events: DataFrame, users: DataFrame, links: DataFrame, transactions: DataFrame) -> DataFrame:
    """What becomes of each payment event (external_id, payment_id, status, purpose, user_id, link_id)."""
    return with_outcome(events, users, links, transactions).select("external_id", "payment_id", "outcome")


def reconcile_payments(payments: DataFrame, provider: DataFrame, users: DataFrame, transactions: DataFrame) -> DataFrame:
    """Pending payments against the provider's statuses: the new status, attempts and what is to be done."""
    pending = payments.where(F.col("status").isin("PENDING", "PROCESSING"))
    rows = (
        pending.join(provider.select("external_id", F.upper("provider_status").alias("now_status")), "external_id", "left")
        .join(users.select(F.col("id").alias("user_id"), F.lit(True).alias("has_user")), "user_id", "left")
        .join(purchase_references(transactions), F.col("payment_id").cast("string") == F.col("known_reference"), "left")
    )
    missing = F.col("now_status").isNull()
    waiting = F.col("now_status").isin("PENDING", "PROCESSING", "")
    action = (
        F.when(missing, "api_failed")
        .when(waiting, "still_pending")
        .when(F.col("known_reference").isNotNull(), "already_credited")
        .when(F.col("has_user").isNull(), "user_missing")
        .when(F.col("now_status") != "COMPLETED", "status_only")
        .when(F.col("purpose") == "subscription", "activate")
        .otherwise("credit")
    )
    counted = F.col("action").isin("api_failed", "still_pending", "already_credited")
    return rows.withColumn("action", action).select(
        "external_id", "action",
        F.when(F.col("action").isin("api_failed", "user_missing"), F.col("status")).when(F.col("now_status") == "", "PENDING").otherwise(F.col("now_status")).alias("status"),
        (F.col("sync_attempts") + counted.cast("long")).alias("sync_attempts"),
    )


def settle_link_decision(links: DataFrame, users: DataFrame, now: str) -> DataFrame:
    """What settling each payment link comes to."""
    rows = links.join(users.select(F.col("id").alias("user_id"), F.lit(True).alias("has_user")), "user_id", "left")
    decision = (
        F.when(F.col("status") == "paid", "already_paid")
        .when(F.col("status") == "cancelled", "cancelled")
        .when(F.col("expires_at") < at(now), "expired")
        .when(F.col("user_id").isNotNull() & F.col("has_user").isNull(), "recipient_missing")
        .when(F.col("user_id").isNull(), "pay_without_credit")
        .otherwise("pay")
    )
    return rows.select("id", decision.alias("decision"))


def payment_link_summary(links: DataFrame, now: str) -> DataFrame:
    """One row: usable pending links, paid ones and their amount, expired ones."""
    open_ = F.col("status") == "pending"
    late = F.coalesce(F.col("expires_at") < at(now), F.lit(False))
    paid = F.col("status") == "paid"
    return links.agg(
        F.count(F.when(open_ & ~late, 1)).alias("usable"), F.count(F.when(paid, 1)).alias("paid"),
        F.coalesce(F.sum(F.when(paid, F.col("amount"))), F.lit(0)).cast("long").alias("paid_amount"),
        F.count(F.when(open_ & late, 1)).alias("expired"),
    )


def invoice_numbers(invoices: DataFrame) -> DataFrame:
    """INV-YYYY-000001: numbered without gaps within each year, by (created_at, id); six digits at least, null
    without a date.

    Numbers are offsets of hours plus a rank within the hour, so that no year is ordered in one task.
    """
    hour = F.date_trunc("hour", "created_at")
    rows = invoices.select("id", "created_at", F.year("created_at").alias("year"), hour.alias("hour"))
    run = Window.partitionBy("year").orderBy("hour")
    before = (
        rows.where("hour is not null").groupBy("year", "hour").agg(F.count("*").alias("n")).select("hour", (F.sum("n").over(run) - F.col("n")).alias("before"))
    )
    rank = F.row_number().over(Window.partitionBy("hour").orderBy("created_at", "id"))
    number = (F.col("before") + F.col("rank")).cast("string")
    number = F.lpad(number, F.greatest(F.length(number), F.lit(6)), F.lit("0"))
    ranked = rows.where("hour is not null").withColumn("rank", rank).join(before, "hour")
    ranked = ranked.unionByName(rows.where("hour is null"), allowMissingColumns=True)
    return ranked.select("id", F.concat(F.lit("INV-"), F.col("year"), F.lit("-"), number).alias("number"))


# What each provider's raw status stands for.
PROVIDER_STATUS = (
    ("M", "1", "completed"), ("M", "7", "completed"), ("M", "-1", "cancelled"), ("M", "9", "cancelled"), ("M", "0", "failed"),
    ("G", "completed", "completed"), ("G", "failed", "failed"), ("G", "cancelled", "cancelled"),
    ("K", "completed", "completed"), ("K", "failed", "failed"), ("K", "cancelled", "cancelled"), ("K", "pending", "pending"), ("K", "processing", "pending"),
)


def status_normalize(events: DataFrame) -> DataFrame:
    """Id, provider, raw and the common status; ``unknown`` if the provider doesn't list the raw one."""
    table = events.sparkSession.createDataFrame(list(PROVIDER_STATUS), "provider string, raw_key string, common string")
    rows = events.withColumn("raw_key", F.lower(F.trim("raw")))
    return rows.join(F.broadcast(table), ["provider", "raw_key"], "left").select(
        "id", "provider", "raw", F.coalesce("common", F.lit("unknown")).alias("status")
    )


def signature_freshness(events: DataFrame, now_epoch: int, ttl: int = 600) -> DataFrame:
    """P5: events whose epoch (seconds, or milliseconds if beyond 9 999 999 999) is at most ``ttl`` seconds off."""
    seconds = F.when(F.col("epoch") > 9_999_999_999, F.expr("epoch div 1000")).otherwise(F.col("epoch"))
    return events.select("id", seconds.alias("seconds")).where(F.abs(F.lit(now_epoch) - F.col("seconds")) <= ttl)


def search_users(
    users: DataFrame, q: str | None = None, admins: bool = False, suspended: bool = False, with_credits: bool = False,
    sort: str = "id", limit: int | None = None,
) -> DataFrame:
    """Users by part of a name or exact id, flags and order; a page if ``limit`` is given."""
    if q:
        users = users.where(F.col("name").ilike(f"%{q}%") | (F.col("id").cast("string") == q))
    if admins:
        users = users.where("is_admin")
    if suspended:
        users = users.where("is_suspended")
    if with_credits:
        users = users.where("credits_balance > 0")
    order = {"credits": F.desc("credits_balance"), "name": F.asc("name"), "recent": F.desc("created_at")}.get(sort)
    users = users.orderBy(*([order] if order is not None else []), "id")
    return users.limit(limit) if limit else users


# The statuses of each bucket of documents.
BUCKETS = {"processing": ("pending", "processing", "detected", "validated", "generated"), "done": ("ready",), "failed": ("failed",)}


def documents_by_bucket(docs: DataFrame, bucket: str, q: str | None = None) -> DataFrame:
    """P3."""
    rows = docs.where(F.col("status").isin(*BUCKETS[bucket]))
    return (rows.where(F.col("filename").contains(q)) if q else rows).select("id", "filename", "status")


def child_counts(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """How many children each parent has, 0 included."""
    counts = children.groupBy(key).agg(F.count("*").alias("children"))
    return parents.join(counts, parents["id"] == counts[key], "left").select("id", F.coalesce("children", F.lit(0)).alias("children"))


def with_owner(docs: DataFrame, users: DataFrame) -> DataFrame:
    """The owner by the JSON key user_id of ``metadata``; null where there is none."""
    owner = F.get_json_object("metadata", "$.user_id").cast("long")
    people = users.select(F.col("id").alias("owner_id"), F.col("name").alias("owner"))
    return docs.withColumn("owner_id", owner).join(people, "owner_id", "left").select("id", "owner_id", "owner")


def not_yet_credited(payments: DataFrame, transactions: DataFrame) -> DataFrame:
    """Completed payments without a purchase of that reference."""
    done = payments.where("status = 'COMPLETED'")
    known = purchase_references(transactions)
    return done.join(known, done["payment_id"].cast("string") == known["known_reference"], "left_anti").select("external_id", "payment_id")


def latest_payment_per_link(payments: DataFrame) -> DataFrame:
    """Per link (a JSON key of ``metadata``) the payment with the largest external_id."""
    link = F.get_json_object("metadata", "$.payment_link_id").cast("long")
    return (
        payments.withColumn("link_id", link).where("link_id is not null").groupBy("link_id")
        .agg(F.max("external_id").alias("external_id"), F.max_by("status", "external_id").alias("status"))
    )
