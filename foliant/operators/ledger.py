"""Credit ledgers and quotas."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators.usage import zero


def with_balance(transactions: DataFrame) -> DataFrame:
    """Transactions with ``balance``, the sum of ``signed`` so far per user in the order of (created_at, id).

    Sums of days come first and are added up per user; rows are then ordered within a user's day only, so a user with a
    large part of all rows is spread over tasks.
    """
    day = F.coalesce(F.to_date("created_at"), F.lit("0001-01-01").cast("date"))
    rows = transactions.withColumn("day", day)
    so_far = Window.partitionBy("user_id").orderBy("day")
    days = rows.groupBy("user_id", "day").agg(F.sum("signed").alias("of_day"))
    before = days.select(
        F.col("user_id").alias("u"), F.col("day").alias("d"), (F.sum("of_day").over(so_far) - F.col("of_day")).alias("before")
    )
    run = Window.partitionBy("user_id", "day").orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(before, rows["user_id"].eqNullSafe(before["u"]) & (rows["day"] == before["d"]))
    return joined.withColumn("balance", F.col("before") + F.sum("signed").over(run)).drop("day", "before", "u", "d")


def running_balance(transactions: DataFrame) -> DataFrame:
    """L1: id, user_id, signed amount and the balance after it."""
    return with_balance(transactions).select("id", "user_id", "signed", "balance")


def balance_audit(transactions: DataFrame, stored: Column) -> DataFrame:
    """L1: per user, how many stored balances differ from the running sum, and the first id that does.

    ``stored`` may refer to ``balance``, the running sum.
    """
    rows = with_balance(transactions).withColumn("stored", stored)
    wrong = F.col("stored") != F.col("balance")
    return rows.groupBy("user_id").agg(
        F.count("*").alias("rows"), F.count(F.when(wrong, 1)).alias("wrong"), F.min(F.when(wrong, F.col("id"))).alias("first_wrong")
    )


def spans(batch: pd.DataFrame, keys: list[str]) -> Iterator[tuple[tuple, int, int]]:
    """The stretches of a sorted batch with the same keys, each as key, begin and end; a row whose key is
    missing (not equal to itself) is a stretch of its own."""
    new = np.ones(len(batch), dtype=bool)
    columns = [batch[k].to_numpy() for k in keys]
    if len(batch):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    begins = np.flatnonzero(new)
    heads = zip(*[c[begins].tolist() for c in columns])
    return zip(heads, begins.tolist(), [*begins[1:].tolist(), len(batch)])


def replay(kinds: list, amounts: list, balance: int = 0) -> tuple[list, list]:
    """Outcomes and balances of one user's requests in order."""
    outcomes, balances = [], []
    for kind, amount in zip(kinds, amounts):
        if amount <= 0:
            outcome = "invalid_amount"
        elif kind == "debit" and amount > balance:
            outcome = "insufficient_balance"
        else:
            outcome = "applied"
            balance += amount if kind == "credit" else -amount
        outcomes.append(outcome)
        balances.append(balance)
    return outcomes, balances


def replay_user(rows: pd.DataFrame, balance: int = 0) -> pd.DataFrame:
    """Requests of one user in order: amounts that aren't positive and debits beyond the balance have no effect."""
    outcomes, balances = replay(rows["kind"].tolist(), rows["amount"].tolist(), balance)
    return rows.assign(outcome=outcomes, balance_after=balances)


REPLAYED = "id long, user_id long, kind string, amount long, outcome string, balance_after long"


def replay_requests(requests: DataFrame) -> DataFrame:
    """L2: outcome and balance of each request. A refused debit leaves the balance, so no running sum can say it.

    Requests of a user are folded as an ordered stream of batches, so that one user's history needn't fit in memory.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, balance = object(), 0
        for batch in batches:
            kinds, amounts, outcomes, balances = batch["kind"].tolist(), batch["amount"].tolist(), [], []
            for (key,), begin, end in spans(batch, ["user_id"]):
                key = None if pd.isna(key) else key  # rows without a user come one by one and go on as one user
                done, after = replay(kinds[begin:end], amounts[begin:end], balance if key == user else 0)
                user, balance = key, after[-1]
                outcomes += done
                balances += after
            yield batch.assign(outcome=outcomes, balance_after=balances)[["id", "user_id", "kind", "amount", "outcome", "balance_after"]]

    ordered = requests.select("id", "user_id", "kind", "amount", "created_at").repartition("user_id")
    return ordered.sortWithinPartitions("user_id", "created_at", "id").drop("created_at").mapInPandas(run, REPLAYED)


def balances_after(replayed: DataFrame) -> DataFrame:
    """user_id, balance: what a replay has left each user with.

    Balances change by applied requests only, so they are a sum and need no order.
    """
    signed = F.when(F.col("kind") == "credit", F.col("amount")).otherwise(-F.col("amount"))
    applied = F.when(F.col("outcome") == "applied", signed).otherwise(F.lit(0))
    return replayed.groupBy("user_id").agg(F.sum(applied).alias("balance"))


def idempotent_credits(requests: DataFrame) -> DataFrame:
    """L3: credits by outcome: only the first with a reference counts; a blank reference or amount is refused."""
    valid = (F.coalesce("reference", F.lit("")) != "") & (F.col("amount") > 0)
    first = Window.partitionBy("user_id", "reference").orderBy("created_at", "id")
    outcome = F.when(F.row_number().over(first) == 1, "credited").otherwise("already_processed")
    rows, columns = requests.where("kind = 'credit'").withColumn("valid", F.coalesce(valid, F.lit(False))), ["id", "user_id", "reference", "amount"]
    refused = rows.where("not valid").select(*columns, F.lit("refused").alias("outcome"))  # ranked by nobody
    return rows.where("valid").select(*columns, outcome.alias("outcome")).unionByName(refused)


def active_plan_per_user(users: DataFrame, subscriptions: DataFrame, plans: DataFrame, at: str) -> DataFrame:
    """Each user's plan at a time: of the active subscriptions the latest, else ``default``."""
    when = F.lit(at).cast("timestamp_ntz")
    live = subscriptions.where(F.col("status") == "active").where(
        (F.col("starts_at").isNull() | (F.col("starts_at") <= when)) & (F.col("ends_at").isNull() | (F.col("ends_at") >= when))
    )
    latest = live.groupBy("user_id").agg(F.max_by("plan_id", F.struct("starts_at", "id")).alias("plan_id"))
    named = latest.join(plans.select("plan_id", "slug", "quota_deterministic", "quota_ai"), "plan_id", "left")
    joined = users.select(F.col("id").alias("user_id")).join(named.withColumn("subscribed", F.lit(True)), "user_id", "left")
    subscribed = F.coalesce("subscribed", F.lit(False))
    return joined.select(
        "user_id", F.coalesce("slug", F.lit("default")).alias("plan"),
        F.when(subscribed, F.col("quota_deterministic")).otherwise(F.lit(5)).alias("quota_deterministic"),
        F.when(subscribed, F.col("quota_ai")).otherwise(F.lit(0)).alias("quota_ai"),
    )


def quotas(user_plans: DataFrame) -> DataFrame:
    """user_id, kind, quota (null: unlimited)."""
    kinds = F.array(
        *[F.struct(F.lit(k).alias("kind"), F.col(f"quota_{k}").alias("quota")) for k in ("deterministic", "ai")]
    )
    return user_plans.select("user_id", F.explode(kinds).alias("k")).select("user_id", "k.kind", "k.quota")


def monthly_usage_status(uses: DataFrame, user_plans: DataFrame, month: str) -> DataFrame:
    """Used, quota, remaining and unlimited of a month, for each user and kind of use."""
    used = uses.where(F.date_format("created_at", "yyyy-MM") == month).groupBy("user_id", "kind").agg(F.count("*").alias("used"))
    left = F.when(F.col("quota").isNotNull(), F.greatest(zero(), F.col("quota") - F.coalesce("used", zero())))
    return quotas(user_plans).join(used, ["user_id", "kind"], "left").select(
        "user_id", "kind", F.coalesce("used", zero()).alias("used"), "quota", left.alias("remaining"),
        F.col("quota").isNull().alias("unlimited"),
    )


def quota_admission(uses: DataFrame, user_plans: DataFrame) -> DataFrame:
    """The first ``quota`` uses of each month are accepted, the others are refused."""
    month = Window.partitionBy("user_id", "kind", F.date_format("created_at", "yyyy-MM")).orderBy("created_at", "id")
    numbered = uses.select("id", "user_id", "kind", F.row_number().over(month).cast("long").alias("number"))
    ok = F.col("quota").isNull() | (F.col("number") <= F.col("quota"))
    return numbered.join(quotas(user_plans), ["user_id", "kind"]).select(
        "id", "user_id", "kind", "number", F.when(ok, "accepted").otherwise("quota_exhausted").alias("outcome")
    )


def count_quota(events: list, months: list, quotas: list, month: str | None = None, used: int = 0) -> tuple[list, list, tuple]:
    """Outcomes and counters of one user's uses and refunds of a kind, and the month and counter they end with."""
    outcomes, counts = [], []
    for event, m, quota in zip(events, months, quotas):
        if m != month:
            month, used = m, 0
        if event == "refund":
            used, outcome = max(0, used - 1), "refunded"
        elif quota is not None and quota == quota and used >= quota:  # a quota that isn't equal to itself is none
            outcome = "quota_exhausted"
        else:
            used, outcome = used + 1, "accepted"
        outcomes.append(outcome)
        counts.append(used)
    return outcomes, counts, (month, used)


def fold_quota(rows: pd.DataFrame, month: str | None = None, used: int = 0) -> pd.DataFrame:
    """Uses and refunds of one user and kind in order; a new month starts at 0, a refund never goes below."""
    outcomes, counts, _ = count_quota(list(rows["event"]), list(rows["month"]), list(rows["quota"]), month, used)
    return rows.assign(outcome=outcomes, used=counts)


QUOTED = "id long, user_id long, kind string, event string, month string, outcome string, used long"


#: More than any counter reaches: the upper bound where there is no quota.
UNBOUNDED = 1 << 60
STEPS = "user_id long, kind string, month string, chunk long, add long, low long, high long"


def step_of(rows: pd.DataFrame | dict[str, list], step: tuple[int, int, int] = (0, 0, UNBOUNDED)) -> tuple[int, int, int]:
    """What uses and refunds in order make of a counter x: min(max(x + add, low), high), as (add, low, high).

    A use is min(x + 1, quota) and a refund max(x - 1, 0); put after such a step, each gives such a step again.
    """
    add, low, high = step
    for event, quota in zip(rows["event"], rows["quota"]):
        if event == "refund":
            add, low, high = add - 1, max(low - 1, 0), max(high - 1, 0)
        else:
            most = UNBOUNDED if pd.isna(quota) else int(quota)
            add, low, high = add + 1, min(low + 1, most), min(high + 1, most)
    return add, low, high


def quota_with_refunds(events: DataFrame, user_plans: DataFrame, chunk_seconds: int = 3600) -> DataFrame:
    """Uses and refunds (column ``event``) in order: refunds make room, so no row number can say it.

    A user's month is cut into chunks of time. Each chunk, read as an ordered stream, comes down to three numbers
    (``step_of``); following the counter over a month's chunks (at most 745 of an hour) says where each begins, and then
    each is folded from there. So a user with a large part of all rows is spread over tasks. Quotas don't fall below 0.
    """
    at = F.col("created_at").cast("timestamp")
    chunk = F.coalesce(F.floor(F.unix_seconds(at) / chunk_seconds), F.lit(-(1 << 40)))
    rows = events.select("id", "user_id", "kind", "event", "created_at", F.date_format("created_at", "yyyy-MM").alias("month"), chunk.alias("chunk"))
    rows = rows.join(quotas(user_plans), ["user_id", "kind"]).withColumn("of_month", F.coalesce("month", F.lit("")))
    keys = ["user_id", "kind", "of_month", "chunk"]

    def in_chunks(df: DataFrame) -> DataFrame:
        return df.repartition(*keys).sortWithinPartitions(*keys, "created_at", "id")

    # Most stretches are a row or two, so rows go through as lists, not as a frame for each stretch.
    def steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, step = None, None
        for batch in batches:
            event, quota, done = batch["event"].tolist(), batch["quota"].tolist(), []
            for key, begin, end in spans(batch, keys):
                if key != last and last is not None:
                    done.append((*last, *step))
                part = {"event": event[begin:end], "quota": quota[begin:end]}
                step = step_of(part, step) if key == last else step_of(part)
                last = key
            yield pd.DataFrame(done, columns=[*keys, "add", "low", "high"])
        if last is not None:
            yield pd.DataFrame([(*last, *step)], columns=[*keys, "add", "low", "high"])

    made = in_chunks(rows).select(*keys, "event", "quota").mapInPandas(steps, STEPS.replace("month", "of_month"))
    after = lambda x, s: F.least(F.greatest(x + s["add"], s["low"]), s["high"])
    none = F.struct(F.lit(0).cast("long").alias("x"), F.array().cast("array<struct<chunk:bigint,start:bigint>>").alias("starts"))
    passed = lambda so_far, s: F.struct(
        after(so_far["x"], s).alias("x"), F.concat(so_far["starts"], F.array(F.struct(s["chunk"].alias("chunk"), so_far["x"].alias("start")))).alias("starts")
    )
    ordered = made.groupBy("user_id", "kind", "of_month").agg(F.sort_array(F.collect_list(F.struct("chunk", "add", "low", "high"))).alias("steps"))
    starts = ordered.select("user_id", "kind", "of_month", F.explode(F.aggregate("steps", none, passed, lambda x: x["starts"])).alias("s")).select("user_id", "kind", "of_month", "s.*")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, used = None, 0
        for batch in batches:
            columns = [batch[c].tolist() for c in ("event", "of_month", "quota", "start")]
            outcome, counts = [], []
            for key, begin, end in spans(batch, keys):
                event, month, quota, start = (c[begin:end] for c in columns)
                outcomes, used_after, (_, now) = count_quota(event, month, quota, key[2], used if key == last else start[0])
                outcome += outcomes
                counts += used_after
                last, used = key, now
            yield batch.assign(outcome=outcome, used=counts)[["id", "user_id", "kind", "event", "month", "outcome", "used"]]

    return in_chunks(rows.join(starts, keys)).drop("created_at").mapInPandas(run, QUOTED)
