"""Edge tables of money: refunds, ledgers, quotas, payments, subscriptions."""

import datetime as dt

from pyspark.sql import functions as F

from foliant.operators import billing, ledger, pricing, usage
from foliant.sources import fixtures as fx

T0 = dt.datetime(2024, 1, 1)


def at(days=0, seconds=0):
    return T0 + dt.timedelta(days=days, seconds=seconds)


def test_proportional_refund(spark):
    rows = [(100, 1, 3, 33), (100, 3, 3, 100), (100, 4, 3, 100), (0, 1, 3, 0), (100, 0, 3, 0), (100, 1, 0, 0), (-5, 1, 2, 0)]
    df = spark.createDataFrame(rows, "d long, f long, t long, want long")
    got = df.select(pricing.proportional_refund(F.col("d"), F.col("f"), F.col("t")).alias("r"), "want").collect()
    assert all(r.r == r.want for r in got)


def test_prices_and_credits(spark):
    calls = [(1, "openai/gpt-4o", 1_000_000, 0), (2, "openai/gpt-image-1", 0, 0), (3, "unknown", 5, 5), (4, "openai/gpt-4o", 0, 0), (5, "openai/gpt-4o-mini", 1, 1)]
    df = spark.createDataFrame(calls, "id long, model string, input_tokens long, output_tokens long")
    usd = {r.id: r.usd for r in pricing.cost_usd(df, fx.prices(spark)).collect()}
    assert usd == {1: 2.5, 2: 0.08, 3: None, 4: 0.0, 5: 0.000001}
    credits_ = {r.id: r.credits for r in pricing.usd_to_credits(df, fx.prices(spark)).collect()}
    assert credits_ == {1: 2852, 2: 92, 3: 0, 4: 0, 5: 1}


def test_refused_debits_have_no_effect(spark):
    steps = [("credit", 10), ("debit", 10), ("debit", 1), ("credit", 5), ("debit", 6), ("debit", 5), ("credit", 0), ("debit", -1)]
    rows = [(i, u, k, a, at(seconds=i)) for u in (1, 2) for i, (k, a) in enumerate(steps)]
    df = spark.createDataFrame(rows, "id long, user_id long, kind string, amount long, created_at timestamp_ntz")
    for user in (1, 2):
        got = [(r.outcome, r.balance_after) for r in ledger.replay_requests(df).where(F.col("user_id") == user).orderBy("id").collect()]
        low = "insufficient_balance"
        assert got == [("applied", 10), ("applied", 0), (low, 0), ("applied", 5), (low, 5), ("applied", 0), ("invalid_amount", 0), ("invalid_amount", 0)]


def test_credits_are_given_once(spark):
    rows = [(1, 1, "credit", 5, "a", at(0)), (2, 1, "credit", 5, "a", at(1)), (3, 1, "credit", 5, "", at(2)), (4, 1, "credit", 0, "b", at(3)), (5, 2, "credit", 7, "a", at(4)), (6, 1, "credit", 5, None, at(5))]
    df = spark.createDataFrame(rows, "id long, user_id long, kind string, amount long, reference string, created_at timestamp_ntz")
    got = {r.id: r.outcome for r in ledger.idempotent_credits(df).collect()}
    assert got == {1: "credited", 2: "already_processed", 3: "refused", 4: "refused", 5: "credited", 6: "refused"}
    twice = ledger.idempotent_credits(df.unionByName(df.withColumn("id", F.col("id") + 100))).where("outcome = 'credited'")
    assert sorted(r.id for r in twice.collect()) == [1, 5]


def test_quota_zero_null_and_refunds(spark):
    plans = spark.createDataFrame([(1, 2, 0), (2, None, None)], "user_id long, quota_deterministic int, quota_ai int")
    events = ["use", "use", "use", "refund", "use", "refund", "refund", "refund", "use"]
    rows = [(i, u, k, e, at(seconds=i)) for u in (1, 2) for k in ("deterministic", "ai") for i, e in enumerate(events)]
    rows += [(50, 1, "deterministic", "use", at(40))]
    df = spark.createDataFrame(rows, "id long, user_id long, kind string, event string, created_at timestamp_ntz")
    got = {(r.user_id, r.kind, r.id): (r.outcome, r.used) for r in ledger.quota_with_refunds(df, plans).collect()}
    assert [got[1, "deterministic", i][0] for i in range(5)] == ["accepted", "accepted", "quota_exhausted", "refunded", "accepted"]
    assert got[1, "deterministic", 7] == ("refunded", 0) and got[1, "deterministic", 50] == ("accepted", 1)
    assert {got[1, "ai", i][0] for i in (0, 1, 2, 4)} == {"quota_exhausted"} and got[2, "ai", 2] == ("accepted", 3)


def test_daily_series_is_filled_and_shares_sum_to_100(spark):
    rows = [(at(0), 5, True, "p", "m", 1, 1), (at(2), 7, False, "p", "n", 1, 1), (at(-10), 9, True, "q", "m", 1, 1)]
    df = spark.createDataFrame(rows, "created_at timestamp_ntz, cost_credits long, succeeded boolean, provider string, model string, input_tokens long, output_tokens long")
    got = usage.daily_ai_cost(df, "2024-01-03", 3).orderBy("day").collect()
    assert [(r.credits, r.calls, r.failures) for r in got] == [(5, 1, 0), (0, 0, 0), (7, 1, 1)]
    assert abs(sum(r.share for r in usage.consumption_by_provider(df).collect()) - 100) <= 0.15
    none = df.where("false")
    assert usage.series_empty_flag(usage.daily_ai_cost(none, "2024-01-03", 3)).first().empty
    assert usage.usage_totals(none.withColumns({"cost_micro": F.lit(0), "is_fallback": F.lit(False)})).first().attempts == 0


def test_signature_freshness_in_milliseconds(spark):
    df = spark.createDataFrame([(1, 1_700_000_600), (2, 1_700_000_601), (3, 1_700_000_600_999), (4, 1_699_999_400), (5, 1_699_999_399)], "id long, epoch long")
    assert sorted(r.id for r in billing.signature_freshness(df, 1_700_000_000).collect()) == [1, 3, 4]


def test_renewal_decisions(spark):
    rows = [(1, "active", True, at(5), 0), (2, "expired", True, at(5), 0), (3, "active", False, at(5), 0), (4, "active", True, None, 0), (5, "active", True, at(5), 3)]
    df = spark.createDataFrame(rows, "id long, status string, auto_renew boolean, ends_at timestamp_ntz, plan_id long")
    got = {r.id: r.decision for r in billing.renewal_decision(df, fx.plans(spark)).collect()}
    assert got == {1: "eligible", 2: "not_active", 3: "auto_renew_disabled", 4: "no_end_date", 5: "free_plan"}


def test_invoice_numbers_have_no_gaps(spark):
    rows = [(i, at(days=i * 13 % 700)) for i in range(200)]
    got = billing.invoice_numbers(spark.createDataFrame(rows, "id long, created_at timestamp_ntz")).collect()
    for year in {r.number[4:8] for r in got}:
        mine = sorted(int(r.number[9:]) for r in got if r.number[4:8] == year)
        assert mine == list(range(1, len(mine) + 1))


def test_invoice_numbers_beyond_six_digits_and_without_a_date(spark):
    many = spark.range(1_000_003).selectExpr("id", "timestamp_ntz'2024-03-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id) as created_at")
    got = billing.invoice_numbers(many.unionByName(spark.createDataFrame([(-1, None)], many.schema)))
    row = got.selectExpr("count(*) as n", "count(distinct number) as different", "max_by(number, id) as last", "count_if(number is null) as without").first()
    assert (row.n, row.different, row.last, row.without) == (1_000_004, 1_000_003, "INV-2024-1000003", 1)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "id long, user_id long, kind string, amount long, created_at timestamp_ntz")
    assert ledger.replay_requests(empty).count() == 0


def test_audit_covers_rows_beyond_the_newest(spark, sf):
    rows = fx.usage_ledger(spark, sf).crossJoin(spark.range(5001).select(F.col("id").alias("copy")).where("copy % 200 = 0"))
    n = rows.count()
    (row,) = usage.cost_audit(rows, fx.prices(spark)).collect()
    assert n > 5000 and row.checked + row.estimated == n
    (row,) = usage.cost_audit(rows, fx.prices(spark), limit=100).collect()
    assert row.checked + row.estimated == 100
