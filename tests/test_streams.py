"""Streams give what their batch forms give, whatever files and triggers their rows come in."""

import datetime as dt
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from foliant.operators import ledger
from foliant.plans import billing_plans as BP
from foliant.plans import registry
from foliant.plans import stream_plans as SP
from foliant.session import read_table
from foliant.sources import fixtures as fx
from foliant.streaming import credits as C
from foliant.streaming import ordered as O
from foliant.streaming import streams as R
from foliant.streaming import windows as W


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def in_files(tmp_path, frames, name="in"):
    """A folder of one parquet file a frame, taken by a stream in the order given."""
    folder = tmp_path / name
    folder.mkdir()
    for k, frame in enumerate(frames):
        path = folder / f"part-{k:03d}.parquet"
        frame.to_parquet(path, index=False, coerce_timestamps="us")
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))
    return str(folder)


def dealt(table, files, seed):
    """A table in files whose rows and order have nothing to do with time."""
    mixed = table.sample(frac=1, random_state=seed)
    return [mixed.iloc[k::files] for k in range(files)]


def days(*which):
    """Two rows on each of these days of January, a frame a day."""
    frames = []
    for n, day in enumerate(which):
        times = [dt.datetime(2024, 1, day, k) for k in (3, 5)]
        frames.append(pd.DataFrame({"id": [2 * n, 2 * n + 1], "user_id": 1, "created_at": times, "cost_credits": [n + 1, 1], "succeeded": [True, n > 0]}))
    return frames


def test_balances(spark, sf):
    key = ("id", "user_id", "outcome", "balance_after")
    assert rows(registry.queries()["R6_balance_stream"](spark, sf), *key) == rows(ledger.replay_requests(fx.credit_requests(spark, sf)), *key)


def test_quotas(spark, sf):
    key = ("id", "kind", "outcome", "used")
    batch = ledger.quota_with_refunds(BP.uses(spark, sf), BP.user_plans(spark, sf))
    assert rows(registry.queries()["R5_quota_stream"](spark, sf), *key) == rows(batch, *key)


@pytest.mark.parametrize("seed", [1, 2])
def test_quotas_of_one_file_a_trigger(spark, sf, tmp_path, seed):
    table = read_table(spark, sf, "events").toPandas()
    path = in_files(tmp_path, dealt(table, 5, seed))
    clock = O.Clock(spark)
    stream = O.quota_stream(SP.quota_events(spark, sf, R.read_stream(spark, path, 1)), "4000 days", clock)
    key = ("id", "kind", "outcome", "used")
    batch = ledger.quota_with_refunds(BP.uses(spark, sf), BP.user_plans(spark, sf))
    assert rows(R.run_to_table(stream, clock=clock), *key) == rows(batch, *key)


def requests(table):
    return pd.DataFrame(table, columns=["id", "user_id", "kind", "amount", "created_at"])


def some_requests(n=120, seed=3):
    rnd = random.Random(seed)
    start = dt.datetime(2024, 3, 1)
    return [(i, rnd.choice([1, 1, 1, 2, 3]), rnd.choice(["credit", "debit", "debit"]), rnd.randint(-1, 40), start + dt.timedelta(hours=rnd.randint(0, 300))) for i in range(n)]


SHAPE = "id long, user_id long, kind string, amount long, created_at timestamp"


@pytest.mark.parametrize("share,seed", [(0.0, 1), (0.5, 2), (0.8, 3)])
def test_balances_go_on_where_a_batch_has_ended(spark, tmp_path, share, seed):
    table = sorted(some_requests(), key=lambda r: (r[4], r[0]))
    cut = table[int(share * len(table))][4]  # no time stands on both sides
    before, after = [r for r in table if r[4] < cut], [r for r in table if r[4] >= cut]
    first = ledger.replay_requests(spark.createDataFrame(before, SHAPE))
    clock = O.Clock(spark)
    stream = R.read_stream(spark, in_files(tmp_path, dealt(requests(after), 4, seed)), 1).withColumn("created_at", F.col("created_at").cast("timestamp"))
    rest = R.run_to_table(O.balance_stream(stream, "4000 days", clock, ledger.balances_after(first)), clock=clock)
    key = ("id", "user_id", "outcome", "balance_after")
    assert sorted(rows(first, *key) + rows(rest, *key)) == rows(ledger.replay_requests(spark.createDataFrame(table, SHAPE)), *key)


def test_a_row_behind_what_is_folded_comes_out_late(spark, tmp_path):
    at = dt.datetime(2024, 3, 1)
    frames = [
        requests([(0, 1, "credit", 5, at), (1, 2, "credit", 7, at)]),
        requests([(2, 1, "debit", 2, at + dt.timedelta(days=9))]),  # moves the watermark to 9 March
        requests([(3, 3, "credit", 1, at)]),  # a trigger in which the first rows are folded
        requests([(4, 1, "credit", 100, at), (5, 2, "debit", 3, at + dt.timedelta(days=2)), (6, 1, "debit", 2, at + dt.timedelta(days=10))]),
    ]
    clock = O.Clock(spark)
    stream = R.read_stream(spark, in_files(tmp_path, frames), 1).withColumn("created_at", F.col("created_at").cast("timestamp"))
    got = rows(R.run_to_table(O.balance_stream(stream, "1 day", clock), clock=clock), "id", "outcome", F.coalesce("balance_after", F.lit(-1)))
    # Row 4 can't be placed any more; row 5 is behind the watermark, too, but nothing of its user after it is folded.
    assert got == [(0, "applied", 5), (1, "applied", 7), (2, "applied", 3), (3, "applied", 1), (4, "late", -1), (5, "applied", 4), (6, "applied", 1)]


@pytest.mark.parametrize("per_trigger", [1, 100])
def test_days_lose_nothing_or_name_it(spark, tmp_path, per_trigger):
    path = in_files(tmp_path, days(20, 21, 22, 1))
    read = lambda: R.read_stream(spark, path, per_trigger).withColumn("created_at", F.col("created_at").cast("timestamp"))
    run = W.grow_windows(read(), W.usage_of_days, ["day"])
    whole = rows(run.counts, "day", "credits", "calls", "failures")
    assert whole == [(dt.date(2024, 1, 1), 5, 2, 0), (dt.date(2024, 1, 20), 2, 2, 1), (dt.date(2024, 1, 21), 3, 2, 0), (dt.date(2024, 1, 22), 4, 2, 0)]
    assert run.refused.count() == 0
    run = W.grow_windows(read(), W.usage_of_days, ["day"], delay_seconds=2 * 86400)
    refused = rows(run.refused, "id")
    assert refused == ([(6,), (7,)] if per_trigger == 1 else [])
    assert run.counts.agg(F.sum("calls")).first()[0] + len(refused) == 8


def test_windows_go_on_in_their_folder(spark, tmp_path):
    frames = days(20, 21, 22)
    path, out = in_files(tmp_path, frames[:2]), f"file://{tmp_path}/out"
    stream = lambda: R.read_stream(spark, path, 1).withColumn("created_at", F.col("created_at").cast("timestamp"))
    W.grow_windows(stream(), W.usage_of_days, ["day"], out=out)
    frames[2].to_parquet(f"{path}/part-100.parquet", index=False, coerce_timestamps="us")
    assert rows(W.grow_windows(stream(), W.usage_of_days, ["day"], out=out).counts, "credits", "calls") == [(2, 2), (3, 2), (4, 2)]


def test_all_limits_of_one_file_a_trigger(spark, tmp_path):
    at, rnd = dt.datetime(2024, 1, 1, 10), random.Random(4)
    calls = [(kind, who, second) for kind, _, _ in W.LIMITS for who, n in (("a", 4), ("b", 21), ("c", 3)) for second in rnd.sample(range(0, 50), n)]
    calls += [("feedback", "d", 60 * k) for k in (0, 20, 40, 59)] + [("feedback", "e", 60 * k) for k in (10, 30, 50, 70)]
    calls += [("login", "f", s) for s in (57, 58, 59, 60, 61, 62)] + [("other", "a", s) for s in range(40)]
    table = pd.DataFrame([(k, w, at + dt.timedelta(seconds=s)) for k, w, s in calls], columns=["kind", "who", "created_at"])
    stream = R.read_stream(spark, in_files(tmp_path, dealt(table, 4, 5)), 1).withColumn("created_at", F.col("created_at").cast("timestamp"))
    found = W.rate_limit_violations(W.grow_windows(stream, W.rate_counts(W.limits(spark)), W.RATE_KEYS).counts)
    over = [("chat", "b", 21)] + [(k, "b", 21) for k in ("feedback", "login", "purchase", "register", "reset")]
    over += [("feedback", "a", 4), ("register", "a", 4), ("reset", "a", 4), ("feedback", "d", 4)]
    assert rows(found, "kind", "who", "calls") == sorted(over)
    assert {r[0] for r in rows(found, "start")} == {at.replace(tzinfo=None)}


def payment_events():
    """Events of three payments: repeated, of an unknown user, not final, for a link, already credited."""
    at = dt.datetime(2024, 5, 1)
    table = [
        (1, 10, "completed", "credits", 1, None, 100), (2, 10, "COMPLETED", "credits", 1, None, 100), (3, 10, "completed", "credits", 1, None, 100),
        (4, 20, "completed", "credits", 99, None, 50), (5, 20, "pending", "credits", 1, None, 50), (6, 20, "failed", "credits", 1, None, 50),
        (7, 30, "completed", "credits", None, 5, 70), (8, 40, "completed", "credits", 2, None, 80), (9, 50, "completed", "link", None, 5, 90),
        (10, 30, "completed", "credits", None, 5, 70), (11, 60, "completed", "subscription", 2, None, 10),
    ]
    frame = pd.DataFrame(table, columns=["external_id", "payment_id", "status", "purpose", "user_id", "link_id", "amount"])
    frame[["user_id", "link_id"]] = frame[["user_id", "link_id"]].astype("Int64")
    return frame.assign(created_at=[at + dt.timedelta(minutes=k) for k in range(len(table))])


def credit_run(spark, path, per_trigger, out):
    users = spark.createDataFrame([(1,), (2,)], "id long")
    links = spark.createDataFrame([(5, 2)], "id long, user_id long")
    past = spark.createDataFrame([("purchase", "40"), ("usage", "10")], "type string, reference string")
    events = R.read_stream(spark, path, per_trigger).withColumn("created_at", F.col("created_at").cast("timestamp"))
    return C.credit_stream(events, users, links, past, out)


CREDITED = [(1, "10", 100), (2, "30", 70)]


@pytest.mark.parametrize("files,per_trigger,seed", [(1, 100, 0), (4, 1, 1), (11, 1, 2)])
def test_payments_are_credited_once(spark, tmp_path, files, per_trigger, seed):
    run = credit_run(spark, in_files(tmp_path, dealt(payment_events(), files, seed)), per_trigger, f"file://{tmp_path}/out")
    assert rows(run.ledger, "user_id", "reference", "amount") == CREDITED
    outcomes = {r["external_id"]: r["outcome"] for r in run.outcomes.collect()}
    assert len(outcomes) == 11 and sorted(outcomes[i] for i in (1, 2, 3)) == ["already_processed", "already_processed", "credited"]
    others = {4: "user_not_found", 5: "ignored_non_terminal", 6: "recorded", 8: "already_processed", 9: "link_settled", 11: "subscription_activated"}
    assert {i: outcomes[i] for i in others} == others


def test_a_trigger_run_again_credits_nothing_twice(spark, tmp_path, monkeypatch):
    path, out = in_files(tmp_path, [payment_events().iloc[:2], payment_events().iloc[2:]]), f"file://{tmp_path}/out"
    real, seen = C.settle, []

    def broken(batch, *rest):
        seen.append(1)
        if len(seen) == 2:  # what a broken run of this trigger may have left
            done = real(batch, *rest)
            done.write.parquet(f"{out}/outcomes/number=1")
            left = done.where("outcome = 'credited'").select(F.col("payer").alias("user_id"), F.col("payment_id").cast("string").alias("reference"), "amount", "external_id", "created_at")
            left.write.parquet(f"{out}/ledger/number=1")
            raise RuntimeError("stopped in mid-batch")
        return real(batch, *rest)

    monkeypatch.setattr(C, "settle", broken)
    with pytest.raises(Exception, match="stopped in mid-batch"):
        credit_run(spark, path, 1, out)
    monkeypatch.setattr(C, "settle", real)
    run = credit_run(spark, path, 1, out)
    assert rows(run.ledger, "user_id", "reference", "amount") == CREDITED and run.outcomes.count() == 11
    again = credit_run(spark, path, 1, out)  # nothing new: nothing changes
    assert rows(again.ledger, "user_id", "reference", "amount") == CREDITED and again.outcomes.count() == 11


def test_windows_are_counted_after_a_shuffle_by_key(spark, tmp_path):
    stream = R.read_stream(spark, in_files(tmp_path, days(20, 21)), 1).withColumn("created_at", F.col("created_at").cast("timestamp"))
    counts = W.grow_windows(stream, W.usage_of_days, ["day"]).counts
    assert counts.count() == 2 and "REPARTITION_BY_COL" in counts._jdf.queryExecution().executedPlan().toString()
