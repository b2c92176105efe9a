"""Counters and sums that depend on order, one user or session having a third of all rows, against plain loops."""

import datetime as dt
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.operators import ledger, usage
from foliant.streaming import ordered as O

START = dt.datetime(2024, 1, 30)
USES = "id long, user_id long, kind string, event string, created_at timestamp"
PLANS = "user_id long, plan string, quota_deterministic long, quota_ai long"


def uses(n=900, seed=1, hours=100):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        user = 1 if i % 3 == 0 else rnd.randrange(2, 12)
        at = START + dt.timedelta(seconds=rnd.randrange(3600 * hours) if rnd.random() < 0.7 else 3600 * rnd.randrange(hours))
        rows.append((i, user, rnd.choice(["deterministic", "ai"]), rnd.choice(["use", "use", "use", "refund"]), at))
    return rows + [(n, 1, "ai", "use", None), (n + 1, 1, "ai", "refund", None), (n + 2, 1, "ai", "use", None)]


def counted(rows, quotas):
    """Outcome and counter of each row by going through a user's rows in order."""
    found, state = {}, {}
    for i, user, kind, event, at in sorted(rows, key=lambda r: (r[4] is not None, r[4] or 0, r[0])):
        if (user, kind) not in quotas:
            continue
        month, used = state.get((user, kind), (None, 0))
        now = at.strftime("%Y-%m") if at else None
        used = used if now == month else 0
        quota = quotas[user, kind]
        if event == "refund":
            outcome, used = "refunded", max(0, used - 1)
        elif quota is not None and used >= quota:
            outcome = "quota_exhausted"
        else:
            outcome, used = "accepted", used + 1
        state[user, kind] = now, used
        found[i] = (now, outcome, used)
    return found


@pytest.mark.parametrize("chunk_seconds", [1, 3600, 86400 * 365])
def test_quotas_with_refunds_of_a_hot_user(spark, chunk_seconds):
    plans = [(1, "a", 6, 0)] + [(u, "b", u % 4, None if u % 2 else 5) for u in range(2, 10)]
    quotas = {(u, k): q for u, _, *both in plans for k, q in zip(("deterministic", "ai"), both)}
    got = ledger.quota_with_refunds(spark.createDataFrame(uses(), USES), spark.createDataFrame(plans, PLANS), chunk_seconds)
    assert {r["id"]: (r["month"], r["outcome"], r["used"]) for r in got.collect()} == counted(uses(), quotas)
    assert ledger.quota_with_refunds(spark.createDataFrame([], USES), spark.createDataFrame(plans, PLANS)).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_steps_put_together_are_a_step(seed):
    rnd = random.Random(seed)
    rows = pd.DataFrame({"event": rnd.choices(["use", "refund"], [3, 2], k=60), "quota": rnd.choice([0.0, 3.0, 9.0, float("nan")])})
    cut = rnd.randrange(60)
    step = ledger.step_of(rows.iloc[cut:], ledger.step_of(rows.iloc[:cut]))
    assert step == ledger.step_of(rows)
    for used in range(4):
        if used <= (rows["quota"].iloc[0] if rows["quota"].notna().all() else 9):
            add, low, high = step
            assert min(max(used + add, low), high) == ledger.fold_quota(rows.assign(month="m"), "m", used)["used"].iloc[-1]


def test_balances_after_a_replay(spark):
    rows = [(i, 1 + i % 2, "credit" if i % 4 < 2 else "debit", 5 * i % 17 - 1, START + dt.timedelta(hours=i)) for i in range(60)]
    replayed = ledger.replay_requests(spark.createDataFrame(rows, "id long, user_id long, kind string, amount long, created_at timestamp"))
    last = {}
    for r in sorted(replayed.collect(), key=lambda r: r["id"]):
        last[r["user_id"]] = r["balance_after"]
    assert {r["user_id"]: r["balance"] for r in ledger.balances_after(replayed).collect()} == last


def test_turns_of_a_hot_session(spark):
    rnd = random.Random(2)
    rows = [(i, 1 if i % 3 else rnd.randrange(2, 20), START + dt.timedelta(hours=rnd.randrange(200)) if i % 50 else None, None if i % 41 == 0 else rnd.randrange(1000)) for i in range(600)]
    table = spark.createDataFrame(rows, "id long, session_id long, created_at timestamp, cost_micro long")
    want, state = {}, {}
    for i, session, at, cost in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0])):
        turn, total = state.get(session, (0, 0))
        state[session] = turn + 1, total + (cost or 0)
        want[i] = (session, *state[session])
    assert {r["id"]: (r["session_id"], r["turn"], r["micro_so_far"]) for r in usage.turn_costs(table).collect()} == want
    totals = {r["session_id"]: (r["turns"], r["usd"]) for r in usage.session_totals(table).collect()}
    assert totals == {s: (turns, pytest.approx(total / 1_000_000)) for s, (turns, total) in state.items()}


def test_plans_of_turn_costs_have_no_window_over_all_rows(spark):
    table = spark.createDataFrame([], "id long, session_id long, created_at timestamp, cost_micro long")
    plan = usage.turn_costs(table.where(F.col("id") >= 0))._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_quotas_of_many_short_chunks_take_seconds(spark):
    table = spark.range(40_000).selectExpr(
        "id", "1 + id % 7 as user_id", "if(id % 2 = 0, 'deterministic', 'ai') as kind", "if(id % 10 = 3, 'refund', 'use') as event",
        "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 60) as created_at")
    plans = spark.createDataFrame([(u, "a", 50 * u, None) for u in range(1, 8)], PLANS)
    began = time.time()
    got = ledger.quota_with_refunds(table, plans, 600).select("id", "month", "outcome", "used").collect()
    assert time.time() - began < 30  # a frame a chunk took several times that
    quotas = {(u, k): 50 * u if k == "deterministic" else None for u in range(1, 8) for k in ("deterministic", "ai")}
    assert {r["id"]: tuple(r)[1:] for r in got} == counted([tuple(r) for r in table.select("id", "user_id", "kind", "event", "created_at").collect()], quotas)


class Store:
    """The state of one key, with the number of calls."""

    def __init__(self):
        self.entries, self.value, self.timers, self.calls = {}, None, set(), 0

    def getMapState(self, *_):  # noqa: N802
        return self

    def getValueState(self, *_):  # noqa: N802
        store, state = self, type("Value", (), {})()
        state.exists = lambda: store.count(store.value is not None)
        state.get = lambda: store.count(store.value)
        state.update = lambda v: store.count(setattr(store, "value", v))
        return state

    def count(self, result):
        self.calls += 1
        return result

    def getValue(self, k):  # noqa: N802
        return self.count(self.entries.get(k))

    def containsKey(self, k):  # noqa: N802
        return self.count(k in self.entries)

    def updateValue(self, k, v):  # noqa: N802
        self.count(self.entries.update({k: v}))

    def removeKey(self, k):  # noqa: N802
        self.count(self.entries.pop(k, None))

    def keys(self):
        return self.count(list(self.entries))

    def registerTimer(self, at):  # noqa: N802
        self.count(self.timers.add(at))


class At:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms


HOUR = 3_600_000


def folded(triggers, store):
    """What comes out of one user's rows (created_us, id, kind, amount), a watermark in ms after each trigger."""
    row = T.StructType([T.StructField(n, t) for n, t in (("created_us", T.LongType()), ("id", T.LongType()), ("kind", T.StringType()), ("amount", T.LongType()))])
    kept = T.StructType([T.StructField("balance", T.LongType())])
    fold = O.InOrder(["user_id"], row, kept, ["id", "user_id", "kind", "amount", "outcome", "balance_after"], O.balance_fold, HOUR)
    fold.init(store)
    out = []
    for rows, watermark in triggers:
        if rows:
            out += fold.handleInputRows((1,), iter([pd.DataFrame(rows, columns=row.names)]), At(watermark))
        for at in sorted(t for t in store.timers if t <= watermark):
            store.timers.discard(at)
            out += fold.handleExpiredTimer((1,), At(watermark), At(at))
    return [tuple(r) for frame in out for r in frame[["id", "outcome", "balance_after"]].itertuples(index=False)]


def hourly(n, seed=5):
    rnd = random.Random(seed)
    return [(k * HOUR * 1000 + rnd.randrange(1000), k, rnd.choice(["credit", "debit"]), rnd.randrange(30)) for k in range(n)]


def test_a_key_in_many_steps_costs_few_calls_of_the_state():
    store = Store()
    assert len(folded([(hourly(100), 1000 * HOUR)], store)) == 100
    assert store.calls < 20 and not store.entries and not store.timers


@pytest.mark.parametrize("together", [1, 7, 2000])
def test_rows_wait_together_or_by_step(monkeypatch, together):
    monkeypatch.setattr(O, "TOGETHER", together)
    rows, rnd = hourly(90), random.Random(together)
    mixed = [rows[k : k + 30] for k in (0, 30, 60)]
    mixed[0], mixed[1] = mixed[0][:20] + mixed[1][:10], mixed[0][20:] + mixed[1][10:]
    for part in mixed:
        rnd.shuffle(part)
    store = Store()
    got = folded([(mixed[0], 15 * HOUR), ([], 18 * HOUR), (mixed[1], 20 * HOUR), (mixed[2], 50 * HOUR), ([], 1000 * HOUR)], store)
    outcomes, balances = ledger.replay_user(pd.DataFrame(rows, columns=["at", "id", "kind", "amount"]))[["outcome", "balance_after"]].T.values.tolist()
    assert got == list(zip(range(90), outcomes, balances)) and not store.entries
