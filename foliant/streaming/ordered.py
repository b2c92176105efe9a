"""Streams whose rows must be taken in order of event time: rows wait in state until the watermark has passed them.

A key's waiting rows lie in a map state: up to ``TOGETHER`` of them in one entry, more by step of event time. A timer at
the end of a step takes the rows of all steps that the watermark has passed, in order of (created_at, id), and folds them
into the key's state. So results depend on neither the files nor the triggers the rows came in, as long as they come within
the watermark's delay; a row of a step that has been folded already comes out with the outcome ``late`` and changes
nothing. Most keys have few rows and cost a few calls of the state store however many steps those are in; of a key with
many rows only a step's, and up to twice ``TOGETHER`` more, are in memory at a time.

Finite input ends with a clock: a source of its own whose one row, added when all else has been read, moves the watermark
past everything (``Clock``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from foliant.operators.ledger import fold_quota, replay_user
from foliant.session import shared_path

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
END_OF_TIME = "9000-01-01 00:00:00"
#: Rows of a key that wait in one entry of its map, whatever their steps, and the key of that entry.
TOGETHER = 2000
LOOSE = (-(1 << 62),)
#: Rows before and after the fold: what waits, and what comes out, with (created_at, id) and the key beside it.
Fold = Callable[[pd.DataFrame, tuple | None], tuple[pd.DataFrame, tuple]]


class Clock:
    """A stream of no rows until ``strike`` adds the one that ends a finite replay."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, shared_path(spark, "clock")
        self.write([], "none")

    def write(self, rows: list, name: str) -> None:
        self.spark.createDataFrame(rows, "at string").select(F.to_timestamp("at").alias("created_at")).write.parquet(f"{self.path}/{name}")

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema("created_at timestamp").parquet(f"{self.path}/*")

    def strike(self) -> None:
        self.write([(END_OF_TIME,)], "end")


class InOrder(StatefulProcessor):
    def __init__(self, keys: list[str], waiting: T.StructType, kept: T.StructType, out: list[str], fold: Fold, step_ms: int):
        self.keys, self.columns, self.out, self.fold, self.step_ms = keys, waiting.names, out, fold, step_ms
        self.plain = [int if isinstance(f.dataType, T.LongType) else f.dataType.fromInternal for f in waiting.fields]
        rows = T.ArrayType(waiting)
        self.schemas = T.StructType([T.StructField("rows", rows)]), T.StructType([*kept.fields, T.StructField("folded", T.LongType())])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", T.StructType([T.StructField("step", T.LongType())]), self.schemas[0])
        self.kept = handle.getValueState("kept", self.schemas[1])

    def of_key(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return rows.assign(**dict(zip(self.keys, key)))[self.out]

    def step_of(self, row: tuple) -> int:
        return row[0] // (1000 * self.step_ms)

    def waits(self, at: tuple) -> list[tuple]:
        found = self.waiting.getValue(at)  # None where there is no entry
        return [tuple(r) for r in found[0]] if found else []

    def by_step(self, rows: list[tuple]) -> dict[int, list[tuple]]:
        found: dict[int, list[tuple]] = {}
        for row in rows:
            found.setdefault(self.step_of(row), []).append(row)
        return found

    def call_at_end_of(self, step: int) -> None:
        self.handle.registerTimer((step + 1) * self.step_ms)

    def let_wait(self, fresh: list[tuple]) -> None:
        """Puts rows to those that wait; the earliest step of a key's loose rows has a timer, and each step of its own entry."""
        rows = self.waits(LOOSE) + fresh
        if len(rows) <= TOGETHER:
            self.waiting.updateValue(LOOSE, (rows,))
            self.call_at_end_of(min(map(self.step_of, fresh)))
            return
        for step, part in self.by_step(rows).items():
            self.waiting.updateValue((step,), (self.waits((step,)) + part,))
            self.call_at_end_of(step)
        self.waiting.removeKey(LOOSE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kept = self.kept.get()
        folded = kept[-1] if kept else None
        for batch in rows:
            steps = batch["created_us"] // (1000 * self.step_ms)
            if folded is not None and (steps <= folded).any():
                late = batch[steps <= folded]
                yield self.of_key(key, late.reindex(columns=[*late.columns, *[c for c in self.out if c not in late]]).assign(outcome="late"))
                batch = batch[steps > folded]
            columns = [[None if x is None or x != x else plain(x) for x in batch[c].tolist()] for c, plain in zip(self.columns, self.plain)]
            if len(batch):
                self.let_wait(list(zip(*columns)))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kept = self.kept.get()
        if kept is not None and kept[-1] >= expiredTimerInfo.getExpiryTimeInMs() // self.step_ms - 1:
            return  # taken by an earlier timer
        passed = timerValues.getCurrentWatermarkInMs() // self.step_ms
        loose = self.by_step(self.waits(LOOSE))
        own = {k[0] for k in self.waiting.keys()} - {LOOSE[0]}  # noqa: SIM118
        state, rows, last = tuple(kept)[:-1] if kept else None, [], None
        steps = sorted(s for s in {*loose, *own} if s < passed)
        for step in steps:
            more = loose.pop(step, [])
            if step in own:
                more += self.waits((step,))
                self.waiting.removeKey((step,))
            rows, last = rows + sorted(more, key=lambda r: r[:2]), step
            if len(rows) >= TOGETHER or step == steps[-1]:
                done, state = self.fold(pd.DataFrame(rows, columns=self.columns), state)
                rows = []
                yield self.of_key(key, done)
        if last is None:
            return
        self.kept.update((*state, last))
        if loose:
            self.waiting.updateValue(LOOSE, ([r for part in loose.values() for r in part],))
            self.call_at_end_of(min(loose))
        elif self.waiting.containsKey(LOOSE):
            self.waiting.removeKey(LOOSE)

    def close(self) -> None:
        pass


class Seeded(InOrder):
    """``InOrder`` that takes over what a batch job has left for each key (columns of the state)."""

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:  # noqa: N802, N803
        given = initialState[self.schemas[1].names[:-1]].iloc[0]
        self.kept.update((*[x.item() if hasattr(x, "item") else x for x in given], -(1 << 62)))


def fold_in_order(
    events: DataFrame, keys: list[str], waiting: str, kept: str, out: str, fold: Fold, delay: str, clock: Clock | None,
    initial: DataFrame | None = None, step_ms: int = 3_600_000,
) -> DataFrame:
    """Rows of events (keys, id, created_at and the other columns of ``waiting``) folded by key in order of (created_at, id).

    ``initial`` has the keys and the columns of ``kept``, one row a key. State lies in RocksDB, which the session is set to.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    named = ["created_us", "id", *[c for c in T._parse_datatype_string(waiting).names]]
    types = T.StructType([T.StructField("created_us", T.LongType()), T.StructField("id", T.LongType()), *T._parse_datatype_string(waiting).fields])
    ticking = events if clock is None else events.unionByName(clock.stream(), allowMissingColumns=True)
    # The time is read after the watermark and goes on as a number: rows behind the watermark reach the fold, to be named.
    timed = ticking.withWatermark("created_at", delay).withColumn("created_us", F.unix_micros("created_at"))
    rows = timed.where(F.col("created_at") < F.lit(END_OF_TIME).cast("timestamp")).select(*keys, *named)
    schema = T._parse_datatype_string(out)
    processor = (InOrder if initial is None else Seeded)(keys, types, T._parse_datatype_string(kept), schema.names, fold, step_ms)
    seed = None if initial is None else initial.groupBy(*keys)
    return rows.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "EventTime", initialState=seed)


def quota_fold(rows: pd.DataFrame, kept: tuple | None) -> tuple[pd.DataFrame, tuple]:
    out = fold_quota(rows, *(kept or (None, 0)))
    return out, (out["month"].iloc[-1], int(out["used"].iloc[-1]))


def quota_stream(events: DataFrame, delay: str = "1 day", clock: Clock | None = None) -> DataFrame:
    """Uses and refunds (id, user_id, kind, event, created_at, month, quota) against a monthly counter in state."""
    return fold_in_order(
        events, ["user_id", "kind"], "event string, month string, quota bigint", "month string, used bigint",
        "id bigint, user_id bigint, kind string, event string, month string, outcome string, used bigint", quota_fold, delay, clock,
    )


def balance_fold(rows: pd.DataFrame, kept: tuple | None) -> tuple[pd.DataFrame, tuple]:
    out = replay_user(rows, kept[0] if kept else 0)
    return out, (int(out["balance_after"].iloc[-1]),)


def balance_stream(requests: DataFrame, delay: str = "1 day", clock: Clock | None = None, balances: DataFrame | None = None) -> DataFrame:
    """Credits and debits (id, user_id, kind, amount, created_at) against a balance in state.

    ``balances`` (user_id, balance) are those that a batch replay ended with: the stream goes on from there.
    """
    return fold_in_order(
        requests, ["user_id"], "kind string, amount bigint", "balance bigint",
        "id bigint, user_id bigint, kind string, amount bigint, outcome string, balance_after bigint", balance_fold, delay, clock, balances,
    )
