"""Counts of tumbling windows that grow with a stream and refuse late rows openly.

Each trigger writes what its own rows add to the windows, under the trigger's number; the counts of a window are the sum
over triggers, so they don't depend on how rows are dealt to files and triggers. Rows further behind the latest event
time of earlier triggers than ``delay`` go to a table of their own. A trigger that is run again writes the same files
again: what it refuses depends on the times that earlier triggers have left.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.session import shared_path

# Calls allowed of each kind, and the window in seconds.
LIMITS = (("chat", 20, 60), ("login", 5, 60), ("register", 3, 60), ("purchase", 5, 60), ("reset", 3, 60), ("feedback", 3, 3600))


class Windowed(NamedTuple):
    counts: DataFrame  # window keys and sums over all triggers
    refused: DataFrame  # rows behind the delay, with the trigger that refused them


def limits(spark: SparkSession) -> DataFrame:
    """kind, allowed, seconds."""
    return spark.createDataFrame(list(LIMITS), "kind string, allowed bigint, seconds bigint")


def grow_windows(
    stream: DataFrame, add: Callable[[DataFrame], DataFrame], keys: list[str], time: str = "created_at", delay_seconds: int | None = None, out: str | None = None
) -> Windowed:
    """Runs ``stream`` until its input is used up; ``add`` makes of a trigger's rows the keys and the numbers to be added.

    Without ``delay_seconds`` no row is refused. ``out`` is the folder of an earlier run to go on with.
    """
    spark = stream.sparkSession
    out = out or shared_path(spark, "windows")
    spark.createDataFrame([], "latest timestamp, number bigint").write.mode("ignore").parquet(f"{out}/times/none")
    numbers = [c for c in add(spark.createDataFrame([], stream.schema)).schema if c.name not in keys]
    empty = add(spark.createDataFrame([], stream.schema))
    empty.write.mode("ignore").parquet(f"{out}/added/none")
    spark.createDataFrame([], stream.schema).withColumn("number", F.lit(0).cast("bigint")).write.mode("ignore").parquet(f"{out}/refused/none")

    def read(part: str, schema) -> DataFrame:
        return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{out}/{part}")

    def take(batch: DataFrame, number: int) -> None:
        # The rows are read again for each output, with its columns only: kept, they would take memory that grows with a trigger.
        earlier = read("times", "latest timestamp, number bigint").where(F.col("number") < number).agg(F.max("latest")).first()[0]
        behind = F.lit(False)
        if earlier is not None and delay_seconds is not None:
            behind = F.col(time) < F.lit(earlier) - F.make_dt_interval(secs=F.lit(delay_seconds))
        late = F.coalesce(behind, F.lit(False))
        add(batch.where(~late)).write.mode("overwrite").parquet(f"{out}/added/{number}")
        batch.where(late).withColumn("number", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{out}/refused/{number}")
        times = batch.agg(F.max(time).cast("timestamp").alias("latest")).select("latest", F.lit(number).cast("bigint").alias("number"))
        times.write.mode("overwrite").parquet(f"{out}/times/{number}")

    query = stream.writeStream.option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(take).start()
    query.awaitTermination()
    # Dealt by key first: hardly any row shares its key, so sums before a shuffle would hold nearly all rows of a file.
    added = read("added", empty.schema).repartition(*keys).groupBy(*keys).agg(*[F.sum(c.name).cast(c.dataType).alias(c.name) for c in numbers])
    return Windowed(added, read("refused", stream.withColumn("number", F.lit(0).cast("bigint")).schema))


RATE_KEYS = ["kind", "who", "start", "allowed"]


def rate_counts(rules: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Of requests (created_at, kind, who) the calls in each window of the rule of their kind; kinds without one go."""

    def add(requests: DataFrame) -> DataFrame:
        ruled = requests.join(rules, "kind")
        second = F.unix_seconds(F.col("created_at").cast("timestamp"))
        start = (second - F.pmod(second, F.col("seconds"))).cast("timestamp")
        calls = ruled.select("kind", "who", start.alias("start"), "allowed").repartition(*RATE_KEYS)
        return calls.groupBy(*RATE_KEYS).agg(F.count("*").alias("calls"))

    return add


def rate_limit_violations(counts: DataFrame) -> DataFrame:
    """Windows with more calls than their rule allows."""
    return counts.where(F.col("calls") > F.col("allowed")).select("kind", "who", "start", "calls", "allowed")


def usage_of_days(ledger: DataFrame) -> DataFrame:
    """Credits, calls and failures by day, of ledger rows (created_at, cost_credits, succeeded)."""
    return ledger.groupBy(F.to_date("created_at").alias("day")).agg(
        F.coalesce(F.sum("cost_credits"), F.lit(0)).alias("credits"), F.count("*").alias("calls"), F.count(F.when(~F.col("succeeded"), 1)).alias("failures")
    )
