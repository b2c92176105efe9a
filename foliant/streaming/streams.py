"""Streams: reading and running them, payment events and stale events.

Each operator takes a streaming DataFrame and returns one; ``run_to_table`` runs a stream over what there is and returns
what came out, so that a stream can be compared with its batch form. Quotas and balances are in ``ordered``, rate limits
and live usage in ``windows``, credits in ``credits``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.session import shared_path
from foliant.streaming.ordered import Clock

TERMINAL = ("completed", "failed", "cancelled")


def read_stream(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """A folder or file of parquet as a stream with the schema it has.

    The last letter goes as a pattern: a stream takes patterns for files as well as for folders.
    """
    schema = spark.read.parquet(path).schema
    path = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def run_to_table(stream: DataFrame, mode: str = "append", clock: Clock | None = None) -> DataFrame:
    """Runs a stream until its input is used up; rows with the number of their batch (column batch).

    With the clock that the stream was made with, what still waits for the watermark comes out as well.
    """
    spark = stream.sparkSession
    out = shared_path(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/rows/{number}")

    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])
    spark.createDataFrame([], schema).write.parquet(f"{out}/rows/none")  # a stream without input has a result, too
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(keep)
    writer.start().awaitTermination()
    if clock is not None:
        clock.strike()
        writer.start().awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{out}/rows")


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows that came out in update mode, the last of each key."""
    others = [c for c in rows.columns if c not in keys and c != "batch"]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("v"))
    return picked.select(*keys, "v.*")


def webhook_stream(events: DataFrame, delay: str = "30 days") -> DataFrame:
    """Terminal payment events (created_at, payment_id, status), the first of each payment within the delay."""
    return (
        events.where(F.lower("status").isin(*TERMINAL)).withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["payment_id"])
    )


def stale_split(events: DataFrame, now_epoch: int, ttl: int = 600) -> tuple[DataFrame, DataFrame]:
    """R2: events (epoch in seconds or milliseconds) that are fresh, and those that are refused as stale."""
    seconds = F.when(F.col("epoch") > 9_999_999_999, F.expr("epoch div 1000")).otherwise(F.col("epoch"))
    rows = events.withColumn("seconds", seconds)
    fresh = F.abs(F.lit(now_epoch) - F.col("seconds")) <= ttl
    return rows.where(fresh), rows.where(~fresh)
