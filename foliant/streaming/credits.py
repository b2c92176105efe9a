"""Credits of payment events, written to a ledger once each, whatever is repeated or run again."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.operators.billing import with_outcome
from foliant.session import shared_path

LEDGER = "user_id bigint, reference string, amount bigint, external_id bigint, created_at timestamp"


class Credited(NamedTuple):
    ledger: DataFrame  # one row a credited payment, with the trigger that credited it
    outcomes: DataFrame  # every event with its outcome and trigger


def settle(batch: DataFrame, users: DataFrame, links: DataFrame, transactions: DataFrame) -> DataFrame:
    """Payment events with payer and outcome: of several that would credit a payment the first one does."""
    rows = with_outcome(batch, users, links, transactions)
    first = Window.partitionBy("payment_id", "outcome").orderBy("created_at", "external_id")
    repeated = (F.col("outcome") == "credited") & (F.row_number().over(first) > 1)
    return rows.withColumn("outcome", F.when(repeated, "already_processed").otherwise(F.col("outcome")))


def credit_stream(events: DataFrame, users: DataFrame, links: DataFrame, transactions: DataFrame, out: str | None = None) -> Credited:
    """Takes payment events (external_id, payment_id, status, purpose, user_id, link_id, amount, created_at) until
    they are used up and credits each payment once.

    A trigger joins its events with users, links and past credits: those of ``transactions`` and those that earlier
    triggers have written. What it writes lies under its number and replaces what a broken run of the same trigger has
    left there, and no trigger reads its own rows; so one that is run again writes the same. ``out`` is the folder of an
    earlier run to go on with.
    """
    spark = events.sparkSession
    out = out or shared_path(spark, "credits")
    decided = T.StructType([*events.schema.fields, *T._parse_datatype_string("payer bigint, outcome string").fields])
    schemas = {"ledger": T._parse_datatype_string(LEDGER), "outcomes": decided}

    def read(part: str) -> DataFrame:
        schema = T.StructType([*schemas[part].fields, T.StructField("number", T.LongType())])
        return spark.read.schema(schema).parquet(f"{out}/{part}")

    for part, schema in schemas.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{out}/{part}/number=-1")

    def take(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            mine = batch.select(F.col("payment_id").cast("string").alias("reference"))
            past = transactions.select("type", "reference").unionByName(
                read("ledger").where(F.col("number") < number).select(F.lit("purchase").alias("type"), "reference")
            )
            settle(batch, users, links, past.join(mine, "reference", "left_semi")).write.mode("overwrite").parquet(f"{out}/outcomes/number={number}")
            credited = read("outcomes").where((F.col("number") == number) & (F.col("outcome") == "credited"))
            credited.select(
                F.col("payer").alias("user_id"), F.col("payment_id").cast("string").alias("reference"), "amount", "external_id", "created_at"
            ).write.mode("overwrite").parquet(f"{out}/ledger/number={number}")
        finally:
            batch.unpersist()

    query = events.writeStream.option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(take).start()
    query.awaitTermination()
    return Credited(read("ledger"), read("outcomes"))
