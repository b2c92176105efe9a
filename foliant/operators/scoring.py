"""Hooks for classifiers that come from outside."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERDICT = "doc_id long, pos long, verdict_type string, verdict_level int, verdict_confidence double"
BATCH = 25


def verdicts_by_column(assessed: DataFrame, classifier: Callable[[Column], Column]) -> DataFrame:
    """Verdicts of blocks that need review by a function from text to struct(type, level, confidence)."""
    rows = assessed.where("needs_review").withColumn("v", classifier(F.col("text"))).where("v is not null")
    return rows.select("doc_id", "pos", F.col("v.type").alias("verdict_type"), F.col("v.level").alias("verdict_level"), F.col("v.confidence").alias("verdict_confidence"))


def full_verdicts(assessed: DataFrame, classifier: Callable[[Column], Column]) -> DataFrame:
    """Verdicts with all that a classifier says: its function goes from text to struct(is_heading, type, level,
    confidence, signals array<string>). What is no heading has no level; a confidence outside of 0 to 1 is cut to it."""
    rows = assessed.where("needs_review").withColumn("v", classifier(F.col("text"))).where("v is not null")
    heading = F.coalesce(F.col("v.is_heading"), F.lit(False))
    return rows.select(
        "doc_id", "pos", heading.alias("is_heading"), F.when(heading, "heading").otherwise(F.coalesce("v.type", F.lit("paragraph"))).alias("verdict_type"),
        F.when(heading, F.col("v.level")).alias("verdict_level"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("v.confidence"))).alias("verdict_confidence"),
        F.array_join(F.coalesce("v.signals", F.array().cast("array<string>")), ",").alias("signals"),
    )


def score_in_batches(assessed: DataFrame, scorer: Callable[[pd.DataFrame], pd.DataFrame], size: int = BATCH) -> DataFrame:
    """Verdicts of blocks that need review by a scorer that takes at most ``size`` rows (doc_id, pos, text) at once and
    returns type, level and confidence for each. Blocks that don't need review never reach it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), size):
                part = batch.iloc[at : at + size].reset_index(drop=True)
                out = scorer(part)
                yield pd.DataFrame({
                    "doc_id": part["doc_id"], "pos": part["pos"], "verdict_type": out["type"], "verdict_level": out["level"],
                    "verdict_confidence": out["confidence"],
                })

    return assessed.where("needs_review").select("doc_id", F.col("pos").cast("long"), "text").mapInPandas(run, VERDICT)
