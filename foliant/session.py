"""Session helpers: reading tables and cutting lineage in the folder the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as Spark reads it; the path may be in any store Spark knows."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only in a local session (as in tests) a temporary folder is made and set where the setting is absent; on a cluster
    that is an error, since executors don't see the driver's folders.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master}")
        found = "file://" + tempfile.mkdtemp(prefix="spark-foliant-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new, unused folder name under the shared folder."""
    return f"{shared_dir(spark)}/foliant-{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back.

    Cuts lineage so that a lost executor costs a re-read and not the whole job, and gives later plans an input of
    known size with no partitioning of its own (so that Spark can split skewed joins over it).
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
