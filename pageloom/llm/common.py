"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where it is unset, a folder of our own in local mode; an error on a cluster."""
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if shared is None and current is None and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if current is None:
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="pageloom-checkpoint-"))
    return shared or context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and cut its lineage there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
