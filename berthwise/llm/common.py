"""Shared pieces: word pattern, table reader, shared-folder tables, row keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from berthwise.session import checkpoint_dir

# ASCII white space and the word pattern of the contracts.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage on storage every executor reaches; Spark's commit protocol
    keeps exactly one attempt of each task, so lost executors do no harm."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/berthwise-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def empty_if_null(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))
