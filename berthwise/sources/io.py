"""Readers and writers for the domain inputs and outputs (SRC1, SRC2, SNK2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from berthwise import schema as S


def read_calls(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """SRC1: the raw call log as CSV with a header, every column a string.

    No inference pass over the file set: columns stay strings, which keeps odd
    values (``"3,5"``, ``"9 to 10"``) for the typed
    cleaners instead of failing the read.
    """
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if schema is not None:
        reader = reader.schema(schema)
    # Without inferSchema every column is a string named by the header line.
    return reader.option("inferSchema", False).csv(path)


def read_port_doc(spark: SparkSession, path: str, port_key: str | None = None,
                  port_id: str | None = None) -> DataFrame:
    """SRC2: one nested port document -> one row ``(port_id, terminals, berths_details)``.

    ``berths_details`` is declared as a MAP so each berth is an entry rather
    than a struct field.  The document's top level holds one key per port; pass
    ``port_key`` to pick it (default: the only key).
    """
    raw = spark.read.text(path, wholetext=True)
    by_port = F.from_json("value", T.MapType(T.StringType(), S.PORT_BODY_SCHEMA))
    out = raw.select(F.explode(by_port).alias("port_key", "doc"))
    if port_key is not None:
        out = out.filter(F.col("port_key") == port_key)
    return out.select(
        (F.lit(port_id) if port_id else F.col("port_key")).alias("port_id"),
        F.col("doc.terminals").alias("terminals"),
        F.col("doc.berths_details").alias("berths_details"),
    )


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
                mode: str = "overwrite", fmt: str = "parquet") -> None:
    """SNK2: write a result table, partitioned (e.g. by ``port_id``)."""
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", True)
    w.save(path)
