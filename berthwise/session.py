"""Session construction and shared-storage helpers."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on: UTC session clock (timestamps are naive local
# port time and must not shift), AQE for runtime coalescing and skew joins.
_BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "berthwise", extra: dict | None = None) -> SparkSession:
    """Return (or create) a session with the library's required settings.

    On a cluster the master and resources come from spark-submit; ``master`` is
    only used for local runs and tests.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(_BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    # getOrCreate may return an existing session: enforce the SQL-level settings.
    for k, v in conf.items():
        if k.startswith("spark.sql."):
            spark.conf.set(k, v)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only when the setting is absent (local tests) do we pick a scratch folder
    and register it, so that ``DataFrame.checkpoint()`` cuts lineage on storage
    every executor can reach.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="berthwise-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, for sessions started outside its folder (with
    spark-submit, ``--py-files`` does the same)."""
    import os
    import shutil
    import berthwise
    home = os.path.dirname(os.path.dirname(os.path.abspath(berthwise.__file__)))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="berthwise-"), "berthwise"), "zip", home, "berthwise")
    spark.sparkContext.addPyFile(archive)


def cut_lineage(df, spark: SparkSession | None = None):
    """Materialise ``df`` reliably (survives executor loss) and drop its lineage."""
    spark = spark or df.sparkSession
    checkpoint_dir(spark)
    return df.checkpoint(eager=True)


# Settings for large clusters (pass as ``extra`` to get_spark or spark-submit
# --conf): ~256 MB input splits and post-shuffle partitions so a task's data
# fits executor memory, AQE coalescing / skew splitting on, and enough initial
# shuffle partitions that AQE has room to coalesce.
CLUSTER_CONF = {
    "spark.sql.files.maxPartitionBytes": str(256 << 20),
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 << 20),
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 << 20),
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
}
