"""SRC3: the live feed from a broker-like log, with offsets and commits.

A topic is a folder of append-only Parquet segments, ``partition=<n>/…``, with columns ``offset``, ``timestamp`` and ``value``; offsets of a
partition ascend by one.  ``AisLog`` is a Spark data source over it: the driver asks the segment footers how far each partition
reaches, every micro-batch is a range of offsets per partition cut into tasks, executors read just their ranges as Arrow batches, and
ranges that Spark has committed are noted beside the topic for each consumer group, when the batch after them begins.  After a restart Spark asks again for the ranges in its
checkpoint, so no message is lost or repeated.

A Kafka topic gives the same rows through :func:`read_kafka`.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.window import Window

LOG_SCHEMA = "partition int, offset bigint, timestamp timestamp_ntz, value string"
_ARROW = pa.schema([("partition", pa.int32()), ("offset", pa.int64()), ("timestamp", pa.timestamp("us")), ("value", pa.string())])
ROWS_PER_TASK = 1_000_000


class Range(InputPartition):
    """Messages ``lo`` to ``hi`` (exclusive) of a partition, and the segments that hold them."""

    def __init__(self, partition: int, lo: int, hi: int, files: list[str]):
        self.partition, self.lo, self.hi, self.files = partition, lo, hi, files


class _Topic:
    def __init__(self, options: dict):
        uri = options["path"]
        if uri.startswith("file:"):
            uri = "/" + uri[5:].lstrip("/")
        self.fs, self.root = pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)
        self.rows = int(options.get("rowspertask", options.get("rowsPerTask", ROWS_PER_TASK)))
        self.group = options.get("group")
        self.known: dict[str, tuple[int, int, int]] = {}

    def segments(self) -> dict[str, tuple[int, int, int]]:
        """(partition, first offset, last offset) of every segment, from footers; a segment never changes, so each is asked once."""
        for f in self.fs.get_file_info(pafs.FileSelector(self.root, recursive=True, allow_not_found=True)):
            found = re.search(r"/partition=(\d+)/[^/_.][^/]*\.parquet$", f.path)
            if not found or f.path in self.known:
                continue
            with self.fs.open_input_file(f.path) as handle:
                meta = pq.ParquetFile(handle).metadata
            at = meta.schema.names.index("offset")
            stats = [meta.row_group(i).column(at).statistics for i in range(meta.num_row_groups) if meta.row_group(i).num_rows]
            if stats:
                self.known[f.path] = (int(found[1]), min(s.min for s in stats), max(s.max for s in stats))
        return self.known

    def ends(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for p, _, last in self.segments().values():
            out[str(p)] = max(out.get(str(p), 0), last + 1)
        return out

    def ranges(self, start: dict, end: dict) -> list[Range]:
        held = self.segments()
        out = []
        for p, hi in sorted(end.items(), key=lambda x: int(x[0])):
            lo = int(start.get(p, 0))
            while lo < hi:
                stop = min(hi, lo + self.rows)
                files = [f for f, (q, first, last) in held.items() if q == int(p) and first < stop and last >= lo]
                out.append(Range(int(p), lo, stop, sorted(files)))
                lo = stop
        return out

    def read(self, r: Range) -> Iterator[pa.RecordBatch]:
        data = ds.dataset(r.files, format="parquet", filesystem=self.fs)
        wanted = (ds.field("offset") >= r.lo) & (ds.field("offset") < r.hi)
        for b in data.to_batches(columns=["offset", "timestamp", "value"], filter=wanted):
            if len(b):
                yield pa.RecordBatch.from_arrays([pa.array([r.partition] * len(b), pa.int32()), b.column("offset").cast(pa.int64()),
                                                  b.column("timestamp").cast(pa.timestamp("us")), b.column("value").cast(pa.string())], schema=_ARROW)

    def note(self, end: dict) -> None:
        if self.group:
            folder = f"{self.root}/_committed"
            self.fs.create_dir(folder, recursive=True)
            with self.fs.open_output_stream(f"{folder}/{self.group}.json") as out:
                out.write(json.dumps(end).encode())


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.topic = _Topic(options)

    def partitions(self):
        return self.topic.ranges({}, self.topic.ends())

    def read(self, partition):
        return self.topic.read(partition) if partition else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.topic = _Topic(options)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.topic.ends()

    def partitions(self, start: dict, end: dict):
        return self.topic.ranges(start, end)

    def read(self, partition):
        return self.topic.read(partition)

    def commit(self, end: dict) -> None:
        self.topic.note(end)


class AisLog(DataSource):
    """``spark.read.format("ais_log")`` and ``spark.readStream.format("ais_log")``; options ``path``, ``group``, ``rowsPerTask``."""

    @classmethod
    def name(cls) -> str:
        return "ais_log"

    def schema(self) -> str:
        return LOG_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(dict(self.options))


def append_log(messages: DataFrame, path: str, partitions: int = 4, key: str = "msg_id", ts: str = "received_at", value: str = "value") -> None:
    """Append messages to a topic: dealt by key, in time order, with the offsets that follow those there."""
    ends = _Topic({"path": path}).ends()
    part = F.pmod(F.xxhash64(key), F.lit(partitions)).cast("int")
    base = F.coalesce(*[F.when(F.col("partition") == int(p), F.lit(e)) for p, e in ends.items()], F.lit(0)).cast("bigint")
    nth = F.row_number().over(Window.partitionBy("partition").orderBy(ts, key)) - 1
    rows = messages.withColumn("partition", part).select(
        "partition", (base + nth).alias("offset"), F.col(ts).cast("timestamp_ntz").alias("timestamp"), F.col(value).cast("string").alias("value"))
    rows.repartition("partition").sortWithinPartitions("partition", "offset").write.mode("append").partitionBy("partition").parquet(path)


def as_messages(log: DataFrame) -> DataFrame:
    """Rows of a log or topic -> (msg_id, received_at, value).  The id is the message's place: partition and offset."""
    place = F.shiftleft(F.col("partition").cast("bigint"), 48).bitwiseOR(F.col("offset").cast("bigint"))
    return log.select(place.alias("msg_id"), F.col("timestamp").cast("timestamp_ntz").alias("received_at"), F.col("value").cast("string").alias("value"))


def read_log(spark: SparkSession, path: str, stream: bool = True, **options) -> DataFrame:
    """The messages of a topic, as a stream or as far as it reaches now."""
    spark.dataSource.register(AisLog)
    r = (spark.readStream if stream else spark.read).format("ais_log").option("path", path)
    for k, v in options.items():
        r = r.option(k, v)
    return as_messages(r.load())


def read_kafka(spark: SparkSession, servers: str, topic: str, **options) -> DataFrame:
    """The same from Kafka, whose source has a schema of its own (needs the connector on the class path)."""
    r = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    for k, v in options.items():
        r = r.option(k, v)
    return as_messages(r.load())
