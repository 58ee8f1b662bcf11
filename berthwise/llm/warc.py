"""WARC records in seekable Zstandard bundles.

Each row becomes a WARC/1.1 record: a ``response`` with its payload, or a ``revisit`` of the response
that holds an equal payload.  Records are grouped into frames that decompress on their own,
frames into bundles; a bundle ends with the seek table of the Zstandard seekable format (a
skippable frame that lists the compressed and plain size of each frame), so any
Zstandard reader reads it whole and a seeking one jumps to a frame.  The index maps each record
identifier to bundle, frame and offset in the frame.

Bundles are written by Spark as rows (bundle_id, data, index), so they go to any store
Spark writes to, and a lost task's bundles are replaced by its retry's.

Defined cases: a null payload is empty; of equal payloads the largest page_id answers, null ids
come last, and of rows with one page_id and payload the first by url answers; rows of payloads smaller
than ``revisit_from`` bytes all answer; an empty table gives no bundles; extra columns are
ignored; a record larger than a frame has its own frame.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from berthwise.llm.common import saved

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 16 << 20
# Fixed values of the seekable format: skippable frame, footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
_DATE = "1970-01-01T00:00:00Z"
BUNDLES = ("bundle_id string, data binary, index array<struct<record_id:string,page_id:bigint,frame:int,offset:bigint,length:bigint>>")


def decided(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """page_id, url, payload, sha1 (hex), record_id, refers_to (a record_id, null for responses).

    The answering page of a payload is found on the small columns; pages join it on
    their digest, both sides plain exchanges, so a hot payload can be split."""
    p = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                     F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("sha1", F.sha1("payload")).withColumn("_n", F.octet_length("payload"))
    # Equal payloads: equal SHA-1, SHA-256 and length.
    p = p.withColumn("_same", F.concat_ws("-", "sha1", F.sha2("payload", 256), F.col("_n").cast("string")))
    groups = (p.groupBy("_same", "page_id").agg(F.count("*").alias("_c")).groupBy("_same")
              .agg(F.max("page_id").alias("_answer"), F.sum("_c").alias("_group"), F.max("_c").alias("_rows")))
    groups = saved(groups.where("_group > 1"), "payload-groups")
    name = lambda page, n: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(":"),
                                    F.col("sha1"), F.lit(":"), n.cast("string"), F.lit(">"))
    # Only payloads with a repeated page_id (rows repeated as such) are numbered by a window.
    nth = F.row_number().over(Window.partitionBy("_same", "page_id").orderBy(F.col("url").asc_nulls_last()))
    j = p.join(groups.where("_rows = 1"), "_same", "left").withColumn("_nth", F.lit(1))
    again = groups.where("_rows > 1")
    j = j.join(again.select("_same"), "_same", "left_anti").unionByName(p.join(again, "_same").withColumn("_nth", nth))
    alone = F.col("_group").isNull() | (F.col("_n") < revisit_from)
    answers = alone | (F.col("page_id").eqNullSafe(F.col("_answer")) & (F.col("_nth") == 1))
    return j.select("page_id", "url", "payload", "sha1", name(F.col("page_id"), F.col("_nth")).alias("record_id"),
                    F.when(~answers, name(F.col("_answer"), F.lit(1))).alias("refers_to"))


def record(page_id, url: str | None, payload: bytes, sha1: str, record_id: str, refers_to: str | None) -> bytes:
    digest = "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: {digest}"]
    if refers_to:
        head += [f"WARC-Refers-To: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", c, p) for c, p in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def frames_of(bundle: bytes) -> list[tuple[int, int]]:
    """(start, compressed size) of each frame, from the seek table at the end."""
    count, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE:
        raise ValueError("not a seekable bundle")
    each = 12 if flags & 0x80 else 8
    at = len(bundle) - 9 - count * each
    out, start = [], 0
    for i in range(count):
        size = struct.unpack_from("<I", bundle, at + i * each)[0]
        out.append((start, size))
        start += size
    return out


class _Writer:
    def __init__(self, task: int, frame_bytes: int, bundle_bytes: int, level: int):
        self.task, self.frame_bytes, self.bundle_bytes = task, frame_bytes, bundle_bytes
        self.zip = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.made = 0
        self._begin()

    def _begin(self) -> None:
        self.data, self.sizes, self.index = [], [], []
        self.frame, self.plain, self.packed = [], 0, 0

    def _end_frame(self) -> None:
        if self.frame:
            raw = b"".join(self.frame)
            c = self.zip.compress(raw)
            self.data.append(c)
            self.sizes.append((len(c), len(raw)))
            self.packed += len(c)
            self.frame, self.plain = [], 0

    def add(self, page_id, record_id: str, raw: bytes) -> tuple | None:
        if self.plain and self.plain + len(raw) > self.frame_bytes:
            self._end_frame()
        self.index.append((record_id, page_id, len(self.sizes), self.plain, len(raw)))
        self.frame.append(raw)
        self.plain += len(raw)
        return self.end() if self.packed >= self.bundle_bytes else None

    def end(self) -> tuple | None:
        self._end_frame()
        if not self.sizes:
            return None
        row = (f"{self.task:08d}-{self.made:06d}", b"".join(self.data) + seek_table(self.sizes),
               [dict(zip(("record_id", "page_id", "frame", "offset", "length"), x)) for x in self.index])
        self.made += 1
        self._begin()
        return row


def bundled(records: DataFrame, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = 3) -> DataFrame:
    """Bundles of ``decided`` records: (bundle_id, data, index).  Write them before use: their
    names are those of the tasks that make them."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = _Writer(TaskContext.get().partitionId(), frame_bytes, bundle_bytes, level)
        frame = lambda row: pd.DataFrame([row], columns=["bundle_id", "data", "index"])
        for pdf in batches:
            for page, url, payload, sha1, rid, ref in pdf.itertuples(index=False):
                page = None if page is None else int(page)
                row = w.add(page, rid, record(page, url, payload, sha1, rid, ref))
                if row:
                    yield frame(row)
        row = w.end()
        if row:
            yield frame(row)
    src = records.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", "sha1", "record_id", "refers_to")
    return src.mapInPandas(run, BUNDLES)


def index_of(bundles: DataFrame) -> DataFrame:
    return bundles.select("bundle_id", F.explode("index").alias("x")).select("bundle_id", "x.*")


def _parse(raw: bytes) -> tuple:
    head, _, rest = raw.partition(b"\r\n\r\n")
    h = dict(x.split(": ", 1) for x in head.decode("utf-8").split("\r\n")[1:])
    block = rest[:int(h["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    return (h["WARC-Record-ID"], h.get("WARC-Target-URI"), h["WARC-Type"], h["WARC-Payload-Digest"][5:], size,
            h.get("WARC-Refers-To"), payload if h["WARC-Type"] == "response" else None)


RECORDS = ("record_id string, url string, record_type string, payload_digest string, payload_bytes bigint, refers_to string, payload binary")


def read(bundles: DataFrame, wanted: DataFrame | None = None, with_payload: bool = True) -> DataFrame:
    """Records of the bundles, or of the ``wanted`` record_ids only: then just the frames
    that hold them are decompressed."""
    src = bundles.select("bundle_id", "data", "index")
    if wanted is not None:
        at = index_of(bundles).join(wanted.select("record_id").distinct(), "record_id", "left_semi")
        at = at.groupBy("bundle_id").agg(F.collect_list(F.struct("record_id", "page_id", "frame", "offset", "length")).alias("index"))
        src = bundles.select("bundle_id", "data").join(at, "bundle_id").select("bundle_id", "data", "index")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unzip = zstandard.ZstdDecompressor()
        names = [c.split()[0] for c in RECORDS.split(", ")]
        for pdf in batches:
            for data, index in zip(pdf["data"], pdf["index"]):
                frames = frames_of(data)
                by_frame: dict[int, list] = {}
                for x in index:
                    by_frame.setdefault(x["frame"], []).append(x)
                for k in sorted(by_frame):
                    start, size = frames[k]
                    plain = unzip.decompress(data[start:start + size])
                    rows = [_parse(plain[x["offset"]:x["offset"] + x["length"]]) for x in by_frame[k]]
                    if not with_payload:
                        rows = [(*r[:4], r[4] if r[6] is None else len(r[6]), r[5], None) for r in rows]
                    yield pd.DataFrame(rows, columns=names)
    # A bundle is large: few to an Arrow batch come from the tables' row groups.
    return src.mapInPandas(run, RECORDS)


def archived(pages: DataFrame, revisit_from: int = 0, **sizes) -> DataFrame:
    """Write every page and return the table of bundles."""
    return saved(bundled(decided(pages, revisit_from), **sizes), "warc")


def page_of(record_id):
    """The page_id in a record identifier; null for pages without one."""
    return F.regexp_extract(record_id, r"^<urn:page:(-?\d+|null):", 1).try_cast("bigint")
