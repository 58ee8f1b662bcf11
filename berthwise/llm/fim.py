"""Fill-in-middle transformation as a pyarrow.compute pipeline.

A text is a list of units: runs of ASCII letters, every other character alone.  Two hashed cuts of the
document's id part the units into prefix, middle and suffix.  Each Arrow batch is split into list arrays of units,
which are flattened with the index of the text they come from; ordinals tell the role of each unit, units are filtered by
role, lists are rebuilt from the counts, joined, and joined once more with the sentinels.  No Python
code runs for a row or unit.

Defined cases: a null text is empty; an empty text, one that holds a sentinel, and one the hash
spares stay plain; a null ``doc_id`` hashes like an empty one, and rows with equal ids get equal hashes; repeated rows are
transformed each; invalid UTF-8 is repaired before; an empty table gives an empty result; extra
columns are ignored.  Long texts are worked on whole: a slice holds ``SLICE_BYTES`` of text or one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentinels, percentages, unit pattern over UTF-8 bytes (a lead byte takes its continuation bytes along).
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
FIM_PERCENT, SPM_PERCENT = 90, 20
UNIT = rb"[A-Za-z]+|[\xc0-\xff][\x80-\xbf]*|[\x00-\x7f\x80-\xbf]"
_APART = b"\xff"                 # in no UTF-8 text
SLICE_BYTES = 2 << 20
_BYTES, _LIST = pa.large_binary(), pa.large_list(pa.large_binary())


def hashed(doc_id: Column, seed: int = 1) -> list[Column]:
    """The first four 8-digit groups of the SHA-256 of ``seed:doc_id``, as numbers."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("bigint").alias(f"h{i + 1}") for i in range(4)]


def _units(text: pa.Array) -> pa.LargeListArray:
    """Units of each text, behind one empty entry."""
    return pc.split_pattern(pc.replace_substring_regex(text, pattern=UNIT, replacement=_APART + rb"\0"), pattern=_APART)


def _modulo(a: pa.Array, b: pa.Array | int) -> pa.Array:
    return pc.subtract(a, pc.multiply(pc.divide(a, b), b))


def _joined(flat: pa.Array, chosen: pa.Array, count: pa.Array) -> pa.Array:
    """Chosen units, ``count`` for each text, as one string a text."""
    ends = pc.cumulative_sum(count)
    offsets = pa.concat_arrays([pa.array([0], pa.int64()), ends.cast(pa.int64())])
    return pc.binary_join(pa.LargeListArray.from_arrays(offsets, flat.filter(chosen)), pa.scalar(b"", _BYTES))


def _plain(text: pa.Array, h3: pa.Array, fim_percent: int) -> pa.Array:
    plain = pc.or_(pc.equal(pc.binary_length(text), 0), pc.greater_equal(_modulo(h3, 100), fim_percent))
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain = pc.or_(plain, pc.match_substring(text, pattern=mark))
    return plain


def transform(text: pa.Array, h: list[pa.Array], fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> dict[str, pa.Array]:
    """n, form, prefix_chars, middle_chars and output of a batch of texts (large_binary)."""
    units = _units(text)
    n = pc.subtract(pc.list_value_length(units), 1).cast(pa.int64())
    one, two = (_modulo(x, pc.add(n, 1)) for x in h[:2])
    low, high = pc.min_element_wise(one, two), pc.max_element_wise(one, two)
    plain = _plain(text, h[2], fim_percent)

    flat, parent = pc.list_flatten(units), pc.list_parent_indices(units)
    first = units.offsets.slice(0, len(units))
    # The entry before the first unit has ordinal -1 and no role.
    ordinal = pc.subtract(pc.subtract(pa.array(np.arange(len(flat), dtype=np.int64)), first.take(parent)), 1)
    after_low = pc.greater_equal(ordinal, low.take(parent))
    after_high = pc.greater_equal(ordinal, high.take(parent))
    real = pc.greater_equal(ordinal, 0)
    prefix = _joined(flat, pc.and_not(real, after_low), low)
    middle = _joined(flat, pc.and_(real, pc.and_not(after_low, after_high)), pc.subtract(high, low))
    suffix = _joined(flat, pc.and_(real, after_high), pc.subtract(n, high))

    mark = {m: pa.scalar(m, _BYTES) for m in (PREFIX, SUFFIX, MIDDLE, b"")}
    join = lambda *parts: pc.binary_join_element_wise(*parts, mark[b""])
    psm = join(mark[PREFIX], prefix, mark[SUFFIX], suffix, mark[MIDDLE], middle)
    spm = join(mark[SUFFIX], suffix, mark[PREFIX], prefix, mark[MIDDLE], middle)
    swap = pc.less(_modulo(h[3], 100), spm_percent)
    chars = lambda x: pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(x.cast(pa.large_string())).cast(pa.int64()))
    return {"n": n, "form": pc.if_else(plain, "plain", pc.if_else(swap, "spm", "psm")),
            "prefix_chars": chars(prefix), "middle_chars": chars(middle),
            "output": pc.if_else(plain, text, pc.if_else(swap, spm, psm))}


def restore(output: pa.Array, form: pa.Array) -> pa.Array:
    """The texts that outputs came from: pieces between the first sentinels of each kind, in text order."""
    def cut(pattern: str, order: tuple[str, ...]) -> pa.Array:
        found = pc.extract_regex(output, pattern=pattern)
        return pc.binary_join_element_wise(*[found.field(k) for k in order], pa.scalar(b"", _BYTES))
    psm = cut(r"(?s)\A<P>(?P<p>.*?)<S>(?P<s>.*?)<M>(?P<m>.*)\z", ("p", "m", "s"))
    spm = cut(r"(?s)\A<S>(?P<s>.*?)<P>(?P<p>.*?)<M>(?P<m>.*)\z", ("p", "m", "s"))
    return pc.if_else(pc.equal(form, "plain"), output, pc.if_else(pc.equal(form, "spm"), spm, psm))


def _slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of at most ``limit`` bytes in ``column``; a larger row goes alone."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(batch):
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def transformed(docs: DataFrame, seed: int = 1, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every document; ``output`` is UTF-8."""
    text = F.encode(F.make_valid_utf8(F.coalesce(F.col("text").cast("string"), F.lit(""))), "UTF-8").alias("text")
    src = docs.select("doc_id", text, *hashed(F.col("doc_id"), seed))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, "text", SLICE_BYTES):
                made = transform(part.column("text").cast(_BYTES), [part.column(f"h{i}") for i in range(1, 5)], fim_percent, spm_percent)
                made["output"] = made["output"].cast(pa.binary())
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), **made})
    return src.mapInArrow(run, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output binary")


def with_restored(made: DataFrame) -> DataFrame:
    """``transformed`` rows and ``restored``, rebuilt from output and form alone."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in made.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, "output", SLICE_BYTES):
                back = restore(part.column("output").cast(_BYTES), part.column("form").cast(pa.string())).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, back], names=[*part.schema.names, "restored"])
    return made.mapInArrow(run, kinds + ", restored binary")
